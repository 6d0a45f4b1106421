"""Licence notices by diagonal voting.

All rolling word k-grams of all documents are joined, by hash, to their positions in a small
table of templates. A hit votes for its diagonal (position in the document less position
in the template). Neighbouring diagonals, which words put in or left out cause, are merged,
and a merged span is kept if it covers enough of its template. Phrases (exact word
sequences) come from the same votes: all k-grams on one diagonal. Everything is DataFrame
functions; no Python runs on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featurekit.llm.tables import let

# Phrases that name a licence, and opening words of notices.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)

K = 2  # the shortest phrase
#: Diagonals so close are one span.
BAND = 3
LEAST_SHARE = 0.7

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of anything but ASCII characters that are no letters or digits, with A-Z
    lower-cased. ``lower`` may be used, as other characters' case changes no ASCII word,
    except for two characters whose lower case is an ASCII letter."""
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("K") | text.contains("İ")
    plain = F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.array_remove(F.split(plain, _NO_WORD), "")


def _k_grams(words: Column, k: int) -> Column:
    def grams(words: Column) -> Column:
        last = F.size(words) - k
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    return let(words, grams)


def template_table(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """(hash, template, label, phrase, n_grams, template_pos), a row per k-gram."""
    rows = [(i, label, text, i < len(phrases)) for i, (label, text) in enumerate([*phrases, *notices])]
    for _, _, text, _ in rows:
        if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)) < k:
            raise ValueError(f"shorter than {k} words: {text}")
    df = spark.createDataFrame(rows, "template int, label string, text string, phrase boolean")
    grams = df.withColumn("grams", _k_grams(words_of(F.col("text")), k))
    return grams.select("template", "label", "phrase", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("template_pos", "hash"))


def license_spans(docs: DataFrame, templates: DataFrame, k: int = K, band: int = BAND, least_share: float = LEAST_SHARE) -> DataFrame:
    """(key, label, phrase, start, end, share): spans of words, end exclusive, that match a
    template; for phrases the exact places (share 1).

    docs: (key, text); rows of equal key must have equal texts, and count once. templates:
    as :func:`template_table` gives them, small enough to broadcast (they are a list in the
    code). Null and empty texts have no spans. Votes are grouped per document and template, so
    a word pair that all documents share is spread like the documents.
    """
    grams = docs.select("key", F.posexplode(_k_grams(words_of(F.col("text")), k)).alias("pos", "hash"))
    hits = grams.join(F.broadcast(templates), "hash")
    votes = hits.groupBy("key", "template", "label", "phrase", "n_grams", (F.col("pos") - F.col("template_pos")).alias("diagonal")).agg(
        F.collect_set("template_pos").alias("seen"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
    )
    exact = votes.where(F.col("phrase") & (F.size("seen") == F.col("n_grams"))).select(
        "key", "label", "phrase", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("n_grams") + k - 1).alias("end"), F.lit(1.0).alias("share")
    )
    ordered = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(ordered) > band
    spans = votes.where(~F.col("phrase")).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    spans = spans.withColumn("_span", F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("key", "template", "label", "phrase", "n_grams", "_span").agg(
        F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("first").alias("start"), (F.max("last") + k).alias("end")
    )
    share = F.size("seen") / F.col("n_grams")
    # A span much longer than its template only gathers stray hits.
    verified = merged.where((share >= least_share) & (F.col("end") - F.col("start") <= F.col("n_grams") + k - 1 + 2 * band))
    return exact.unionByName(verified.select("key", "label", "phrase", "start", "end", share.alias("share")))


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row
    per row of docs.

    n_base counts the places of phrases, first_word and last_word are their smallest and
    largest start (null without any); labels also has those of notices; both lists are
    distinct, sorted and joined by commas (empty without any). score: the largest share of a
    template that a span covers, 0 without spans. Null texts are empty. Rows with the same
    doc_id (or none) and text get the same result; very long texts are scanned whole.
    """
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = whole.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = license_spans(keyed.select("key", "text"), template_table(docs.sparkSession))

    def named(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    base = F.when(F.col("phrase"), F.col("start"))
    found = spans.groupBy("key").agg(
        F.count_distinct(F.when(F.col("phrase"), F.struct("label", "start"))).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        named(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        named(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    counted = keyed.select("doc_id", "key", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return counted.join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
