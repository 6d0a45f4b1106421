"""A training corpus from documents: quality, repeated lines, near duplicates, benchmark
leaks, packing. Each stage works on all that its predecessor kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from featurekit.llm import decontaminate, jaccard, line_dedup, packing, quality
from featurekit.llm.queries import tokenizer_file
from featurekit.llm.tables import recorded, release, release_folders, written

#: Folders of the tables that earlier stages have written for themselves.
_folders: list[str] = []


def stage(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Tables of earlier stages go when the next one begins, as its documents are written by then;
    those that they still read stay."""

    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_folders(spark, _folders, docs)
        with recorded(_folders):
            return step(spark, docs, sf_dir)

    return run_step


@stage
def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like any
    other; repeated rows are judged alike; without labels or documents nothing fails (see
    ``quality.accepted``). Other columns, whatever their names, pass through, here and below."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, and documents of which nothing is left. Null and empty
    texts stay as they are; an empty table gives an empty one."""
    return line_dedup.drop_repeated_lines(docs, exact_chars=line_dedup.EXACT_CHARS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest doc_id. Rows
    without doc_id and null or empty texts stay; an empty table gives an empty one."""
    return jaccard.without_near_duplicates(docs)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts, and null or empty items, hold
    or are none; an empty table, or an empty benchmark, changes nothing."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 2048. Null texts are
    empty (an end alone); longer ones are cut; repeated rows are packed each; no rows, no pieces."""
    cut = packing.pieces(docs, tokenizer_file("word_bpe_49k.json"))
    return packing.pack(cut.drop("ids"))


STAGES = [
    ("quality classifier", accept),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("best-fit packing", pack),
]

#: A trained model and classes of near copies have no SQL; tests compare the stages with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder."""
    docs, older = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES[:-1]:
        kept = written(step(spark, docs, sf_dir))
        if older is not None:
            release(older)
        docs = older = kept
    return STAGES[-1][1](spark, docs, sf_dir)
