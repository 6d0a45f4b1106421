"""Line dedup, Jaccard join, decontamination, quality and licence scan, by brute force and on
nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featurekit.llm import decontaminate, jaccard, license_scan, line_dedup, links, quality
from featurekit.llm.words import words

SCHEMA = "doc_id long, text string, lang string, n_words int, score double, key string, id long"


def frame(spark, rows):
    """Documents with further columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, 0.5, "k", 9) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- words -----------------------------------------------------------------------------------


def test_words_are_what_splitting_gives():
    texts = ["A b\tc", None, "", "  ", "ab  AB é\x0bx\x1cy", "é" * 5, "x " * 400_000]
    hashed, first = words(pa.array(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(first).tolist() == [len(s) for s in split]
    flat = [w for s in split for w in s]
    assert len({(w, h) for w, h in zip(flat, hashed.tolist(), strict=True)}) == len(set(flat)) == len(set(hashed.tolist()))


# --- classes ---------------------------------------------------------------------------------


def test_components_and_buckets_lose_no_link(spark):
    rng = random.Random(4)
    values = {i: rng.randrange(400) for i in range(120)}
    true = {(a, b) for a in values for b in values if a < b and abs(values[a] - values[b]) <= 2}
    # Buckets overlap, some are large and hold many that are not alike.
    buckets = [(v // w, i) for i, v in values.items() for w in (1, 40)] + [(1000 + (v + s) // 8, i) for i, v in values.items() for s in (0, 4)]
    df = spark.createDataFrame(buckets, "key long, id long")
    table = spark.createDataFrame(sorted(true), "a long, b long")
    asked = []

    def alike(pairs):
        asked.append(pairs.count())
        return pairs.join(table, ["a", "b"])

    met = {(a, b) for a, b in true if {k for k, i in buckets if i == a} & {k for k, i in buckets if i == b}}
    want = roots(120, met)
    got = dict(map(tuple, links.connect(links.shared_buckets(df), alike).collect()))
    assert {i: got.get(i, i) for i in values} == dict(enumerate(want))
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- Jaccard join ------------------------------------------------------------------------------


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for _ in range(n):
        kind = rng.randrange(5)
        if kind < 3 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            w = w[: len(w) - rng.choice([0, 0, 1, 5])] or ["x"]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 8, 30, 120, 300]))]
            if kind == 4:
                w[len(w) // 2 : len(w) // 2] = passage
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("k", "similarity"), [(4, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_duplicates_equal_brute_force(spark, k, similarity):
    texts = near_copies(random.Random(k), 400)
    sets = [shingle_set(t, k) for t in texts]
    pairs = [
        (a, b)
        for a in range(len(sets))
        for b in range(a)
        if sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    ]
    got = jaccard.near_duplicates(frame(spark, enumerate(texts)).repartition(5), k, similarity)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(
        ((i, len(s), c) for (i, s), c in zip(enumerate(sets), roots(len(sets), pairs), strict=True)), key=str
    )


def test_near_duplicates_on_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    docs = frame(spark, [(3, "a B c d"), (2, "A b c D"), (2, "A b c D"), (5, None), (6, ""), (7, " \n"), (None, "a b c d"), (9, long), (8, long + " x")])
    got = rows(jaccard.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    assert got == [(2, 1, 2), (3, 1, 2), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 59997, 8), (9, 59996, 8)]
    assert jaccard.near_duplicates(empty(spark)).count() == 0
    kept = jaccard.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 2, 5, 6, 7, 8]


# --- lines -----------------------------------------------------------------------------------


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        if kind == 0:
            text.insert(at, rng.choice("abcé"))
        elif at < len(text):
            text[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(text)


def test_edit_distance_equals_the_full_one(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abcé") for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 40, 70, 130])))
        pairs.append((a, edited(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(pairs, "a string, b string")
    for most in (0, 1, 2, 3):
        found = line_dedup.within_edits(F.col("a"), F.col("b"), most)
        assert df.where(found != (F.levenshtein("a", "b") <= most)).count() == 0


def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.choice([20, 21, 25, 60]))) for _ in range(25)]
    docs = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 5])) for _ in range(rng.randrange(5)))) for i in range(80)]
    places = [((i, n), line) for i, t in docs for n, line in enumerate(t.split("\n")) if len(line) >= 20]
    df = spark.createDataFrame([(k, line) for k, (_, line) in enumerate(places)], "k int, line string")
    other = df.select(F.col("k").alias("j"), F.col("line").alias("other"))
    near = [tuple(r) for r in df.join(other, (F.col("k") < F.col("j")) & (F.levenshtein("line", "other") <= 2)).select("k", "j").collect()]
    classes = defaultdict(list)
    for (place, _), c in zip(places, roots(len(places), near), strict=True):
        classes[c].append(place)
    want = sorted(((*p, *min(c)) for c in classes.values() if len(c) > 1 for p in c), key=str)
    got = line_dedup.repeated_lines(frame(spark, docs).repartition(4))
    assert rows(got, "doc_id", "line_no", "first_doc_id", "first_line_no") == want


def test_lines_on_odd_rows(spark):
    line = "a line that is long enough"
    docs = frame(
        spark,
        [(1, f"{line}\nshort\n{line}!"), (2, f"{line}?\nshort"), (3, line), (4, None), (5, ""), (None, line), (3, line), (6, "x" * 200_000)],
    )
    got = rows(line_dedup.drop_repeated_lines(docs), "doc_id", "text")
    want = [(1, f"{line}\nshort"), (2, "short"), (4, None), (5, ""), (6, "x" * 200_000), (None, line)]
    assert got == sorted(want, key=str)
    assert line_dedup.drop_repeated_lines(docs).columns == docs.columns
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0


def test_short_lines_are_repeats_if_equal(spark, tmp_path):
    from corpus_pipeline import drop_lines
    from featurekit.llm.queries import queries

    texts = [(1, "Read more\nown one\n}\n \n7"), (2, "Read more\nRead mora\n}\n \n7"), (3, "own three\nRead more"), (4, "Read more")]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, 0, 1, 0), (1, 4, 1, 4), (2, 0, 1, 0), (2, 4, 1, 4), (3, 1, 1, 0), (4, 0, 1, 0)]
    got = queries()["op3_line_dedup"](spark, str(tmp_path))
    assert rows(got, "doc_id", "line_no", "first_doc_id", "first_line_no") == want
    kept = drop_lines(spark, frame(spark, texts), str(tmp_path))
    assert rows(kept, "doc_id", "text") == [(1, texts[0][1]), (2, "Read mora\n}\n "), (3, "own three")]


# --- benchmark items ----------------------------------------------------------------------------


def item_words(rng, n):
    return " ".join(rng.choice(["quick", "brown", "over", "lazy", "river", "stone", "bread", "house", "green", "small"]) + rng.choice("abc") for _ in range(n))


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(11)
    items = [(i, item_words(rng, rng.choice([10, 16, 40]))) for i in range(20)]
    items.append((20, "A train leaves Boston at 60 km per hour and another at 60 km from Paris with 12 coaches"))
    items.append((21, "tiny item here"))
    docs, planted = [], set()
    for d in range(120):
        text = item_words(rng, 80)
        if d % 3 == 0:
            i = rng.randrange(20)
            text = f"{text} {items[i][1]} {item_words(rng, 30)}"
            planted.add((d, i))
        docs.append((d, text))
    docs.append((500, "So it was. A train leaves Denver at 45 miles per hour and another at 45 miles from Rome with 8 coaches. Then"))
    docs.append((501, "A train leaves Denver at 45 miles per hour and another at 70 miles from Rome with 8 coaches"))
    docs.append((502, "so the tiny item here is whole"))
    found = decontaminate.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    pairs = {(r["doc_id"], r["item_id"]): r for r in found.collect()}
    assert set(pairs) == planted | {(500, 20), (502, 21)}
    assert pairs[500, 20]["changed"] > 0
    assert all(pairs[p]["changed"] == 0 for p in planted)


def test_leaks_on_odd_rows(spark):
    text = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "z " * 300_000 + text)])
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    assert rows(decontaminate.leaks(docs, items), "doc_id", "item_id", "n_matched") == [(1, 1, 10), (4, 1, 10)]
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 2, 3]


def leaks_of(spark, item, docs):
    found = decontaminate.leaks(frame(spark, enumerate(docs)), spark.createDataFrame([(1, item)], "item_id long, text string"))
    return {r["doc_id"]: (r["n_matched"], r["changed"]) for r in found.collect()}


def test_leaks_with_inconsistent_slots(spark):
    words = item_words(random.Random(5), 60).split()
    words[10], words[40] = "2", "2"
    leak, other = list(words), list(words)
    leak[40] = "3"
    other[10], other[40] = "3", "5"
    again = "the first box holds 3 red stones and the second box holds 5 blue stones in all"
    same = "the first box holds 4 red stones and the second box holds 4 blue stones in all"
    assert leaks_of(spark, " ".join(words), [" ".join(leak), " ".join(other)]) == {0: (59, 1), 1: (58, 2)}
    assert leaks_of(spark, again, [same]) == {0: (17, 2)}


def test_leaks_of_items_that_are_mostly_placeholders(spark):
    sums = "Compute 12 + 34 + 56 + 78 + 90 + 11 + 13 + 15 + 17"
    capitals = "Paris London Rome Berlin Madrid Vienna Oslo Lisbon Prague"
    assert set(leaks_of(spark, sums, [f"so {sums} now", "Compute 1 + 2 + 3 + 4 + 5 + 6 + 7 + 8 + 9"])) == {0}
    assert set(leaks_of(spark, capitals, [f"we saw {capitals} then", "Paris Rome"])) == {0}


def test_leaks_after_quotes_and_in_another_case(spark):
    short, long = "What is the capital of France?", "What is the long name of the river that runs through Paris and Rouen"
    docs = ['he asked, "{}" of us', 'the stop." {} and so on', "(see {})"]
    for item in (short, long):
        texts = [d.format(x) for d in docs for x in (item, item.lower(), item.upper())]
        assert set(leaks_of(spark, item, [*texts, "nothing of it here"])) == set(range(9))


# --- quality ---------------------------------------------------------------------------------


def test_quality_is_learnt_and_holds_on_unseen_texts(spark):
    rng = random.Random(2)

    def text(good):
        w = [rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice("xyz") for _ in range(rng.choice([20, 60]))]
        return " ".join(w if good else [x.upper() + "!!" for x in w])

    labels = [(i, int(rng.random() < 0.8)) for i in range(600)]
    docs = frame(spark, [(i, text(q)) for i, q in labels])
    got = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    want, held = dict(labels), [r for r in got if r["held_out"]]
    assert len(held) > 50
    assert np.mean([r["predicted"] == want[r["doc_id"]] for r in held]) > 0.97


def test_quality_on_odd_rows(spark):
    docs = frame(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a b"), (4, "long " * 200_000)])
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (2, 1), (None, 1), (3, None), (77, 0)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    assert {r["score"] for r in quality.judge(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.judge(empty(spark), labels).count() == 0
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns


def test_update_equals_the_formula():
    model = quality.Ftrl(4)
    rng = np.random.default_rng(1)
    z, n = np.zeros(4), np.zeros(4)
    for _ in range(50):
        at, x, y = rng.choice(4, 2, replace=False), rng.random(2), int(rng.random() < 0.5)
        w = [0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2) for i in at]
        p = 1 / (1 + np.exp(-(w[0] * x[0] + w[1] * x[1])))
        for i, wi, xi in zip(at, w, x, strict=True):
            g = (p - y) * xi
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
            z[i] += g - s * wi
            n[i] += g * g
        model.update(at, x, y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


# --- licences --------------------------------------------------------------------------------


def brute_license(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = Counter()
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        places.update((label, i) for i in range(len(w)) if w[i : i + len(p)] == p)
    starts = sorted(i for _, i in places)
    return len(w), len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for x, _ in places}))


def test_base_places_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["MIT", "License", "cc", "BY", "gnu", "general", "Public", "apache", "é", "a-b", "x9", "Kİ", "mit license", "\n"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 40, 200]))) for _ in range(300)]
    got = license_scan.scan_licenses(frame(spark, enumerate(texts)))
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows(got, *names) == sorted(((i, *brute_license(t)) for i, t in enumerate(texts)), key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got.collect())


def test_notices_and_odd_rows(spark):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    broken = notice.replace("hereby ", "").replace("copy", "fine copy")
    docs = frame(
        spark,
        [(1, f"x y {notice}."), (2, broken), (3, None), (4, ""), (None, "The MIT License"), (5, "permission is granted"),
         (6, "word " * 100_000 + "Licensed under CC BY-NC 4.0."), (7, "the mit license"), (7, "the mit license")],
    )
    got = rows(license_scan.scan_licenses(docs), "doc_id", "n_words", "n_base", "base_labels", "labels")
    want = [
        (1, 18, 0, "", "mit"), (2, 16, 0, "", "mit"), (3, 0, 0, "", ""), (4, 0, 0, "", ""), (None, 3, 1, "mit", "mit"), (5, 3, 0, "", ""),
        (6, 100_007, 1, "cc-by", "cc-by,cc-by-nc"), (7, 3, 1, "mit", "mit"), (7, 3, 1, "mit", "mit"),
    ]
    assert got == sorted(want, key=str)
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_sketches_bound_the_difference(spark):
    """Of sets of any sizes whose sketches have the same width or the double."""
    rng = np.random.default_rng(5)
    rows, differ = [], []
    for n in (1, 10, 80, 140, 150, 600, 700, 5000):
        for swaps in (0, 1, n // 20, n // 8):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.r_[a[swaps:], rng.integers(0, 1 << 63, swaps * 2, dtype=np.uint64)])
            sketches = [jaccard.sketch_of(s, Fraction(4, 5)).tolist() for s in (a, b)]
            rows.append((len(rows), *sketches))
            differ.append(len(np.setxor1d(a, b)))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    got = [r.d for r in df.select("i", jaccard.sketches_differ(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert all(d <= true for d, true in zip(got, differ, strict=True)) and len({len(r[1]) for r in rows}) > 2
    assert got[-1] > differ[-1] / 2  # wide enough to tell


def test_tables_are_released_unless_read(spark):
    from featurekit.llm import tables

    folders = []
    with tables.recorded(folders):
        a = tables.written(spark.range(3))
        b = tables.written(spark.range(4))
    c = tables.written(spark.range(5))
    assert folders == [a._folder, b._folder]
    tables.release_folders(spark, folders, b.where("id > 0"))
    assert folders == [b._folder] and b.count() == 4 and c.count() == 5
    tables.release(b, c)
    assert not (Path(b._folder).exists() or Path(c._folder).exists())
