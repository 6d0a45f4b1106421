"""Periodic runs, whitening and fingerprints by brute force, and on nulls, empty and long texts,
ties, repeated rows, empty tables and columns with names the operators use themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from featurekit.llm import fingerprints, periodic_runs, whitening

SCHEMA = "doc_id long, text string, runs string, number long, range int, row string, next string, fingerprint int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", 7, 8, "w", "n", 9) for i, t in rows], SCHEMA)


# --- periodic runs ---------------------------------------------------------------------------


def runs_by_hand(words, least):
    """All maximal stretches of equal words q apart, of every q; the smallest q of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            if i > start and size >= max(least, 2 * q):
                found.setdefault((start, size), q)
            i += 1
    return sorted((start, size, q) for (start, size), q in found.items())


def some_words(rng):
    n = rng.choice([0, 1, 11, 12, 13, 40, 200, 400])
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(n)]
    if n > 30 and rng.random() < 0.6:
        a, p = rng.randrange(n), 1 + rng.randrange(70)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_cover_meets_from_any_two_places():
    assert (periodic_runs._MEETING >= 0).all()
    places = {(i + s) % periodic_runs.MODULUS for i in range(3) for s in periodic_runs.COVER}
    assert len(periodic_runs.COVER) < periodic_runs.MODULUS // 5 and places


@pytest.mark.parametrize("pairs", [7, 1 << 21])
@pytest.mark.parametrize("least", [1, 12])
def test_runs_equal_brute_force(monkeypatch, least, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(least)
    for _ in range(40):
        docs = [some_words(rng) for _ in range(rng.randrange(1, 6))]
        docs += [docs[0]] * rng.randrange(3)
        numbers = np.array([w for d in docs for w in d], np.int64)
        found = periodic_runs.runs_of(numbers, np.array([len(d) for d in docs]), least)
        got = [[] for _ in docs]
        for doc, *run in zip(*(x.tolist() for x in found), strict=True):
            got[doc].append(tuple(run))
        assert got == [runs_by_hand(d, least) for d in docs]


def test_extensions_equal_brute_force():
    rng = np.random.default_rng(3)
    words = np.tile(rng.integers(0, 4, 90), 9)
    words[rng.integers(0, len(words), 6)] = 9
    symbols = np.concatenate([[20], words, [21], words, [22]])
    document = np.repeat([0, 1], [len(words) + 1, len(words) + 2])
    lce = periodic_runs.Extensions(symbols, document)
    i, j = rng.integers(1, len(words), (2, 3000))
    i, j = i[i != j], j[i != j]

    def common(a, b):
        n = 0
        while symbols[a + n] == symbols[b + n]:
            n += 1
        return n

    assert lce.of(i, j).tolist() == [common(a, b) for a, b in zip(i, j, strict=True)]


def test_runs_of_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{w}" for w in some_words(rng)) for _ in range(60)]
    texts += [None, "", " \t\n", "A a " * 9, "é\x0bé\r" * 8, "x " * 50_000, texts[0], texts[0]]
    rows = [*enumerate(texts), (None, "q " * 20), (5, "again " * 12)]
    got = periodic_runs.find_runs(frame(spark, rows).repartition(3)).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        found = runs_by_hand(words, 12) if len(words) < 10_000 else [(0, len(words), 1)]
        dropped = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((str(i), len(words), found, b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == sorted(want)
    assert periodic_runs.run_report(frame(spark, [])).count() == 0


def test_run_report_of_repeated_tails(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 1, 30, 150])))) for i in range(200)]
    rows += [(10**12, None), (-7, "one"), (None, "a b " * 10)]
    report = periodic_runs.run_report(periodic_runs.repeated_tails(frame(spark, rows))).collect()
    got = {r.doc_id: tuple(r)[1:] for r in report}
    assert len(report) == len(rows)
    changed = 0
    for i, t in rows:
        words = (t or "").split()
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
            changed += 1
        found = runs_by_hand(words, 12)
        dropped = {k for s, m, q in found for k in range(s + q, s + m)}
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        s, m, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
        assert got[i] == (len(found), s, m, q, 1000 * m // q if found else None, *digests)
    assert changed > 5


# --- whitening -------------------------------------------------------------------------------


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for t in range(600):
        d = rng.integers(1, 16)
        x = rng.standard_normal((rng.integers(0, 2 * d + 1), d)) * 10.0 ** rng.integers(-6, 6, d)
        scatter = x.T @ x
        if t % 5 == 0:  # equal eigenvalues
            scatter = np.diag(rng.integers(0, 3, d).astype(float))
        v = rng.standard_normal(d) * 10.0 ** rng.integers(-8, 3)
        if t % 7 == 0:
            v[rng.random(d) < 0.5] = 0
        values, basis = whitening.rank_one(*np.linalg.eigh(scatter), v)
        after = scatter + np.outer(v, v)
        size = np.abs(after).max() or 1
        assert np.abs(basis @ np.diag(values) @ basis.T - after).max() <= 1e-12 * size
        assert np.abs(basis.T @ basis - np.eye(d)).max() <= 1e-12
        assert (np.diff(values) >= 0).all()


def test_spectra_merge_to_the_whole():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) * 64).astype(np.int64) + 1_000_000
    whole = whitening.Spectrum(12)
    for part in np.split(x, [100, 101, 101, 420]):
        one = whitening.Spectrum(12)
        one.add(part[:60])
        one.add(part[60:])
        whole.merge(one.n, one.sums, one.values, one.basis)
    centred = x - x.mean(axis=0)
    assert whole.n == 700 and whole.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(whole.basis @ np.diag(whole.values) @ whole.basis.T, centred.T @ centred, rtol=1e-11, atol=1e-6)


def vectors(spark, x, parts=5):
    rows = [(i, v, 1, "s") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, vector array<long>, n int, part string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 40])
def test_whiten_against_numpy(spark, parts):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((900, 10)) * np.arange(1, 11) * 20).astype(np.int64) + 1_000_000
    odd = [None, [], [1, None], [5] * 9, [None] * 10]
    found = whitening.whiten(vectors(spark, [*x.tolist(), *odd], parts), 7).toPandas().sort_values(["vec_id", "component"])
    n, sums = len(x), x.sum(axis=0)
    centred = (x * n - sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    want = centred @ basis[:, :7] / np.sqrt(values[:7])
    got = found["whitened"].to_numpy().reshape(n, 7)
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    assert np.allclose(got, want * np.sign((got * want).sum(axis=0)), atol=1e-9)
    assert np.allclose(found["explained"].to_numpy().reshape(n, 7), (values / values.sum())[:7], rtol=1e-10)
    assert found["deviation"].tolist() == np.repeat(((x * n - sums) ** 2).sum(axis=1), 7).tolist()
    assert (found["n"] == n).all() and found["identity_error"].iloc[0] < 1e-10
    assert found["component"].tolist() == list(range(1, 8)) * n


def test_whiten_without_variance_and_empty(spark):
    flat = whitening.whiten(vectors(spark, [[3, 4]] * 4)).collect()
    assert len(flat) == 8 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat} == {(4, 0, None, None, None)}
    line = whitening.whiten(vectors(spark, [[3, 4], [5, 4], [7, 4]])).toPandas()
    assert line[line["component"] == 2]["whitened"].isna().all() and line["identity_error"].max() < 1e-12
    assert sorted(abs(line[line["component"] == 1]["whitened"]).round(9)) == [0, 1.224744871, 1.224744871]
    assert whitening.whiten(vectors(spark, [None, []])).count() == 0
    wide = whitening.whiten(vectors(spark, [[0], [2**40], [2**41]])).collect()
    assert {r.deviation for r in wide} == {None, 0}


def test_whiten_floors_scaled_entries(spark):
    inf = float("inf")
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, -inf]), (6, [1e30, 0.0]), (7, []), (8, [0.25, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = whitening.whiten(table, scale=64, base=1_000_000, vector="embedding").toPandas()
    x = np.array([[1_000_032, 999_999], [1_000_016, 1_000_032]])
    deviation = ((2 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert found.sort_values(["vec_id", "component"])["vec_id"].tolist() == [1, 1, 8, 8]
    assert set(found["deviation"]) == set(deviation.tolist()) and set(found["n"]) == {2}
    assert np.allclose(found[found["component"] == 1]["whitened"].abs(), 1)


# --- fingerprints ----------------------------------------------------------------------------


def fingerprint_by_hand(text):
    data, mask = text.encode(), (1 << 64) - 1
    base, numbers = 0xD1342543DE82EF95, [int(x) for x in fingerprints._BYTE]

    def value(part):
        return sum(numbers[b] * pow(base, k, 1 << 64) for k, b in enumerate(part)) & mask

    def letter(chunk):
        mixed = fingerprints.mix(np.array([(value(chunk) + len(chunk)) & mask], np.uint64))
        return chr(fingerprints.ALPHABET[int(mixed[0] >> np.uint64(58))])

    def signature(level):
        out, start = "", 0
        for i in range(len(data)):
            ends = (value(data[max(0, i - 6) : i + 1]) >> 20) % (1 << level) == 0
            if (ends and len(out) < fingerprints.LETTERS - 1) or i == len(data) - 1:
                out, start = out + letter(data[start : i + 1]), i + 1
        return out

    level = max(0, (len(data) // 64).bit_length() - 1)
    return f"{1 << level}:{signature(level)}:{signature(level + 1)}"


def test_fingerprints_equal_the_definition(monkeypatch):
    rng = random.Random(5)
    texts = ["", "a", "é" * 20, "ab" * 50, "x" * 3000] + ["".join(rng.choice("abcde \né") for _ in range(n)) for n in (6, 7, 8, 64, 500, 4000)]
    for text in texts:
        assert fingerprints.fingerprint(text) == fingerprint_by_hand(text)
    long = "".join(rng.choice("abcdef \n") for _ in range(600_000))
    whole = fingerprints.fingerprint(long)
    monkeypatch.setattr(fingerprints, "_BLOCK", 1000)
    assert fingerprints.fingerprint(long) == whole
    assert fingerprints.fingerprint(None) == fingerprints.fingerprint("") == "1::"


def test_likeness():
    def shared(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before, row = row, [0]
            for j, y in enumerate(b):
                row.append(before[j] + 1 if x == y else max(row[j], before[j + 1]))
        return row[-1]

    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert fingerprints._shared(a, b) == shared(a, b)
    alike = fingerprints.likeness_of
    assert alike("8:abcdefghij:ace", "8:abcdefghij:ace") == 1.0 and alike("1::", "1::") == 1.0
    assert alike("8:abcdefghij:ace", "8:abcdefgxyz:xyz") == 0.7
    assert alike("8:abcdefghij:ace", "16:zzzzzzzzz:zz") == 0.0 and alike("8:abcdefghij:ace", "32:abcdefghij:ace") == 0.0
    assert alike("8:qqqqqqqqq:abcdefg", "16:abcdefg:zz") == 1.0
    assert alike(None, "1::") is None and alike("1::", "1:a:b") == 0.0


def test_edits_and_followers(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([0, 1, 3, 5, 40, 900]))) for _ in range(150)]
    ids = rng.sample(range(-500, 10**13, 10**9 + 7), 120) + rng.sample(range(400), 30)
    rows = [*zip(ids, texts, strict=True), (10**15, None)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(frame(spark, rows).repartition(4)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        follower = ordered[(k + 1) % len(ordered)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + follower[:m]
        own, new, following = (fingerprints.fingerprint(x) for x in (t, edited, follower))
        near = (fingerprints.likeness_of(own, new), fingerprints.likeness_of(own, following))
        assert tuple(got[i]) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own, new, *near)


def test_followers_of_ties_nulls_and_few_rows(spark):
    table = spark.createDataFrame([(5, "b"), (5, "a"), (None, "n"), (5, None), (9, "z"), (None, None)], "k long, v string")
    got = {(r.k, r.v, r.after) for r in fingerprints.with_next(table, "k", {"after": "v"}).collect()}
    order = [(None, None), (None, "n"), (5, None), (5, "a"), (5, "b"), (9, "z")]
    assert got == {(*x, order[(i + 1) % 6][1]) for i, x in enumerate(order)}
    one = fingerprints.compare_edited(frame(spark, [(3, "abcdefgh")])).collect()
    assert [(r.edited, r.near_next) for r in one] == [("abcdefab", 1.0)]
    assert fingerprints.fingerprint_report(frame(spark, [])).count() == 0
    copies = frame(spark, [(4, "same")] * 300 + [(5, "other")])
    assert fingerprints.compare_edited(copies).count() == 301


def test_edited_texts_stay_near(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(99)) for _ in range(300)) for _ in range(60)]
    got = fingerprints.fingerprint_report(frame(spark, enumerate(texts))).toPandas()
    assert got["near_edited"].min() > 0.5 and got["near_next"].max() < 0.4
