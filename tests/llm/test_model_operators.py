"""Neighbours, host reputation, packing, token counts and the language model, by brute force and
on nulls, empty and long inputs, ties, repeated rows, empty tables and clashing columns."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurekit.llm import neighbours, packing, recurrent_lm, token_counts, url_reputation

P = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, length int, sequence_id string, offset string, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "o", 0) for i, t in rows], SCHEMA)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# --- neighbours ------------------------------------------------------------------------------


def exact(data, queries, k):
    out = {}
    for q in queries:
        others = [(i, float((v * data[q]).sum() / math.sqrt((v * v).sum()) / math.sqrt((data[q] ** 2).sum()))) for i, v in data.items() if i != q]
        out[q] = sorted(others, key=lambda x: (-x[1], x[0]))[:k]
    return out


@pytest.mark.parametrize("clusters", [0, 12])
def test_recall_against_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(neighbours, "VECTORS_PER_BLOCK", 700)
    rng = np.random.default_rng(clusters)
    data = rng.standard_normal((2500, 32))
    if clusters:
        data = rng.standard_normal((clusters, 32))[rng.integers(clusters, size=2500)] + 0.3 * data
    df = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, score double")
    got = neighbours.nearest(df, df.where("vec_id % 50 = 0"))
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = exact(dict(enumerate(data)), range(0, 2500, 50), 5)
    assert all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in found.values()) and len(found) == 50
    hits = sum(len({x[1] for x in found[q]} & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * 250
    assert all(math.isclose(s, dict(exact(dict(enumerate(data)), [q], 2500)[q])[i]) for q in list(found)[:3] for _, i, s in found[q])


def test_neighbours_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, []), (7, [2.0, 0.0]),
        (8, [2.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [0.0, 3.0]), (10, [1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert rows(neighbours.nearest(df, df.where("vec_id IN (0, 2, 9, 10)")), "query_id", "rank", "vec_id", "score") == sorted(
        [(0, 1, 7, 1.0), (0, 2, 8, 1.0), (0, 3, 9, 0.0), (9, 1, 0, 0.0), (9, 2, 7, 0.0), (9, 3, 8, 0.0)], key=str
    )
    assert neighbours.nearest(df, df.limit(0)).count() == neighbours.nearest(df.limit(0), df).count() == 0


# --- hosts -----------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://A.Example.net/en/x?q=/de/", "https://example.com/de/", "x://example.com/DE/", "https://b.org/fr/1#a", "http://net/", "http://xnet/a",
        "no url", None, "", "http://a.net", "http://[::1]:80?x", "ftp://É.example.com:8080/de/a?b", "http://example.net/en", "a://b://c/d",
    ]
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([], "page_id long, good boolean")

    def want(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fits = [(r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, rule, verdict

    got = url_reputation.judge_pages(pages, outcomes, rules)
    assert rows(got, "page_id", "host", "path", "rule", "verdict") == sorted(((i, *want(u)) for i, u in enumerate(urls)), key=str)
    assert url_reputation.judge_pages(pages.limit(0), outcomes, rules).count() == 0


def test_reputation_shrinks_and_blocks(spark):
    rng = random.Random(1)
    hosts = [(f"h{j}.good.example", 0.95, 30) for j in range(20)] + [(f"h{j}.bad.example", 0.1, 30) for j in range(20)] + [("big.example", 0.9, 3000)]
    hosts += [("one.good.example", 0.0, 1), ("one.bad.example", 0.0, 1)]
    table = [(h, rng.random() < p) for h, p, n in hosts for _ in range(n)]
    df = spark.createDataFrame([*table, (None, True), ("x.example", None)], "host string, good boolean")
    got = {r["host"]: r for r in url_reputation.host_reputation(df).collect()}
    seen = Counter(h for h, _ in table)
    assert {h: r["n"] for h, r in got.items()} == dict(seen)
    assert all(r["lower"] <= r["rate"] <= r["upper"] for r in got.values())
    assert got["one.good.example"]["rate"] > 0.5 > got["one.bad.example"]["rate"]  # one bad page each
    assert abs(got["big.example"]["rate"] - sum(g for h, g in table if h == "big.example") / 3000) < 0.01
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(got)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, g) for i, h in enumerate(got) for hh, g in table if hh == h], "page_id long, good boolean")
    verdicts = {r["host"]: r["verdict"] for r in url_reputation.judge_pages(pages, outcomes).dropDuplicates(["page_id"]).collect()}
    assert verdicts["h3.bad.example"] == "block" and verdicts["h3.good.example"] == verdicts["big.example"] == "allow"


def test_hosts_without_outcomes_have_their_domains_reputation(spark):
    hosts = [(f"h{j}.bad.example", 0.02) for j in range(10)] + [(f"h{j}.good.example", 0.98) for j in range(10)] + [(f"h{j}.d{j}.evil", 0.0) for j in range(30)]
    unknown = ["new.bad.example", "new.good.example", "new.other.example", "new.unseen.evil", "new.nowhere.test"]
    rng = random.Random(2)
    table = [(h, rng.random() < p) for h, p in hosts for _ in range(60)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate([*(h for h, _ in table), *unknown])], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, g) for i, (_, g) in enumerate(table)], "page_id long, good boolean")
    got = {r["host"]: r for r in url_reputation.judge_pages(pages, outcomes).collect()}
    assert {h: (got[h]["n"], got[h]["verdict"]) for h in unknown} == {
        "new.bad.example": (0, "block"), "new.good.example": (0, "allow"), "new.other.example": (0, "allow"),
        "new.unseen.evil": (0, "block"), "new.nowhere.test": (0, "allow"),
    }
    assert got["new.bad.example"]["rate"] < got["new.other.example"]["rate"] < got["new.good.example"]["rate"]
    # A host's own outcomes move it from the same prior, and the unlabelled hosts change no fit.
    alone = {r["host"]: r["rate"] for r in url_reputation.host_reputation(spark.createDataFrame(table, "host string, good boolean")).collect()}
    assert all(math.isclose(got[h]["rate"], rate) for h, rate in alone.items())


# --- packing ---------------------------------------------------------------------------------


def check_packed(packed, capacity):
    """Gapless sequences within the capacity; returns their number."""
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 101), rng.randrange(1, 20), rng.randrange(35, 65), 100]) for _ in range(rng.choice([1, 50, 3000]))]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, length long, sequence_id string").repartition(5)
    packed = packing.pack(df, 100).collect()
    assert sorted((r["doc_id"], r["length"]) for r in packed) == list(enumerate(sizes))
    assert check_packed(packed, 100) <= max(-(-sum(sizes) // 100), sum(2 * s > 100 for s in sizes)) * 11 / 9 + 1


def test_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Hello, WORLD don't I'LL", None, "", "  ", "İstanbul ÀÉ x\u00a0y\u200b <|endoftext|>a", "日本 ΣΣ １２ 12a3", "a\x85b \x1c ''s's ﬁ ǅ ŉ ẞ ½", "word " * 30_000]
    docs = frame(spark, [*enumerate(texts), (None, "x"), (0, texts[0])])
    got = packing.pieces(docs, path, 100)
    found = {}
    for r in got.where("doc_id > 0").collect():
        found.setdefault(r["doc_id"], {})[r["piece"]] = r
    for i, text in list(enumerate(texts))[1:]:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        ids = [x for p in sorted(found[i]) for x in np.frombuffer(found[i][p]["ids"], "<u4").tolist()]
        assert ids == want
        assert all(r["start"] == 100 * p and r["length"] == len(r["ids"]) // 4 for p, r in found[i].items())
        assert all(r["length"] == 100 for p, r in found[i].items() if p + 1 < len(found[i]))
    assert got.where("doc_id IS NULL").count() == 1 and got.where("doc_id = 0").count() == 2
    assert packing.pack(packing.pieces(docs.limit(0), path)).count() == 0
    packed = packing.pack(got, 100)
    assert packing.sequences(packed).agg(F.sum("n_tokens"), F.sum(F.length("ids"))).first()[0] == packed.agg(F.sum("length")).first()[0]


# --- token counts ----------------------------------------------------------------------------


def test_edits_equal_counting_again():
    split, count = token_counts._coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    parts = ["a", "bc", " ", "  ", "   ", "\n", "'", "'s", "'ll", "7", "12", "!", "é", "日", "x y", "don't", "\t "]
    for _ in range(600):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 10, 200, 900])))
        tree = token_counts.Tree(text, split, count)
        for _ in range(5):
            a = rng.randrange(len(text) + 1)
            b = min(len(text), a + rng.choice([0, 0, 1, 2, 5, 300]))
            new = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 6])))
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            ends = list(split(text, 0))
            assert tree.text() == text and tree.length == len(text)
            assert [n for leaf in tree.leaves for n in leaf[1]] == [e - s for s, e in zip([0, *ends], ends, strict=False)]
            assert tree.total == sum(count(text[s:e]) for s, e in zip([0, *ends], ends, strict=False))


def test_redacted_counts_equal_encoding_the_new_text(spark):
    _, count = token_counts._coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["mail a.b@c.example now", "call +1 (555) 123-4567 or 10.0.0.12", None, "", "plain", "a@b.io a@b.io", "w " * 50_000 + "x@y.org"]
    docs = frame(spark, [*enumerate(texts), (None, texts[0]), (0, texts[0])])
    got = token_counts.count_redacted(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r["doc_id"] or 0] or ""
        after = text
        for pattern, put in token_counts.REDACTIONS:
            for found in dict.fromkeys(m[0] for m in re.finditer(pattern, text)):
                after = after.replace(found, put)
        assert (r["n_chars"], r["n_tokens"]) == (len(text), count(text))
        assert (r["n_chars_after"], r["n_tokens_after"]) == (len(after), count(after))
        assert r["n_encoded_again"] <= 200
    assert token_counts.count_redacted(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# --- language model --------------------------------------------------------------------------


def test_gradients_equal_differences(monkeypatch):
    for name, value in (("HIDDEN", 4), ("CLASS_SIZE", 3), ("CLASSES", 2), ("MIDDLE", 6), ("RARE", 7), ("RATE", 1.0)):
        monkeypatch.setattr(recurrent_lm, name, value)
    h, c, n = 4, 2, 3
    shapes = {"input": (8, 12), "gates": (h, 8), "state": (h, h), "classes": (h, c + 2), "class_bias": (c + 2,), "members": (c, h, n), "member_bias": (c, n)}
    rng = np.random.default_rng(3)
    w = {k: rng.standard_normal(s) * 0.3 for k, s in shapes.items()}
    inputs, targets = rng.integers(0, 8, (5, 3)), rng.integers(0, 8, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0], fresh[2, 1] = True, True
    real = np.ones((5, 3), bool)
    real[4, 2] = False
    start = np.zeros((3, h))

    def loss(w):
        states, _ = recurrent_lm._forward(w, start, inputs, fresh)
        return -recurrent_lm.log_probability(w, states[real].astype(float), targets[real]).sum() / 3

    monkeypatch.setattr(recurrent_lm.np, "float32", np.float64)
    trainer, seen = recurrent_lm.Trainer({k: v.copy() for k, v in w.items()}), {}

    def keep(name, g, at=...):
        full = seen.setdefault(name, np.zeros(shapes[name]))
        full[at] += g

    trainer._apply = keep
    trainer.window(start, inputs, targets, fresh, real)
    for name in shapes:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in shapes[name])
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert math.isclose((loss(up) - loss(down)) / 2e-5, seen[name][at], rel_tol=1e-3, abs_tol=1e-6), name


def texts_with_context(rng, n):
    """Words of one of two kinds, of which a text holds only one."""
    return [" ".join(f"{'ab'[i % 2]}{rng.choice([0, 0, 0, 1, 1, 2, 3, rng.randrange(400)])}" for _ in range(rng.choice([3, 30, 90]))) for i in range(n)]


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(recurrent_lm, "SHARE", 1 / 2)
    texts = texts_with_context(random.Random(4), 500)
    docs = frame(spark, enumerate(texts)).repartition(3)
    got = {r["doc_id"]: r for r in recurrent_lm.score_texts(docs, head=50).collect()}
    tokens = {i: [*t.encode().lower().split(), "end"] for i, t in enumerate(texts)}
    learn = [i for i in tokens if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in learn for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, w in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in learn, len(w), sum(x in counts for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    vocabulary = recurrent_lm.Vocabulary(np.arange(10, 3010, dtype=np.uint64), np.arange(3000, 0, -1), 5_000_000, 9000)
    w = recurrent_lm.first_weights(vocabulary)
    states = np.random.default_rng(0).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    classes = [recurrent_lm.log_probability(w, states, np.array([t]))[0] for t in (*range(recurrent_lm.MIDDLE), recurrent_lm.MIDDLE, recurrent_lm.RARE)]
    assert math.isclose(sum(map(math.exp, classes)), 1, rel_tol=1e-4)
    middle = (np.arange(3000, 0, -1)[recurrent_lm.MIDDLE :] + 0.1).sum() / vocabulary.middle_total
    rest, kinds = 5_000_000 - 3000 * 3001 // 2, 9000 - 3000
    assert math.isclose(middle, 1) and math.isclose(vocabulary.rare_total, rest + 0.1 * (kinds + 1))


def _plain_window_gradients(w, states, targets, scale):
    """Of the summed -log probability, place by place, in double precision."""
    w = {k: v.astype(float) for k, v in w.items()}
    out = {k: np.zeros(v.shape) for k, v in w.items()}

    def step(h, weights, bias, columns, at, first):
        x = np.r_[0.0, h @ weights[:, columns[1:]] + bias[columns[1:]]] if first else h @ weights[:, columns] + bias[columns]
        e = np.exp(x - x.max())
        g = e / e.sum()
        g[at] -= 1
        return [(c, v) for i, (c, v) in enumerate(zip(columns, g, strict=True)) if i or not first]

    def softmax(h, name, bias_name, where, at, two_steps):
        weights, bias = w[name][where], w[bias_name][where]
        k = weights.shape[1]
        size = math.isqrt(max(k - 1, 0)) + 1
        found = [(list(range(k)), at, False)]
        if two_steps:
            group = list(range(at // size * size, min(at // size * size + size, k)))
            found = [(list(range(0, k, size)), at // size, False), (group, at % size, True)]
        for columns, place, first in found:
            for c, v in step(h, weights, bias, columns, place, first):
                out[name][where][:, c] += scale * v * h
                out[bias_name][where][c] += scale * v

    n, _, size = w["members"].shape
    for h, t in zip(states.astype(float), targets, strict=True):
        softmax(h, "classes", "class_bias", ..., int(t // size if t < n * size else n + (t > n * size)), True)
        if t < n * size:
            softmax(h, "members", "member_bias", t // size, int(t % size), t < size)
    return out


@pytest.mark.parametrize("bias", [0.0, 200.0, -300.0])
def test_softmax_gradients_equal_plain_ones(bias):
    """Also where exp of a logit is beyond the range of floats."""
    vocabulary = recurrent_lm.Vocabulary(np.arange(10, 100, dtype=np.uint64), np.arange(90, 0, -1), 5000, 95, 10, 9)
    w = recurrent_lm.first_weights(vocabulary)
    w["member_bias"] += np.float32(bias)
    w["class_bias"] += np.float32(bias)
    rng = np.random.default_rng(5)
    targets = rng.integers(0, 92, (6, 20))
    inputs, fresh, real = rng.integers(0, 92, (6, 20)), np.zeros((6, 20), bool), rng.random((6, 20)) < 0.9
    start = np.zeros((20, recurrent_lm.HIDDEN), np.float32)
    states, _ = recurrent_lm._forward(w, start, inputs, fresh)
    want = _plain_window_gradients(w, states[real], targets[real], 1 / 20)
    trainer, seen = recurrent_lm.Trainer({k: v.copy() for k, v in w.items()}), {}

    def keep(name, g, at=...):
        seen.setdefault(name, np.zeros(w[name].shape))[at] += g

    trainer._apply = keep
    trainer.window(start, inputs, targets, fresh, real)
    for name in ("classes", "class_bias", "members", "member_bias"):
        assert np.allclose(seen[name], want[name], rtol=1e-3, atol=2e-5), name
    assert np.isfinite(recurrent_lm.log_probability(w, states[real], targets[real])).all()


def test_tail_class_costs_no_more_calls_than_needed(monkeypatch):
    """A window updates the members in blocks of classes, not class by class."""
    vocabulary = recurrent_lm.Vocabulary(np.arange(10, 10_010, dtype=np.uint64), np.full(10_000, 5), 50_000, 10_000, *recurrent_lm.layout(10_000))
    trainer, calls = recurrent_lm.Trainer(recurrent_lm.first_weights(vocabulary)), Counter()
    monkeypatch.setattr(trainer, "_apply", lambda name, g, at=...: calls.update([name]))
    ids = np.arange(10_000).reshape(20, 500)
    trainer.window(np.zeros((500, recurrent_lm.HIDDEN), np.float32), ids, ids, np.zeros(ids.shape, bool), np.ones(ids.shape, bool))
    assert calls["members"] == -(-100 // recurrent_lm.CLASS_BLOCK) == calls["member_bias"]


def test_language_model_on_odd_rows(spark):
    docs = frame(spark, [(1, "a b a"), (1, "a b a"), (2, None), (3, ""), (None, "a"), (4, "long " * 100_000)])
    got = recurrent_lm.score_texts(docs).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 4, 4, 100_001]
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert recurrent_lm.score_texts(docs.limit(0)).count() == 0
    unknown = recurrent_lm.score_texts(docs.where("doc_id IS NULL")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in unknown] == [(0, 0, 0.0)]


def test_every_training_text_moves_the_weights(spark):
    texts = [(i, f"own{i} own{i} own{i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    counts = recurrent_lm.token_counts(docs)
    vocabulary = recurrent_lm.Vocabulary(*recurrent_lm.most_frequent(counts, 100), 240, 61)
    before = recurrent_lm.first_weights(vocabulary)["input"]
    after = recurrent_lm.train(docs, vocabulary)["input"]
    assert ((before != after).any(axis=1)).sum() == 61  # each text's own word, and the end


def test_the_softmax_covers_the_whole_head(spark):
    n = 2600
    docs = spark.createDataFrame([(i, f"own{i} own{i} own{i}") for i in range(n)], "doc_id long, text string").coalesce(1)
    hashes, counts = recurrent_lm.most_frequent(recurrent_lm.token_counts(docs), recurrent_lm.HEAD)
    vocabulary = recurrent_lm.Vocabulary(hashes, counts, 4 * n, n + 1, *recurrent_lm.layout(len(hashes)))
    assert len(set(vocabulary.ids(*vocabulary.find(hashes)))) == len(hashes) == n + 1
    before = recurrent_lm.first_weights(vocabulary)
    after = recurrent_lm.train(docs, vocabulary)
    assert (before["input"] != after["input"]).any(axis=1).sum() == n + 1
    state = np.random.default_rng(0).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32)
    every = [recurrent_lm.log_probability(after, state, np.array([t]))[0] for t in [*range(n + 1), vocabulary.middle, vocabulary.middle + 1]]
    assert math.isclose(sum(map(math.exp, every)), 1, rel_tol=1e-3)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 3000, 100_000])
def test_classes_grow_with_the_root_of_the_head(n):
    classes, size = recurrent_lm.layout(n)
    assert classes * size >= n and (classes - 1) * size < max(n, 1) and abs(size - math.sqrt(n)) <= 1


def test_stretches_hold_every_token_once():
    rng = np.random.default_rng(3)
    for sizes in ([1], [5000, 1, 2], [1] * 7, [3] * 4000, [100_000], list(rng.integers(1, 900, 60))):
        borders = np.r_[0, np.cumsum(sizes)]
        ids = rng.integers(0, 99, borders[-1])
        inputs, targets, fresh, place = recurrent_lm.stretches_of(ids, borders, 77)
        at = place[place >= 0]
        assert sorted(at) == list(range(len(ids))) and (targets[place >= 0] == ids[at]).all()
        starts = np.isin(at, borders[:-1])
        assert (fresh[place >= 0] == starts).all()
        assert (inputs[place >= 0] == np.where(starts, 77, ids[at - 1])).all()
        assert place.size - len(at) < place.shape[1]  # no lane runs dry


@pytest.mark.parametrize("table", ["sf0.001", "sf0.01", "long"])
def test_training_beats_counts_and_untrained_weights(spark, monkeypatch, table):
    """Held-out log probability, also beside one very long text that is nothing like the others."""
    path = f"/root/testdata/{'sf0.001' if table == 'long' else table}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test tables not present")
    docs = spark.read.parquet(path).select("doc_id", "text")
    if table == "long":
        assert zlib.crc32(b"1000003") % 10
        docs = docs.unionAll(spark.range(1).selectExpr("1000003L", "repeat('strange words without end ', 100000)"))
    trained = recurrent_lm.score_texts(docs).where("held_out").toPandas()
    monkeypatch.setattr(recurrent_lm, "train", lambda texts, vocabulary: recurrent_lm.first_weights(vocabulary))
    first = recurrent_lm.score_texts(docs).where("held_out").toPandas()
    score = trained["score"].sum()
    assert score > first["score"].sum() and score > trained["base_score"].sum()
