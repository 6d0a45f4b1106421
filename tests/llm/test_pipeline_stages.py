"""Every stage of the pipeline on its own against a plain Python version, on planted cases."""

import random
import re

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "harbour meadow lantern copper willow orchard granite velvet saddle thimble".split()
BAD = "xqz zzk kjj wvv qpp bxx ftt grr hmm dvv".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def prose(rng, words, n=60):
    return " ".join(f"{rng.choice(words)}{rng.randrange(30)}" for _ in range(n))


STAGES = dict(corpus_pipeline.STAGES)


def test_quality_stage_keeps_good_documents(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, prose(rng, BAD if i % 2 == 0 else GOOD)) for i in range(2000)]
    labels = [(i, i % 2, 0) for i in range(1500)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = STAGES["quality classifier"](spark, frame(spark, rows), str(tmp_path))
    assert kept.columns == [f.split()[0] for f in SCHEMA.split(", ")]
    assert ids(kept) == list(range(1, 2000, 2))


def test_line_stage_drops_later_copies_of_lines(spark):
    rng = random.Random(2)
    lines = [prose(rng, GOOD, 12) for _ in range(40)]
    rows = [(i, "\n".join([f"own line {i} {prose(rng, GOOD, 9)}", rng.choice(lines), f"end {i * 977} {prose(rng, GOOD, 8)}", rng.choice(lines)])) for i in range(80)]
    rows += [(100, lines[0]), (101, lines[0]), (102, None), (103, "")]
    seen, want = set(), {}
    for i, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            if line not in seen or not line:
                kept.append(line)
            seen.add(line)
        if "".join(kept).strip() or not (text or "").strip():
            want[i] = text and "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in STAGES["line dedup"](spark, frame(spark, rows).repartition(4), "").collect()}
    assert got.keys() == want.keys()
    assert {i: (t or "").strip() for i, t in got.items()} == {i: (t or "").strip() for i, t in want.items()}


def test_near_duplicate_stage_keeps_the_first_of_each_class(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 2, 9])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        else:
            texts.append(prose(rng, GOOD, rng.choice([6, 60, 200])))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    changed = True
    while changed:  # the smallest id that links reach
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    kept = STAGES["n-gram Jaccard join"](spark, frame(spark, [*enumerate(texts), (900, None), (901, "")]), "")
    assert ids(kept) == [i for i in range(len(texts)) if root[i] == i] + [900, 901]


def test_leak_stage_drops_only_holders_of_items(spark, tmp_path):
    rng = random.Random(4)
    items = [f"If a {rng.choice(GOOD)} holds {rng.randrange(10, 99)} coins and loses {k} of them every week, how many weeks pass before the {rng.choice(GOOD)} is empty?" for k in range(3, 13)]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows, leaked = [], set()
    for i in range(120):
        text = prose(rng, GOOD, 80)
        if i % 6 == 0:
            item = rng.choice(items)
            if i % 12 == 0:  # the same question with other numbers
                item = re.sub(r"\d+", lambda m: str(int(m.group()) + 100), item)
            text, _ = f"{text}\n{item}\n{prose(rng, GOOD, 30)}", leaked.add(i)
        rows.append((i, text))
    kept = ids(STAGES["benchmark decontamination"](spark, frame(spark, rows), str(tmp_path)))
    assert set(range(120)) - set(kept) == leaked


def test_packing_stage_loses_no_token(spark):
    tokenizers = pytest.importorskip("tokenizers")
    from featurekit.llm.queries import tokenizer_file

    rng = random.Random(5)
    rows = [(i, prose(rng, GOOD, rng.choice([1, 20, 300, 1500]))) for i in range(60)] + [(80, None), (81, "")]
    coder = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {i: len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    packed = STAGES["best-fit packing"](spark, frame(spark, rows), "").toPandas()
    assert packed.groupby("doc_id")["length"].sum().to_dict() == want
    for _, group in packed.sort_values("offset").groupby("sequence_id"):
        assert group["offset"].tolist() == [0, *group["length"].cumsum()[:-1]] and group["length"].sum() <= 2048
    total = sum(want.values())
    assert packed["sequence_id"].nunique() <= -(-total // 2048) + 2
