"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featurekit.llm import (
    decontaminate,
    fingerprints,
    jaccard,
    license_scan,
    line_dedup,
    neighbours,
    packing,
    periodic_runs,
    quality,
    recurrent_lm,
    token_counts,
    url_reputation,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL query.
RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    judged = url_reputation.judge_pages(_table(spark, sf_dir, "pages"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(_table(spark, sf_dir, "documents"), exact_chars=line_dedup.EXACT_CHARS)


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), k=4, similarity=Fraction(85, 100))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    digest = F.crc32("ids").alias("ids_crc32")
    packed = packing.pack(cut.select("doc_id", "piece", "start", "length", digest))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_texts(_table(spark, sf_dir, "documents"))


def edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rank_file = tokenizer_file("byte_bpe_50k.tiktoken")
    return token_counts.count_redacted(_table(spark, sf_dir, "documents"), rank_file, public_tokenizers.PATTERN)


def periodic_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(periodic_runs.repeated_tails(_table(spark, sf_dir, "documents")))


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), scale=64, base=1_000_000, vector="embedding")


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_collision_counting_ann": nearest_neighbours,
        "op2_decontamination": decontamination,
        "op3_line_dedup": repeated_lines,
        "op4_url_reputation": url_filter,
        "op5_jaccard_join": jaccard_join,
        "op6_quality_classifier": quality_classifier,
        "op7_best_fit_packing": best_fit_packing,
        "op8_license_scan": license_scans,
        "op9_recurrent_lm": language_model,
        "op10_edited_token_counts": edited_token_counts,
        "op11_periodic_runs": periodic_run_report,
        "op12_embedding_whitening": embedding_whitening,
        "op13_document_fingerprints": document_fingerprints,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _strength_sql(table: str, parent: str) -> str:
    p = f"least(greatest({parent}, 1e-6), 1 - 1e-6)"
    over, room = f"sum(n * pow(good / n - {p}, 2) - {p} * (1 - {p}))", f"sum({p} * (1 - {p}) * (n - 1))"
    rho = f"CASE WHEN {room} > 0 THEN {over} / {room} ELSE 0.0 END"
    return f"(SELECT least(greatest(1 / greatest({rho}, 1e-9) - 1, 1.0), 1e4) FROM {table})"


def _url_sql() -> str:
    suffixes = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)

    def level(name: str, table: str, prior: str) -> str:
        """The posterior's parameters and mean at one level."""
        return f"""{name}_s AS (SELECT *, {_strength_sql(table, prior)} AS strength FROM {table}),
        {name} AS (SELECT *, {prior} * strength + good AS a, (1 - {prior}) * strength + n - good AS b FROM {name}_s)"""

    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))

    def case(pick: int) -> str:
        tests = []
        for rule in rules:
            host, _, path = rule[1].partition("/")
            fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
            tests.append(f"WHEN {fits} THEN '{rule[pick]}'")
        return "CASE " + " ".join(tests) + " END"

    upper = f"least(a / (a + b) + {url_reputation.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1.0)"
    return f"""WITH page AS (SELECT page_id,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        hosts0 AS (SELECT host, string_split(host, '.') AS l, count(*) AS n, count(*) FILTER (quality = 1) AS good
            FROM page JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY host),
        hosts1 AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') IN ({suffixes}) THEN array_to_string(l[-2:], '.')
            ELSE l[-1] END AS suffix FROM hosts0),
        hosts2 AS (SELECT *, array_to_string(CASE WHEN contains(suffix, '.') THEN l[-3:] ELSE l[-2:] END, '.') AS domain
            FROM hosts1),
        domains0 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM hosts2 GROUP BY 1, 2),
        suffixes0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains0 GROUP BY 1),
        suffixes1 AS (SELECT *, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM suffixes0) AS prior FROM suffixes0),
        {level("suffixes", "suffixes1", "prior")},
        domains1 AS (SELECT d.*, s.a / (s.a + s.b) AS prior FROM domains0 d JOIN suffixes s USING (suffix)),
        {level("domains", "domains1", "prior")},
        hosts3 AS (SELECT h.host, h.n::DOUBLE AS n, h.good::DOUBLE AS good, d.a / (d.a + d.b) AS prior
            FROM hosts2 h JOIN domains d USING (domain, suffix)),
        {level("hosts", "hosts3", "prior")}
        SELECT page_id, host, path, {case(1)} AS rule,
            coalesce({case(0)}, CASE WHEN {upper} < {url_reputation.LEAST_RATE} THEN 'block' ELSE 'allow' END) AS verdict
        FROM page LEFT JOIN hosts USING (host)"""


#: Distinct shingles, links by shared shingles, and the smallest id that links reach.
_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(4, len(w)) - 1], ' ') AS shingle
            FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle
            AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * k >= 85 * (p.n + q.n - k)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_reputation": _url_sql(), "op5_jaccard_join": _JACCARD_SQL}
