"""Every query of the training-data operators on the smallest tables, against SQL where there
is any, and the pipeline against its parts."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import corpus_pipeline  # noqa: E402
from featurekit.llm import queries  # noqa: E402

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="test tables not present")

COLUMNS = {
    "op1": "query_id rank vec_id score",
    "op4": "page_id host path rule verdict",
    "op5": "doc_id n_shingles component_id",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "vec_id component n deviation whitened explained identity_error",
    "op13": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}
PER_DOCUMENT = ("op5", "op6", "op8", "op9", "op10", "op11", "op13")


def cells(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple(None if x is None or x != x else str(x) for x in r) for r in pdf[columns].itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    found = queries.queries()[name](spark, str(TABLES)).toPandas()
    n = name.split("_")[0]
    assert set(COLUMNS.get(n, "").split()) <= set(found.columns)
    if n in PER_DOCUMENT:
        assert len(found) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    if name in queries.oracle_sql():
        database = duckdb.connect()
        for path in TABLES.glob("*.parquet"):
            database.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        assert cells(found) == cells(database.execute(queries.oracle_sql()[name]).df())


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(TABLES)).toPandas(), docs.schema)
        assert docs.columns == columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        ids = left
    packed = corpus_pipeline.run(spark, str(TABLES)).toPandas()
    assert set(packed["doc_id"]) == ids
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
