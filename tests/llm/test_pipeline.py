"""The pipeline's stages on the driver's small tables and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from recollect.llm import mixing, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in c.STAGES:
        before, docs = docs, c.written(stage(spark, docs, SF), name)
        out[name] = (before, docs)
    return out


def test_stages_keep_columns_and_rows(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.exceptAll(before).count() == 0, name


def test_near_duplicates_leave_one_of_each_group(spark, stages):
    from tests.llm.test_duplicates import near

    before, after = stages["near_duplicates"]
    _, label = near([(r["doc_id"], r["text"]) for r in before.collect()], 80)
    assert {r["doc_id"] for r in after.collect()} == set(label.values())


def test_mixing_follows_its_sql(stages):
    before, after = stages["mixing"]
    con = duckdb.connect()
    documents = before.toPandas()  # noqa: F841  DuckDB reads it by name
    kept = con.execute(f"SELECT doc_id FROM ({mixing.oracle()}) WHERE m_kept").fetchall()
    assert {r["doc_id"] for r in after.collect()} == {x[0] for x in kept}


def test_last_stage_round_trips(stages):
    before, after = stages["pieces"]
    assert after.count() == before.count() and after.filter("not decoded_ok or size(ids) <> n_pieces").count() == 0


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.first()["text"]
    odd = spark.createDataFrame([(None, text, None, None, None), (900001, None, "en", "s", 0), (900002, "", None, "s", 0), (900003, "12 !", "en", None, 4), (900004, text, "en", "s", None), (900004, text, "en", "s", None)], docs.schema)
    rows = docs.union(odd).withColumns({"score": F.lit("x"), "m_p": F.lit(1), "_text": F.lit("t"), "ids": F.lit("i"), "id": F.lit(0), "n_": F.lit(2), "share_": F.lit("y")})
    for name, stage in c.STAGES:
        before, rows = rows.columns, c.written(stage(spark, rows, SF), name)
        if name != c.STAGES[-1][0]:
            assert rows.columns == before
        if name == "language":
            assert rows.filter("doc_id in (900001, 900002, 900003)").count() == 0
        if name == "near_duplicates":
            assert rows.groupBy("doc_id").count().filter("count > 1").count() == 0
    for _, stage in c.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_have_the_contract_s_columns(spark):
    want = {
        "op1_toxicity": ["doc_id", "held_out", "score", "predicted"], "op2_language": ["doc_id", "held_out", "lang_pred", "score"], "op3_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op4_posting_lists": ["query_id", "rank", "vec_id", "score"], "op7_quality": ["doc_id", "held_out", "score", "predicted"], "op8_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
        "op10_metric_join": ["vec_id", "n_links", "component_id", "kept"],
    }
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, SF).columns[: len(columns)] == columns


def test_near_duplicates_are_told_by_texts_not_by_ids(spark):
    """Unrelated texts with one id all stay; of copies one stays, whatever their ids, and that with an id first."""
    text = lambda k: " ".join(f"w{k}.{j}" for j in range(30))
    rows = [(7, text(k)) for k in range(4)] + [(7, text(0)), (None, text(0)), (None, text(9)), (None, text(9)), (None, text(8)), (3, text(1)), (None, text(1) + " more"), (5, text(6)), (5, text(6))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["text"], r["doc_id"]) for r in c.near_duplicates(spark, docs, SF).collect())
    assert got == sorted([(text(0), 7), (text(1), 3), (text(2), 7), (text(3), 7), (text(6), 5), (text(8), None), (text(9), None)])
