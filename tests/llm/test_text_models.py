"""Toxicity, language and quality: held-out accuracy on the driver's tables, and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import language, quality, toxicity
from recollect.llm import textbuf as tb
from recollect.llm.supervised import crc_mod

SF = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "é"), (4, "12 34 !!"), (5, "the " * 60_000), (6, "same text here"), (6, "same text here"), (None, "no id here")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("x"), "label": F.lit(1), "lang_pred": F.lit("y"), "buckets": F.lit(0)})


@pytest.mark.parametrize("op,label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_and_odd_rows(spark, tables, op, label):
    docs, labels = tables
    model = op.train(docs, labels, crc_mod("doc_id", 4) != 2)
    got = op.score(docs, model, ["doc_id"]).join(labels, "doc_id").filter(crc_mod("doc_id", 4) == 2).toPandas()
    assert got["score"].between(0, 1).all()
    y, s = got[label].to_numpy(), got["score"].to_numpy()
    auc = np.mean((s[y == 1][:, None] > s[y == 0]) + (s[y == 1][:, None] == s[y == 0]) / 2)
    assert auc > 0.85, auc
    rows = op.score(odd(spark), model, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 6]
    assert same[0] == same[1]
    assert op.score(odd(spark).limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("op", [toxicity, quality])
def test_without_labels_or_with_one_class(spark, op):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for labels, want in ((none, 0.0), (spark.createDataFrame([(6, 1, 1), (6, None, None)], none.schema), 1.0)):
        model = op.train(docs, labels, F.lit(True))
        assert all(abs(r["score"] - want) < 1e-6 for r in op.score(docs, model, ["doc_id"]).collect())


def test_factorisation_identity():
    random = np.random.default_rng(1)
    w, v, x = random.normal(size=9), random.normal(size=(9, 3)), random.normal(size=4)
    index = np.array([1, 4, 5, 8])
    got, _ = quality.machine(index, x, np.array([0, 4]), w, v, 0.3)
    want = 0.3 + w[index] @ x + sum(v[index[i]] @ v[index[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert got[0] == pytest.approx(want)


def test_language_held_out_and_odd_rows(spark, tables):
    docs, _ = tables
    model = language.train(docs, crc_mod("doc_id", 3) != 1)
    assert model["langs"] == ["de", "en", "es", "fr"]
    got = language.mixtures(docs, model, ["doc_id", "lang"]).filter(crc_mod("doc_id", 3) == 1).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    rows = language.mixtures(odd(spark), model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in rows}
    assert [by[k]["lang_pred"] for k in (1, 2, 4)] == ["und"] * 3 and by[4]["score"] == 0 and by[3]["lang_pred"] != "und"
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert language.mixtures(odd(spark).limit(0), model, ["doc_id"]).count() == 0
    # A third of one language and two thirds of another.
    a, b = (docs.filter(f"lang = '{k}' and n_chars > 3000").first()["text"] for k in ("fr", "de"))
    mixed = spark.createDataFrame([(a[:1000] + " " + b[:2000],)], "text string")
    share = language.mixtures(mixed, model, []).first()["proportions"]
    assert share["de"] == pytest.approx(2 / 3, abs=0.1) and share["fr"] == pytest.approx(1 / 3, abs=0.1)


def test_language_without_labels(spark):
    model = language.train(odd(spark).withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r["lang_pred"] for r in language.mixtures(odd(spark), model, ["doc_id"]).collect()} == {"und"}


def test_blocks_cover_rows():
    import pyarrow as pa

    texts = ["", "aé", None, "x" * 50, "☃" * 9]
    column = pa.array(texts * 3).slice(2, 9)
    seen = []
    for lo, hi, data, offs in tb.text_blocks(column, block=20):
        chars, starts = tb.code_points(data, offs)
        seen += ["".join(map(chr, chars[s:e])) for s, e in zip(starts[:-1], starts[1:], strict=True)]
        assert hi - lo == len(offs) - 1
    assert seen == [t or "" for t in column.to_pylist()]


def test_every_language_is_learned_and_a_text_may_have_many(spark):
    random = np.random.default_rng(12)
    own = lambda k: [chr(0x4E00 + 40 * k + j) for j in range(40)]
    text = lambda k, n: " ".join("".join(random.choice(own(k), 4)) for _ in range(n))
    rows = [(k, text(k, 60), f"l{k:02}") for k in range(70)]
    asked = [(100, text(69, 40), None), (101, " ".join(text(k, 30) for k in (1, 2, 3, 65, 66)), None)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    assert model["langs"] == [r[2] for r in rows]
    got = {r["doc_id"]: r for r in language.mixtures(docs.filter("doc_id >= 100"), model, ["doc_id"]).collect()}
    assert got[100]["lang_pred"] == "l69"
    assert set(got[101]["proportions"]) == {"l01", "l02", "l03", "l65", "l66"} and got[101]["score"] == pytest.approx(0.2, abs=0.05)
