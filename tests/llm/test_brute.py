"""Features, models, scores and the pipeline's first stages against plain loops, and long texts against short ones."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from recollect.llm import language, quality, toxicity, url_filter
from recollect.llm import textbuf as tb
from recollect.llm.supervised import crc_mod, unpack
from tests.llm import brute

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "a", "é", "12 34 !!", "Ünïcode WÖRTER\nund\nund noch\n\nmehr!!  Zeichen -- hier", "𠀀𠀁𠀂 ｆｕｌｌ ｗｉｄｔｈ", "・・", "々〆〇", "the cat\tsat\x0bon\x0cthe\r\nmat.. 99%%", "x" * 3000, "line one\nline one\nline two\n",
    "le chat et le chien sont dans la maison avec der Hund und die Katze", "no\u00a0break", " lead and trail \n",
]


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_toxicity(spark, docs):
    p = toxicity.ToxicityParams(rounds=25)
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    text = {i: t[:600] for i, t, _ in docs}
    rows = [(text[i], y) for i, y in labels if i in text and i % 3]
    model = brute.toxic_fit(rows, p)
    frame = spark.createDataFrame([(i, t) for i, t in text.items()], "doc_id long, text string")
    got = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), F.col("doc_id") % 3 != 0, p)
    assert set(np.flatnonzero(got["weight"])) <= set(model[0]) and float(got["bias"]) == pytest.approx(model[1], abs=1e-6)
    asked = spark.createDataFrame(list(enumerate(TEXTS + [t for _, t, _ in docs[:60]])), "doc_id long, text string")
    for r in toxicity.score(asked, got, ["doc_id", "text"], p).collect():
        assert r["score"] == pytest.approx(brute.toxic_score(r["text"], model, p), abs=1e-5), r["doc_id"]


def test_language(spark, docs):
    p = language.LanguageParams()
    rows = [(t[:500], k if i % 4 else None) for i, t, k in docs]
    model = brute.language_fit(rows, p)
    frame = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    got = language.train(frame, F.lit(True), p)
    assert got["langs"] == model[0]
    for o in range(len(p.orders)):
        assert np.abs(got["logp"][o] - np.stack([model[1][k][o] for k in model[0]], 1)).max() < 1e-5
    mixed = [f"{a} {b} {d}" for (a, _), (b, _), (d, _) in zip(rows[::9], rows[3::9], rows[5::9], strict=False)]
    asked = TEXTS + [t for t, _ in rows[:180]] + mixed
    found = language.mixtures(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), got, ["doc_id"], p).collect()
    assert len(found) == len(asked)
    for r in found:
        want = brute.language_mixture(asked[r["doc_id"]], model, p)
        if want is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["proportions"] == pytest.approx(want, abs=1e-9), asked[r["doc_id"]]
            assert r["score"] == pytest.approx(max(want.values()), abs=1e-9) and want[r["lang_pred"]] == pytest.approx(r["score"], abs=1e-9)


def test_letters_are_unicode_s(spark):
    every = np.arange(0x110000)
    assert (tb.letters(every) == np.array([chr(x).isalpha() for x in every])).all()


def test_quality(spark, docs):
    p = quality.QualityParams()
    random = np.random.default_rng(3)
    size = quality.size_of(p)
    model = {"w": random.normal(size=size).astype(np.float32), "v": random.normal(size=(size, p.rank)).astype(np.float32), "bias": 0.1}
    asked = TEXTS + [t[:400] for _, t, _ in docs[:40]]
    for r in quality.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model, ["doc_id"], p).collect():
        x = brute.quality_vector(asked[r["doc_id"]], p, quality.STATS, quality.SHARES, quality.LENGTHS, quality.BINS)
        index, value = quality._vector(np.frombuffer((asked[r["doc_id"]] or "").encode(), np.uint8), p)
        assert dict(zip(index.tolist(), value.tolist(), strict=True)) == pytest.approx(x), asked[r["doc_id"]]
        assert r["score"] == pytest.approx(brute.sigmoid(brute.machine(x, model["w"].astype(float), model["v"].astype(float), model["bias"])), abs=1e-9)


def test_quality_fit_by_single_rows():
    """Two rounds of the fit, with gradients summed row by row and pair by pair."""
    p = quality.QualityParams(bits=4, rank=2, rounds=2)
    random = np.random.default_rng(5)
    rows = [(sorted(random.choice(12, 4, replace=False)), random.normal(size=4).astype(np.float32), k % 2) for k in range(9)]
    table = pa.table({"label": [y for _, _, y in rows], "index": [np.array(i, np.uint32).tobytes() for i, _, _ in rows], "value": [x.tobytes() for _, x, _ in rows]})
    got = unpack(quality.fit(table, p))
    names = sorted({i for index, _, _ in rows for i in index})
    seeded = np.random.default_rng(p.seed)
    y = np.array([k for _, _, k in rows])
    w, v = np.zeros(len(names)), seeded.normal(0, 0.05, (len(names), p.rank))
    bias, gw2, gv2, gb2 = np.log(y.mean() / (1 - y.mean())), np.full(len(names), 1e-6), np.full(v.shape, 1e-6), 1e-6
    order = np.arange(len(y))
    for _ in range(p.rounds):
        seeded.shuffle(order)
        gw, gv, gb = np.zeros(len(names)), np.zeros(v.shape), 0.0
        for k in order:
            x = {names.index(i): float(a) for i, a in zip(rows[k][0], rows[k][1], strict=True)}
            g = (brute.sigmoid(brute.machine(x, w, v, bias)) - y[k]) / len(y)
            gb += g
            for i in x:
                gw[i] += g * x[i]
                gv[i] += g * x[i] * sum(v[j] * x[j] for j in x if j != i)
        gw, gv = gw + p.ridge * w, gv + p.ridge * v
        gw2, gv2, gb2 = gw2 + gw**2, gv2 + gv**2, gb2 + gb**2
        w, v, bias = w - 0.1 * gw / np.sqrt(gw2), v - 0.03 * gv / np.sqrt(gv2), bias - 0.1 * gb / np.sqrt(gb2)
    assert got["w"][names] == pytest.approx(w, abs=1e-5) and got["v"][names] == pytest.approx(v, abs=1e-5) and float(got["bias"]) == pytest.approx(bias)


def test_url_scores_are_the_regression_s(spark):
    """Scores from the coefficients over n-grams that are cut by hand; urls that weren't learned from are mostly right."""
    p = url_filter.UrlParams()
    labels = url_filter.default_labels(spark)
    model = url_filter.train(labels, p)
    hashing, weights = url_filter._hashed(p), model.coefficients.toArray()
    urls = ["https://www.example.org/en/article", "http://Casino.example/slots", "x://é/a?b", "nothing", None, "https://a.b/"]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), labels, url_filter.default_rules(spark), p).collect()
    for r in got:
        grams = {m[i : i + n] for m in (f"h:{r['host']}$", f"p:{r['path']}$") for n in p.orders if len(m) > n + 2 for i in range(len(m) - n + 1)}
        assert r["score"] == pytest.approx(brute.sigmoid(sum(weights[k] for k in {hashing.indexOf(g) for g in grams}) + model.intercept), abs=1e-9)
    rows, right = labels.collect(), 0
    for k in range(6):
        learn, held = ([r for i, r in enumerate(rows) if (i % 6 == k) == part] for part in (False, True))
        out = url_filter.filter_urls(spark.createDataFrame(list(enumerate(r["url"] for r in held)), "page_id long, url string"), spark.createDataFrame(learn, labels.schema), url_filter.default_rules(spark).limit(0), p)
        right += sum((r["verdict"] == "block") == held[r["page_id"]]["label"] for r in out.collect())
    assert right / len(rows) > 0.6


def test_pipeline_s_first_stages(spark, docs):
    """Language and toxicity of the pipeline, decided by the plain loops' models."""
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 500).alias("text"), "lang", "source", "n_chars")
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    learn = {r["doc_id"] for r in frame.filter(crc_mod("doc_id", 3) != 1).collect()}
    p, lang = language.LanguageParams(), {i: k for i, _, k in docs}
    model = brute.language_fit([(text[i], lang[i]) for i in sorted(learn)], p)
    kept = set()
    for i, t in text.items():
        share = brute.language_mixture(t, model, p)
        if share is not None and (max(share.values()) >= c.MIN_LANGUAGE_SHARE or len(t) < c.SHORT):
            kept.add(i)
    first = c.written(c.languages(spark, frame, SF), "first")
    assert {r["doc_id"] for r in first.collect()} == kept
    q = toxicity.ToxicityParams()
    train = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter(crc_mod("doc_id", 4) != 2).collect() if r["doc_id"] in kept}
    toxic = brute.toxic_fit([(text[i], y) for i, y in train.items()], q)
    score = {i: brute.toxic_score(text[i], toxic, q) for i in kept}
    assert min(abs(x - c.MAX_TOXIC) for x in score.values()) > 1e-4
    assert {r["doc_id"] for r in c.toxic(spark, first, SF).collect()} == {i for i in kept if score[i] < c.MAX_TOXIC}


def test_long_texts_in_pieces_are_as_whole():
    """Texts that are cut into pieces of any size give what they give as one."""
    text = ("Wörter und ｗｏｒｄｓ 𠀀𠀁, 12!! the  end\n\n" * 40 + "x" * 700 + "\n--== tail").encode()
    data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    q, t, p = quality.QualityParams(), toxicity.ToxicityParams(), language.LanguageParams()
    whole = quality._vector(data, q)
    buckets = next(toxicity._buckets(data, offs, t))
    random = np.random.default_rng(0)
    logp = np.log(random.random((len(p.orders), 1 << p.bits, 3)) + 0.01).astype(np.float32)
    share, _ = language._mixtures(data, offs, logp, p)
    for size in (1, 5, 64, 1000):
        part = quality._vector(data, q, size)
        assert all((a == b).all() for a, b in zip(whole, part, strict=True))
        units, often = language._long_units(data, logp, p, size)
        assert language._chosen(units, np.array([0, len(units)]), often.astype(float), p) == pytest.approx(share, abs=1e-9)
        seen = np.zeros(1 << t.bits, bool)
        for chars, _ in tb.pieces(data, max(t.orders) - 1, size):
            for n in t.orders:
                seen[tb.gram_buckets(tb.lowered(chars), n, t.bits, t.seed)] = True
        assert (np.flatnonzero(seen) == buckets).all()


LONG = """
import resource, numpy as np
from recollect.llm import language, quality, toxicity
words = np.array([f"word{k}x" for k in range(50_000)])
text = " ".join(np.random.default_rng(1).choice(words, 9_500_000)).encode()
data, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
p = language.LanguageParams(rounds=2)
logp = np.log(np.random.default_rng(0).random((2, 1 << p.bits, 4)) + 0.01).astype(np.float32)
language._mixtures(data, offs, logp, p)
next(toxicity._buckets(data, offs, toxicity.ToxicityParams()))
quality._vector(data, quality.QualityParams())
print(len(text) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""


def test_memory_of_a_very_long_text():
    """Beside a text of 80 MB, its features need less than 300 MB."""
    out = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 75 and int(out[1]) < 300, out
