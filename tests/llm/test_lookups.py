"""Nearest neighbours, url filters, licences, mixing and pieces."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import license_scan, mixing, pieces, posting_lists, url_filter

SF = "/root/testdata/sf0.01"


def test_nearest_recall_and_ties(spark):
    random = np.random.default_rng(3)
    x = random.normal(size=(3000, 16)) * random.uniform(0.5, 2, size=(3000, 1))
    x[100:140] = x[99]  # copies
    x = x.astype(np.float32)
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)] + [(3001, None), (3020, [0.0] * 16), (3040, [1.0]), (3060, [float("nan")] * 16), (None, [1.0] * 16), (40, list(map(float, x[40])))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"rep": F.lit(1), "list": F.lit(2)})
    got = {}
    for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0, posting_lists.PostingParams(shard=500, query_block=40)).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 3000, 20))
    exact = x.astype(np.float64)
    recall = []
    for q, found in got.items():
        s = exact @ exact[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(3000), -np.round(s, 9)))[:20])
        ids = [found[k][0] for k in range(1, 21)]
        assert q not in ids and len(set(ids)) == 20
        keys = [(-found[k][1], found[k][0]) for k in range(1, 21)]
        assert keys == sorted(keys)
        assert all(abs(found[k][1] - s[found[k][0]]) < 1e-9 for k in range(1, 21))
        recall.append(len(want & set(ids)) / 20)
    assert np.mean(recall) >= 0.9
    assert [got[100][k][0] for k in range(1, 21)] == [99, *range(101, 120)] or got[100][1][1] > exact[100] @ exact[100]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_query_s_own_parameters_reach_recall(spark, sf):
    """Several lists, and recall as the contract asks, with nothing but the defaults."""
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = zip(*((r["vec_id"], r["embedding"]) for r in df.collect()), strict=True)
    ids, x = np.array(ids), np.array(x, np.float64)
    got = {}
    for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        recall.append(len(set(ids[np.argsort(-s)[:20]]) & got[q]) / 20)
    assert len(recall) == len(got) and np.mean(recall) >= 0.9
    assert len(posting_lists.fit(x, (x * x).sum(1).max(), len(x), posting_lists.PostingParams())[0].at) >= 8


def _far_queries(n=3000, d=32, copies=1):
    """Vectors in 40 groups; those that are asked lie in none of them."""
    random = np.random.default_rng(5)
    x = 3 * random.normal(size=(40, d))[random.integers(0, 40, n)] + random.normal(size=(n, d))
    x[::20] = random.normal(size=(len(x[::20]), d))
    return np.repeat(x, copies, 0)


@pytest.mark.parametrize(("copies", "measured"), [(1, 512), (1, 60), (20, 512)])
def test_queries_unlike_the_other_rows_reach_recall(spark, copies, measured):
    x = _far_queries(3000 // copies, copies=copies)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in posting_lists.nearest(df, F.col("vec_id") % 20 == 0, posting_lists.PostingParams(measured=measured)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in range(0, 3000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        assert len(got[q]) == 20
        recall.append(len(set(best) & got[q]) / 20)
    assert np.mean(recall) >= 0.9 and np.mean(np.array(recall) >= 0.5) >= 0.95


def test_queries_alone_in_their_lists_get_all_their_rows(spark):
    """The nearest list of such a query is its own and holds nothing else."""
    far = 50 * np.eye(48)[:40]
    near = np.random.default_rng(1).normal(size=(760, 48)) * 0.01
    x = np.concatenate([far, near])
    ids = np.concatenate([np.arange(40) * 20, [i for i in range(800) if i % 20]])
    df = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    p = posting_lists.PostingParams(min_lists=60)
    got = posting_lists.nearest(df, F.col("vec_id") % 20 == 0, p).groupBy("query_id").count().collect()
    assert sorted((r["query_id"], r["count"]) for r in got) == [(20 * i, 20) for i in range(40)]


def test_nearest_keeps_doubles(spark):
    rows = [(0, [1.0, 1e-12]), (1, [1.0, 2e-12]), (2, [1.0, 3e-12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = posting_lists.nearest(df, F.col("vec_id") == 0, posting_lists.PostingParams(k=2)).collect()
    assert {r["vec_id"]: r["score"] for r in got} == {1: 1.0 + 2e-24, 2: 1.0 + 3e-24}


def test_nearest_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = posting_lists.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert posting_lists.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert posting_lists.nearest(df, F.col("vec_id") == 7).count() == 0


URLS = ["http://Www.Example.COM/en/71?x", "http://example.com/en/8", "https://a.net/de/1#t", "https://x.example.net/de/88", "http://b.org/es/", "http://b.org/fr", "no scheme", None, "", "x://", "x://HOST", "a://b://c/en/", "http://com/en/x", "http://notcom/en/x", "http://é.com?q", "h://" + "a" * 5000 + ".com/en/"]


def by_hand(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h) + len(p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark):
    df = spark.createDataFrame([*enumerate(URLS), (0, URLS[0])], "page_id long, url string").withColumns({"host": F.lit("h"), "label": F.lit(1.0), "score": F.lit(2), "features": F.lit(3)})
    labels, rules = url_filter.default_labels(spark), url_filter.default_rules(spark)
    for p in (url_filter.UrlParams(), url_filter.UrlParams(inline_rules=2)):
        got = url_filter.filter_urls(df, labels, rules, p).collect()
        assert len(got) == len(URLS) + 1
        for r in got:
            host, path, rule = by_hand(URLS[r["page_id"]])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]), URLS[r["page_id"]]
            assert r["verdict"] == (rule[1] if rule else "block" if r["score"] >= 0.5 else "allow")
    assert url_filter.filter_urls(df.limit(0), labels, rules).count() == 0
    assert url_filter.filter_urls(df, labels.limit(0), rules.limit(0)).filter("verdict = 'allow'").count() == len(URLS) + 1


def test_urls_learn(spark):
    labels = url_filter.default_labels(spark)
    df = spark.createDataFrame([(1, "https://big-casino.example.biz/slots/bonus"), (2, "https://docs.example.biz/guide/history")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, labels, url_filter.default_rules(spark)).collect()}
    assert got == {1: "block", 2: "allow"}


def test_licenses(spark):
    mit = license_scan.LICENSES["MIT"]
    odd = "Copyright (c) 2020 Somebody\n\n" + mit.replace("sublicense", "sub-license").replace(". ", ".\n").upper().replace('"', "\u201c")
    rows = [(1, mit), (2, odd), (3, None), (4, ""), (5, "  !!  "), (6, "Released under the MIT Licence!"), (7, "Released under the MIT License. And more."), (7, mit), (8, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit("d"), "license_id": F.lit("l")})
    got = sorted((r["doc_id"], r["license_id"] or "") for r in license_scan.scan(df, license_scan.known(spark)).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (5, ""), (6, "MIT-notice"), (7, ""), (7, "MIT"), (8, "")]
    assert license_scan.scan(df.limit(0), license_scan.known(spark)).count() == 0
    assert license_scan.scan(df, license_scan.known(spark).limit(0)).filter("license_id is null").count() == len(rows)


def test_licenses_among_many_documents(spark):
    """Planted whole licences, with titles, notices and other spellings, among all documents; the same in SQL."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    planted, want = [], {}
    for k, (name, text) in enumerate(license_scan.TEXTS):
        title = next((t for t in license_scan.TITLES.get(name, ()) if text.startswith(t)), "")
        body = text.removeprefix(title).strip()
        shapes = [text, f"{title}\n\nCopyright (c) 20{k % 30:02} Some Body\nAll rights reserved.\n\n{body}\n", text.upper().replace(", ", ",\n"), f"  ** {text} **\n"]
        for j, shape in enumerate(shapes):
            planted.append((100_000 + 10 * k + j, shape))
            want[100_000 + 10 * k + j] = name
        planted.append((100_000 + 10 * k + 9, text + " and one word more"))
    every = docs.union(spark.createDataFrame(planted, docs.schema))
    got = {r["doc_id"]: (r["canonical_chars"], r["digest"], r["license_id"]) for r in license_scan.scan(every, license_scan.known(spark)).collect()}
    assert {i: x[2] for i, x in got.items() if x[2] is not None} == want
    documents = every.toPandas()  # noqa: F841  DuckDB reads it by name
    con = duckdb.connect()
    sql = con.execute(license_scan.ORACLE)
    names = [d[0] for d in sql.description]
    assert {r[names.index("doc_id")]: tuple(r[names.index(c)] for c in ("canonical_chars", "digest", "license_id")) for r in sql.fetchall()} == got


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="this machine has no licence texts")
def test_whole_texts_have_the_known_digests(spark):
    texts = license_scan.read_texts(spark, "/usr/share/common-licenses").filter("license_id in ('Apache-2.0', 'CC0-1.0', 'GPL-2', 'GPL-3', 'LGPL-2.1', 'LGPL-3', 'MPL-2.0')")
    got = license_scan.scan(texts.select(F.col("license_id").alias("doc_id"), "text"), license_scan.known(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    more = license_scan.known(spark, spark.createDataFrame([("mine", "All mine."), ("none", " !! ")], "license_id string, text string"))
    got = license_scan.scan(spark.createDataFrame([(1, "ALL  mine"), (2, "!")], "doc_id long, text string"), more).collect()
    assert {r["doc_id"]: r["license_id"] for r in got} == {1: "mine", 2: None}


def test_mixing_meets_all_three_marginals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    share = lambda x: spark.createDataFrame(list(x.items()), "value string, share double")
    rows = mixing.featured(docs).groupBy("m_topic").agg(F.sum("m_tokens").alias("t")).collect()
    topics = {r["m_topic"]: r["t"] for r in rows}
    want = {"m_lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "m_topic": {k: v**0.9 / sum(x**0.9 for x in topics.values()) for k, v in topics.items()}}
    cells = mixing.probabilities(mixing.featured(docs), mixing.MixParams(strict=True), {d: share(x) for d, x in want.items()}).toPandas()
    for d, target in want.items():
        got = cells.groupby(d)["w"].sum()
        assert all(abs(got[k] - v) < 1e-9 for k, v in target.items())
    tokens = mixing.featured(docs).groupBy("m_source").agg(F.sum("m_tokens").alias("t")).toPandas().set_index("m_source")["t"]
    power = (tokens / tokens.sum()) ** mixing.MixParams().temper
    assert np.abs(cells.groupby("m_source")["w"].sum() - power / power.sum()).max() < 1e-9


def test_mixing_says_when_marginals_can_t_be_met(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "x"), (2, "d e", "de", "y")], "doc_id long, text string, lang string, source string")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"m_lang": share(en=0.5, de=0.5), "m_source": share(x=0.9, y=0.1)}
    with pytest.raises(ValueError, match="missed by up to 0.4"):
        mixing.probabilities(mixing.featured(docs), mixing.MixParams(strict=True, rounds=10), targets)
    with pytest.warns(UserWarning, match="missed"):
        assert mixing.probabilities(mixing.featured(docs), mixing.MixParams(rounds=10), targets).count() == 2


def test_mixing_rakes_to_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    share = lambda **x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"m_lang": share(en=0.4, de=0.2, fr=0.2, es=0.2)}
    cells = mixing.probabilities(mixing.featured(docs, F.lit("t")), mixing.MixParams(rounds=25), targets).toPandas()
    got = cells.groupby("m_lang")["w"].sum()
    assert all(abs(got[k] - v) < 1e-3 for k, v in {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}.items())
    assert abs((cells["p"] * cells["t"]).sum() / cells["t"].sum() - 0.5) < 0.01 and cells["p"].between(0, 1).all()


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "word", None, "a"), (3, "word", None, "a"), (None, "two words", "en", None), (5, "w " * 50_000, "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"m_p": F.lit("x"), "w": F.lit(1), "t": F.lit(2)})
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and all(0 <= r["m_p"] <= 1 for r in got)
    assert {r["m_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0} and {r["m_topic"] for r in got if r["doc_id"] == 1} == {"none"}
    assert len({r["m_kept"] for r in got if r["doc_id"] == 3}) == 1
    assert mixing.mixed(df.limit(0)).count() == 0


def test_mixing_keeps_rows_without_a_topic(spark):
    """A null topic is a topic: both halves are kept alike."""
    df = spark.range(4000).selectExpr("id as doc_id", "'a b c d' as text", "'en' as lang", "'s' as source", "case when id % 2 = 0 then 't' end as topic")
    kept = {r["topic"]: r["n"] for r in mixing.mixed(df, topic=F.col("topic")).filter("m_kept").groupBy("topic").agg(F.count("doc_id").alias("n")).collect()}
    assert set(kept) == {None, "t"} and all(900 < n < 1100 for n in kept.values())


@pytest.mark.parametrize("keep", [0.001, 0.3, 0.62, 0.97, 1.0])
def test_mixing_clips_exactly(spark, keep):
    """Some cells are kept whole, and the tokens that are expected are those that are wanted."""
    cells = spark.createDataFrame([(f"s{i}", "en", "t", 100 + i * i, 0.5**i, 10_000.0) for i in range(12)] + [("z", "en", "t", 50, 0.0, 10_000.0)], "m_source string, m_lang string, m_topic string, t long, w double, all double")
    rows = [(r["t"], r["w"] * r["all"] / r["t"]) for r in cells.collect() if r["w"] > 0]
    wanted = keep * sum(t for t, _ in rows)
    c = mixing._factor(cells.filter("w > 0").withColumn("r", F.col("w") * F.col("all") / F.col("t")), wanted)
    assert sum(t * min(1.0, c * r) for t, r in rows) == pytest.approx(wanted, rel=1e-12)
    with pytest.warns(UserWarning, match="as many tokens"):
        assert mixing._factor(cells.withColumn("r", F.lit(1.0)), 1e9) == float("inf")


TEXTS = ["", " ", "  ", "a", "Hello world", " two  spaces   and " + " " * 40 + "more ", "tabs\tand\nlines\r\n", "☃ é ñ 中文 \U0001f600", "▁mark ▁▁ marks", "x" * 3000, "no" + "space" * 900, "word " * 700, "日本語" * 400, "\x00\x7f", "the international " * 60, " " * 500, "a" + " " * 333 + "b"]


@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@pytest.mark.parametrize("chunk", [32768, 40])
def test_pieces_equal_the_library(spark, library, chunk):
    rows = [*enumerate(TEXTS), (3, "a"), (99, None), (None, TEXTS[9]), (100, TEXTS[9])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "name": F.lit("n"), "c": F.lit(1)})
    p = pieces.PieceParams(chunk=chunk)
    got = pieces.encode(df, p)
    assert sorted(got.columns) == sorted(["doc_id", "name", "c", "ids", "decoded_ok"])
    back = pieces.decode(got.select("doc_id", "ids"), p).collect()
    want = dict(rows)
    found = got.collect()
    assert len(found) == len(rows) == len(back)
    for r in found:
        text = want[r["doc_id"]]
        assert r["ids"] == (None if text is None else library.encode(text)), text
        assert r["decoded_ok"] is (None if text is None else True)
    for r in back:
        text = want[r["doc_id"]]
        assert r["text"] == (None if text is None else text.replace("▁", " "))
    assert pieces.encode(df.limit(0), p).count() == 0


def by_matrices(enc, text, chunk):
    """All of a text by transfer matrices, scan and traces, whatever its length."""
    marked, out = pieces.MARK + text.replace(" ", pieces.MARK), []
    for begin, end in pieces.parts(marked, chunk, enc.run):
        part = marked[begin:end]
        at = [*pieces.cuts(part, chunk), len(part)]
        around = [(part[max(0, s - enc.longest) : s], part[s:e], part[e : e + enc.longest]) for s, e in zip(at[:-1], at[1:], strict=True)]
        ends = pieces.scan([enc.transfer(*x) for x in around])
        out += [i for (_, mid, right), (x, y) in zip(around, ends, strict=True) for i in enc.traced(mid, right, x, y)]
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 8, 13, 34, 200])
def test_matrices_of_any_chunk_equal_the_library(spark, library, chunk):
    enc = pieces.Encoder(pieces.load_vocabulary(pieces.DEFAULT_MODEL), 100_000)
    texts = [t for t in TEXTS if t.strip()] + [r["text"][:1200] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 60 = 7").collect()]
    for t in texts:
        t = t if len(t) < 1300 else t[:1300]
        assert by_matrices(enc, t, chunk) == library.encode(t), (chunk, t[:80])


def test_long_runs_of_spaces(spark, library):
    texts = ["a" + " " * 5000 + "b", " " * 3001, "x y" + " " * 4096, " " * 2047 + "word  and" + " " * 700 + "more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode(df, pieces.PieceParams(chunk=100)).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded_ok"]
    assert len(pieces.parts(pieces.MARK + " ".join(texts).replace(" ", pieces.MARK), 100, 16)) > 50


def test_a_vocabulary_with_long_pieces():
    """Chunks see as many characters around them as the vocabulary's longest piece has."""
    whole = "abcdefghijklmnopqrstuvwxy"
    grown = [whole[:k] for k in range(2, len(whole) + 1)]
    vocabulary = [("<unk>", 0.0, 3), *((p, -float(k), 1) for k, p in enumerate(grown)), *((c, -1000.0, 1) for c in whole + pieces.MARK)]
    enc = pieces.Encoder(vocabulary, 1000)
    for text in (whole, whole * 3 + whole[:9], f"{whole} {whole[:20]} {whole}"):
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        want = [p for u in pieces._UNIT.findall(marked) for p in enc.merged(u)]
        for chunk in (3, 7, 30):
            assert [enc.pieces[i] for i in by_matrices(enc, text, chunk)] == want


def test_scan_is_associative():
    enc = pieces.Encoder(pieces.load_vocabulary(pieces.DEFAULT_MODEL), 1000)
    text = pieces.MARK + "internationalisation of the unbelievable " .replace(" ", pieces.MARK) * 4
    at = [*pieces.cuts(text, 7), len(text)]
    m = [enc.transfer(text[max(0, s - 16) : s], text[s:e], text[e : e + 16]) for s, e in zip(at[:-1], at[1:], strict=True)]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = pieces.compose(left, x)
    for x in m[-2::-1]:
        right = pieces.compose(x, right)
    assert set(left) == set(right) and len([e for e in left if e[1][1] == 0]) == 1
