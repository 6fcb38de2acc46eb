"""Near-duplicates and the metric join against brute force."""

import re
from dataclasses import replace
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import metric_join, neardup
from recollect.llm import shingles as sh
from recollect.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def as_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def least(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near(rows, percent=85):
    sets = {i: as_set(t) for i, t in rows}
    ids = [i for i in sets if i is not None and sets[i]]
    links = [(a, b) for a, b in combinations(ids, 2) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, least([i for i in sets if i is not None], links)


def varied(random, words, n):
    out = list(words)
    for _ in range(n):
        out[random.integers(len(out))] = f"x{random.integers(10**6)}"
    return " ".join(out)


def test_near_duplicates(spark):
    random = np.random.default_rng(4)
    texts = []
    for k in range(30):
        base = [f"w{random.integers(400)}" for _ in range(int(random.integers(6, 150)))]
        texts += [varied(random, base, int(random.integers(0, 3))) for _ in range(int(random.integers(1, 7)))]
    shared = " ".join(f"p{k}" for k in range(60))
    texts += [f"{shared} " + " ".join(f"q{random.integers(10**6)}" for _ in range(20)) for _ in range(60)]  # a passage, no links
    texts += ["", "   ", None, "one two", "One TWO", "a b c d e", "a b c d e f", "Ünïcode wörds here are five", "long " * 40_000, "tab\tand\nline five words\x0b"]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (0, texts[0]), (None, texts[0])], "doc_id long, text string").withColumns({"n": F.lit("a"), "keys": F.lit(1), "id": F.lit(2)})
    got = neardup.near_duplicates(df, neardup.NearDupParams(small=4, block=8)).collect()
    sets, label = near(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            i = r["doc_id"]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), label[i], label[i] == i), i
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_looser_similarity(spark):
    """Links between 0.8 and 0.85, of long and of short sets; and a bitmap so full that every set goes on."""
    random = np.random.default_rng(14)
    texts = []
    for n in (9, 14, 30, 60, 120, 400):
        for k in range(12):
            base = [f"w{n}.{k}.{j}" for j in range(n)]
            texts += [" ".join(base), " ".join(base[: n - int(random.integers(0, max(2, n // 6)))]), varied(random, base, max(1, n // 50))]
    rows = list(enumerate(texts))
    _, label = near(rows, 80)
    _, strict = near(rows)
    assert label != strict
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (neardup.LOOSE, replace(neardup.LOOSE, bitmap_bits=1, small=1, block=4, block_shingles=50)):
        assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, p).collect()} == label


def test_members_that_only_meet_in_a_bucket(spark):
    """Links between members that the star's centre isn't linked with are found in both ways of the second step."""
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(base[: 200 - 12 * k] + [f"y{k}.{j}" for j in range(12 * k)])) for k in range(4)] + [(10 + k, " ".join(base[:152] + [f"y3.{j}" for j in range(48 + k)])) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    _, label = near(rows)
    for small in (1, 100):
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, neardup.NearDupParams(small=small, bands=48, rows=2, block=2)).collect()}
        assert got == label


def test_sketch_collides_as_often_as_sets_overlap():
    random = np.random.default_rng(2)
    sketcher = sh.Sketcher(24, 6)
    for n in (8, 40, 2000):
        same = []
        for _ in range(60):
            x = np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            y = x.copy()
            y[: max(1, n // 10)] = random.integers(0, 1 << 63, max(1, n // 10), dtype=np.uint64)
            y.sort()
            same.append(np.mean(sketcher.sketch(x) == sketcher.sketch(y)) - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
        assert abs(np.mean(same)) < 0.04, n


def test_long_documents_hash_as_whole():
    text = (" ".join(f"w{k % 977}" for k in range(200_000))).encode()
    data = np.frombuffer(text, np.uint8)
    got, _ = sh.word_hashes(data, np.array([0, len(data)]))
    first, _ = sh.word_hashes(data[:5000], np.array([0, 5000]))
    assert len(got) == 200_000 and (got[:900] == first[:900]).all() and (got[977:1800] == got[: 1800 - 977]).all()


def test_components(spark):
    edges = [(5, 3), (3, 9), (9, 3), (20, 21), (21, 22), (22, 23), (7, 7), (None, 1), *((100, 100 + k) for k in range(1, 50)), *((200 + k, 201 + k) for k in range(40))]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components(df, "a", "b").collect()}
    want = least({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    assert components(df.limit(0), "a", "b").count() == 0


def vectors(random):
    rows = []
    for label in (1, 2, None):
        for _ in range(8):
            base = random.normal(size=8)
            rows += [((base + random.normal(scale=0.09, size=8)) * random.choice([1, 3]), label) for _ in range(int(random.integers(1, 12)))]
    rows += [(rows[0][0], 1), (rows[0][0], 1), (rows[0][0] * 2, 1)]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [1.0, 2.0]]
    out = [(i * 2, [float(np.float32(x)) for x in v], k) for i, (v, k) in enumerate(rows)]
    return out + [(5001 + i, v, 1) for i, v in enumerate(odd)]


def test_metric_join(spark):
    rows = vectors(np.random.default_rng(9))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "cell": F.lit("c")})
    good = {i: (np.array(v, np.float64), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a, b in combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and cos(good[a][0], good[b][0]) >= 0.98]
    n = {i: sum(i in x for x in links) for i, _, _ in rows}
    label = least([i for i, _, _ in rows], links)
    assert len(links) > 50
    for p in (metric_join.MetricJoinParams(), metric_join.MetricJoinParams(per_pivot=5, home_block=4, member_block=8), metric_join.MetricJoinParams(min_pivots=2, max_pivots=2, home_block=3, member_block=5, rings=4)):
        got = metric_join.metric_links(df, p).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (n[i], label[i], label[i] == i) for i, _, _ in rows}
    assert metric_join.metric_links(df.limit(0)).count() == 0


def test_metric_join_decides_alike_from_both_ends(spark):
    """Vectors at the threshold, in doubles and of very different lengths: links are symmetric, and have several pivots."""
    random = np.random.default_rng(19)
    rows = []
    for k in range(40):
        a = random.normal(size=6)
        b = random.normal(size=6)
        b -= a * (a @ b) / (a @ a)
        c = 0.98 * a / np.linalg.norm(a) + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b)
        rows += [(2 * k, (a * 1e200).tolist(), 1), (2 * k + 1, (c * 1e-200).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in metric_join.metric_links(df, metric_join.MetricJoinParams(home_block=8, member_block=8)).collect()}
    n = sum(r["n_links"] for r in got.values())
    assert n % 2 == 0 and n == 2 * sum(not r["kept"] for r in got.values())
    classes = df.withColumns({"rep": F.col("vec_id"), "dim": F.size("embedding")})
    assert len(metric_join._pivots(classes, metric_join.MetricJoinParams())[6]) == 8


@pytest.mark.parametrize("column", ["vec_id", "label", "embedding"])
def test_metric_join_nulls(spark, column):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    df = df.withColumn(column, F.when(F.col("vec_id") == 2, F.lit(None)).otherwise(F.col(column)))
    got = {r["vec_id"]: (r["n_links"], r["kept"]) for r in metric_join.metric_links(df).collect()}
    assert got[1] == (0, True) and got[None if column == "vec_id" else 2] == (0, True)
