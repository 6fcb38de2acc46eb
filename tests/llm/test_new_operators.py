"""Hard negatives, BPE and conversation repair."""

import hashlib
import itertools
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import bpe, conversations, hard_negatives, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_conversations"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(found.columns)
    want, have = Counter(got.fetchall()), Counter(tuple(r) for r in found.select(*names).collect())
    assert want and want == have


def mined(rows, is_anchor, positives=5, negatives=3):
    """Every pair's score, in plain loops."""
    rows = sorted({(i, lab, tuple(int(np.floor(c)) for c in v)) for i, lab, v in rows})
    out = []
    for i, lab, v in rows:
        if is_anchor(i):
            scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
            for s, j, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
                ok = sorted(x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s)[:negatives]
                out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(ok, 1)]
    return Counter(out)


@pytest.mark.parametrize("few", [0.0, 0.1, 2.0])
def test_mining_against_all_pairs(spark, few):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 6)) * 40)
    x[200:440] = x[199]  # a third of all rows, and ties
    labels = np.where(rng.random(700) < 0.4, 1, rng.integers(0, 5, 700))
    good = [(int(i), int(lab), [float(c) for c in v]) for i, (lab, v) in enumerate(zip(labels, x))]
    good += [(701, 1, [0.0] * 6), (750, 2, [0.0] * 6), (800, 1, [1.0, 2.0]), (801, 1, [3.0, -2.0]), (802, 2, [2.0, 0.4]), good[50], (850, 3, []), (851, 3, [])]
    odd = [(900, None, [1.0] * 6), (None, 1, [1.0] * 6), (950, 1, None), (1000, 1, [1.0, None] * 3), (1050, 1, [float("nan")] * 6), (1100, 1, [float("inf")] * 6), (1150, 1, [1e300] * 6)]
    df = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<double>").withColumns({"row_": F.lit(1), "score": F.lit(2)})
    p = hard_negatives.MiningParams(anchor_block=5, block=90, rows_at_once=3, few=few)
    got = Counter(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, p).collect())
    assert got == mined(good, lambda i: i % 50 == 0)
    assert hard_negatives.mine(df.filter("false"), F.col("vec_id") % 50 == 0, p).count() == 0


def test_intervals_drop_pairs_but_no_answer():
    """Planes tighten the intervals; whatever is dropped on the way, scores found are exact."""
    rng = np.random.default_rng(1)
    a, y = rng.integers(-300, 300, (20, 16)), rng.integers(-300, 300, (500, 16))
    lo, hi = np.full((20, 1), -hard_negatives.NEVER), np.full((20, 1), hard_negatives.NEVER)
    row, _, at, score = hard_negatives.best(a, y, np.arange(500), np.ones((20, 500), bool), lo, hi, 4)
    whole = a @ y.T
    assert (whole[row, at] == score).all()
    assert (np.sort(score.reshape(20, 4)) == np.sort(whole, axis=1)[:, -4:]).all()


def test_mining_is_dealt_over_tasks(spark):
    """Groups of few bytes are much work: they don't end up in one task."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.col("id").alias("row_"), (F.col("id") % 3).alias("label"), F.array(F.col("id").cast("int"), F.lit(1)).alias("x"), F.lit(2).alias("dim"))
    asked = rows.filter("vec_id % 50 = 0").withColumns({"lo": F.array(F.lit(-hard_negatives.NEVER)), "hi": F.array(F.lit(hard_negatives.NEVER))})
    found = hard_negatives._meet(rows, asked, ["dim"], False, 2, hard_negatives.MiningParams(anchor_block=20, block=500))
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_best_rows_over_many_tiles():
    """Ties go to smaller ids wherever their rows stand, and a window that is full still takes better rows."""
    rng = np.random.default_rng(3)
    a, y, ids = rng.integers(-40, 40, (7, 5)), rng.integers(-3, 4, (9000, 5)), rng.permutation(9000)
    lo, hi = np.tile([-60, 10, 5], (7, 1)), np.tile([90, 120, -5], (7, 1))
    got = hard_negatives.best(a, y, ids, lambda i, r: (i + r) % 3 > 0, lo, hi, 4, at_once=3)
    want = set()
    for i, w in itertools.product(range(7), range(2)):
        ok = [(-int(s), int(ids[r]), r) for r, s in enumerate(y @ a[i]) if (i + r) % 3 and lo[i, w] <= s <= hi[i, w]]
        want |= {(i, w, r, -s) for s, _, r in sorted(ok)[:4]}
    assert set(zip(*(c.tolist() for c in got))) == want


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)


def test_bpe_equals_the_library(spark, library):
    r = random.Random(1)
    letters = [*"abcdefghijklmnopqrstuvwxyzABCDEFéèüßÑñ 0123456789  \n\t'.,!?-_<>|Σσς́̈日本\U0001f600\x00\x85​İ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "the "]
    texts = ["", None, " ", "a" * 20_000, "ab" * 9_000 + "!?" * 3_000, "It's <|endoftext|>I'LL", "é ́ x", "word " * 9_000, "same", "same"]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 150))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"IDS": F.lit("x"), "c0": F.lit(7), "a b`c": F.lit(8)})
    out = bpe.encode(df, bpe.BpeParams(slice=700, memory=50, longest=9), decoded="back")
    assert out.columns == ["doc_id", "text", "c0", "a b`c", "ids", "back"]
    again = bpe.decode(out.drop("back"), text="back").select("doc_id", F.col("back").alias("again"))
    rows = {x["doc_id"]: x for x in out.join(again, "doc_id").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want and rows[i]["c0"] == 7
        assert rows[i]["back"] == rows[i]["again"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(df.filter("false")).count() == 0


def test_bpe_query(spark, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_bpe_cuts_are_certain(library):
    """Fragments encoded on their own give the ids of the word; some words are cut, and ids that don't exist decode to nothing."""
    import pyarrow as pa

    e = bpe.Encoder(bpe.load_vocabulary(bpe.DEFAULT_VOCABULARY), bpe.BpeParams())
    assert 0 < e.inside.mean() < 0.1
    words = ["éxüqzj", "the", "zzqq" * 80, "a", "aaaa" * 60, "aaaaa"]
    assert [np.frombuffer(x, np.int32).tolist() for x in e.encoded(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert e.decode(pa.array([[320, -1, 99_999_999, None], None, []], pa.list_(pa.int32()))).to_pylist() == ["a</w>", None, ""]


def repaired(signature):
    """The cheapest repair by trying all edits, row by row, in plain recursion over (row, initials so far)."""
    best = {}
    todo = [("", 0, 0, "")]  # audit, rows done, cost, state
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    while todo:
        audit, i, cost, q = todo.pop()
        key = i, q
        # No pruning by text: all ways up to the least cost so far, inserts bounded by what they could save.
        if audit.count("I") > len(signature) or cost > 2 * len(signature):
            continue
        if i == len(signature) and q in ("", "a"):
            best.setdefault(cost, []).append(audit)
        for r in "ua":
            if r in follow[q] and not audit.endswith("II"):
                todo.append((audit + "I", i, cost + 5, r))
        if i < len(signature):
            x = signature[i]
            todo.append((audit + "D", i + 1, cost + 2, q))
            if x != "d":
                more = 5 * x.isupper()
                if x.lower() in follow[q]:
                    todo.append((audit + "K", i + 1, cost + more, x.lower()))
                todo += [(audit + "R", i + 1, cost + 1 + more, r) for r in "ua" if r in follow[q]]
        assert key
    least = min(best)
    return least, min(best[least])


def test_trie_gives_the_cheapest_repair():
    trie = conversations.Trie()
    signatures = ["", *sorted("".join(s) for n in (1, 2, 3) for s in itertools.product("dsuaoUS", repeat=n))]
    r = random.Random(4)
    signatures = sorted(signatures + ["".join(r.choice("ddsuauauaoUA") for _ in range(6)) for _ in range(150)])
    for s in signatures:
        assert trie.repair(s) == repaired(s), s
    alone = sum(map(len, set(signatures)))
    assert trie.computed < 0.7 * alone  # prefixes are shared


def test_repair_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, None, "system", "Be kind."), (1, 5, "tool", "x"),
        (2, None, None, None), (2, 3, "user", " \t\n"), (None, 1, "user", "One?"), (None, 2, "assistant", "Two"),
        (3, 1, "user", "y" * 300_000 + "!"), (3, 2, "user", "z" * 10 + "!\x0b "), (4, None, "a", "b."), (4, None, "a", "b."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"cost": F.lit(1), "at_": F.lit(2), "signature": F.lit(3)})
    got = {r["conv_id"]: r for r in conversations.repair(df).collect()}
    a = got[1]
    assert (a["gaps"], a["blank"], a["duplicate"], a["truncated"], a["illegal"]) == (3, 0, 1, 1, 2)
    assert (a["cost"], a["audit"], [tuple(t) for t in a["repaired"]]) == (4, "KKKDD", [("system", "Be kind."), ("user", "Hi."), ("assistant", "Hello.")])
    assert (got[2]["blank"], got[2]["cost"], got[2]["audit"], got[2]["repaired"], got[2]["gaps"]) == (2, 4, "DD", [], 0)
    assert (got[None]["truncated"], got[None]["cost"], got[None]["audit"]) == (1, 4, "DD")
    assert (got[3]["cost"], got[3]["audit"], got[3]["repaired"][1]["role"], len(got[3]["repaired"][0]["text"])) == (1, "KR", "assistant", 300_001)
    assert (got[4]["duplicate"], got[4]["gaps"], got[4]["cost"], got[4]["audit"]) == (1, 0, 4, "DD")
    assert conversations.repair(df.filter("false")).count() == 0
