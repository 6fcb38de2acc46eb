"""Operators on literal rows, with values worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from recollect.functions import score as s
from recollect.functions.hashes import fnv_12
from recollect.functions.injected import strip_blocks
from recollect.functions.rules import prompt_class
from recollect.functions.text import chunks
from recollect.operators import access, dataset, digest, facts, graph, mutations, recall, sets, telemetry, timeline
from recollect.sources import logs, transcripts


@pytest.fixture
def ranges(spark):
    """Small tables in several ranges, as large ones are."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(*w):
    return F.array(*map(F.lit, w)) if w else F.array().cast("array<string>")


def test_tiebreak_anchors(spark):
    assert one(spark, s.tiebreak(words("a"), words("a"), words())) == pytest.approx(1.13)
    assert one(spark, s.tiebreak(words("a", "b"), words("a"), words())) == pytest.approx(1.065)
    assert one(spark, s.tiebreak(words("a"), words("a"), words("a"))) == pytest.approx(1.15)


def test_recency_anchors(spark):
    at = lambda days: F.expr(f"TIMESTAMP '2024-01-01' - INTERVAL '{days}' DAY")
    assert one(spark, s.recency(at(180), "2024-01-01")) == pytest.approx(0.5)
    assert one(spark, s.recency(at(4000), "2024-01-01")) == 0.25
    assert one(spark, s.recency(at(-5), "2024-01-01")) == 1.0
    assert one(spark, s.recency(F.lit(None).cast("timestamp"), "2024-01-01")) == 1.0
    assert one(spark, s.recency(at(180), "2024-01-01", half_life=0)) == 1.0


def test_rounding_is_half_up(spark):
    assert one(spark, s.rounded(F.lit(-2.5), 0)) == -2.0
    assert one(spark, s.corroboration(F.lit(1))) == 1.0
    assert one(spark, s.corroboration(F.lit(10_000))) == 2.0


def test_bands_are_disjoint(spark):
    kw = spark.createDataFrame([("q", "a", 8.0), ("q", "b", 2.0)], "q string, d string, score double")
    sem = spark.createDataFrame([("q", "b", 0.9), ("q", "c", 0.8)], "q string, d string, score double")
    got = dict(values(recall.hybrid(kw, sem, "q", "d"), "d", "score"))
    assert got["a"] == 1.0 and 0.5 <= got["b"] < 1.0 and got["c"] < 0.5


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple", "", "pear plum"), (2, "", "", "apple fig fig"), (3, "", "", "nut nut"), (4, "", "", "oak")], "id long, label string, summary string, body string")
    asked = spark.createDataFrame([("q", "apple apple")], "q string, t string")
    got = dict(values(recall.keyword_scores(docs, asked, "id", "q", "t"), "id", "score"))
    idf = 1e-6  # in half of the documents
    avg = (3 + 3 + 2 + 1) / 4
    want = lambda f, n: 2 * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / avg))
    assert got == {1: pytest.approx(want(10, 3)), 2: pytest.approx(want(1, 3))}


def test_pointer_cycles_by_pieces(spark, monkeypatch):
    """Circles inside of pieces and across them, ways into them and ways that end; of rows in order only few go through the rounds."""
    import random

    r = random.Random(2)
    points = {k: k + 1 for k in range(4999)} | {5000 + k: 5000 + (k + 1) % 3000 for k in range(3000)} | {9000 + k: r.choice([None, *range(9000, 9400), 12, 5005, -1]) for k in range(400)}
    on = set()
    for k in points:
        seen, at = {}, k
        while at in points and points[at] not in (None, at) and at not in seen:
            seen[at], at = len(seen), points[at]
        on |= {x for x, n in seen.items() if at in seen and n >= seen[at]}
    assert len(on) > 3000
    ranked, sizes = graph._ranked, []
    monkeypatch.setattr(graph, "_ranked", lambda pointing, steps: sizes.append(pointing.count()) or ranked(pointing, steps))
    monkeypatch.setattr(graph, "HERE", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    rows = list(points.items())
    for n, given in enumerate((rows, r.sample(rows, len(rows)))):
        df = spark.createDataFrame([(f"n{a}", None if b is None else f"n{b}") for a, b in given], "a string, b string")
        assert values(graph.pointer_cycles(df, "a", "b"), "node") == sorted((f"n{k}",) for k in on)
        assert n or max(sizes) < 700
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shuffle_files_go_with_the_job_that_wrote_them(spark):
    """A step's shuffle files are gone when it is written, and the setting is what it was before."""
    import os
    import time

    from recollect.operators.tables import CLEANUP, written

    def files():
        return {f for top, _, names in os.walk(spark.conf.get("spark.local.dir")) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before, kept = files(), spark.conf.get(CLEANUP, None)
    rows = written(spark.range(20000).withColumn("k", F.col("id") % 7).groupBy("k").agg(F.collect_list("id").alias("all")), "step")
    assert rows.count() == 7 and spark.conf.get(CLEANUP, None) == kept
    late = time.time() + 20
    while files() - before and time.time() < late:
        time.sleep(0.2)
    # The count of the rows is a job of its own, with a file for each task at most.
    assert sum(spark.sparkContext._jvm.java.io.File(f).length() for f in files() - before) < 1000


def test_similar_sets_leave_few_pairs(spark, monkeypatch):
    """Sets that share a single item but lack others by their bits aren't written as pairs; results are those of all pairs."""
    import random

    from recollect.operators import sets as module

    r = random.Random(4)
    sets = {k: frozenset(r.sample(range(60), r.choice([1, 2, 3, 4, 5, 9]))) for k in range(400)}
    df = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "id long, s array<long>")
    written, sizes = module.written, {}

    def counted(table, name="step"):
        out = written(table, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(module, "written", counted)
    for t in (0.5, 0.75, 1.0):
        want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= t * len(x | y)}
        got = {(x["a"], x["b"]): x["similarity"] for x in module.similar_sets(df, "id", "s", t).collect()}
        assert got == pytest.approx(want) and want
        assert sizes["pairs"] < 2 * len(want) + 10


def test_phrases_by_hand(spark):
    """A token that an index splits is a phrase: side by side, in one field, with a document frequency of its own; places overlap."""
    rows = [(1, "see foo-bar.ts", "", "x"), (2, "", "", "foo x bar ts"), (3, "foo", "bar ts", ""), (4, "", "FOO_bar", "ts foo bar TS."), (5, "", "", "a a a b"), (6, "", "Caf\u00e9 ol\u00e9", "cafe\u0301"), (7, None, None, None)]
    docs = spark.createDataFrame(rows, "id long, label string, summary string, body string")
    score = lambda text, **more: dict(values(recall.keyword_scores(docs, spark.createDataFrame([("q", text)], "q string, t string"), "id", "q", "t", **more), "id", "score"))
    avg = (5 + 4 + 3 + 6 + 4 + 3 + 0) / 7
    part = lambda df, f, n: math.log((7 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / avg))
    assert score("foo-bar.ts") == {1: pytest.approx(part(2, 10, 5)), 4: pytest.approx(part(2, 1, 6))}
    assert score("Foo.BAR") == {1: pytest.approx(part(2, 10, 5)), 4: pytest.approx(part(2, 5, 6))}
    assert score("a-a") == {5: pytest.approx(part(1, 2, 4))}
    assert score("cafe") == {6: pytest.approx(part(1, 5, 3))} and score("caf") == {} and score("... \u00e9") == {}
    assert len(score("foo bar ts", k=2)) == 2 and len(score("foo bar ts")) == 4
    assert score("ts. ts")[1] == pytest.approx(2 * score("ts")[1])


def test_words_of_many_phrases_are_not_paired_with_them(spark):
    """What is matched are occurrences of phrases, and not every phrase that has a word wherever the word stands; long phrases are intersected."""
    docs = spark.createDataFrame([(1, "the", "the one the two", "the one " * 50 + "the x"), (2, "", "b", "a b " * 6)], "id long, label string, summary string, body string")
    phrases = [f"the {x}" for x in ("one", "two", "x", *range(200))] + ["a b a b a b a", "b a b a b b", "a b a b", "a b a b a b a b a b a b a b"]
    wanted = spark.createDataFrame([(p, n) for n, p in enumerate(phrases)], "phrase string, n long")
    rows, pieces = recall.matches(docs, wanted, "id")
    assert pieces and rows.filter("id = 1 and n >= 0").count() == 53
    got = {(x["id"], x["n"]): x["f"] for x in recall.postings(docs, wanted, "id").collect()}
    assert got == {(1, -1): 107, (2, -1): 13, (1, 0): 54, (1, 1): 4, (1, 2): 1, (2, 203): 3, (2, 205): 5}


def test_phrases_against_every_place(spark):
    """Random texts and queries, in one pass and in blocks, against a plain loop over all places."""
    import random
    import re
    from collections import Counter

    from recollect.operators import blocks

    r = random.Random(3)
    words = lambda n: "".join(r.choice("abc") + r.choice([" ", "-", ".", " "]) for _ in range(r.randrange(n)))
    docs = [(i, words(5), words(9), words(30)) for i in range(80)]
    asked = [(f"q{i}", words(6)) for i in range(12)]
    index = lambda t: re.findall("[a-z0-9]+", t.lower())
    lens = {d[0]: sum(len(index(t)) for t in d[1:]) for d in docs}
    avg, want = sum(lens.values()) / len(docs), {}
    for q, text in asked:
        for phrase, times in Counter(" ".join(index(t)) for t in re.findall("[A-Za-z0-9][A-Za-z0-9_.-]*", text)).items():
            p = phrase.split()
            f = {d[0]: sum(w * sum(t[k : k + len(p)] == p for k in range(len(t))) for t, w in zip(map(index, d[1:]), (10, 4, 1))) for d in docs}
            df = sum(x > 0 for x in f.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            for d, x in f.items():
                if x:
                    want[q, d] = want.get((q, d), 0) + times * idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * lens[d] / avg))
    frame = spark.createDataFrame(docs, "id long, label string, summary string, body string"), spark.createDataFrame(asked, "q string, t string")
    few = blocks.FEW
    try:
        for blocks.FEW in (few, 0):
            got = {(x["q"], x["id"]): x["score"] for x in recall.keyword_scores(*frame, "id", "q", "t").collect()}
            assert got == pytest.approx(want)
            top = recall.keyword_scores(*frame, "id", "q", "t", k=3, digits=6).collect()
            best = {q: sorted(((-round(x, 6), d) for (p, d), x in want.items() if p == q))[:3] for q, _ in asked}
            assert {(x["q"], x["id"]) for x in top} >= {(q, d) for q, rows in best.items() for _, d in rows}
    finally:
        blocks.FEW = few


def test_nearest_by_groups_and_penalties(spark):
    """Both ways of meeting, ties, own rows, groups over several tasks, penalties, rounding, lengths that differ and nulls."""
    import numpy as np

    from recollect.operators import blocks

    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(300, 4)), 1)
    x[100:180] = x[99]
    rows = [(i, [float(c) for c in v], f"g{i % 7}", i % 3 == 0, i % 5 % 2) for i, v in enumerate(x)] + [(900, None, "g1", True, 0), (901, [1.0], "g9", False, 1)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, g string, negative boolean, survived int").repartition(5)
    asked = df.filter("id % 30 = 9 or id >= 900").select(F.col("id").alias("q"), "embedding")
    dist = {(q, i): math.sqrt(sum((a - b) ** 2 for a, b in zip(x[q], x[i]))) for q in range(9, 300, 30) for i in range(300)}
    few = blocks.FEW
    try:
        for blocks.FEW in (few, 0):
            got = values(recall.nearest(df, asked, "id", "q", 6, others=True), "q", "rank", "id")
            assert [g for g in got if g[0] < 900] == [(q, k + 1, i) for q in range(9, 300, 30) for k, (_, i) in enumerate(sorted((dist[q, i], i) for i in range(300) if i != q)[:6])]
            assert [g for g in got if g[0] >= 900] == []
            least = {q: sorted((min(dist[q, i] for i in range(j, 300, 7)), f"g{j}") for j in range(7))[:4] for q in range(9, 300, 30)}
            got = values(recall.nearest(df, asked, "id", "q", 4, group="g"), "q", "rank", "g")
            assert [g for g in got if g[0] < 900] == [(q, k + 1, g) for q, gs in least.items() for k, (_, g) in enumerate(gs)]
            cost = lambda q, i: math.floor((dist[q, i] + 0.05 * (i % 5 % 2 == 0) + 0.1 * (i % 3 == 0)) * 1e4 + 0.5) / 1e4
            got = values(recall.code_search(df, asked, "q", "id", 5), "q", "rank", "id", "cost")
            assert [g for g in got if g[0] < 900] == [(q, k + 1, i, c) for q in range(9, 300, 30) for k, (c, i) in enumerate(sorted((cost(q, i), i) for i in range(300) if i != q)[:5])]
    finally:
        blocks.FEW = few


def test_select_hits_budget(spark):
    hits = spark.createDataFrame([("c", f"i{k}", float(k)) for k in range(10)], "c string, id string, score double")
    used = spark.createDataFrame([("c", f"u{k}") for k in range(8)] + [("c", "i9")], "c string, id string")
    assert values(recall.select_hits(hits, used, "c", "id", 1.0), "id", "pick") == [("i8", 1)]


def test_fact_acceptance_rejects_retired(spark):
    rows = spark.createDataFrame([(1, None, 0, 0.9, "open"), (2, "x", 0, 0.9, "open"), (3, "x", 1, 0.9, "open")], "id int, superseded_by string, retired int, confidence double, kind string")
    assert values(rows.filter(facts.accepted(superseded=True)), "id") == [(1,), (2,)]
    assert values(rows.filter(facts.accepted()), "id") == [(1,)]


def test_diamond_is_no_cycle(spark):
    diamond = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "x string, y string")
    assert values(graph.on_cycles(diamond, "x", "y"), "node") == []
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "x string, y string")
    assert values(graph.on_cycles(ring, "x", "y"), "node") == [("a",), ("b",), ("c",)]


def walked(pointers):
    """Each node's survivor, hops and whether it runs in a circle, step by step."""
    out = {}
    for n in pointers:
        seen, at = [], n
        while at not in seen and pointers.get(at) is not None and pointers[at] != at:
            seen.append(at)
            at = pointers[at]
        out[n] = (at, seen.index(at) if at in seen else len(seen), at in seen)
    return out


def test_pointers_lead_where_a_walk_ends(spark):
    """Ends, missing nodes, a loop, circles of two and three with tails of their own: q->a gives a, whatever its circle holds."""
    import random

    r = random.Random(2)
    made = {"a": "b", "b": "a", "q": "a", "qq": "q", "x": "y", "y": "z", "z": "x", "t": "y", "m": "gone", "s": "s", "e": None, "f": "e"}
    made |= {f"n{i}": r.choice([None, *(f"n{r.randrange(60)}" for _ in range(9))]) for i in range(60)}
    made |= {f"c{i}": f"c{i + 1}" for i in range(70)}
    got = graph.resolved(spark.createDataFrame(list(made.items()), "id string, into string"), "id", "into").collect()
    assert {x["id"]: (x["survivor"], x["hops"], x["circular"]) for x in got} == walked(made)
    assert graph.resolved(spark.createDataFrame([], "id string, into string"), "id", "into").count() == 0


def test_long_chains_take_few_rounds(spark, ranges, monkeypatch):
    """A chain of 10,000: the rounds are the logarithm of its length, and no session is cut off."""
    rounds, keep = [], graph.Steps.keep
    monkeypatch.setattr(graph.Steps, "keep", lambda self, df, name="step": rounds.append(name) or keep(self, df, name))
    n = 10_000
    rows = spark.range(n).selectExpr("cast(id as string) as id", f"case when id < {n - 1} then 'replaced' else 'active' end as status", "timestamp_seconds(id) as started_at", "cast(id + 1 as string) as replaced_by")
    lost = spark.createDataFrame([("o", "replaced", None), ("p", "replaced", "o"), ("u", "replaced", "w"), ("w", "replaced", "u"), ("g", "replaced", "none")], "id string, status string, replaced_by string")
    got = graph.threads(rows.unionByName(lost.withColumn("started_at", F.lit(None).cast("timestamp")).select(rows.columns)))
    by = {x["id"]: x for x in got.collect()}
    assert len(by) == n + 5 and len(rounds) < 25
    assert all(by[str(i)]["head"] == str(n - 1) and by[str(i)]["hops"] == n - 1 - i and by[str(i)]["position"] == i + 1 for i in range(n - 1))
    assert by[str(n - 1)]["kind"] == "live" and {by[x]["kind"] for x in "opuwg"} == {"orphan"}


def test_cascade_takes_current_facts_only(spark):
    """Of the successor's facts only a current one counts; it replaces what superseded the predecessor's fact before."""
    sessions = spark.createDataFrame([("p", "active"), ("s", "active")], "id string, status string")
    edges = spark.createDataFrame([("old", "p", "supersedes")], "from_session string, to_session string, kind string")
    marks = spark.createDataFrame([("p", "s", "ok")], "predecessor string, successor string, verdict string")
    rows = [("p1", "p", "x", "is", "z9"), ("p2", "p", "y", "is", None), ("p3", "p", "w", "is", "z8"), ("s1", "s", "x", "is", None), ("s2", "s", "x", "is", "s1"), ("s3", "s", "y", "is", "s9")]
    facts_ = spark.createDataFrame(rows, "id string, session_id string, subject string, predicate string, superseded_by string")
    now, links, owned = mutations.superseded_sessions(sessions, edges, facts_, marks)
    assert values(links, "from_session", "to_session") == [("s", "p")] and values(now, "id", "status") == [("p", "superseded"), ("s", "active")]
    assert values(owned.na.fill("-"), "id", "superseded_by", "cascaded") == [("p1", "s1", True), ("p2", "-", False), ("p3", "z8", False), ("s1", "-", False), ("s2", "s1", False), ("s3", "s9", False)]


def test_embeddings_stay_lost(spark):
    facts_ = spark.createDataFrame([(k, None, 0) for k in "abcdef"] + [("z", "a", 0)], "id string, superseded_by string, retired int")
    writes = [("a", "supersede", "b", 1), ("a", "supersede", None, 2), ("b", "supersede", "c", 3), ("b", "embed", None, 4), ("c", "supersede", "c", 5), ("c", "supersede", "zz", 6), ("d", "retire", "1", 7), ("d", "retire", "0", 8), ("q", "retire", "1", 9), ("e", "embed", None, 1), ("e", "retire", "1", 2), ("z", "supersede", None, 1)]
    w = spark.createDataFrame(writes, "id string, action string, by string, pos int")
    got = {r["id"]: (r["superseded_by"], r["retired"], r["embedded"]) for r in mutations.fact_versions(facts_, w).collect()}
    assert got == {"a": (None, 0, False), "b": ("c", 0, True), "c": (None, 0, True), "d": (None, 0, False), "e": (None, 1, False), "f": (None, 0, True), "z": (None, 0, False)}
    assert values(mutations.fact_writes(facts_, w).filter("error is not null"), "pos", "error") == [(5, "self"), (6, "missing target"), (9, "missing")]


def test_pruning_of_exemplars(spark):
    rows = spark.createDataFrame([(1, "a", 0, 50), (2, "b", 0, 50), (3, "a", 1, 5), (4, "a", None, 50), (5, "a", 0, 5), (6, None, 0, None)], "id int, scope string, survived int, ts int")
    assert values(mutations.pruned_exemplars(rows, "a", "10"), "id", "reason") == [(1, "reverted"), (3, "old"), (5, "reverted")]
    assert values(mutations.pruned_exemplars(rows, older_than="10"), "id") == [(3,), (5,)] and mutations.pruned_exemplars(rows).count() == 0


def test_marking_verdicts(spark):
    edges = spark.createDataFrame([("b", "a", "supersedes"), ("c", "b", "supersedes")], "from_session string, to_session string, kind string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    wanted = spark.createDataFrame([("a", "a"), ("c", "a"), ("a", "zz"), ("d", "c")], "predecessor string, successor string")
    assert values(graph.marked_superseded(edges, wanted, ids), "predecessor", "successor", "verdict") == [("a", "a", "self"), ("a", "zz", "missing"), ("c", "a", "cycle"), ("d", "c", "ok")]


def test_spans_include_the_gap(spark):
    rows = spark.sql("SELECT 1 AS u, timestamp_seconds(x) AS ts FROM VALUES (0), (300), (601), (700) AS t(x)")
    assert [(a // 1_000_000, b // 1_000_000, n) for a, b, n in values(timeline.spans(rows, "u"), "start_us", "end_us", "n")] == [(0, 300, 2), (601, 700, 2)]


def test_interval_union_keeps_minutes(spark):
    day = 86_400_000_000
    rows = spark.createDataFrame([(0, 10), (5, 20), (20, 30), (40, 50), (day - 5, day + 5), (day + 3, day + 9)], "start_us long, end_us long")
    assert values(timeline.merged(rows), "start_us", "end_us") == [(0, 30), (40, 50), (day - 5, day + 9)]


def test_set_predecessors(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], 1), (2, ["b", "a", "a"], 2), (3, ["a"], 3), (4, ["a", "b"], 4)], "id int, m array<string>, t int")
    assert values(sets.predecessors(rows, "id", "m", "t", "id"), "id", "predecessor") == [(2, 1), (4, 2)]
    assert values(sets.predecessors(rows, "id", "m", "t", "id", as_of=False), "id", "predecessor") == [(1, 4), (2, 4), (4, 2)]


def test_merge_suggestions_need_a_floor(spark):
    with pytest.raises(ValueError):
        sets.merge_suggestions(None, 0.3)


def test_overlay_last_write_wins(spark):
    rows = [(1, "rename_entity", "entity", "e", '{"to": "f"}'), (2, "rename_entity", "entity", "e", '{"to": " "}'), (3, "label_entity", "entity", "e", '{"new_type": "t"}'), (4, "label_entity", "entity", "e", "broken"), (5, "snooze", "alert", "a", '{"snoozed_until": "2020-01-01T00:00:00"}')]
    df = spark.createDataFrame([(*r, None) for r in rows], "id int, kind string, subject_type string, subject_id string, payload string, reverted_by int")
    assert values(mutations.overlay(df, "2024-01-31 00:00:00"), "kind", "value") == [("label_entity", "t")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x")], "id int, a string, b string")
    new = spark.createDataFrame([(1, None, None), (2, "n", "m")], "id int, a string, b string")
    once = mutations.upsert(old, new, "id", keep=["a"], fill=["b"])
    assert values(once, "id", "a", "b") == values(mutations.upsert(once, new, "id", keep=["a"], fill=["b"]), "id", "a", "b") == [(1, "a", "x"), (2, "n", "m")]


def test_tenant_and_limits():
    with pytest.raises(ValueError):
        access.tenant(None, "")
    assert [access.clamp_limit(x) for x in (None, math.nan, 0, 7, 1e9)] == [1, 1, 1, 7, 100]


def test_prompt_classes(spark):
    for text, want in (("ok", "skip"), ("<system-reminder>write x</system-reminder>", "skip"), ("please draft a note", "generative"), ("ok so why does X fail", "evaluate"), ("", "skip"), ("!!!", "skip")):
        assert one(spark, prompt_class(F.lit(text))) == want, text


def test_injected_blocks_go(spark):
    text = "hello\n## Known\n- a\nTools: x\n\n\n\nbye"
    assert one(spark, strip_blocks(F.lit(text), ["## Known"])) == "hello\n\nbye"
    assert one(spark, strip_blocks(F.lit("## Known\nno footer"), ["## Known"])) == "## Known\nno footer"


def test_chunks_overlap(spark):
    got = one(spark, chunks(F.lit("h"), F.lit("abcdefghijklmnopqrstuvwxyz"), 10, 3))
    assert got[0] == "h abcdefgh" and all(len(c) <= 10 for c in got) and got[-1].endswith("z") and got[1].startswith("fgh")


def test_fnv(spark):
    rows = spark.createDataFrame([("",), ("a",), (None,)], "t string").select(fnv_12(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in rows] == ["cbf29ce48422", "af63dc4c8601", None]


def test_log_reader_skips_bad_lines(spark, tmp_path):
    good = {"ts": "2024-01-30T10:00:00Z", "conversation_id": "c1", "cited_id": "s1"}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "{broken", "", json.dumps({"cited_id": "s2"}), json.dumps(good | {"ts": "2023-01-01T00:00:00Z"})]))
    rows = logs.read_log(spark, str(tmp_path / "log.jsonl"), logs.CITATION_LOG, "2024-01-31", 14)
    assert values(rows, "cited_id") == [("s1",)]
    logs.append_log(spark.createDataFrame([("unknown",), ("c9",)], "conversation_id string"), str(tmp_path / "out"), "conversation_id")
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_transcript_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in [{"c": "hi", "r": "user"}, {"c": [{"text": "yo"}]}]) + "\nnot json\n")
    turns = transcripts.generic_jsonl(transcripts.lines(spark, str(tmp_path)), {"content": "c", "role": "r"})
    got = transcripts.sessions(turns, transcripts.titled).first()
    assert got["body"] == "User: hi\n\nAssistant: yo" and got["label"] == "hi"


def test_lines_of_a_file_in_splits(spark, tmp_path):
    """A file in many splits: every line once, its byte offset, and an order that needs no offsets."""
    import random

    r = random.Random(4)
    made = ["".join(r.choice("ab\u00e9 \u4e2d") for _ in range(r.choice([0, 1, 5, 40, 900]))) + r.choice(["", "\r"]) for _ in range(3000)]
    (tmp_path / "one.jsonl").write_bytes("\n".join(made).encode())
    (tmp_path / "two.jsonl").write_bytes(b"x\n\ny\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        exact = transcripts.lines(spark, str(tmp_path), blank=True, exact=True)
        assert spark.read.text(str(tmp_path / "one.jsonl")).rdd.getNumPartitions() > 10
        got = sorted((x["pos"], x["line"]) for x in exact.collect() if x["file"].endswith("one.jsonl"))
        at, want = 0, []
        for m in made:
            want.append((at, m.removesuffix("\r")))
            at += len(m.encode()) + 1
        assert got == want
        rough = transcripts.lines(spark, str(tmp_path))
        rows = sorted((x["pos"], x["line"]) for x in rough.collect() if x["file"].endswith("one.jsonl"))
        assert [x for _, x in rows] == [x for _, x in want if x.strip(" ")] and len({p for p, _ in rows}) == len(rows)
        assert values(exact.filter("file like '%two.jsonl'"), "pos", "line") == [(0, "x"), (2, ""), (3, "y")]
    finally:
        spark.conf.set(name, before)


def test_agents_have_sessions_of_their_own(spark):
    line = lambda **x: json.dumps(x)
    said = lambda kind, text, **x: line(type=kind, message={"role": kind, "content": text}, **x)
    rows = [
        ("/p/main.jsonl", [line(type="mode"), said("user", "<system-reminder>x</system-reminder>Plan\nit", sessionId="m"), said("assistant", [{"type": "text", "text": "ok"}, {"type": "tool_use", "name": "grep", "input": {}}, {"type": "image"}], sessionId="m")]),
        ("/p/m/subagents/a.jsonl", [said("user", "look", sessionId="m", agentId="a1", slug="scout", isSidechain=True), said("assistant", [{"type": "tool_result", "content": "r" * 300}], agentId="a1")]),
        ("/p/m/subagents/b.jsonl", ["{broken", said("assistant", [{"type": "tool_result", "content": [{"text": "one"}, {"text": "two"}]}], sessionId="gone", agentId="b2")]),
        ("/p/plain.jsonl", [said("user", "hi", agentId="zz")]), ("/p/empty.jsonl", [said("user", " "), line(type="user")]),
    ]
    df = spark.createDataFrame([(f, i, x) for f, xs in rows for i, x in enumerate(xs)], "file string, pos long, line string")
    got = {r["session"]: r for r in transcripts.agent_sessions(df).collect()}
    assert set(got) == {"m", "sub_a1", "sub_b2", "plain"}
    assert (got["m"]["label"], got["m"]["body"]) == ("Plan", "[user] Plan\nit\n\n[assistant] ok\n[tool_use: grep]\n[image]")
    assert got["sub_a1"]["label"] == "[subagent scout] look" and got["sub_a1"]["body"].endswith("[tool_result: " + "r" * 240 + "…]")
    assert [(got[k]["parent"], got[k]["root"], got[k]["persona"]) for k in ("m", "sub_a1", "sub_b2", "plain")] == [(None, "m", None), ("m", "m", "scout"), ("gone", "gone", "anon"), (None, "plain", None)]
    assert got["sub_b2"]["body"] == "[assistant] [tool_result: one\ntwo]"


def test_exclusions_come_in_order(spark):
    long = "this line is long enough to count"
    rows = [(1, "  short "), (2, long + " x"), (3, " " + long + " x "), (4, "no block for this prompt"), (5, f"before {long} after"), (6, "only a short line is in here"), (7, None), (8, "a" * 14 + " "), (9, long + " y")]
    blocks_ = [(k, f"a short line\n  {long}  \n") for k in (1, 2, 3, 5, 8)] + [(6, "a short line\nsomething else that is long"), (4, None), (9, "")]
    found = dataset.eligible(spark.createDataFrame(rows, "id int, t string"), spark.createDataFrame(blocks_, "id int, block string"), "id", "t", "id")
    assert dict(values(found, "id", "reason")) == {1: "short", 2: "leakage", 3: "duplicate", 4: "unresolved", 5: "leakage", 6: "eligible", 7: "short", 8: "short", 9: "eligible"}


def test_a_killed_job_goes_on(spark, tmp_path):
    rows = spark.range(100).withColumnRenamed("id", "k")
    parts = []

    def work(fails):
        def run(part):
            parts.append(part.count())
            if len(parts) == fails:
                raise RuntimeError("killed")
            return part.withColumn("run", F.lit(fails))

        return run

    lane = {"provider": "p", "model": "m"}
    with pytest.raises(RuntimeError):
        mutations.resumed(rows, "k", lane, work(3), str(tmp_path), 25)
    assert parts == [25, 25, 25]
    got = mutations.resumed(rows, "k", lane, work(0), str(tmp_path), 25)
    assert parts == [25] * 5 and values(got.groupBy("run").agg(F.min("k").alias("a"), F.count("k").alias("n")), "run", "a", "n") == [(0, 50, 50), (3, 0, 50)]
    mutations.resumed(rows, "k", lane, work(0), str(tmp_path), 25)
    assert len(parts) == 5
    assert mutations.resumed(rows, "k", lane | {"model": "other"}, work(0), str(tmp_path), 40).count() == 100 and parts[5:] == [40, 40, 20]
    assert mutations.resumed(rows.limit(0), "k", {"model": "none"}, lambda part: part, str(tmp_path)).count() == 0


def test_precision_of_distinct_ids(spark):
    shown = spark.createDataFrame([("c", "a"), ("c", "a"), ("c", "b"), ("d", "x")], "conversation_id string, id string")
    used = spark.createDataFrame([("c", "a"), ("c", "zz")], "conversation_id string, id string")
    assert values(telemetry.precision(shown, used), "conversation_id", "precision") == [("c", 0.5), ("d", 0.0)]


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_similar_sets_against_brute_force(spark):
    import random
    from itertools import combinations

    r = random.Random(5)
    made = {k: frozenset(r.sample(range(12), r.randint(0, 7))) for k in range(60)}
    rows = spark.createDataFrame([(k, [str(x) for x in v]) for k, v in made.items()], "id int, s array<string>")
    for least in (0.3, 0.5, 0.8):
        want = {(a, b) for a, b in combinations(made, 2) if made[a] | made[b] and len(made[a] & made[b]) / len(made[a] | made[b]) >= least}
        assert {(x["a"], x["b"]) for x in sets.similar_sets(rows, "id", "s", least).collect()} == want


def test_similar_sets_with_an_item_in_most(spark, monkeypatch):
    """One item is in two thirds of all sets, many sets are equal, and an index of it is split: no pair is lost, and few are looked at."""
    import random
    from itertools import combinations

    r = random.Random(7)
    made = {k: frozenset([*(["hot"] if k % 3 else []), *(f"i{r.randrange(40)}" for _ in range(r.randint(0, 3)))]) for k in range(240)}
    rows = spark.createDataFrame([(k, list(v)) for k, v in made.items()], "id int, s array<string>")
    monkeypatch.setattr(sets, "SPLIT", 10)
    for least in (0.34, 0.5, 0.75):
        want = {(a, b): len(made[a] & made[b]) / len(made[a] | made[b]) for a, b in combinations(made, 2) if made[a] | made[b] and len(made[a] & made[b]) / len(made[a] | made[b]) >= least}
        got = [((x["a"], x["b"]), x["similarity"]) for x in sets.similar_sets(rows, "id", "s", least).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)
    # Sets of the hot item and one of their own: nobody asks the hot item's index at all.
    monkeypatch.setattr(sets, "SPLIT", 2000)
    wide = spark.range(4000).selectExpr("id", "array('hot', concat('x', id)) as s")
    assert sets.similar_sets(wide, "id", "s", 0.5).count() == 0


def greedy(names):
    """Suggestions by one pass over the list, pair by pair."""
    fold = lambda n: "".join(c for c in n.lower() if c not in " -_.\t")
    groups, out, gone = {}, [], set()
    for n, c in names:
        groups.setdefault(fold(n), []).append((-c, n))
    for g in groups.values():
        first, *rest = sorted(g)
        out += [(n, first[1], "safe") for _, n in rest]
        gone |= {n for _, n in rest}
    base = lambda f: next((f[: -len(x)] for x in ("ts", "js", "py", "rs", "go") if f.endswith(x) and len(f) > len(x)), f)
    left = [(n, c, fold(n)) for n, c in names if n not in gone]
    for i, (a, ca, fa) in enumerate(left):
        for b, cb, fb in left[i + 1 :]:
            if a not in gone and b not in gone and (fb == fa + "s" or fa == fb + "s" or base(fa) == base(fb) and (fa != base(fa) or fb != base(fb))):
                source, target = (b, a) if (-ca, a) <= (-cb, b) else (a, b)
                out.append((source, target, "likely"))
                gone.add(source)
    return sorted(out)


def test_suggestions_are_those_of_one_pass(spark):
    import random

    r = random.Random(11)
    names = {"".join(r.choice(["ab", "c", "d"]) for _ in range(r.randint(1, 4))) + r.choice(["", "", "s", "ss", ".py", "-ts", "ts", " go", "js", "pys", ".s"]) for _ in range(3000)}
    listed = [(n, r.randint(1, 4)) for n in sorted(names, key=lambda n: (len(n), n[::-1]))][:1000]
    df = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(listed)], "name string, n int, at int")
    got = sets.suggested(df, "name", "n", "at")
    found = values(got, "source", "target", "class")
    assert len(listed) > 400 and found == greedy(listed) and len({f[0] for f in found}) == len(found)


def test_unions_over_many_ranges(spark, ranges):
    """Without a key, and with keys of which one has most rows and one is null, against a loop; no task holds more than its range."""
    import random

    r = random.Random(12)
    made = [(r.choice([None, "a", "b", "b", "b", "b"]), s, s + r.choice([0, 3, 20, 900])) for s in (r.randrange(40_000) for _ in range(1500))]
    df = spark.createDataFrame(made, "k string, start_us long, end_us long")

    def union(rows):
        out = []
        for s, e in sorted(rows):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [tuple(x) for x in out]

    assert values(timeline.merged(df), "start_us", "end_us") == union((s, e) for _, s, e in made)
    got = sorted((str(x["k"]), x["start_us"], x["end_us"]) for x in timeline.merged(df, "k").collect())
    assert got == sorted((str(k), *i) for k in (None, "a", "b") for i in union((s, e) for kk, s, e in made if kk == k))
    assert spark.read.parquet(timeline.by_range(df, "start_us", "end_us")._written_at).groupBy("part_").count().agg({"count": "max"}).first()[0] < 800


def test_a_day_of_23_hours(spark):
    """New York, 10 March 2024: 5:00 to 4:00 UTC the next day. Activity is cut at midnight, ties go to the session that began first."""
    t = lambda text: f"2024-03-{text}:00"
    said = [("a", t("10 04:50")), ("a", t("10 04:58")), ("a", t("10 05:02")), ("a", t("10 05:10")), ("a", t("10 06:55")), ("a", t("10 07:03")), ("b", t("10 07:00")), ("b", t("10 07:10")), ("b", t("11 03:59")), ("b", t("11 04:01"))]
    act = spark.createDataFrame(said, "session string, at string").select("session", F.to_timestamp("at").alias("ts"))
    spans = digest.day_spans(act, "America/New_York", 10)
    assert [(str(x[0]), *x[1:]) for x in values(spans, "day", "session", "n")] == [("2024-03-09", "a", 2), ("2024-03-10", "a", 2), ("2024-03-10", "a", 2), ("2024-03-10", "b", 1), ("2024-03-10", "b", 2), ("2024-03-11", "b", 1)]
    of = spark.createDataFrame([("a", "x", t("09 12:00"), t("10 08:00"), ["d1", "d2"], []), ("b", "y", t("09 13:00"), t("11 05:00"), ["d2"], ["o"]), ("c", "z", t("10 12:00"), None, [], [])], "session string, topic string, s string, e string, decisions array<string>, open array<string>")
    of = of.withColumns({"started_at": F.to_timestamp("s"), "ended_at": F.to_timestamp("e")})
    seg = digest.segments(spans, of)
    assert [(str(d), topic, m, share) for d, topic, m, share in values(digest.by_topic(seg), "day", "topic", "active_minutes", "share")] == [("2024-03-09", "x", 8.0, 1.0), ("2024-03-10", "x", 23.0, 1.0), ("2024-03-10", "y", 0.0, 0.0), ("2024-03-11", "y", 0.0, 0.0)]
    assert [(str(d), *x) for d, *x in values(digest.focus(seg, 15), "day", "context_switches", "longest_block_min", "deep_work_ratio", "projects")][1] == ("2024-03-10", 1, 23.0, 1.0, 2)
    assert [(str(d), *x) for d, *x in values(digest.coverage(of, spans, "America/New_York"), "day", "sessions", "measured", "skipped", "decisions", "open_loops")] == [("2024-03-09", 2, 1, 1, 2, 1), ("2024-03-10", 3, 2, 1, 2, 1), ("2024-03-11", 1, 1, 0, 1, 1)]


def test_nearest_rank_against_sorting(spark):
    import random

    r = random.Random(6)
    for xs in ([r.choice([1.0, 2.0, 2.0, r.random() * 9]) for _ in range(999)], [4.0], []):
        rows = spark.createDataFrame([(x,) for x in [*xs, None]], "x double")
        got = dict(values(telemetry.nearest_rank(rows, "x", [0, 50, 95, 100]), "percent", "value"))
        assert got == {p: sorted(xs)[p * (len(xs) - 1) // 100] for p in (0, 50, 95, 100) if xs}


def test_rederived_pairs_leave_out_linked_ones(spark):
    """More than 1000 sessions, some numbered beyond 20,000, against all pairs."""
    import random
    from datetime import datetime, timedelta

    r = random.Random(8)
    ids = [*range(900), *range(30_000, 30_300)]
    made = {i: (datetime(2020, 1, 1) + timedelta(days=r.randint(0, 60)), frozenset(r.sample(range(300), r.randint(1, 4))), r.randint(0, 3)) for i in ids}
    sessions = spark.createDataFrame([(i, t, [str(x) for x in d]) for i, (t, d, _) in made.items()], "id long, started_at timestamp, decisions array<string>")
    members = spark.createDataFrame([(i, m) for i, (_, _, m) in made.items()], "id long, member int")
    similar = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 2 * len(made[a][1] & made[b][1]) >= len(made[a][1] | made[b][1])]
    links = [(b, a) for a, b in similar if (a + b) % 3 == 0]
    want = [(a, b) for a, b in similar if (a + b) % 3 and made[a][2] == made[b][2] and abs((made[a][0] - made[b][0]).days) > 7]
    assert len(want) > 50
    assert values(sets.rederived(sessions, members, spark.createDataFrame(links, "a long, b long")), "a", "b") == want


def test_equal_vectors_rank_without_gaps(spark):
    """A query's own row takes no rank, wherever it would stand among its copies."""
    rows = spark.createDataFrame([(50, [1.0, 0.0]), (100, [1.0, 0.0]), (150, [1.0, 0.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id = 100").withColumnRenamed("vec_id", "query_id")
    assert values(recall.nearest(rows, asked, "vec_id", "query_id", 3, others=True), "rank", "vec_id") == [(1, 50), (2, 150), (3, 7)]


def test_cycles_of_any_length(spark):
    """A ring of 24, two rings with a bridge whose node is on none, a ring below a smaller number, and a loop."""
    ring = [(k, (k + 1) % 24) for k in range(24)]
    rest = [(200, 201), (201, 200), (201, 202), (202, 203), (203, 204), (204, 203), (300, 301), (301, 302), (302, 301), (302, 303), (400, 400), (204, 205)]
    df = spark.createDataFrame(ring + rest, "a long, b long")
    want = [(k,) for k in [*range(24), 200, 201, 203, 204, 301, 302]]
    assert values(graph.on_cycles(df, "a", "b"), "node") == want
    one = spark.createDataFrame([*ring, (200, 201), (201, 202), (202, 200), (203, 202), (204, 204), (205, None)], "a long, b long")
    assert values(graph.pointer_cycles(one, "a", "b"), "node") == [(k,) for k in [*range(24), 200, 201, 202]]


def test_fnv_against_python(spark):
    texts = ["", "a", "héllo", "\U0001f600 x", "中文" * 50, "z" * 700]

    def fnv(t):
        h = 0xCBF29CE484222325
        b = t.encode("utf-16-le")
        for k in range(0, len(b), 2):
            h = ((h ^ int.from_bytes(b[k : k + 2], "little")) * 0x100000001B3) & (1 << 64) - 1
        return f"{h:016x}"[:12]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv_12(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == {t: fnv(t) for t in texts}


def test_passages_are_found_wherever_they_stand(spark, monkeypatch):
    docs = [(1, "abc defghij kl mno pq"), (2, "xabc defghij kl mnoz"), (3, "abc  defghij kl mno"), (4, "q"), (5, None), (6, "one two"), (7, "")]
    asked = [(1, "abc defghij kl mno"), (2, "c defghij k"), (3, "q"), (4, "one two"), (5, "  "), (6, None), (7, "j kl m")]
    want = sorted((p, d) for p, t in asked for d, x in docs if t is not None and x is not None and t in x)
    for small in (recall.SMALL, 0):
        monkeypatch.setattr(recall, "SMALL", small)
        got = recall.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string"), "doc_id", "item_id")
        assert values(got, "item_id", "doc_id") == want


def test_predecessors_of_a_frequent_set(spark, ranges):
    rows = [(k, ["a", "b"] if k % 5 else ["b"], k * 7 % 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, m array<string>, at long")
    want, last = {}, {}
    for k, m, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if tuple(m) in last:
            want[k] = last[tuple(m)]
        last[tuple(m)] = k
    assert dict(values(sets.predecessors(df, "id", "m", "at", "id"), "id", "predecessor")) == want


def test_percentiles_between_rows(spark):
    import statistics

    xs = [float(x * x % 97) for x in range(60)]
    got = dict(values(telemetry.percentiles(spark.createDataFrame([(x,) for x in xs], "x double"), "x", [25, 50, 75, 100]), "percent", "value"))
    assert [got[p] for p in (25, 50, 75)] == pytest.approx(statistics.quantiles(xs, n=4, method="inclusive")) and got[100] == max(xs)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_nearest_answers_any_number_of_queries(spark, threshold):
    import numpy as np

    random = np.random.default_rng(6)
    near, asked = random.normal(size=(30, 3)), random.normal(size=(5003, 3))
    frame = lambda x, name: spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"{name} long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = values(recall.nearest(frame(near, "vec_id"), frame(asked, "query_id"), "vec_id", "query_id", 2), "query_id", "rank", "vec_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    order = ((asked[:, None] - near[None]) ** 2).sum(2).argsort(1)
    assert got == [(q, r + 1, int(order[q, r])) for q in range(len(asked)) for r in range(2)]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    """Two runs over a folder that grows: state and tables are those of one run over all."""
    from recollect.streaming import pipelines as p

    rows = [(i, f"k{i % 3}", f"2024-01-0{1 + i // 8} 0{i % 8}:00:00", i % 4 != 0) for i in range(16)]
    frame = lambda part: spark.createDataFrame(part, "event_id long, k string, at string, ok boolean").select("event_id", "k", F.to_timestamp("at").alias("ts"), "ok")
    seen = []
    for part in (rows[:9], rows[9:]):
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t")
        stream = p.opened(spark, f"{tmp_path}/in/t")
        table = p.upserted(stream, "k", "ts", at=f"{tmp_path}/up", buckets=4)
        first = p.available(p.surfaced_first(stream.select(F.col("k").alias("conversation_id"), F.lit("s").alias("id"), "ts"), dormant_us=20 * 3_600_000_000), at=f"{tmp_path}/memo")
        fired = p.available(p.alerts(stream.select(F.lit(1).cast("long").alias("one"), "event_id", F.unix_micros("ts").alias("us"), (F.col("event_id") % 5 == 0).alias("ok")), "one", "ok", again_us=7_200_000_000), at=f"{tmp_path}/fired")
        seen.append((values(table, "k", "event_id"), values(first, "conversation_id", "us"), values(fired, "event_id")))
    assert seen[0][0] == [("k0", 6), ("k1", 7), ("k2", 8)] and seen[1][0] == [("k0", 15), ("k1", 13), ("k2", 14)]
    assert len(seen[0][1]) == 3 and len(seen[1][1]) == 3  # a day isn't long enough for any of them to be forgotten
    assert seen[1][2] == [(2,), (4,), (7,), (8,), (12,), (14,)]


def test_keys_that_are_quiet_take_no_room(spark, tmp_path):
    """Three runs over listings that go on: state is kept from run to run, and that of paths which are no longer listed goes."""
    from recollect.streaming import pipelines as p

    hour, state, progress = 3_600_000_000, [], []
    runs = [[(f"p{i}", 5, 0, hour) for i in range(40)], [("p0", 5, 0, 3 * hour), ("p1", 6, 0, 3 * hour)], [("p0", 5, 0, 30 * hour), ("q", 1, 0, 30 * hour)], [("q", 1, 0, 31 * hour)], [("p0", 5, 0, 31 * hour), ("p7", 5, 0, 31 * hour), ("q", 2, 0, 32 * hour)]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for part in runs:
            spark.createDataFrame(part, "path string, size long, modified_us long, listed_us long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t")
            stream = p.opened(spark, f"{tmp_path}/in/t")
            got = p.available(p.changed_files(stream, forget_us=10 * hour), at=f"{tmp_path}/out", progress=progress)
            state.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    late = [r for r in values(got, "listed_us", "path", "size") if r[0] > hour]
    # p1 has grown; p0 was quiet for 27 hours and is parsed again, as is p7, which nobody remembers.
    assert late == [(3 * hour, "p1", 6), (30 * hour, "p0", 5), (30 * hour, "q", 1), (31 * hour, "p7", 5), (32 * hour, "q", 2)]
    assert state[0] >= 40 and state[-1] < 20


def test_upserts_keep_each_bucket_once(spark, tmp_path):
    """Six batches over the same keys: what committed batches replaced is gone, and the rows are the last ones."""
    from recollect.streaming import pipelines as p

    for i in range(6):
        spark.createDataFrame([(k + 100 * i, k, f"2024-01-0{i + 1} 00:00:00") for k in range(20)], "event_id long, k long, at string").select("event_id", "k", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/t")
        table = p.upserted(p.opened(spark, f"{tmp_path}/in/t"), "k", "ts", at=f"{tmp_path}/up", buckets=4)
        assert values(table, "k", "event_id") == [(k, k + 100 * i) for k in range(20)]
    assert len(list((tmp_path / "up" / "table").glob("epoch=*/bucket=*"))) <= 8


def test_facts_beside_hits(spark):
    rows = [("f1", "a", "p", "v", "s1", 9), ("f2", "a", "p", "w", "s2", 8), ("f3", "a", "p", "w", "s3", 7), ("f4", "b", "p", "v", "s1", 9), ("f5", "b", "p", "v", "s2", 1), ("f6", "c", "p", "v", "s1", 9), ("f7", "c", "p", "v", "s2", 9)]
    df = spark.createDataFrame([(*r, None, 0, 0.8) for r in rows], "id string, subject string, predicate string, value string, session_id string, created_at int, superseded_by string, retired int, confidence double")
    hits = spark.createDataFrame([("q", "s1", 1), ("q", "s2", 6), ("r", "s2", 1), ("r", "s1", 2)], "q string, session_id string, rank int")
    ents = spark.createDataFrame([("s1", " a ", 2), ("s1", "b", 1), ("s1", " ", 3), ("s2", "c", 1), ("s2", "a", 2)], "session_id string, entity string, position int")
    got = values(facts.related_to_hits(df, hits, ents, "q", most_entities=2), "q", "rank", "subject", "value", "sessions")
    assert got == [("q", 1, "a", "w", 2), ("q", 2, "b", "v", 2), ("r", 1, "a", "w", 2), ("r", 2, "c", "v", 2)]
    assert values(facts.related_to_hits(df, hits, ents, "q", newest=1), "q", "subject") == [("q", "b"), ("r", "b"), ("r", "c")]


def test_alerts_name_the_first_of_two_questions(spark):
    entities = spark.createDataFrame([("a b", 3, 61, "active"), ("c", 1, 46, None), ("d", 1, 31, "snoozed"), ("e", 0, 90, "active"), ("f", 2, 30, "active"), ("g", 1, 70, "active")], "entity string, n long, age long, status string")
    hidden = spark.createDataFrame([("stale_g",)], "alert_id string")
    opens = spark.createDataFrame([("a b", 2, 1, "later"), ("a b", 1, 2, "x" * 90), ("a b", 3, 3, "third"), ("c", 1, 4, "why")], "entity string, at long, id long, question string")
    rows = dataset.alert_summaries(entities, hidden, opens).collect()
    assert [(r.alert_id, r.severity) for r in rows] == [("stale_a_b", "high"), ("stale_c", "medium")]
    assert rows[0].summary == f'Last touch 61 days ago · 2 unresolved open questions: "{"x" * 80}"'
    assert rows[1].summary == 'Last touch 46 days ago · 1 unresolved open question: "why"'


def test_catalogue_under_an_overlay(spark):
    """Counts fold into targets that are there, overrides stand beside what is computed, and facets and metrics go by what shows."""
    ents = spark.createDataFrame([("a", 2, 5, "t", "a", None), ("b", 1, 40, "t", "b", "active"), ("c", 0, None, None, "c", "active"), ("d", 4, 1, "t", "d", "active")], "entity string, n long, age long, type string, display string, status string")
    laid = spark.createDataFrame([("merge_entity", "entity", "b", "a"), ("merge_entity", "entity", "d", "nowhere"), ("label_entity", "entity", "a", "u"), ("rename_entity", "entity", "a", "A"), ("set_coherence", "entity", "a", "stale"), ("snooze", "entity", "c", "later"), ("snooze", "alert", "a", "later")], "kind string, subject_type string, subject_id string, value string")
    cat = dataset.catalogue(ents, laid)
    got = {r["entity"]: (r["n"], r["type"], r["display"], r["status"], r["coherence_computed"], r["coherence"]) for r in cat.collect()}
    assert got == {"a": (3, "u", "A", None, "active", "stale"), "b": (1, "t", "b", "retired", "stale", "stale"), "c": (0, None, "c", "snoozed", "sparse", "sparse"), "d": (4, "t", "d", "retired", "active", "active")}
    alerts = spark.createDataFrame([("x", "high"), ("y", "high"), ("z", "low")], "entity string, severity string")
    assert values(dataset.facets(cat, alerts), "facet", "value", "n") == [("active", "2-5", 1), ("active", "any", 1), ("severity", "all", 3), ("severity", "high", 2), ("severity", "low", 1), ("stale", "1", 1), ("stale", "2-5", 1), ("stale", "any", 2), ("stale", "overridden", 1)]
    rows = spark.createDataFrame([("2024-01-31 00:00:00", None, 2), ("2024-01-24 00:00:00", "closed", 3), ("2024-01-25 12:00:00", "superseded", 5), ("2024-01-17 00:00:00", "replaced", None), ("2024-02-01 00:00:00", "active", 1), (None, "active", 1)], "at string, status string, decisions int").withColumn("started_at", F.to_timestamp("at"))
    one_ = dataset.metrics(rows, cat, "2024-01-31 00:00:00").first()
    assert (one_["this_week"], one_["last_week"], one_["closed_decisions"], one_["healthy"], one_["sparse"], one_["stale"]) == (2, 1, 7, 1, 0, 2)


def test_recall_coverage_takes_the_first_table(spark):
    log = spark.createDataFrame([(1, 1, "old", ["a"]), (2, 2, "x", ["a", "b", None]), (3, 3, "x", ["a", "zz"]), (3, 4, "y", [])], "ts int, entry int, source string, ids array<string>")
    one_ = spark.createDataFrame([("a", None), ("a", None)], "id string, scope string")
    two = spark.createDataFrame([("a", "s"), ("b", "s")], "id string, scope string")
    assert values(dataset.recall_coverage(log, one_, two, window=3), "surface", "returned", "found", "scoped", "fraction") == [("*", 3, 2, 1, 0.5), ("x", 3, 2, 1, 0.5)]


def test_aborted_sessions(spark):
    line = lambda role, text, stop=None, **x: json.dumps({"type": "message", "message": {"role": role, "content": text, "stopReason": stop}} | x)
    files = {
        "fine": [json.dumps({"type": "session", "id": "s"}), line("user", "hi"), line("assistant", [{"type": "text", "text": "a"}, {"type": "tool", "text": "x"}, {"type": "text", "text": "b"}]), line("assistant", "", "error")],
        "empty": [line("user", "hi"), line("assistant", " ")], "errors": [line("user", "hi"), line("assistant", "sorry", "error")],
        "alone": [line("assistant", "hello")], "odd": ["{", json.dumps({"type": "custom_message"}), line("system", "x"), line("user", "only")],
    }
    df = spark.createDataFrame([(f"/p/{f}.jsonl", i, x) for f, xs in files.items() for i, x in enumerate(xs)], "file string, pos long, line string")
    got = {r["session"]: (r["aborted"], r["n_turns"], r["body"]) for r in transcripts.custom_sessions(df).collect()}
    assert got == {"s": (False, 2, "[user] hi\n\n[assistant] a\nb"), "empty": (True, 1, "[user] hi"), "errors": (True, 2, "[user] hi\n\n[assistant] sorry"), "alone": (False, 1, "[assistant] hello"), "odd": (True, 1, "[user] only")}


def test_relative_floors_take_the_upper_median(spark):
    hits = spark.createDataFrame([("f", "c", "a", 4.0), ("f", "c", "b", 2.0), ("f", "c", "b", 2.0), ("f", "c", "d", 4.0), ("z", "c", "a", 0.0), ("n", "other", "a", 9.0)], "fire string, conversation_id string, id string, score double")
    gold = spark.createDataFrame([("c", "a"), ("c", "a")], "conversation_id string, id string")
    rows = {r.floor: r for r in telemetry.relative_floors(hits, gold, [0.4, 0.6, 1.0], min_kept=0.5).collect()}
    assert [(rows[x].gold_kept, rows[x].noise_cut, rows[x].recommended) for x in (0.4, 0.6, 1.0)] == [(0.5, 0.0, False), (0.5, 0.6667, True), (0.5, 0.6667, False)]


def test_short_answers_need_word_boundaries(spark):
    bodies = spark.createDataFrame([("p", 1, "It cost $3."), ("q", 1, "It cost 33."), ("r", 1, "a  Long,\nanswer"), ("s", 6, "yes"), ("t", 1, None)], "query_id string, rank int, body string")
    answers = spark.createDataFrame([("p", "3"), ("q", "3"), ("r", "long answer!"), ("s", "yes"), ("t", "yes"), ("u", "?"), ("v", None)], "query_id string, answer string")
    assert {r.query_id: r.body_hit for r in telemetry.body_hits(bodies, answers).collect()} == {"p": 1, "q": 0, "r": 1, "s": 0, "t": 0, "u": 0, "v": 0}


def test_scope_coverage_and_gold_samples(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("b", None)], "surface string, scope string")
    found = {(r.surface, r.scope): (r.total, r.stamped, r.unstamped, r.fraction) for r in dataset.scope_coverage(rows).collect()}
    assert found == {("a", "x"): (1, 1, 0, 1.0), ("a", "*"): (2, 1, 1, 0.5), ("b", "*"): (1, 0, 1, 0.0), ("*", "*"): (3, 1, 2, 0.3333)}
    pool = spark.range(20).selectExpr("id", "CAST(id % 2 AS STRING) AS kind")
    picked = dataset.gold_sample(pool, spark.range(8), "id", "kind", 10).collect()
    assert len({r.id for r in picked}) == 10 and sum(r.chosen_by == "citation" for r in picked) == 6
    assert dataset.gold_sample(pool.limit(0), spark.range(8), "id", "kind", 10).count() == 0
    assert dataset.gold_sample(pool, spark.range(8), "id", "kind", 50).count() == 20
