"""Queries over graphs and integrity: G1-G9, I1-I7."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..operators import graph, integrity
from .registry import Views, query

RESOLVE = """WITH RECURSIVE r AS (SELECT id, id AS node, 0 AS d FROM workstreams UNION ALL SELECT r.id, w.merged_into, d + 1 FROM r JOIN workstreams w ON w.id = r.node WHERE w.merged_into IS NOT NULL AND d < 100),
s AS (SELECT id, arg_max(node, d) AS survivor FROM r GROUP BY 1)"""


@query(RESOLVE + " SELECT id, survivor FROM s")
def g4_survivors(v: Views) -> DataFrame:
    return graph.survivors(v.workstreams, "id", "merged_into")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 40 = 39 THEN c_custkey - 6 ELSE c_custkey + 1 END AS to_id FROM customer),
w AS (SELECT id, id AS place, [id] AS seen, false AS stop FROM n UNION ALL SELECT w.id, n.to_id, list_append(seen, n.to_id), list_contains(seen, n.to_id) FROM w JOIN n ON n.id = w.place WHERE NOT stop AND n.to_id IS NOT NULL)
SELECT id, arg_max(place, len(seen)) AS survivor, (max(len(seen)) - 1 - CASE WHEN bool_or(stop) THEN CASE WHEN arg_max(place, len(seen)) = id THEN max(len(seen)) - 1 ELSE max(len(seen)) - list_position(arg_max(seen, len(seen)), arg_max(place, len(seen))) END ELSE 0 END)::BIGINT AS hops, bool_or(stop) AS circular FROM w GROUP BY 1""")
def g4_circles(v: Views) -> DataFrame:
    """Ways of customers along their numbers, of which some end and some run into circles."""
    k = F.col("c_custkey")
    rows = v.customer.select(k.alias("id"), F.when(k % 7 == 0, None).when(k % 40 == 39, k - 6).otherwise(k + 1).alias("to_id"))
    return graph.resolved(rows, "id", "to_id")


@query(RESOLVE + " SELECT survivor, count(DISTINCT x.id) AS sessions, count(f.id) AS facts FROM s JOIN sessions x ON x.workstream_id = s.id LEFT JOIN facts f ON f.session_id = x.id GROUP BY 1")
def g5_rollup(v: Views) -> DataFrame:
    to = graph.survivors(v.workstreams, "id", "merged_into").withColumnRenamed("id", "workstream_id")
    n = v.facts.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    rows = v.sessions.select("id", "workstream_id").join(to, "workstream_id").join(n, "id", "left")
    return rows.groupBy("survivor").agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("facts"))


MARK = "WITH RECURSIVE w AS (SELECT to_session AS predecessor, from_session AS successor FROM edges WHERE kind = 'supersedes' AND from_session LIKE 's%5' UNION ALL SELECT from_session, to_session FROM edges WHERE kind = 'supersedes' AND from_session LIKE 's%00' UNION ALL SELECT 's1', 's1' UNION ALL SELECT 's1', 'nobody'),"


def _wanted(v: Views) -> DataFrame:
    e = v.edges.filter("kind = 'supersedes'")
    a = e.filter("from_session like 's%5'").select(F.col("to_session").alias("predecessor"), F.col("from_session").alias("successor"))
    b = e.filter("from_session like 's%00'").select(F.col("from_session").alias("predecessor"), F.col("to_session").alias("successor"))
    return a.union(b).union(v.spark.createDataFrame([("s1", "s1"), ("s1", "nobody")], "predecessor string, successor string"))


@query(MARK + """ r AS (SELECT DISTINCT predecessor AS start, e.to_session AS node, 1 AS d FROM w JOIN edges e ON e.from_session = predecessor WHERE e.kind IN ('supersedes', 'replaces')
UNION SELECT start, e.to_session, d + 1 FROM r JOIN edges e ON e.from_session = r.node WHERE e.kind IN ('supersedes', 'replaces') AND d < 100)
SELECT predecessor, successor, CASE WHEN predecessor = successor THEN 'self' WHEN predecessor NOT IN (SELECT id FROM sessions) OR successor NOT IN (SELECT id FROM sessions) THEN 'missing' WHEN EXISTS (SELECT 1 FROM r WHERE start = predecessor AND node = successor) THEN 'cycle' ELSE 'ok' END AS verdict FROM w""")
def g1_mark_superseded(v: Views) -> DataFrame:
    return graph.marked_superseded(v.edges, _wanted(v), v.sessions)


APPLIED = MARK + """ r AS (SELECT DISTINCT predecessor AS start, e.to_session AS node, 1 AS d FROM w JOIN edges e ON e.from_session = predecessor WHERE e.kind IN ('supersedes', 'replaces')
UNION SELECT start, e.to_session, d + 1 FROM r JOIN edges e ON e.from_session = r.node WHERE e.kind IN ('supersedes', 'replaces') AND d < 100),
ok AS (SELECT predecessor AS id, max(successor) AS successor FROM w WHERE predecessor <> successor AND predecessor IN (SELECT id FROM sessions) AND successor IN (SELECT id FROM sessions) AND NOT EXISTS (SELECT 1 FROM r WHERE start = predecessor AND node = successor) GROUP BY 1)"""


def _applied(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..operators.mutations import superseded_sessions

    marks = graph.marked_superseded(v.edges, _wanted(v), v.sessions)
    kept = v.versions.withColumn("superseded_by", F.when(F.col("version") % 3 == 0, F.col("superseded_by")))
    return superseded_sessions(v.sessions, v.edges, kept, marks)


@query(APPLIED + " SELECT s.id, CASE WHEN ok.id IS NOT NULL THEN 'superseded' ELSE status END AS status FROM sessions s LEFT JOIN ok ON ok.id = s.id")
def g1_statuses(v: Views) -> DataFrame:
    return _applied(v)[0].select("id", "status")


@query(APPLIED + " SELECT from_session, to_session, kind FROM edges WHERE NOT (kind = 'supersedes' AND to_session IN (SELECT id FROM ok)) UNION ALL SELECT successor, id, 'supersedes' FROM ok")
def g1_edges(v: Views) -> DataFrame:
    return _applied(v)[1]


@query(APPLIED + """, k AS (SELECT id, session_id, subject, predicate, CASE WHEN version % 3 = 0 THEN superseded_by END AS superseded_by FROM versions),
h AS (SELECT session_id, subject, predicate, max(id) AS heir FROM k WHERE superseded_by IS NULL GROUP BY 1, 2, 3)
SELECT f.id, coalesce(heir, f.superseded_by) AS superseded_by, heir IS NOT NULL AS cascaded FROM k f LEFT JOIN ok ON ok.id = f.session_id LEFT JOIN h ON h.session_id = ok.successor AND h.subject = f.subject AND h.predicate = f.predicate""")
def g1_facts(v: Views) -> DataFrame:
    """The facts of superseded sessions give way to current ones of their successor; two of three versions are current here."""
    return _applied(v)[2]


@query("SELECT id, before AS prior, CASE WHEN seq % 7 = 0 THEN 'replaces' ELSE 'continues' END AS kind, CASE WHEN seq % 7 = 0 THEN 'replaced' END AS new_status FROM ordered WHERE before IS NOT NULL AND before <> id")
def g2_ingest_edges(v: Views) -> DataFrame:
    rows = v.ordered.filter("before is not null and before <> id")
    late = F.col("seq") % 7 == 0
    return rows.select("id", F.col("before").alias("prior"), F.when(late, "replaces").otherwise("continues").alias("kind"), F.when(late, "replaced").alias("new_status"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 10 + (c_custkey * 7 + 3) % 10 AS b FROM customer UNION SELECT c_custkey, c_custkey + 10 FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT a AS start, b AS node FROM e WHERE a - a % 10 = b - b % 10 UNION SELECT start, b FROM r JOIN e ON a = node WHERE a - a % 10 = b - b % 10) SELECT DISTINCT start AS node FROM r JOIN e ON e.a = start AND e.a <> e.b WHERE start = node""")
def g3_cycles(v: Views) -> DataFrame:
    """Rings inside tens of customers, and edges from ten to ten that close none."""
    k = F.col("c_custkey")
    e = v.customer.select(k.alias("a"), (k - k % 10 + (k * 7 + 3) % 10).alias("b")).union(v.customer.filter(k % 3 == 0).select(k, k + 10))
    return graph.on_cycles(e, "a", "b")


@query("""WITH RECURSIVE p AS (SELECT to_session AS id, from_session AS newer FROM edges WHERE kind = 'replaces'),
x AS (SELECT s.id, s.started_at, CASE WHEN p.id IS NOT NULL THEN 'replaced' ELSE s.status END AS status, CASE WHEN s.seq % 13 = 0 THEN 'gone' ELSE p.newer END AS newer FROM sessions s LEFT JOIN p ON p.id = s.id),
r AS (SELECT id, newer AS head, 1 AS hops FROM x WHERE status = 'replaced' AND newer IS NOT NULL UNION ALL SELECT r.id, x.newer, hops + 1 FROM r JOIN x ON x.id = r.head WHERE x.status = 'replaced' AND x.newer IS NOT NULL),
h AS (SELECT r.id, r.head, hops::BIGINT AS hops, x.started_at FROM r JOIN x y ON y.id = r.head AND y.status <> 'replaced' JOIN x ON x.id = r.id)
SELECT id, 'earlier' AS kind, head, hops, row_number() OVER (PARTITION BY head ORDER BY started_at, id) AS position FROM h
UNION ALL SELECT id, CASE WHEN status = 'replaced' THEN 'orphan' ELSE 'live' END, CASE WHEN status <> 'replaced' THEN id END, CASE WHEN status <> 'replaced' THEN 0 END, NULL FROM x WHERE id NOT IN (SELECT id FROM h)""")
def g6_replace_chains(v: Views) -> DataFrame:
    """Sessions by replace chains: live ones, earlier ones below their live head, and orphans; some replacements are missing."""
    by = v.edges.filter("kind = 'replaces'").select(F.col("to_session").alias("id"), F.col("from_session").alias("by"))
    rows = v.sessions.select("id", "seq", "status", "started_at").join(by, "id", "left")
    status = F.when(F.col("by").isNotNull(), "replaced").otherwise(F.col("status"))
    return graph.threads(rows.select("id", status.alias("status"), "started_at", F.when(F.col("seq") % 13 == 0, "gone").otherwise(F.col("by")).alias("replaced_by")))


@query("SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS base FROM pages")
def g7_base_names(v: Views) -> DataFrame:
    return v.pages.select("page_id", base_name(F.col("url")).alias("base"))


@query("SELECT id, (SELECT count(*) FROM edges e WHERE e.from_session = s.id AND kind = 'supersedes') AS supersedes, (SELECT max(from_session) FROM edges e WHERE e.to_session = s.id AND kind = 'supersedes') AS superseded_by FROM sessions s")
def g8_lineage(v: Views) -> DataFrame:
    e = v.edges.filter("kind = 'supersedes'")
    down = e.groupBy(F.col("from_session").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    up = e.groupBy(F.col("to_session").alias("id")).agg(F.max("from_session").alias("superseded_by"))
    return v.sessions.select("id").join(down, "id", "left").join(up, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("supersedes"), "superseded_by")


@query("SELECT id, row_number() OVER (PARTITION BY subject, predicate ORDER BY created_at DESC, id DESC) AS version FROM facts")
def g9_fact_history(v: Views) -> DataFrame:
    from ..operators.facts import history

    return history(v.facts).select("id", "version")


INTEGRITY = {
    "i1": "SELECT count(*) FROM edges WHERE from_session = to_session",
    "i2": "SELECT count(*) FROM sessions s WHERE status = 'superseded' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_session = s.id AND e.kind = 'supersedes')",
    "i2r": "SELECT count(*) FROM sessions s WHERE status = 'replaced' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_session = s.id AND e.kind = 'replaces')",
    "i4": "SELECT (SELECT count(*) FROM edges WHERE from_session NOT IN (SELECT id FROM sessions)) + (SELECT count(*) FROM edges WHERE to_session NOT IN (SELECT id FROM sessions))",
    "i5a": "SELECT count(*) FROM (SELECT subject FROM versions WHERE superseded_by IS NULL AND retired = 0 AND predicate <> 'stack' GROUP BY subject, predicate HAVING count(*) > 1)",
    "i5a_mv": "SELECT count(*) FROM (SELECT subject FROM versions WHERE superseded_by IS NULL AND retired = 0 AND predicate = 'stack' GROUP BY subject, predicate HAVING count(*) > 1)",
    "i5b": "SELECT count(*) FROM versions WHERE superseded_by IS NOT NULL AND superseded_by NOT IN (SELECT id FROM versions)",
    "i6": "SELECT count(*) FROM signals WHERE session_id NOT IN (SELECT id FROM sessions)",
    "i7": "SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "i7b_1": "SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)",
    "i7b_2": "SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS \"check\", ({q}) AS n" for k, q in INTEGRITY.items()))
def i_report(v: Views) -> DataFrame:
    """I1-I7 in one report; the cycle checks are g3_cycles and i3_session_cycles."""
    return integrity.report({
        "i1": integrity.self_loops(v.edges), "i2": integrity.unexplained(v.sessions, v.edges, "superseded", "supersedes"), "i2r": integrity.unexplained(v.sessions, v.edges, "replaced", "replaces"),
        "i4": integrity.dangling_edges(v.edges, v.sessions), "i5a": integrity.several_current(v.versions, False), "i5a_mv": integrity.several_current(v.versions, True), "i5b": integrity.dangling_versions(v.versions),
        "i6": integrity.missing(v.signals, "session_id", v.sessions, "id"), "i7": integrity.missing(v.labels, "doc_id", v.documents, "doc_id"),
        "i7b_1": integrity.missing(v.embeddings, "vec_id", v.documents, "doc_id"), "i7b_2": integrity.missing(v.documents, "doc_id", v.labels, "doc_id"),
    })


@query("""WITH RECURSIVE e AS (SELECT from_session AS a, to_session AS b FROM edges UNION SELECT to_session, from_session FROM edges WHERE kind = 'replaces'), r AS (SELECT a AS start, b AS node FROM e UNION SELECT start, b FROM r JOIN e ON a = node)
SELECT count(*) AS cycles FROM r WHERE start = node""")
def i3_session_cycles(v: Views) -> DataFrame:
    """Sessions on cycles. Edges lead from newer to older sessions; replacements that point both ways close some."""
    back = v.edges.filter("kind = 'replaces'").select("to_session", "from_session")
    return graph.on_cycles(v.edges.select("from_session", "to_session").union(back), "from_session", "to_session").agg(F.count(F.lit(1)).alias("cycles"))


@query("""WITH n AS (SELECT subject, predicate, arg_min(id, version) AS newest, arg_max(id, version) AS oldest FROM versions GROUP BY 1, 2 HAVING count(*) > 1 AND subject LIKE '%7')
SELECT v.id AS node FROM versions v JOIN n USING (subject, predicate)""")
def i5c_fact_cycles(v: Views) -> DataFrame:
    """Facts on cycles of supersedence: the chains of some subjects, whose newest fact points to their oldest."""
    own = Window.partitionBy("subject", "predicate")
    closes = F.col("subject").like("%7") & (F.col("version") == 1) & (F.count(F.lit(1)).over(own) > 1)
    rows = v.versions.select("id", F.when(closes, F.max_by("id", "version").over(own)).otherwise(F.col("superseded_by")).alias("p"))
    return graph.pointer_cycles(rows, "id", "p")


@query("SELECT id, CASE WHEN status IN ('superseded', 'replaced') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_session = s.id AND ((kind = 'supersedes' AND status = 'superseded') OR (kind = 'replaces' AND status = 'replaced'))) THEN 'closed' ELSE status END AS status FROM sessions s")
def m10_repair(v: Views) -> DataFrame:
    return integrity.repaired_status(v.sessions, v.edges).select("id", "status")
