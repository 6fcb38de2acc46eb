"""Queries over sessions, entities and time: S1-S4, F1, F5, F6, J1-J16, A9-A13, A16, A19-A22, W1-W10, T1-T7, U1-U3."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import micros, rounded
from ..functions.text import label_key
from ..operators import facts as f
from ..operators import digest, sets, timeline
from ..operators.tables import written
from .registry import NOW, NOW_SESSIONS, Views, query

US = 86_400_000_000


def _n():
    return F.count(F.lit(1)).alias("n")


@query("SELECT id, label, status FROM sessions WHERE id IN ('s1', 's7', 's42')")
def s1_by_ids(v: Views) -> DataFrame:
    return v.sessions.filter(F.col("id").isin("s1", "s7", "s42")).select("id", "label", "status")


@query("SELECT id, epoch_us(started_at) AS us FROM sessions WHERE started_at < TIMESTAMP '1998-03-02' AND (ended_at IS NULL OR ended_at >= TIMESTAMP '1998-02-20')")
def s2_overlap_scan(v: Views) -> DataFrame:
    rows = v.sessions.filter("started_at < timestamp_ntz '1998-03-02' and (ended_at is null or ended_at >= timestamp_ntz '1998-02-20')")
    return rows.select("id", micros(F.col("started_at")).alias("us"))


@query("WITH r AS (SELECT id, seq FROM sessions ORDER BY started_at DESC, seq DESC LIMIT 20) SELECT r.id, count(entity) AS entities, coalesce(min(entity), '') AS first FROM r LEFT JOIN session_entities e ON e.session_id = r.id GROUP BY 1")
def s3_recent_writes(v: Views) -> DataFrame:
    recent = v.sessions.orderBy(F.desc("started_at"), F.desc("seq")).limit(20).select("id")
    rows = v.session_entities.withColumnRenamed("session_id", "id").join(recent, "id", "left_semi")
    return recent.join(rows, "id", "left").groupBy("id").agg(F.count("entity").alias("entities"), F.coalesce(F.min("entity"), F.lit("")).alias("first"))


@query("SELECT id, subject, predicate, value FROM versions WHERE subject = 'e5' AND kind = 'decision' AND confidence >= 0.5 AND superseded_by IS NULL ORDER BY created_at DESC, id DESC LIMIT 500")
def s4_fact_list(v: Views) -> DataFrame:
    rows = v.versions.filter("subject = 'e5' and kind = 'decision' and confidence >= 0.5 and superseded_by is null")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(500).select("id", "subject", "predicate", "value")


@query("SELECT session_id AS id, count(*) FILTER (kind = 'decision') AS decisions, count(*) FILTER (kind = 'open') AS opens FROM facts WHERE session_id IN (SELECT session_id FROM session_entities WHERE entity = 'e9') GROUP BY 1 HAVING count(*) FILTER (kind = 'decision') > 0")
def f1_recall_filter(v: Views) -> DataFrame:
    """Sessions with an entity and a decision."""
    own = v.facts.join(v.session_entities.filter("entity = 'e9'"), "session_id", "left_semi")
    n = lambda k: F.count_if(F.col("kind") == k)
    return own.groupBy(F.col("session_id").alias("id")).agg(n("decision").alias("decisions"), n("open").alias("opens")).filter("decisions > 0")


@query("SELECT tenant_id, coalesce(scope, '') AS scope, count(*) AS n FROM sessions WHERE tenant_id = 't1' AND (scope = 'r2' OR scope = 'global') GROUP BY 1, 2")
def f5_tenant_scope(v: Views) -> DataFrame:
    from ..operators.access import scoped, tenant

    return scoped(tenant(v.sessions, "t1"), "r2").groupBy("tenant_id", F.coalesce("scope", F.lit("")).alias("scope")).agg(_n())


@query(r"SELECT page_id, contains(url, '/') OR contains(url, chr(92)) OR starts_with(url, '.') OR regexp_matches(url, '(?i)\.(ts|js|py|rs|go|html|md|json)$') AS path_shaped FROM pages")
def f6_path_shaped(v: Views) -> DataFrame:
    from ..functions.rules import path_shaped

    return v.pages.select("page_id", path_shaped(F.col("url")).alias("path_shaped"))


@query("SELECT e.kind, s.status, count(*) AS n FROM edges e JOIN sessions s ON s.id = e.to_session GROUP BY 1, 2")
def j2_edges_sessions(v: Views) -> DataFrame:
    return v.edges.join(v.sessions.select("id", "status"), F.col("to_session") == F.col("id")).groupBy("kind", "status").agg(_n())


@query("WITH w AS (SELECT DISTINCT subject, predicate, value FROM facts WHERE subject IN ('e1', 'e2', 'e3')) SELECT w.*, count(f.id) AS n FROM w LEFT JOIN (SELECT * FROM facts WHERE confidence >= 0.6) f USING (subject, predicate, value) GROUP BY ALL")
def j3_three_key_left_join(v: Views) -> DataFrame:
    keys = ["subject", "predicate", "value"]
    wanted = v.facts.filter(F.col("subject").isin("e1", "e2", "e3")).select(*keys).distinct()
    return wanted.join(v.facts.filter("confidence >= 0.6").select(*keys, "id"), keys, "left").groupBy(*keys).agg(F.count("id").alias("n"))


@query("SELECT id FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.session_id = s.id)")
def j4_without_facts(v: Views) -> DataFrame:
    return v.sessions.select("id").join(v.facts.select(F.col("session_id").alias("id")), "id", "left_anti")


@query("SELECT f.id FROM versions f LEFT JOIN sessions s ON s.id = f.session_id WHERE s.id IS NULL OR s.status = 'superseded'")
def j5_ghosts(v: Views) -> DataFrame:
    rows = v.versions.select("id", "session_id").join(v.sessions.select(F.col("id").alias("session_id"), "status"), "session_id", "left")
    return rows.filter("status is null or status = 'superseded'").select("id")


@query("SELECT user_id, count(*) AS n FROM sessions s WHERE EXISTS (SELECT 1 FROM edges e WHERE e.to_session = s.id AND kind = 'replaces') GROUP BY 1")
def j6_semi_join(v: Views) -> DataFrame:
    replaced = v.edges.filter("kind = 'replaces'").select(F.col("to_session").alias("id"))
    return v.sessions.join(replaced, "id", "left_semi").groupBy("user_id").agg(_n())


@query("SELECT w.id, (SELECT count(*) FROM sessions s WHERE s.workstream_id = w.id) AS n FROM workstreams w")
def j7_scalar_subquery(v: Views) -> DataFrame:
    counts = v.sessions.groupBy(F.col("workstream_id").alias("id")).agg(_n())
    return v.workstreams.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


SETS = "WITH k AS (SELECT s.id, s.seq, s.started_at, string_agg(entity, chr(1) ORDER BY entity) AS k FROM sessions s JOIN (SELECT DISTINCT session_id, 'm' || (right(entity, 1)) AS entity FROM session_entities) e ON e.session_id = s.id GROUP BY ALL)"


def _with_sets(v: Views) -> DataFrame:
    members = v.session_entities.select(F.col("session_id").alias("id"), F.concat(F.lit("m"), F.right("entity", F.lit(1))).alias("m")).distinct()
    return v.sessions.select("id", "seq", "started_at").join(members.groupBy("id").agg(F.collect_list("m").alias("members")), "id")


@query(SETS + " SELECT * FROM (SELECT id, lag(id) OVER (PARTITION BY k ORDER BY started_at, seq) AS predecessor FROM k) WHERE predecessor IS NOT NULL")
def j8_same_set_predecessor(v: Views) -> DataFrame:
    return sets.predecessors(_with_sets(v), "id", "members", "started_at", "seq")


@query(SETS + ", r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY started_at DESC, seq DESC) AS r FROM k) SELECT a.id, b.id AS predecessor FROM k a JOIN r b ON a.k = b.k AND b.r <= 2 AND b.id <> a.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.r) = 1")
def j8_same_set_latest(v: Views) -> DataFrame:
    return sets.predecessors(_with_sets(v), "id", "members", "started_at", "seq", as_of=False)


@query("""WITH s AS (SELECT id, min(decided_at) AS started_at, list_distinct(list(l_partkey)) AS decisions, list_distinct(list(l_suppkey % 10)) AS members FROM decided GROUP BY 1),
x AS (SELECT DISTINCT id, l_partkey AS t FROM decided), p AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b USING (t) WHERE a.id < b.id),
e AS (SELECT substr(from_session, 2)::BIGINT AS u, substr(to_session, 2)::BIGINT AS v FROM edges), l AS (SELECT least(u, v) AS a, greatest(u, v) AS b FROM e),
j AS (SELECT a, b, len(list_intersect(y.decisions, z.decisions)) / len(list_distinct(y.decisions || z.decisions)) AS j FROM p JOIN s y ON y.id = a JOIN s z ON z.id = b WHERE list_has_any(y.members, z.members) AND abs(epoch(y.started_at) - epoch(z.started_at)) > 7 * 86400)
SELECT a, b, floor(j * 1e4 + 0.5) / 1e4 AS similarity FROM j ANTI JOIN l USING (a, b) WHERE j >= 0.5""")
def j9_rederivation(v: Views) -> DataFrame:
    """Orders play sessions, their parts decisions; every hundredth order's are decided once more by the next one."""
    sessions = v.decided.groupBy("id").agg(F.min("decided_at").alias("started_at"), F.collect_set("l_partkey").alias("decisions"))
    number = lambda c: F.substring(c, 2, 30).cast("long")
    links = v.edges.select(number("from_session").alias("a"), number("to_session").alias("b"))
    members = v.decided.select("id", (F.col("l_suppkey") % 10).alias("member"))
    return sets.rederived(sessions, members, links, similarity=0.5).withColumn("similarity", rounded(F.col("similarity")))


STREAMS = """WITH s AS (SELECT 'w' || CAST(o_custkey % 40 AS VARCHAR) AS id, list_distinct(list('e' || CAST(o_custkey % 7 AS VARCHAR))) AS entities, list_distinct(list('s' || CAST(floor(o_totalprice)::BIGINT % 50 AS VARCHAR))) AS sessions FROM orders GROUP BY 1),
t AS (SELECT *, 'stream ' || id AS label FROM s)"""


@query(STREAMS + """ SELECT a.id AS a, b.id AS b, floor(x * 1e4 + 0.5) / 1e4 AS score FROM (SELECT a, b, (len(list_intersect(a.entities, b.entities)) / len(list_distinct(a.entities || b.entities)) + len(list_intersect(a.sessions, b.sessions)) / len(list_distinct(a.sessions || b.sessions))
 + 1 - levenshtein(a.label, b.label) / greatest(length(a.label), length(b.label))) / 3 AS x FROM t a JOIN t b ON a.id < b.id) WHERE x >= 0.6""")
def j10_merge_suggestions(v: Views) -> DataFrame:
    key = lambda c: c.cast("string")
    rows = v.orders.groupBy(F.concat(F.lit("w"), key(F.col("o_custkey") % 40)).alias("id")).agg(F.collect_set(F.concat(F.lit("e"), key(F.col("o_custkey") % 7))).alias("entities"), F.collect_set(F.concat(F.lit("s"), key(F.floor("o_totalprice").cast("long") % 50))).alias("sessions"))
    return sets.merge_suggestions(rows.withColumn("label", F.concat(F.lit("stream "), "id")), 0.6).withColumn("score", rounded(F.col("score")))


NAMES = "WITH e AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Part-' WHEN p_partkey % 3 = 1 THEN 'part_' ELSE 'PART ' END || CAST(p_partkey % 199 AS VARCHAR) || CASE WHEN p_partkey % 5 = 0 THEN 's' WHEN p_partkey % 5 = 1 THEN '.py' ELSE '' END AS name, count(*) AS n FROM part GROUP BY 1), f AS (SELECT *, regexp_replace(lower(name), '[\\s\\-_.]+', '', 'g') AS fold FROM e)"


def _names(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "Part-").when(k % 3 == 1, "part_").otherwise("PART "), (k % 199).cast("string"), F.when(k % 5 == 0, "s").when(k % 5 == 1, ".py").otherwise(""))
    return v.part.groupBy(name.alias("name")).agg(_n())


@query(NAMES + " SELECT name AS source, target FROM (SELECT *, first_value(name) OVER (PARTITION BY fold ORDER BY n DESC, name) AS target FROM f) WHERE name <> target")
def j11_same_fold(v: Views) -> DataFrame:
    return sets.same_fold(_names(v), "name", "n")


@query(NAMES + """, b AS (SELECT *, CASE WHEN length(fold) > 2 THEN regexp_replace(fold, '(ts|js|py|rs|go)$', '') ELSE fold END AS base FROM f),
p AS (SELECT x.name AS na, x.n AS ca, y.name AS nb, y.n AS cb FROM b x JOIN b y ON x.fold || 's' = y.fold UNION SELECT x.name, x.n, y.name, y.n FROM b x JOIN b y ON x.base = y.base AND x.name < y.name AND x.fold <> y.fold)
SELECT CASE WHEN ca > cb OR (ca = cb AND na <= nb) THEN nb ELSE na END AS source, CASE WHEN ca > cb OR (ca = cb AND na <= nb) THEN na ELSE nb END AS target FROM p""")
def j11_likely_pairs(v: Views) -> DataFrame:
    return sets.likely_pairs(_names(v), "name", "n")


@query(NAMES.replace("WITH e", "WITH RECURSIVE e") + """, sf AS (SELECT name AS source, target FROM (SELECT *, first_value(name) OVER (PARTITION BY fold ORDER BY n DESC, name) AS target FROM f) WHERE name <> target),
b AS (SELECT *, CASE WHEN length(fold) > 2 THEN regexp_replace(fold, '(ts|js|py|rs|go)$', '') ELSE fold END AS base FROM f WHERE name NOT IN (SELECT source FROM sf)),
p AS (SELECT x.name AS na, x.n AS ca, y.name AS nb, y.n AS cb FROM b x JOIN b y ON x.fold || 's' = y.fold UNION SELECT x.name, x.n, y.name, y.n FROM b x JOIN b y ON x.base = y.base AND x.name < y.name AND x.fold <> y.fold),
o AS (SELECT row_number() OVER (ORDER BY least(na, nb), greatest(na, nb)) AS k, CASE WHEN ca > cb OR (ca = cb AND na <= nb) THEN nb ELSE na END AS source, CASE WHEN ca > cb OR (ca = cb AND na <= nb) THEN na ELSE nb END AS target FROM p),
r AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS gone UNION ALL SELECT r.k + 1, CASE WHEN list_contains(gone, source) OR list_contains(gone, target) THEN gone ELSE list_append(gone, source) END FROM r JOIN o ON o.k = r.k + 1)
SELECT source, target, 'safe' AS class FROM sf UNION ALL SELECT source, target, 'likely' FROM o JOIN (SELECT k, len(gone) > lag(len(gone)) OVER (ORDER BY k) AS took FROM r) USING (k) WHERE took""")
def j11_suggestions(v: Views) -> DataFrame:
    """The greedy pass over the list by name: no name is a source twice, or takes part after it was one."""
    return sets.suggested(_names(v), "name", "n", "name").select("source", "target", "class")


@query("SELECT session_id, count(DISTINCT entity) AS overlap FROM session_entities WHERE entity IN (SELECT entity FROM session_entities WHERE session_id IN ('s1', 's2')) GROUP BY 1 ORDER BY overlap DESC, session_id LIMIT 20")
def j12_overlap_candidates(v: Views) -> DataFrame:
    wanted = v.session_entities.filter(F.col("session_id").isin("s1", "s2"))
    return sets.overlapping(v.session_entities, wanted, "session_id", "entity", 20)


@query("SELECT coalesce(n.n_name, 'other') AS name, count(*) AS n FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1")
def j13_dimension_lookup(v: Views) -> DataFrame:
    names = v.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return v.customer.join(names, "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("other")).alias("name")).agg(_n())


SPANS = """WITH e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events), g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 7200000000)::INT, 0) AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS span FROM g), p AS (SELECT user_id, span::BIGINT AS span, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY 1, 2)"""


def _spans(v: Views) -> DataFrame:
    return timeline.spans(v.events, "user_id", gap_minutes=120)


@query(SPANS + " SELECT * FROM p")
def w4_active_spans(v: Views) -> DataFrame:
    return _spans(v)


UNION = SPANS + """, o AS (SELECT start_us, end_us, max(end_us) OVER (ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p), i AS (SELECT *, sum(coalesce((start_us > b)::INT, 0)) OVER (ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM o)"""


@query(UNION + " SELECT min(start_us) AS start_us, max(end_us) AS end_us, (max(end_us) - min(start_us)) / 60e6::DOUBLE AS minutes FROM i GROUP BY island")
def w5_interval_union(v: Views) -> DataFrame:
    return timeline.merged(_spans(v))


ATTRIBUTED = SPANS + """, a AS (SELECT user_id, span, start_us, end_us, event_type, count(*) AS hits FROM p JOIN e USING (user_id) WHERE us BETWEEN start_us AND end_us GROUP BY user_id, span, start_us, end_us, event_type QUALIFY row_number() OVER (PARTITION BY user_id, span ORDER BY count(*) DESC, event_type) = 1)"""


def _attributed(v: Views) -> DataFrame:
    return timeline.attributed(_spans(v), v.events, "user_id", "event_type")


@query(ATTRIBUTED + " SELECT * FROM a")
def w6_attribution(v: Views) -> DataFrame:
    """J14, W6."""
    return _attributed(v)


RUNS = ATTRIBUTED + """, c AS (SELECT *, coalesce((lag(event_type) OVER (PARTITION BY user_id ORDER BY start_us, span) <> event_type)::INT, 0) AS ch FROM a), r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY start_us, span ROWS UNBOUNDED PRECEDING) AS run FROM c),
b AS (SELECT user_id, run::BIGINT AS run, event_type, min(start_us) AS start_us, max(end_us) AS end_us FROM r GROUP BY 1, 2, 3)"""


@query(RUNS + " SELECT * FROM b")
def w7_topic_runs(v: Views) -> DataFrame:
    return timeline.runs(_attributed(v), "user_id", "event_type")


@query(RUNS + " SELECT user_id, count(*) - 1 AS switches, max(end_us - start_us) AS longest_us, sum(CASE WHEN end_us - start_us >= 25 * 60000000 THEN end_us - start_us ELSE 0 END)::BIGINT AS deep_us, sum(end_us - start_us)::BIGINT AS active_us, count(DISTINCT event_type) AS topics FROM b GROUP BY 1")
def w8_work_digest(v: Views) -> DataFrame:
    return timeline.focus(timeline.runs(_attributed(v), "user_id", "event_type"), "user_id", "event_type")


@query("""WITH l AS (SELECT * FROM queries_log ORDER BY ts DESC, event_id DESC LIMIT 2000), i AS (SELECT source AS surface, unnest([returned_id, 'f' || (event_id % 90) || '-1-' || (event_id % 90), 'nobody']) AS id FROM l),
d AS (SELECT DISTINCT surface, id FROM i UNION SELECT '*', id FROM i), t AS (SELECT id, scope, 0 AS o FROM sessions UNION ALL SELECT id, CASE WHEN retired = 0 THEN 'own' END, 1 FROM facts UNION ALL SELECT 's' || n, 'late', 2 FROM range(100) r(n)),
x AS (SELECT d.surface, d.id, count(t.id) > 0 AS found, arg_min(coalesce(scope, ''), o) AS scope FROM d LEFT JOIN t USING (id) GROUP BY 1, 2)
SELECT surface, count(*) AS returned, count(*) FILTER (found) AS found, count(*) FILTER (found AND scope <> '') AS scoped, CASE WHEN count(*) FILTER (found) = 0 THEN 0 ELSE floor(count(*) FILTER (found AND scope <> '') / count(*) FILTER (found) * 1e4 + 0.5) / 1e4 END::DOUBLE AS fraction FROM x GROUP BY 1""")
def a16_recall_weighted(v: Views) -> DataFrame:
    """Scopes of what the newest 2000 log entries returned: sessions first, then facts, then a table that knows some numbers as well."""
    from ..operators.dataset import recall_coverage

    k = F.col("event_id") % 90
    log = v.queries_log.select("ts", F.col("event_id").alias("entry"), "source", F.array("returned_id", F.concat(F.lit("f"), k.cast("string"), F.lit("-1-"), k.cast("string")), F.lit("nobody")).alias("ids"))
    late = v.spark.range(100).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), F.lit("late").alias("scope"))
    return recall_coverage(log, v.sessions, v.facts.select("id", F.when(F.col("retired") == 0, "own").alias("scope")), late, window=2000)


# Days of New York in spring, so that one of them has 23 hours. Users play sessions, which come back day after day.
DAYS = """WITH e AS (SELECT 'u' || user_id AS session, epoch_us(ts + INTERVAL 60 DAY) AS us, event_id, event_type FROM events), z AS (SELECT *, (timezone('America/New_York', make_timestamptz(us)))::DATE AS day FROM e),
act AS (SELECT * FROM z WHERE substr(session, 2)::INT % 10 <> 0),
g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY session, day ORDER BY us) > 7200000000)::INT, 0) AS new FROM act), s AS (SELECT *, sum(new) OVER (PARTITION BY session, day ORDER BY us ROWS UNBOUNDED PRECEDING) AS span FROM g),
sp AS (SELECT day, session, span, min(us) AS a, max(us) AS b, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT *, coalesce((a > max(b) OVER (PARTITION BY day ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS fresh FROM sp), i AS (SELECT *, sum(fresh) OVER (PARTITION BY day ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM o),
starts AS (SELECT session, min(us) AS started, max(us) AS ended FROM z GROUP BY 1),
c AS (SELECT day, island, session, sum(n) AS n, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2, 3),
seg AS (SELECT day, island, min(a) AS a, max(b) AS b, arg_min(substr(session, 2)::INT % 4, (-n, started, session)) AS topic FROM c JOIN starts USING (session) GROUP BY 1, 2)"""


def _days(v: Views) -> tuple[DataFrame, DataFrame]:
    """Sessions, of which every tenth has no transcript, and the day spans of the others."""
    rows = v.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), F.expr("ts + INTERVAL 60 DAY").cast("timestamp").alias("ts"), "user_id", "event_type", "event_id")
    some = lambda kind: F.collect_set(F.when(F.col("event_type") == kind, F.concat(F.lit("x"), (F.col("event_id") % 40).cast("string"))))
    sessions = rows.groupBy("session", (F.col("user_id") % 4).alias("topic")).agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), some("purchase").alias("decisions"), some("error").alias("open"))
    return sessions, written(digest.day_spans(rows.filter("user_id % 10 <> 0"), "America/New_York", 120), "spans")


@query(DAYS + """, t AS (SELECT day, topic, sum(b - a) AS us FROM seg GROUP BY 1, 2), u AS (SELECT *, sum(us) OVER (PARTITION BY day) AS total FROM t)
SELECT day, topic, floor(us / 60e6::DOUBLE * 10 + 0.5) / 10 AS active_minutes, CASE WHEN total = 0 THEN 0 ELSE floor(us / total * 100 + 0.5) / 100 END::DOUBLE AS share FROM u""")
def w8_by_topic(v: Views) -> DataFrame:
    sessions, spans = _days(v)
    return digest.by_topic(digest.segments(spans, sessions))


@query(DAYS + """, f AS (SELECT *, coalesce((lag(topic) OVER (PARTITION BY day ORDER BY island) <> topic)::INT, 0) AS ch FROM seg), r AS (SELECT *, sum(ch) OVER (PARTITION BY day ORDER BY island ROWS UNBOUNDED PRECEDING) AS block FROM f),
k AS (SELECT day, block, topic, sum(b - a) AS us FROM r GROUP BY 1, 2, 3)
SELECT day, floor(sum(us) / 60e6::DOUBLE * 10 + 0.5) / 10 AS active_minutes, count(*) - 1 AS context_switches, floor(max(us) / 60e6::DOUBLE * 10 + 0.5) / 10 AS longest_block_min,
CASE WHEN sum(us) = 0 THEN 0 ELSE floor(coalesce(sum(us) FILTER (us >= 25 * 60000000), 0) / sum(us) * 100 + 0.5) / 100 END::DOUBLE AS deep_work_ratio, count(DISTINCT topic) AS projects FROM k GROUP BY 1""")
def w8_focus(v: Views) -> DataFrame:
    sessions, spans = _days(v)
    return digest.focus(digest.segments(spans, sessions))


@query(DAYS + """, d AS (SELECT session, unnest(generate_series((timezone('America/New_York', make_timestamptz(started)))::DATE::TIMESTAMP, (timezone('America/New_York', make_timestamptz(ended)))::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM starts),
m AS (SELECT DISTINCT day, session, true AS there FROM sp), x AS (SELECT DISTINCT day, event_type, event_id % 40 AS x FROM d JOIN e USING (session) WHERE event_type IN ('purchase', 'error')),
y AS (SELECT day, count(*) FILTER (event_type = 'purchase') AS decisions, count(*) FILTER (event_type = 'error') AS open_loops FROM x GROUP BY 1)
SELECT day, count(*) AS sessions, count(there) AS measured, count(*) - count(there) AS skipped, coalesce(any_value(decisions), 0) AS decisions, coalesce(any_value(open_loops), 0) AS open_loops FROM d LEFT JOIN m USING (day, session) LEFT JOIN y USING (day) GROUP BY 1""")
def w8_coverage(v: Views) -> DataFrame:
    sessions, spans = _days(v)
    return digest.coverage(sessions, spans, "America/New_York")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, length(text) AS n FROM conversations")
def w10_next_start(v: Views) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return v.conversations.select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.length("text").cast("long").alias("n"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def w9_timestamp_reader(v: Views) -> DataFrame:
    rows = v.events.filter("ts >= timestamp_ntz '2024-01-10' and ts < timestamp_ntz '2024-01-12'")
    return rows.select("event_id", micros(F.col("ts")).alias("us"))


@query("SELECT id, first_value(id) OVER (PARTITION BY subject, predicate ORDER BY created_at DESC, id DESC) AS winner FROM facts QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY created_at DESC, id DESC) > 1")
def w1_latest_per_key(v: Views) -> DataFrame:
    return f.collapsed(v.facts)


@query("SELECT event_id FROM signals QUALIFY row_number() OVER (PARTITION BY repo, kind, outcome = 'pass' ORDER BY ts DESC, event_id DESC) <= 5")
def w2_bucket_cap(v: Views) -> DataFrame:
    """The newest 5 of each bucket stay; the cap is the feature."""
    w = Window.partitionBy("repo", "kind", F.col("outcome") == "pass").orderBy(F.desc("ts"), F.desc("event_id"))
    return v.signals.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("event_id")


@query("SELECT subject, predicate, arg_max(id, (created_at, id)) AS id FROM facts GROUP BY 1, 2")
def w3_batch_winners(v: Views) -> DataFrame:
    return v.facts.groupBy("subject", "predicate").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"))


@query("""SELECT count(*) FILTER (superseded_by IS NULL AND retired = 0) AS active, count(*) FILTER (superseded_by IS NOT NULL) AS superseded, count(*) FILTER (retired = 1) AS retired, (SELECT count(*) FROM (SELECT entity FROM session_entities GROUP BY 1 HAVING count(*) = 1)) AS hapax FROM versions""")
def a9_fact_stats(v: Views) -> DataFrame:
    hapax = v.session_entities.groupBy("entity").count().filter("count = 1").agg(F.count(F.lit(1)).alias("hapax"))
    n = lambda c: F.count_if(F.expr(c))
    stats = v.versions.agg(n("superseded_by is null and retired = 0").alias("active"), n("superseded_by is not null").alias("superseded"), n("retired = 1").alias("retired"))
    return stats.crossJoin(hapax)  # one row each


@query("SELECT sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) >= 20000) AS large FROM documents")
def a9_corpus_size(v: Views) -> DataFrame:
    n = F.length("text")
    return v.documents.agg(F.sum(n).cast("long").alias("chars"), F.count_if(n >= 20000).alias("large"))


@query("""WITH a AS (SELECT floor((epoch_us($now) - epoch_us(ts)) / 86400000000)::BIGINT AS age FROM events) SELECT d AS days_ago, count(age) AS n FROM (SELECT unnest(range(7)) AS d) LEFT JOIN a ON age = d GROUP BY 1""")
def a10_sparkline(v: Views) -> DataFrame:
    age = F.floor((micros(F.lit(NOW)) - micros(F.col("ts"))) / US)
    days = v.spark.range(7).withColumnRenamed("id", "days_ago")
    counts = v.events.select(age.alias("days_ago")).filter("days_ago < 7").groupBy("days_ago").agg(_n())
    return days.join(counts, "days_ago", "left").select("days_ago", F.coalesce("n", F.lit(0)).alias("n"))


COHERENCE = """WITH e AS (SELECT entity, count(*) AS n, max(started_at) AS last FROM session_entities x JOIN sessions s ON s.id = x.session_id GROUP BY 1), a AS (SELECT *, floor((epoch_us($then) - epoch_us(last)) / 86400000000)::BIGINT AS age FROM e)"""


def _aged(v: Views) -> DataFrame:
    rows = v.session_entities.join(v.sessions.select(F.col("id").alias("session_id"), "started_at"), "session_id")
    return rows.groupBy("entity").agg(_n(), F.max("started_at").alias("last")).withColumn("age", F.floor((micros(F.lit(NOW_SESSIONS)) - micros(F.col("last"))) / US))


@query(COHERENCE + " SELECT entity, n, age, CASE WHEN n = 0 THEN 'sparse' WHEN age > 30 THEN 'stale' WHEN n >= 3 THEN 'active' ELSE 'sparse' END AS state FROM a")
def a11_coherence(v: Views) -> DataFrame:
    from ..operators.dataset import coherence

    return _aged(v).select("entity", "n", "age", coherence(F.col("n"), F.col("age")).alias("state"))


@query(COHERENCE + " SELECT entity, age, CASE WHEN age > 60 THEN 'high' WHEN age > 45 THEN 'medium' ELSE 'low' END AS severity FROM a WHERE age > 30 AND entity NOT IN ('e1', 'e2')")
def a12_stale_alerts(v: Views) -> DataFrame:
    from ..operators.dataset import stale_alerts

    dismissed = v.spark.createDataFrame([("e1",), ("e2",)], "entity string")
    return stale_alerts(_aged(v), dismissed)


@query(COHERENCE + """, o AS (SELECT x.entity, started_at AS began, f.id, f.subject || ' ' || f.predicate || ' ' || f.value AS question FROM facts f JOIN session_entities x USING (session_id) JOIN sessions s ON s.id = session_id WHERE f.kind = 'open'),
p AS (SELECT entity, count(*) AS k, min_by(question, r) AS first FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY began, id) AS r FROM o) WHERE r <= 2 GROUP BY 1)
SELECT 'stale_' || entity AS alert_id, entity, age, CASE WHEN age > 60 THEN 'high' WHEN age > 45 THEN 'medium' ELSE 'low' END AS severity,
'Last touch ' || age::VARCHAR || ' days ago' || CASE WHEN k IS NULL THEN '' ELSE ' · ' || k::VARCHAR || ' unresolved open ' || CASE WHEN k = 1 THEN 'question' ELSE 'questions' END || ': "' || substr(first, 1, 80) || '"' END AS summary
FROM a LEFT JOIN p USING (entity) WHERE n > 0 AND age > 30 AND entity NOT IN ('e1', 'e2') AND entity NOT LIKE '%7'""")
def a12_alert_summaries(v: Views) -> DataFrame:
    from ..operators.dataset import alert_summaries

    hidden = v.spark.createDataFrame([("stale_e1",), ("stale_e2",)], "alert_id string")
    status = F.when(F.col("entity").endswith("7"), "snoozed").otherwise("active")
    asked = v.facts.filter("kind = 'open'").select("session_id", "id", F.concat_ws(" ", "subject", "predicate", "value").alias("question"))
    started = v.sessions.select(F.col("id").alias("session_id"), F.col("started_at").alias("at"))
    opens = asked.join(started, "session_id").join(v.session_entities, "session_id")
    return alert_summaries(_aged(v).withColumn("status", status), hidden, opens)


@query("""SELECT coalesce(nullif(trim(runtime), ''), 'unknown') AS runtime, count(*) AS total, count(*) FILTER (started_at >= $then - INTERVAL 7 DAY) AS week, epoch_us(max(started_at)) AS last_us,
CASE WHEN max(started_at) >= $then - INTERVAL 1 HOUR THEN 'active' WHEN max(started_at) >= $then - INTERVAL 24 HOUR THEN 'idle' ELSE 'dormant' END AS state FROM sessions GROUP BY 1""")
def a13_runtimes(v: Views) -> DataFrame:
    from ..operators.dataset import runtimes

    return runtimes(v.sessions, NOW_SESSIONS)


@query("SELECT t AS surface, count(*) AS total, count(scope) AS stamped, floor(count(scope) / count(*) * 1e4 + 0.5) / 1e4 AS fraction FROM (SELECT 'sessions' AS t, scope FROM sessions UNION ALL SELECT 'workstreams', CASE WHEN merged_into IS NULL THEN 'global' END FROM workstreams) GROUP BY 1")
def a16_scope_coverage(v: Views) -> DataFrame:
    rows = v.sessions.select(F.lit("sessions").alias("surface"), "scope").unionByName(v.workstreams.select(F.lit("workstreams").alias("surface"), F.when(F.col("merged_into").isNull(), "global").alias("scope")))
    return rows.groupBy("surface").agg(F.count(F.lit(1)).alias("total"), F.count("scope").alias("stamped"), rounded(F.count("scope") / F.count(F.lit(1))).alias("fraction"))


@query("""WITH r AS (SELECT 'sessions' AS surface, scope FROM sessions UNION ALL SELECT 'facts', s.scope FROM facts f JOIN sessions s ON s.id = f.session_id UNION ALL SELECT 'exemplars', source FROM documents
UNION ALL SELECT 'signals', CASE WHEN step IS NOT NULL THEN repo END FROM signals UNION ALL SELECT 'workstreams', CASE WHEN merged_into IS NULL THEN 'global' END FROM workstreams),
c AS (SELECT surface, scope, count(*) AS total, count(scope) AS stamped FROM r WHERE scope IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT surface, '*', count(*), count(scope) FROM r GROUP BY 1 UNION ALL SELECT '*', '*', count(*), count(scope) FROM r)
SELECT *, total - stamped AS unstamped, floor(stamped / total * 1e4 + 0.5) / 1e4 AS fraction FROM c""")
def a16_by_scope(v: Views) -> DataFrame:
    from ..operators.dataset import scope_coverage

    own = v.sessions.select(F.col("id").alias("session_id"), "scope")
    surfaces = {
        "sessions": own.select("scope"),
        "facts": v.facts.join(own, "session_id").select("scope"),
        "exemplars": v.documents.select(F.col("source").alias("scope")),
        "signals": v.signals.select(F.when(F.col("step").isNotNull(), F.col("repo")).alias("scope")),
        "workstreams": v.workstreams.select(F.when(F.col("merged_into").isNull(), "global").alias("scope")),
    }
    rows = [x.select(F.lit(name).alias("surface"), "scope") for name, x in surfaces.items()]
    return scope_coverage(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4]))


@query("SELECT entity, count(*) AS session_count FROM session_entities GROUP BY 1")
def a19_session_counts(v: Views) -> DataFrame:
    return v.session_entities.groupBy("entity").agg(F.count(F.lit(1)).alias("session_count"))


@query("""WITH l AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 24) SELECT event_type AS lane, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (user_id % 2 = 0) AS superseded FROM events WHERE event_type IN (SELECT event_type FROM l) GROUP BY 1, 2""")
def a20_heat_map(v: Views) -> DataFrame:
    lanes = v.events.groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(24).select("event_type")
    rows = v.events.join(lanes, "event_type", "left_semi")
    return rows.groupBy(F.col("event_type").alias("lane"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(_n(), F.count_if(F.col("user_id") % 2 == 0).alias("superseded"))


@query("SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '6+' END AS bucket, count(*) AS entities FROM (SELECT session_id, count(*) AS n FROM session_entities GROUP BY 1) GROUP BY 1")
def a21_size_facets(v: Views) -> DataFrame:
    n = v.session_entities.groupBy("session_id").agg(_n())
    return n.groupBy(F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").otherwise("6+").alias("bucket")).agg(F.count(F.lit(1)).alias("entities"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def a22_search_facets(v: Views) -> DataFrame:
    return v.documents.groupBy("lang", "source").agg(_n())


@query(r"""WITH q AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN '  ' || c_name || ' ' WHEN c_custkey % 3 = 0 THEN 'alias ' || c_custkey ELSE 'nobody ' || c_custkey END AS name FROM customer),
k AS (SELECT name, lower(regexp_replace(trim(name), '\s+', ' ', 'g')) AS k FROM q), l AS (SELECT lower(regexp_replace(trim(label), '\s+', ' ', 'g')) AS k, min(id) AS id FROM workstreams GROUP BY 1), a AS (SELECT 'alias ' || substr(id, 2) AS k, id FROM workstreams)
SELECT name, coalesce(l.id, a.id) AS id, CASE WHEN l.id IS NOT NULL THEN 'label' ELSE 'alias' END AS how FROM k LEFT JOIN l USING (k) LEFT JOIN a USING (k) WHERE coalesce(l.id, a.id) IS NOT NULL""")
def j16_name_match(v: Views) -> DataFrame:
    """Streams by label, else by alias."""
    from ..operators.mutations import bound

    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).when(k % 3 == 0, F.concat(F.lit("alias "), k.cast("string"))).otherwise(F.concat(F.lit("nobody "), k.cast("string")))
    aliases = v.workstreams.select(F.concat(F.lit("Alias  "), F.substring("id", 2, 20)).alias("alias"), "id")
    return bound(v.customer.select(name.alias("name")), v.workstreams.select("id", "label"), aliases).filter("how <> 'created'")


@query("SELECT id, total FROM (SELECT id, size AS total, row_number() OVER (ORDER BY size DESC, id) AS r FROM sessions) WHERE r BETWEEN 21 AND 40")
def t2_page(v: Views) -> DataFrame:
    return v.sessions.orderBy(F.desc("size"), "id").offset(20).limit(20).select("id", F.col("size").alias("total"))


@query("SELECT id, seq FROM sessions WHERE seq > 1000 ORDER BY seq LIMIT 50")
def t3_keyset(v: Views) -> DataFrame:
    return v.sessions.filter("seq > 1000").orderBy("seq").limit(50).select("id", "seq")


@query("SELECT id FROM sessions WHERE runtime IS DISTINCT FROM 'F' AND size < 20000 ORDER BY started_at DESC, seq DESC LIMIT 30")
def t4_reprocess_candidates(v: Views) -> DataFrame:
    return v.sessions.filter(~F.col("runtime").eqNullSafe("F") & (F.col("size") < 20000)).orderBy(F.desc("started_at"), F.desc("seq")).limit(30).select("id")


@query("SELECT id, size FROM sessions WHERE status = 'replaced' ORDER BY size DESC, id LIMIT 10")
def t5_oversized(v: Views) -> DataFrame:
    return v.sessions.filter("status = 'replaced'").orderBy(F.desc("size"), "id").limit(10).select("id", "size")


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, n * 50.0::DOUBLE / sum(n) OVER () AS x FROM n), a AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, lang) <= 50 - sum(floor(x)) OVER ())::INT AS k FROM t)
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) JOIN a USING (lang) WHERE r <= k""")
def t6_stratified_sample(v: Views) -> DataFrame:
    from ..operators.dataset import stratified

    return stratified(v.documents.select("doc_id", "lang"), "doc_id", "lang", 50)


@query("""WITH p AS (SELECT doc_id, coalesce(lang, '') || ':' || CASE WHEN length(text) < 3000 THEN 'short' WHEN length(text) < 10000 THEN 'medium' ELSE 'long' END AS stratum FROM documents),
c AS (SELECT doc_id FROM p WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 30), o AS (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM c)),
n AS (SELECT stratum, count(*) AS n FROM o GROUP BY 1), t AS (SELECT *, n * 20.0::DOUBLE / sum(n) OVER () AS x FROM n), a AS (SELECT *, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, stratum) <= 20 - sum(floor(x)) OVER ())::INT AS k FROM t)
SELECT doc_id, 'citation' AS chosen_by FROM c UNION ALL SELECT doc_id, 'stratum' FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM o) JOIN a USING (stratum) WHERE r <= k""")
def t6_gold_sample(v: Views) -> DataFrame:
    from ..operators.dataset import gold_sample, length_bucket

    stratum = F.concat(F.coalesce("lang", F.lit("")), F.lit(":"), length_bucket(F.length("text")))
    return gold_sample(v.documents.select("doc_id", stratum.alias("stratum")), v.labels.filter("quality = 1"), "doc_id", "stratum", 50)


@query("""WITH r AS (SELECT doc_id, CASE WHEN length(text) < 100 THEN 'short' WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'duplicate' WHEN NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'unresolved' ELSE 'eligible' END AS reason FROM documents d) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def t7_eligibility(v: Views) -> DataFrame:
    from ..operators.dataset import eligibility

    return eligibility(v.documents, v.labels, "doc_id", "text", 100).groupBy("reason").agg(_n())


@query(r"""WITH p AS (SELECT doc_id, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x, CASE WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 5 = 0 THEN 'short line' || chr(10) || '  ' || substr(text, 40, 60) || ' ' ELSE 'another line of some length ' || doc_id || chr(10) || substr(text, 1, 12) END AS block FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(block, chr(10)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: length(y) >= 20) AS ls FROM p),
r AS (SELECT doc_id, CASE WHEN length(x) < 100 THEN 'short' WHEN doc_id <> min(doc_id) FILTER (length(x) >= 100) OVER (PARTITION BY md5(x)) THEN 'duplicate' WHEN block IS NULL THEN 'unresolved' WHEN len(list_filter(ls, lambda y: contains(text, y))) > 0 THEN 'leakage' ELSE 'eligible' END AS reason FROM l)
SELECT reason, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1""")
def t7_leakage(v: Views) -> DataFrame:
    """Exclusions in order: some prompts hold a long line of their own block, some only a short one."""
    from ..operators.dataset import eligible

    k = F.col("doc_id")
    leaked = F.concat(F.lit("short line\n  "), F.substring("text", 40, 60), F.lit(" "))
    block = F.when(k % 4 != 3, F.when(k % 5 == 0, leaked).otherwise(F.concat(F.lit("another line of some length "), k.cast("string"), F.lit("\n"), F.substring("text", 1, 12))))
    found = eligible(v.documents, v.documents.select("doc_id", block.alias("block")), "doc_id", "text", "doc_id", 100)
    return found.groupBy("reason").agg(_n(), F.min("doc_id").alias("first"))


@query("SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)")
def u1_union(v: Views) -> DataFrame:
    return v.nation.select(F.col("n_name").alias("name")).union(v.region.select(F.col("r_name").alias("name"))).distinct()


@query("(SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') EXCEPT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 45")
def u2_intersect_except(v: Views) -> DataFrame:
    key = lambda c: v.lineitem.filter(c).select(F.col("l_partkey").alias("k"))
    return key("l_returnflag = 'R'").intersect(key("l_returnflag = 'A'")).subtract(key("l_linestatus = 'O' and l_quantity > 45"))


@query("SELECT event_type, min(event_id) AS first FROM events GROUP BY 1")
def u3_first_occurrence(v: Views) -> DataFrame:
    return v.events.groupBy("event_type").agg(F.min("event_id").alias("first"))
