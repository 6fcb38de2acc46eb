"""Queries over changes: K1-K5, M1-M14."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import micros
from ..operators import mutations as m
from ..operators.tables import shared_dir
from .registry import NOW, NOW_SESSIONS, Views, query


def _batch(v: Views) -> DataFrame:
    late = F.col("seq") % 3 == 0
    new = v.sessions.filter("seq % 6 = 0").select("id", F.concat("label", F.lit("!")).alias("label"), F.when(late, "late").alias("runtime"), F.lit(0.0).alias("size"))
    return new.unionByName(v.spark.createDataFrame([("new1", "fresh", "late", 5.0)], "id string, label string, runtime string, size double"))


@query("""WITH n AS (SELECT id, label || '!' AS label, CASE WHEN seq % 3 = 0 THEN 'late' END AS runtime, 0.0::DOUBLE AS size FROM sessions WHERE seq % 6 = 0 UNION ALL SELECT 'new1', 'fresh', 'late', 5.0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.label, o.label) AS label, coalesce(n.runtime, o.runtime) AS runtime, CASE WHEN o.id IS NOT NULL THEN o.size ELSE n.size END AS size FROM sessions o FULL JOIN n ON n.id = o.id""")
def k1_upsert(v: Views) -> DataFrame:
    old = v.sessions.select("id", "label", "runtime", "size")
    return m.upsert(old, _batch(v), "id", keep=["size"], fill=["runtime"])


@query("WITH n AS (SELECT DISTINCT session_id, 'x' || entity AS entity FROM session_entities WHERE session_id LIKE 's%7'), a AS (SELECT * FROM session_entities WHERE session_id NOT IN (SELECT session_id FROM n) UNION ALL SELECT * FROM n) SELECT session_id, count(*) AS n, min(entity) AS first FROM a GROUP BY 1")
def k2_replace_children(v: Views) -> DataFrame:
    new = v.session_entities.filter("session_id like 's%7'").withColumn("entity", F.concat(F.lit("x"), "entity"))
    return m.replace_children(v.session_entities, new, "session_id").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("first"))


@query("SELECT count(*) AS n, count(*) FILTER (producer = 'again') AS fresh FROM (SELECT event_id, producer FROM signals WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'again' FROM signals WHERE event_id % 3 = 0 AND event_id % 2 <> 0)")
def k3_insert_ignore(v: Views) -> DataFrame:
    old = v.signals.filter("event_id % 2 = 0").select("event_id", "producer")
    again = v.signals.filter("event_id % 3 = 0").select("event_id", F.lit("again").alias("producer"))
    out = m.insert_ignore(old, again.union(again), ["event_id"])
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("producer") == "again").alias("fresh"))


@query("SELECT conversation_id AS c, count(*) AS n FROM queries_log WHERE conversation_id <> 'c1' GROUP BY 1")
def k4_appended_log(v: Views) -> DataFrame:
    """Two appends to a log of JSON lines; rows of unknown conversations never get there."""
    from ..operators.graph import shared_dir
    from ..sources.logs import append_log

    path = f"{shared_dir(v.spark)}/log-{uuid.uuid4().hex}"
    rows = v.queries_log.select(F.when(F.col("conversation_id") == "c1", "unknown").otherwise(F.col("conversation_id")).alias("conversation_id"), "event_id")
    for part in (0, 1):
        append_log(rows.filter(F.col("event_id") % 2 == part), path, "conversation_id")
    log = v.spark.read.schema("conversation_id string, event_id long").json(path)
    return log.groupBy(F.col("conversation_id").alias("c")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events WHERE date_diff('day', ts::DATE, DATE '2024-01-31') >= 14")
def k5_snapshot_rotation(v: Views) -> DataFrame:
    days = v.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return m.prune_snapshots(days, "day", 14, "2024-01-31")


ACTIONS = """a AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'rename_entity' WHEN 1 THEN 'retire_entity' WHEN 2 THEN 'merge_entity' WHEN 3 THEN 'set_coherence' WHEN 4 THEN 'label_entity' ELSE 'snooze' END AS kind, 'entity' AS subject_type, 'e' || CAST(user_id % 40 AS VARCHAR) AS subject_id,
CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN '{"to": " "}' ELSE '{"to": "n' || event_id % 9 || '"}' END WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'broken' ELSE '{"into": "e' || event_id % 40 || '"}' END WHEN 3 THEN CASE WHEN event_id % 4 = 1 THEN '{"state": "odd"}' ELSE '{"state": "stale"}' END
WHEN 4 THEN CASE WHEN event_id % 5 = 0 THEN '{}' ELSE '{"new_type": "t' || event_id % 7 || '"}' END WHEN 5 THEN '{"snoozed_until": "2024-0' || (event_id % 3 + 1) || '-15T00:00:00"}' END AS payload, CASE WHEN event_id % 50 = 0 THEN 1 END AS reverted_by FROM events)"""
LAID = "WITH " + ACTIONS + """, p AS (SELECT *, CASE WHEN payload IS NULL OR payload = 'broken' THEN '' ELSE coalesce(trim(CASE kind WHEN 'rename_entity' THEN json_extract_string(payload, '$.to') WHEN 'merge_entity' THEN json_extract_string(payload, '$.into') WHEN 'set_coherence' THEN json_extract_string(payload, '$.state')
 WHEN 'label_entity' THEN json_extract_string(payload, '$.new_type') WHEN 'snooze' THEN json_extract_string(payload, '$.snoozed_until') END), '') END AS raw FROM a WHERE reverted_by IS NULL),
x AS (SELECT *, CASE WHEN kind = 'set_coherence' AND raw NOT IN ('active', 'sparse', 'stale') THEN '' WHEN kind = 'rename_entity' AND raw = subject_id THEN '' ELSE raw END AS value FROM p),
l AS (SELECT kind, subject_type, subject_id, value FROM x WHERE kind IN ('rename_entity', 'merge_entity', 'set_coherence', 'retire_entity') OR (kind = 'label_entity' AND value <> '') OR (kind = 'snooze' AND value > '2024-01-31T00:00:00') QUALIFY row_number() OVER (PARTITION BY kind, subject_type, subject_id ORDER BY id DESC) = 1),
o AS (SELECT * FROM l WHERE kind NOT IN ('rename_entity', 'merge_entity', 'set_coherence') OR value <> '')"""


def _actions(v: Views) -> DataFrame:

    sql = ACTIONS[len("a AS (") : -1].replace("FROM events", "FROM {events}").replace("AS VARCHAR", "AS STRING")
    for word in ("event_id % 9 ||", "event_id % 40 ||", "event_id % 7 ||"):
        sql = sql.replace(f"|| {word}", f"|| CAST({word[:-3]} AS STRING) ||")
    # Braces of the JSON texts are not names of tables.
    safe = sql.replace("'{\"", "'<\"").replace("\"}'", "\">'").replace("'{}'", "'<>'")
    found = v.spark.sql(safe, events=v.events)
    return found.withColumn("payload", F.translate("payload", "<>", "{}"))


@query(LAID + " SELECT kind, subject_type, subject_id, value FROM o")
def m1_overlay(v: Views) -> DataFrame:
    return m.overlay(_actions(v), NOW)


@query(LAID + """, e AS (SELECT 'e' || CAST(user_id % 40 AS VARCHAR) AS entity, count(*) AS n FROM events GROUP BY 1), t AS (SELECT coalesce(o.value, e.entity) AS entity, sum(n)::BIGINT AS n FROM e LEFT JOIN o ON o.subject_id = e.entity AND o.kind = 'merge_entity' GROUP BY 1)
SELECT t.entity, n, CASE WHEN r.kind IS NOT NULL THEN 'retired' WHEN s.kind IS NOT NULL THEN 'snoozed' ELSE 'active' END AS state FROM t LEFT JOIN o r ON r.subject_id = t.entity AND r.kind = 'retire_entity' LEFT JOIN o s ON s.subject_id = t.entity AND s.kind = 'snooze'""")
def m2_projection(v: Views) -> DataFrame:
    entities = v.events.groupBy(F.concat(F.lit("e"), (F.col("user_id") % 40).cast("string")).alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return m.projected(entities, m.overlay(_actions(v), NOW))


ENTITIES = LAID + """, e AS (SELECT 'e' || CAST(user_id % 40 AS VARCHAR) AS entity, count(*) FILTER (event_type = 'signup') AS n, floor((epoch_us($now) - epoch_us(max(ts) - to_days((user_id % 40)::INT))) / 86400000000)::BIGINT AS age, 'kind' || CAST(user_id % 3 AS VARCHAR) AS type FROM events WHERE event_id % 50 = user_id % 40 GROUP BY user_id % 40, user_id % 3),
u AS (SELECT entity, sum(n)::BIGINT AS n, min(age) AS age, min(type) AS type FROM e GROUP BY 1), oe AS (SELECT * FROM o WHERE subject_type = 'entity'),
f AS (SELECT v.value AS entity, sum(n) AS more FROM u JOIN oe v ON v.subject_id = u.entity AND v.kind = 'merge_entity' GROUP BY 1), g AS (SELECT u.entity, (n + coalesce(more, 0))::BIGINT AS n, age, type FROM u LEFT JOIN f USING (entity)),
h AS (SELECT *, CASE WHEN n = 0 THEN 'sparse' WHEN age > 30 THEN 'stale' WHEN n >= 3 THEN 'active' ELSE 'sparse' END AS coherence_computed FROM g), val AS (SELECT subject_id AS entity, max(value) FILTER (kind = 'label_entity') AS t, max(value) FILTER (kind = 'rename_entity') AS d, max(value) FILTER (kind = 'set_coherence') AS c,
  count(*) FILTER (kind IN ('merge_entity', 'retire_entity')) > 0 AS gone, count(*) FILTER (kind = 'snooze') > 0 AS later FROM oe GROUP BY 1),
cat AS (SELECT h.entity, n, coalesce(t, type) AS type, coalesce(d, h.entity) AS display, CASE WHEN gone THEN 'retired' WHEN later THEN 'snoozed' ELSE 'active' END AS status, coherence_computed, coalesce(c, coherence_computed) AS coherence FROM h LEFT JOIN val USING (entity))"""


def _catalogue(v: Views) -> DataFrame:
    """Entities that some events name, with few sessions each, and older the larger their number is."""
    from ..operators.dataset import catalogue

    k = F.col("user_id") % 40
    age = F.floor((micros(F.lit(NOW)) - micros(F.max("ts") - F.make_dt_interval(F.first(k).cast("int")))) / F.lit(86_400_000_000))
    rows = v.events.filter(F.col("event_id") % 50 == k).groupBy(k.alias("k"), (F.col("user_id") % 3).alias("m")).agg(F.count_if(F.col("event_type") == "signup").alias("n"), age.alias("age"))
    rows = rows.groupBy(F.concat(F.lit("e"), F.col("k").cast("string")).alias("entity")).agg(F.sum("n").alias("n"), F.min("age").alias("age"), F.concat(F.lit("kind"), F.min("m").cast("string")).alias("type"))
    return catalogue(rows.withColumns({"display": F.col("entity"), "status": F.lit("active")}), m.overlay(_actions(v), NOW))


@query(ENTITIES + " SELECT * FROM cat")
def m2_catalogue(v: Views) -> DataFrame:
    return _catalogue(v)


@query(ENTITIES + """, xs AS (SELECT s.*, (SELECT count(*) FROM facts f WHERE f.session_id = s.id AND f.kind = 'decision') AS decisions, date_diff('second', started_at, $then) / 86400 AS age FROM sessions s)
SELECT count(*) FILTER (age >= 0 AND age < 7) AS this_week, count(*) FILTER (age >= 7 AND age < 14) AS last_week, coalesce(sum(decisions) FILTER (coalesce(status NOT IN ('superseded', 'replaced'), true)), 0)::BIGINT AS closed_decisions,
(SELECT count(*) FROM cat WHERE n > 0 AND coherence = 'active') AS healthy, (SELECT count(*) FROM cat WHERE n > 0 AND coherence NOT IN ('active', 'stale')) AS sparse, (SELECT count(*) FROM cat WHERE n > 0 AND coherence = 'stale') AS stale FROM xs""")
def a10_metrics(v: Views) -> DataFrame:
    from ..operators.dataset import metrics

    decided = v.facts.filter("kind = 'decision'").groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("decisions"))
    return metrics(v.sessions.join(decided, "id", "left"), _catalogue(v), NOW_SESSIONS)


@query(ENTITIES + """, al AS (SELECT CASE WHEN age > 60 THEN 'high' WHEN age > 45 THEN 'medium' ELSE 'low' END AS severity FROM h WHERE age > 30)
SELECT 'severity' AS facet, value, count(*) AS n FROM (SELECT unnest(['all', severity]) AS value FROM al) GROUP BY 2
UNION ALL SELECT coherence, value, count(*) FROM (SELECT coherence, unnest(list_filter(['any', CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' ELSE '6+' END, CASE WHEN coherence <> coherence_computed THEN 'overridden' END], lambda y: y IS NOT NULL)) AS value FROM cat WHERE n > 0) GROUP BY 1, 2""")
def a21_facets(v: Views) -> DataFrame:
    from ..operators.dataset import facets, stale_alerts

    k = F.col("user_id") % 40
    age = F.floor((micros(F.lit(NOW)) - micros(F.max("ts") - F.make_dt_interval(F.first(k).cast("int")))) / F.lit(86_400_000_000))
    aged = v.events.filter(F.col("event_id") % 50 == k).groupBy(k.alias("k"), F.col("user_id") % 3).agg(age.alias("age")).groupBy(F.concat(F.lit("e"), F.col("k").cast("string")).alias("entity")).agg(F.min("age").alias("age"))
    return facets(_catalogue(v), stale_alerts(aged, aged.select("entity").limit(0)))


@query("""WITH n AS (SELECT id, session_id, subject, predicate, row_number() OVER (ORDER BY created_at, id) AS pos FROM facts WHERE session_id LIKE 's%3'), w AS (SELECT subject, predicate, arg_max(id, pos) AS winner FROM n GROUP BY 1, 2),
a AS (SELECT id, subject, predicate, superseded_by FROM versions WHERE session_id NOT IN (SELECT session_id FROM n) UNION ALL SELECT id, subject, predicate, NULL FROM n)
SELECT id, coalesce(superseded_by, CASE WHEN winner <> id THEN winner END) AS superseded_by FROM a LEFT JOIN w USING (subject, predicate)""")
def m3_fact_ingest(v: Views) -> DataFrame:
    new = v.facts.filter("session_id like 's%3'").withColumn("pos", F.struct("created_at", "id"))
    return m.ingested_facts(v.versions, new)


ITEMS = "SELECT id, session_id, CASE WHEN kind = 'attribute' THEN 'open' ELSE kind END AS kind, value AS text FROM facts WHERE kind <> 'open'"


@query("""WITH i AS (""" + ITEMS + """), n AS (SELECT *, CAST(regexp_extract(id, '[0-9]+$', 0) AS BIGINT) % 8 AS m FROM i)
SELECT session_id, id, CASE WHEN kind = 'open' AND m IN (1, 2) THEN 'decision' ELSE kind END AS kind, CASE WHEN kind = 'open' AND m IN (1, 2) THEN 'r' || text WHEN kind = 'decision' AND m = 4 THEN 'now' ELSE text END AS text
FROM n WHERE NOT (kind = 'open' AND m = 0) AND NOT (kind = 'decision' AND m = 3)""")
def m2_decisions(v: Views) -> DataFrame:
    """Questions and decisions of sessions, of which actions resolved (0, 2), promoted (1, 2), dismissed (3) and revised (4) some."""
    items = v.facts.filter("kind <> 'open'").select("id", "session_id", F.when(F.col("kind") == "attribute", "open").otherwise(F.col("kind")).alias("kind"), F.col("value").alias("text"))
    n = F.regexp_extract("id", "[0-9]+$", 0).cast("long") % 8
    json = lambda k, c: F.to_json(F.struct(c.alias(k)))
    act = lambda kind, subject, which, payload: items.filter(n.isin(*which)).select(F.xxhash64("id").alias("n"), F.lit(kind).alias("kind"), F.lit(subject).alias("subject_type"), F.col("id").alias("subject_id"), payload.alias("payload"), F.lit(None).cast("int").alias("reverted_by"))
    none = F.lit(None).cast("string")
    actions = act("resolve_open", "open_question", (0, 2), none).union(act("promote_open", "open_question", (1, 2), json("resolution", F.concat(F.lit("r"), "text")))).union(act("dismiss_decision", "decision", (3,), none)).union(act("revise_decision", "decision", (4,), json("to", F.lit(" now "))))
    return m.with_decisions(items, m.overlay(actions.withColumnRenamed("n", "id"), NOW))


WRITES = """WITH w AS (SELECT id, 'supersede' AS action, superseded_by AS heir, 1 AS pos FROM versions WHERE version = 2 UNION ALL SELECT id, 'supersede', NULL, 2 FROM versions WHERE version = 2
UNION ALL SELECT id, 'embed', NULL, 3 FROM versions WHERE version = 2 AND confidence > 0.6 UNION ALL SELECT id, 'supersede', CASE WHEN length(value) % 2 = 0 THEN id ELSE 'nobody' END, 4 FROM versions WHERE version = 1 AND confidence > 0.6
UNION ALL SELECT id, 'retire', '0', 5 FROM versions WHERE version = 3 UNION ALL SELECT id || 'x', 'retire', '1', 6 FROM versions WHERE version = 4 UNION ALL SELECT id, 'retire', '1', 7 FROM versions WHERE confidence < 0.4),
e AS (SELECT w.*, CASE WHEN action = 'supersede' AND w.id = heir THEN 'self' WHEN w.id NOT IN (SELECT id FROM versions) THEN 'missing' WHEN action = 'supersede' AND heir IS NOT NULL AND heir NOT IN (SELECT id FROM versions) THEN 'missing target' END AS error FROM w)"""


def _writes(v: Views) -> DataFrame:
    """Second versions are superseded once more, made current again, and the surer ones embedded anew; some writes can't be done; doubtful facts are retired."""
    of = lambda where, action, by, pos, key="id": v.versions.filter(where).select(F.expr(key).alias("id"), F.lit(action).alias("action"), F.expr(by).cast("string").alias("by"), F.lit(pos).alias("pos"))
    wrong = "case when length(value) % 2 = 0 then id else 'nobody' end"
    parts = [of("version = 2", "supersede", "superseded_by", 1), of("version = 2", "supersede", "null", 2), of("version = 2 and confidence > 0.6", "embed", "null", 3), of("version = 1 and confidence > 0.6", "supersede", wrong, 4),
             of("version = 3", "retire", "'0'", 5), of("version = 4", "retire", "'1'", 6, "id || 'x'"), of("confidence < 0.4", "retire", "'1'", 7)]
    return functools.reduce(DataFrame.union, parts)


@query(WRITES + """, g AS (SELECT id, max(pos) FILTER (action = 'supersede') AS s, max(pos) FILTER (action = 'retire') AS r, max(pos) FILTER (action = 'embed') AS e, max(pos) FILTER ((action = 'supersede' AND heir IS NOT NULL) OR (action = 'retire' AND heir = '1')) AS gone FROM e WHERE error IS NULL GROUP BY 1)
SELECT v.id, CASE WHEN s IS NULL THEN superseded_by WHEN s = 1 THEN superseded_by END AS superseded_by, CASE r WHEN 5 THEN 0 WHEN 7 THEN 1 ELSE retired END AS retired,
CASE WHEN e IS NULL AND gone IS NULL THEN superseded_by IS NULL AND retired = 0 ELSE coalesce(e, 0) > coalesce(gone, 0) END AS embedded FROM versions v LEFT JOIN g USING (id)""")
def m4_fact_versions(v: Views) -> DataFrame:
    return m.fact_versions(v.versions.select("id", "superseded_by", "retired"), _writes(v))


@query(WRITES + " SELECT id, action, pos, error FROM e WHERE error IS NOT NULL")
def m4_write_errors(v: Views) -> DataFrame:
    return m.fact_writes(v.versions, _writes(v)).filter("error is not null").select("id", "action", "pos", "error")


@query("""WITH k AS (SELECT DISTINCT x.session_id, CASE WHEN CAST(substr(entity, 2) AS INT) % 10 = 7 THEN 'e' || CAST(CAST(substr(entity, 2) AS INT) - 7 AS VARCHAR) ELSE entity END AS entity FROM session_entities x)
SELECT entity, count(*) AS n, min(epoch_us(started_at)) AS first_us, max(epoch_us(started_at)) AS last_us FROM k JOIN sessions s ON s.id = k.session_id GROUP BY 1""")
def m5_entity_merge(v: Views) -> DataFrame:
    merges = v.spark.createDataFrame([(f"e{i}", f"e{i - 7}") for i in range(7, 400, 10)], "source string, target string")
    return m.merged_entities(v.session_entities, merges, v.sessions)


NAMES = "SELECT 'e' || CAST(l_partkey % 400 AS VARCHAR) AS canonical, 'v' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem GROUP BY 1, 2"


@query("WITH n AS (" + NAMES + """), m AS (SELECT 'e' || i AS source, 'e' || (i - 7) AS target FROM range(7, 400, 10) t(i) UNION ALL SELECT 'e' || i, 'e' || (i + 5) FROM range(0, 390, 20) t(i)),
e AS (SELECT a.source, coalesce(b.target, a.target) AS target FROM m a LEFT JOIN m b ON b.source = a.target)
SELECT name, coalesce(e.target, canonical) AS canonical, false AS retired FROM n LEFT JOIN e ON e.source = canonical UNION ALL SELECT source, target, true FROM e""")
def m5_repointed_variants(v: Views) -> DataFrame:
    """Chains of merges: 7 into 0, 0 into 5."""
    merges = v.spark.createDataFrame([(f"e{i}", f"e{i - 7}") for i in range(7, 400, 10)] + [(f"e{i}", f"e{i + 5}") for i in range(0, 390, 20)], "source string, target string")
    variants = v.lineitem.select(F.concat(F.lit("e"), (F.col("l_partkey") % 400).cast("string")).alias("canonical"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("name")).distinct()
    return m.repointed(variants, merges)


@query("""WITH k AS (SELECT DISTINCT entity, CAST(substr(entity, 2) AS INT) % 7 = 3 AS retired FROM session_entities), p AS (SELECT entity AS source, 'e' || CAST((CAST(substr(entity, 2) AS INT) * 3) % 450 AS VARCHAR) AS target, retired FROM k)
SELECT source, target, CASE WHEN source = target THEN 'self' WHEN b.entity IS NULL THEN 'missing' WHEN p.retired OR b.retired THEN 'retired' END AS error FROM p LEFT JOIN k b ON b.entity = p.target""")
def m5_merge_errors(v: Views) -> DataFrame:
    n = F.substring("entity", 2, 10).cast("int")
    known = v.session_entities.select("entity").distinct().withColumn("retired", n % 7 == 3)
    return m.merge_errors(known.select(F.col("entity").alias("source"), F.concat(F.lit("e"), (n * 3 % 450).cast("string")).alias("target")), known)


STREAM_COUNTS = "SELECT workstream_id AS id, status AS entity, count(*) AS n FROM sessions GROUP BY 1, 2"


@query(f"""WITH RECURSIVE r AS (SELECT id, merged_into AS to_id FROM workstreams WHERE merged_into <> id UNION SELECT r.id, w.merged_into FROM r JOIN workstreams w ON w.id = r.to_id WHERE w.merged_into <> w.id),
f AS (SELECT r.id, to_id FROM r LEFT JOIN workstreams w ON w.id = r.to_id WHERE coalesce(w.merged_into, w.id) = w.id), c AS ({STREAM_COUNTS}) SELECT coalesce(f.to_id, c.id) AS id, entity, sum(n)::BIGINT AS n FROM c LEFT JOIN f ON f.id = c.id GROUP BY 1, 2""")
def m6_workstream_merge(v: Views) -> DataFrame:
    """Counts of a merged stream are added to its survivor's."""
    counts = v.sessions.groupBy(F.col("workstream_id").alias("id"), F.col("status").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    merges = v.workstreams.filter("merged_into <> id").select(F.col("id").alias("source"), F.col("merged_into").alias("target"))
    return m.merged_streams(v.workstreams.select("id", "label"), counts, merges)[1]


@query(f"""WITH RECURSIVE r AS (SELECT id, merged_into AS to_id FROM workstreams WHERE merged_into <> id UNION SELECT r.id, w.merged_into FROM r JOIN workstreams w ON w.id = r.to_id WHERE w.merged_into <> w.id),
f AS (SELECT r.id, to_id FROM r LEFT JOIN workstreams w ON w.id = r.to_id WHERE coalesce(w.merged_into, w.id) = w.id) SELECT s.id, label, to_id IS NOT NULL AS retired, to_id AS merged_into FROM workstreams s LEFT JOIN f ON f.id = s.id""")
def m6_retired_streams(v: Views) -> DataFrame:
    merges = v.workstreams.filter("merged_into <> id").select(F.col("id").alias("source"), F.col("merged_into").alias("target"))
    return m.merged_streams(v.workstreams.select("id", "label"), v.spark.createDataFrame([], "id string, entity string, n long"), merges)[0]


@query(r"""WITH q AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN '  CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ' ' WHEN o_custkey % 3 = 1 THEN 'Alias  ' || o_custkey ELSE 'new ' || o_custkey % 50 END AS name FROM orders),
k AS (SELECT name, lower(regexp_replace(trim(name), '\s+', ' ', 'g')) AS k FROM q), l AS (SELECT lower(regexp_replace(trim(label), '\s+', ' ', 'g')) AS k, min(id) AS id FROM workstreams GROUP BY 1),
a AS (SELECT 'alias ' || substr(id, 2) AS k, id FROM workstreams WHERE CAST(substr(id, 2) AS INT) % 2 = 0)
SELECT name, coalesce(l.id, a.id, 'ws_' || substr(sha256(k), 1, 16)) AS id, CASE WHEN l.id IS NOT NULL THEN 'label' WHEN a.id IS NOT NULL THEN 'alias' ELSE 'created' END AS how FROM k LEFT JOIN l USING (k) LEFT JOIN a USING (k)""")
def m6_bound_streams(v: Views) -> DataFrame:
    k = F.col("o_custkey")
    text = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("  CUSTOMER#"), F.lpad(text, 9, "0"), F.lit(" "))).when(k % 3 == 1, F.concat(F.lit("Alias  "), text)).otherwise(F.concat(F.lit("new "), (k % 50).cast("string")))
    aliases = v.workstreams.withColumn("n", F.substring("id", 2, 20)).filter("cast(n as int) % 2 = 0").select(F.concat(F.lit("ALIAS "), "n").alias("alias"), "id")
    return m.bound(v.orders.select(name.alias("name")).distinct(), v.workstreams.select("id", "label"), aliases)


@query("""WITH l AS (SELECT user_id AS id, event_type = 'error' AS survived, CASE WHEN event_id % 40 = 0 THEN 'human' ELSE 'model' END AS source, ts FROM events)
SELECT id, survived, source FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY source = 'human' DESC, ts DESC, survived) = 1""")
def m7_exemplar_verdicts(v: Views) -> DataFrame:
    labels = v.events.select(F.col("user_id").alias("id"), (F.col("event_type") == "error").alias("survived"), F.when(F.col("event_id") % 40 == 0, "human").otherwise("model").alias("source"), "ts")
    return m.verdicts(labels.select("id").distinct(), labels).select("id", "survived", "source")


@query("""WITH x AS (SELECT event_id AS id, user_id % 3 = 1 AS mine, ts, CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'click' THEN NULL ELSE 1 END AS survived FROM events)
SELECT id, CASE WHEN mine AND survived = 0 THEN 'reverted' ELSE 'old' END AS reason FROM x WHERE (mine AND survived = 0) OR ts < $now - INTERVAL 20 DAY""")
def m7_pruned_exemplars(v: Views) -> DataFrame:
    survived = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") != "click", 1)
    rows = v.events.select(F.col("event_id").alias("id"), F.concat(F.lit("i"), (F.col("user_id") % 3).cast("string")).alias("scope"), "ts", survived.alias("survived"))
    return m.pruned_exemplars(rows, "i1", "2024-01-11 00:00:00")


@query("SELECT count(*) AS kept FROM signals WHERE ts >= $now - INTERVAL 20 DAY")
def m8_signal_retention(v: Views) -> DataFrame:
    from ..operators.telemetry import since

    return since(v.signals, NOW, 20).agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT workstream_id, CASE WHEN count(DISTINCT scope) = 1 AND count(*) = count(scope) THEN min(scope) END AS scope FROM sessions GROUP BY 1")
def m9_scope_backfill(v: Views) -> DataFrame:
    return m.derived_scopes(v.sessions, "workstream_id", "scope")


@query("SELECT f.id, CASE WHEN length(value) % 2 = 0 THEN 'own' ELSE s.scope END AS scope, length(value) % 2 <> 0 AND s.scope IS NOT NULL AS filled FROM facts f LEFT JOIN sessions s ON s.id = f.session_id")
def m9_cascaded_scopes(v: Views) -> DataFrame:
    children = v.facts.select("id", "session_id", F.when(F.length("value") % 2 == 0, "own").alias("scope"))
    return m.cascaded_scopes(v.sessions, children)


@query("SELECT id FROM sessions WHERE seq > 500 AND id NOT IN (SELECT session_id FROM facts) ORDER BY seq LIMIT 40")
def m11_fact_backfill(v: Views) -> DataFrame:
    done = v.facts.select(F.substring("session_id", 2, 20).cast("long").alias("seq")).distinct()
    return m.pending(v.sessions.select("id", "seq"), done, "seq", after=500).orderBy("seq").limit(40).select("id")


@query("""WITH r AS (SELECT CASE WHEN seq % 4 = 0 THEN 'agent-' || workstream_id || '@s' || CAST(seq + 1 AS VARCHAR) ELSE id END AS id, seq, runtime AS model, CASE WHEN seq % 9 <> 0 THEN size END AS tokens, status FROM sessions), o AS (SELECT *, regexp_extract(id, '^agent-([^@]+)@(.+)$', 1) AS a, regexp_extract(id, '^agent-([^@]+)@(.+)$', 2) AS b FROM r),
f AS (SELECT o.*, seq % 5 < 3 AS found, b <> '' AND b NOT IN (SELECT id FROM sessions) AS lost FROM o)
SELECT id, CASE WHEN found THEN coalesce(model, 'from ' || status) ELSE model END AS model, CASE WHEN found THEN coalesce(tokens, 7.0) ELSE tokens END AS tokens, nullif(a, '') AS persona, nullif(b, '') AS parent,
CASE WHEN lost THEN 'unknown-parent' WHEN found AND (model IS NULL OR tokens IS NULL) THEN 'stamped' WHEN model IS NOT NULL AND tokens IS NOT NULL THEN 'already' ELSE 'no-op' END AS outcome FROM f""")
def m13_derivables_backfill(v: Views) -> DataFrame:
    k = F.col("seq")
    name = F.when(k % 4 == 0, F.concat(F.lit("agent-"), "workstream_id", F.lit("@s"), (k + 1).cast("string"))).otherwise(F.col("id"))
    rows = v.sessions.select(name.alias("id"), "seq", F.col("runtime").alias("model"), F.when(k % 9 != 0, F.col("size")).alias("tokens"), "status")
    found = rows.filter(k % 5 < 3).select("id", F.concat(F.lit("from "), "status").alias("model"), F.lit(7.0).alias("tokens"))
    return m.stamped(rows.drop("seq", "status"), found, ["model", "tokens"], v.sessions.select("id"))


@query("SELECT count(*) AS n, min(seq) AS next FROM sessions WHERE seq NOT IN (SELECT seq FROM sessions WHERE epoch_us(started_at) % 3 = 0 OR status = 'closed')")
def m14_resumable(v: Views) -> DataFrame:
    done = v.sessions.filter((micros(F.col("started_at")) % 3 == 0) | (F.col("status") == "closed"))
    return m.pending(v.sessions, done, "seq").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("next"))




@query("""SELECT lane, provider, count(*) AS n, min(seq) AS first, max(seq) AS last FROM (SELECT seq, unnest(['one', 'two']) AS lane, unnest([CASE WHEN seq % 3 = 0 THEN 'first' ELSE 'second' END, 'second']) AS provider FROM sessions) GROUP BY 1, 2""")
def m14_lanes(v: Views) -> DataFrame:
    """A job over a third of the sessions, and then over all in two lanes: one goes on with what is done, the other starts anew."""
    at = f"{shared_dir(v.spark)}/lanes-{uuid.uuid4().hex}"
    work = lambda name: lambda part: part.select("seq", F.lit(name).alias("provider"))
    m.resumed(v.sessions.filter("seq % 3 = 0"), "seq", {"model": "one"}, work("first"), at, 4000)
    rows = [m.resumed(v.sessions, "seq", {"model": name}, work("second"), at, 40_000).withColumn("lane", F.lit(name)) for name in ("one", "two")]
    return rows[0].union(rows[1]).groupBy("lane", "provider").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))
