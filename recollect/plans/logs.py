"""Queries over logs and signals: A1-A8, A17-A31, F7, F8, S5-S7."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import jaccard, micros, rounded
from ..functions.text import normalised, token_set, tokens
from ..operators import digest
from ..operators import telemetry as t
from .registry import NOW, NOW_SESSIONS, Views, query


@query("SELECT count(*) AS total, count(*) FILTER (n_results > 0) AS with_results, floor(count(*) FILTER (n_results > 0) / count(*) * 1000 + 0.5) / 1000 AS hit_rate FROM queries_log WHERE ts >= $now - INTERVAL 7 DAY")
def a1_recall_stats(v: Views) -> DataFrame:
    return t.hit_stats(t.since(v.queries_log, NOW, 7))


@query("SELECT source, count(*) AS n FROM queries_log WHERE ts >= $now - INTERVAL 7 DAY GROUP BY 1")
def a1_by_source(v: Views) -> DataFrame:
    return t.counts_by(t.since(v.queries_log, NOW, 7), F.col("source"), "source")


@query("SELECT lower(trim(query)) AS query, count(*) AS n FROM queries_log WHERE ts >= $now - INTERVAL 7 DAY GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def a1_top_queries(v: Views) -> DataFrame:
    return t.counts_by(t.since(v.queries_log, NOW, 7), normalised(F.col("query")), "query", top=5)


@query("SELECT 'subject' AS what, lower(trim(subject)) AS name, count(*) AS n FROM facts GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10")
def a2_fact_top_subjects(v: Views) -> DataFrame:
    return t.counts_by(v.facts, normalised(F.col("subject")), "name", top=10).select(F.lit("subject").alias("what"), "name", "n")


@query("SELECT predicate, count(*) AS n FROM facts GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def a2_fact_top_predicates(v: Views) -> DataFrame:
    return t.counts_by(v.facts, F.col("predicate"), "predicate", top=10)


@query("SELECT count(*) AS total, count(DISTINCT id) AS distinct_ids FROM cited")
def a3_citation_totals(v: Views) -> DataFrame:
    return v.cited.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("id").alias("distinct_ids"))


@query("SELECT id, count(*) AS n FROM cited GROUP BY 1 ORDER BY n DESC, id LIMIT 20")
def a3_citation_top(v: Views) -> DataFrame:
    return t.counts_by(v.cited, F.col("id"), "id", top=20)


@query("""WITH missed AS (SELECT DISTINCT c.conversation_id, c.id FROM cited c WHERE NOT EXISTS (SELECT 1 FROM surfaced s WHERE s.conversation_id = c.conversation_id AND s.id = c.id))
SELECT id, count(*) AS n, count(DISTINCT conversation_id) AS distinct_conversation_id FROM missed GROUP BY 1 ORDER BY n DESC, id LIMIT 20""")
def a4_miss_stats(v: Views) -> DataFrame:
    missed = v.cited.select("conversation_id", "id").distinct().join(v.surfaced, ["conversation_id", "id"], "left_anti")
    return t.counts_by(missed, F.col("id"), "id", top=20, distinct="conversation_id")


PRECISION = """WITH s AS (SELECT DISTINCT conversation_id, id FROM surfaced), c AS (SELECT DISTINCT conversation_id, id FROM cited),
p AS (SELECT s.conversation_id, count(*) AS n_surfaced, count(c.id) AS n_cited FROM s LEFT JOIN c USING (conversation_id, id) GROUP BY 1)"""


@query(PRECISION + " SELECT conversation_id, n_surfaced, n_cited, n_cited / n_surfaced AS precision FROM p")
def a5_precision(v: Views) -> DataFrame:
    return t.precision(v.surfaced, v.cited)


@query(PRECISION + " SELECT count(*) AS conversations, floor(avg(n_cited / n_surfaced) * 10000 + 0.5) / 10000 AS macro FROM p")
def a5_macro_precision(v: Views) -> DataFrame:
    return t.precision(v.surfaced, v.cited).agg(F.count(F.lit(1)).alias("conversations"), rounded(F.avg("precision")).alias("macro"))


@query("""WITH s AS (SELECT DISTINCT source, conversation_id, id FROM surfaced), c AS (SELECT DISTINCT conversation_id, id FROM cited),
p AS (SELECT source, s.conversation_id, count(c.id) / count(*) AS p FROM s LEFT JOIN c USING (conversation_id, id) GROUP BY 1, 2)
SELECT source, count(*) AS conversations, floor(avg(p) * 10000 + 0.5) / 10000 AS precision FROM p GROUP BY 1""")
def a6_precision_by_source(v: Views) -> DataFrame:
    return t.precision_by_source(v.surfaced, v.cited)


@query("""WITH s AS (SELECT CASE WHEN event_type = 'click' THEN 'quiet' ELSE source END AS source, n_results FROM queries_log WHERE NOT (event_type = 'click' AND n_results = 0)) SELECT DISTINCT source FROM s WHERE source NOT IN (SELECT source FROM s WHERE n_results = 0)""")
def a6_unmeasurable(v: Views) -> DataFrame:
    """Sources that never log a query without results, so that their hit rate says nothing."""
    name = F.when(F.col("event_type") == "click", "quiet").otherwise(F.col("source"))
    log = v.queries_log.filter("not (event_type = 'click' and n_results = 0)").select(name.alias("source"), "n_results")
    return log.select("source").distinct().join(log.filter("n_results = 0").select("source"), "source", "left_anti")


MODES = """WITH m AS (SELECT repo, model, kind, coalesce(step, '') AS step, count(*) AS samples, count(*) FILTER (outcome IN ('fail', 'exhausted')) AS failures, epoch_us(max(ts)) AS last_seen
  FROM signals WHERE ts >= $now - INTERVAL 14 DAY GROUP BY 1, 2, 3, 4 HAVING count(*) >= 10 AND count(*) FILTER (outcome IN ('fail', 'exhausted')) / count(*) >= 0.2)"""


def _modes(v: Views) -> DataFrame:
    return t.failure_modes(t.since(v.signals, NOW, 14))


@query(MODES + " SELECT *, failures / samples AS rate FROM m")
def a7_failure_modes(v: Views) -> DataFrame:
    return _modes(v).withColumn("last_seen", micros(F.col("last_seen")))


@query(MODES + " SELECT repo || '/' || model || ' ' || kind || ' ' || step || ': ' || failures || ' of ' || samples AS line FROM m ORDER BY failures / samples DESC, samples DESC, repo, model, kind, step LIMIT 3")
def a7_failure_lines(v: Views) -> DataFrame:
    top = t.failure_modes(t.since(v.signals, NOW, 14), top=3)
    return top.select(F.format_string("%s/%s %s %s: %d of %d", "repo", "model", "kind", "step", "failures", "samples").alias("line"))


@query(MODES + """ SELECT repo, model, kind, step, action FROM (SELECT *, unnest(list_filter([CASE WHEN failures / samples >= 0.5 THEN 'swap' END, CASE WHEN step <> '' THEN 'rule' END], lambda x: x IS NOT NULL)) AS action FROM m)""")
def a8_recommendations(v: Views) -> DataFrame:
    return t.recommendations(_modes(v))


@query("""SELECT count(*) AS real_queries, count(*) FILTER (n_results > 0) AS answered, count(DISTINCT conversation_id) AS conversations FROM queries_log
WHERE ts >= $now - INTERVAL 1 DAY AND NOT (lower(trim(query)) IN ('pgvector', 'hono', 'x', '') OR regexp_matches(lower(trim(query)), 'probe|beacon|smoke|path test|recall test|cutover-test'))""")
def a17_digest_day(v: Views) -> DataFrame:
    day = t.since(v.queries_log, NOW, 1).filter(~t.is_probe(F.col("query")))
    return day.agg(F.count(F.lit(1)).alias("real_queries"), F.count_if(F.expr("n_results > 0")).alias("answered"), F.countDistinct("conversation_id").alias("conversations"))


@query("""WITH p AS (SELECT *, coalesce(lower(trim(query)) IN ('pgvector', 'hono', 'x', '') OR regexp_matches(lower(trim(query)), 'probe|beacon|smoke|path test|recall test|cutover-test'), false) AS p FROM queries_log WHERE ts BETWEEN $now - INTERVAL 7 DAY AND $now),
d AS (SELECT * FROM p WHERE ts >= $now - INTERVAL 1 DAY AND NOT p)
SELECT 'source' AS part, source AS name, count(*) AS n FROM d GROUP BY 2 UNION ALL (SELECT 'query', query, count(*) FROM d WHERE query <> '' GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)
UNION ALL SELECT 'week', unnest(['total', 'real', 'surfaced']), unnest([count(*), count(*) FILTER (NOT p), count(*) FILTER (n_results > 0)]) FROM p""")
def a17_digest(v: Views) -> DataFrame:
    """The morning digest: sources and top queries of a day, traffic of a week; the limit of five is the report's."""
    return digest.daily(v.queries_log, NOW, t.is_probe(F.col("query")))


@query("""SELECT count(*) FILTER (NOT p) AS real, count(*) AS total FROM (SELECT coalesce(lower(trim(query)) IN ('pgvector', 'hono', 'x', '') OR
regexp_matches(lower(trim(query)), 'probe|beacon|smoke|path test|recall test|cutover-test'), false) AS p FROM queries_log WHERE ts >= $now - INTERVAL 7 DAY)""")
def f7_probe_share(v: Views) -> DataFrame:
    week = t.since(v.queries_log, NOW, 7).select(t.is_probe(F.col("query")).alias("p"))
    return week.agg(F.count_if(F.expr("not p")).alias("real"), F.count(F.lit(1)).alias("total"))


@query("SELECT source, count(*) AS n FROM queries_log WHERE coalesce(source NOT IN ('', 'unknown', 'mcp_tool') AND NOT regexp_matches(source, '^(conv_)?test'), false) GROUP BY 1")
def f8_attributable(v: Views) -> DataFrame:
    return v.queries_log.filter(t.attributable(F.col("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) FILTER (live) AS fires, count(*) FILTER (live AND injecting) AS injecting, count(*) FILTER (live) = 0 AS dead, count(*) FILTER (live) >= 10 AND count(*) FILTER (live AND injecting) = 0 AS mute
FROM (SELECT source = 'hook' AS live, n_results > 0 AS injecting FROM queries_log WHERE ts >= $now - INTERVAL 2 DAY)""")
def a18_hook_canaries(v: Views) -> DataFrame:
    fires = t.since(v.queries_log, NOW, 2).select((F.col("source") == "hook").alias("live"), (F.col("n_results") > 0).alias("injecting"))
    return t.quiet_hook(fires, sessions_yesterday=1)


@query("""WITH g AS (SELECT conversation_id, source, id FROM (SELECT DISTINCT conversation_id, source, id FROM surfaced)),
r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY md5(id), id) AS rank FROM (SELECT DISTINCT conversation_id, id FROM g)),
gold AS (SELECT DISTINCT conversation_id, id FROM cited),
b AS (SELECT gold.conversation_id, min(rank) AS rank FROM gold LEFT JOIN r USING (conversation_id, id) GROUP BY 1),
q AS (SELECT conversation_id, rank FROM b)
SELECT count(*) AS queries, floor(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) * 1e4 + 0.5) / 1e4 AS recall_1, floor(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END) * 1e4 + 0.5) / 1e4 AS recall_3,
floor(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) * 1e4 + 0.5) / 1e4 AS recall_k, floor(avg(coalesce(1.0::DOUBLE / rank, 0)) * 1e4 + 0.5) / 1e4 AS mrr FROM q""")
def a23_retrieval_metrics(v: Views) -> DataFrame:
    return t.retrieval_metrics(_ranked(v), v.cited.select(F.col("conversation_id").alias("query_id"), F.col("id").alias("doc_id")))


def _ranked(v: Views) -> DataFrame:
    from pyspark.sql import Window

    rows = v.surfaced.select(F.col("conversation_id").alias("query_id"), F.col("id").alias("doc_id")).distinct()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.md5("doc_id"), "doc_id")))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY md5(id), id) AS rank FROM (SELECT DISTINCT conversation_id, id FROM surfaced)),
gold AS (SELECT DISTINCT conversation_id, id FROM cited),
k AS (SELECT conversation_id, CASE WHEN min(rank) <= 5 THEN 'hit' WHEN min(rank) IS NOT NULL THEN 'ranking-miss' ELSE 'candidate-miss' END AS kind FROM gold LEFT JOIN r USING (conversation_id, id) GROUP BY 1)
SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def a24_miss_classes(v: Views) -> DataFrame:
    gold = v.cited.select(F.col("conversation_id").alias("query_id"), F.col("id").alias("doc_id"))
    return t.miss_classes(_ranked(v), _ranked(v), gold, 5)


@query("""WITH r AS (SELECT conversation_id, id, count(*) / 10.0::DOUBLE AS score FROM surfaced GROUP BY 1, 2), t AS (SELECT id, count(*) AS total FROM cited GROUP BY 1), o AS (SELECT id, conversation_id, count(*) AS own FROM cited GROUP BY 1, 2)
SELECT conversation_id, id, floor((score + 0.15::DOUBLE * ln(1 + coalesce(total, 0) - coalesce(own, 0))) * 1e6 + 0.5) / 1e6 AS boosted FROM r LEFT JOIN t USING (id) LEFT JOIN o USING (id, conversation_id)""")
def a25_citation_boost(v: Views) -> DataFrame:
    ranked = v.surfaced.groupBy("conversation_id", "id").agg((F.count(F.lit(1)) / 10.0).alias("score"))
    return t.boosted(ranked, v.cited).select("conversation_id", "id", rounded(F.col("boosted"), 6).alias("boosted"))


@query("""WITH r AS (SELECT conversation_id, id, count(*) / 10.0::DOUBLE AS score FROM surfaced GROUP BY 1, 2), t AS (SELECT id, count(*) AS total FROM cited GROUP BY 1), o AS (SELECT id, conversation_id, count(*) AS own FROM cited GROUP BY 1, 2),
b AS (SELECT conversation_id, id, score, floor((score + 0.15::DOUBLE * ln(1 + coalesce(total, 0) - coalesce(own, 0))) * 1e6 + 0.5) / 1e6 AS boosted FROM r LEFT JOIN t USING (id) LEFT JOIN o USING (id, conversation_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY score DESC, id) AS x, row_number() OVER (PARTITION BY conversation_id ORDER BY boosted DESC, id) AS y FROM b),
g AS (SELECT conversation_id, min(x) AS x, min(y) AS y FROM k JOIN (SELECT DISTINCT conversation_id, id FROM cited) USING (conversation_id, id) GROUP BY 1)
SELECT count(*) AS conversations, floor(avg(1.0::DOUBLE / x) * 1e4 + 0.5) / 1e4 AS mrr_before, floor(avg(1.0::DOUBLE / y) * 1e4 + 0.5) / 1e4 AS mrr_after, count(*) FILTER (y < x) AS improved, count(*) FILTER (y > x) AS hurt FROM g""")
def a25_reranked(v: Views) -> DataFrame:
    ranked = v.surfaced.groupBy("conversation_id", "id").agg((F.count(F.lit(1)) / 10.0).alias("score"))
    return t.reranked(t.boosted(ranked, v.cited).withColumn("boosted", rounded(F.col("boosted"), 6)), v.cited)


@query("""WITH s AS (SELECT value AS score, event_type = 'purchase' AS gold FROM events), f AS (SELECT unnest([10.0, 25.0, 50.0, 75.0])::DOUBLE AS floor),
k AS (SELECT floor.floor AS floor, avg(CASE WHEN gold THEN (score >= floor.floor)::INT::DOUBLE END) AS a, avg(CASE WHEN NOT gold THEN (score < floor.floor)::INT::DOUBLE END) AS b FROM s, f AS floor GROUP BY 1),
k2 AS (SELECT floor, floor(a * 1e4 + 0.5) / 1e4 AS gold_kept, floor(b * 1e4 + 0.5) / 1e4 AS noise_cut FROM k)
SELECT *, gold_kept >= 0.5 AND row_number() OVER (PARTITION BY gold_kept >= 0.5 ORDER BY noise_cut DESC, floor DESC) = 1 AS recommended FROM k2""")
def a26_floor_calibration(v: Views) -> DataFrame:
    scored = v.events.select(F.col("value").alias("score"), (F.col("event_type") == "purchase").alias("gold"))
    return t.floor_calibration(scored, [10.0, 25.0, 50.0, 75.0], min_kept=0.5)


@query("""WITH h AS (SELECT user_id::VARCHAR || '/' || (event_id % 7)::VARCHAR AS fire, 'c' || user_id::VARCHAR AS conversation_id, 's' || (event_id % 300)::VARCHAR AS id, value AS score FROM events),
g AS (SELECT DISTINCT conversation_id, id FROM cited), w AS (SELECT h.*, g.id IS NOT NULL AS gold, list_sort(list(score) OVER (PARTITION BY fire)) AS l FROM h LEFT JOIN g USING (conversation_id, id) WHERE conversation_id IN (SELECT conversation_id FROM g)),
m AS (SELECT gold, CASE WHEN l[(len(l) // 2) + 1] > 0 THEN score / l[(len(l) // 2) + 1] ELSE 0 END AS rel FROM w),
k AS (SELECT floor.floor AS floor, floor(avg(CASE WHEN gold THEN (rel >= floor.floor)::INT::DOUBLE END) * 1e4 + 0.5) / 1e4 AS gold_kept, floor(avg(CASE WHEN NOT gold THEN (rel < floor.floor)::INT::DOUBLE END) * 1e4 + 0.5) / 1e4 AS noise_cut
FROM m, (SELECT unnest([0.3, 0.5, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS floor) AS floor GROUP BY 1)
SELECT *, gold_kept >= 0.5 AND row_number() OVER (PARTITION BY gold_kept >= 0.5 ORDER BY noise_cut DESC, floor) = 1 AS recommended FROM k""")
def a26_relative_floors(v: Views) -> DataFrame:
    text = lambda c: c.cast("string")
    user, event = F.col("user_id"), F.col("event_id")
    hits = v.events.select(
        F.concat(text(user), F.lit("/"), text(event % 7)).alias("fire"), F.concat(F.lit("c"), text(user)).alias("conversation_id"), F.concat(F.lit("s"), text(event % 300)).alias("id"), F.col("value").alias("score")
    )
    return t.relative_floors(hits, v.cited, [0.3, 0.5, 0.7, 0.8, 0.9, 1.0], min_kept=0.5)


@query("""WITH r AS (SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY md5(id), id) AS rank FROM (SELECT DISTINCT conversation_id, id FROM surfaced)),
b AS (SELECT conversation_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS body FROM r JOIN documents ON id = 's' || doc_id::VARCHAR WHERE rank <= 5),
a AS (SELECT 'c' || u::VARCHAR AS query_id, trim(regexp_replace(lower(CASE WHEN u % 2 = 0 THEN (u % 100)::VARCHAR ELSE regexp_extract(text, '^[A-Za-z]+') END), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS answer FROM (SELECT DISTINCT user_id AS u FROM events) JOIN benchmark ON item_id = u % 40)
SELECT query_id, (coalesce(bool_or(answer <> '' AND CASE WHEN length(answer) < 4 THEN regexp_matches(body, '\\b' || regexp_escape(answer) || '\\b') ELSE contains(body, answer) END), false))::INT AS body_hit FROM a LEFT JOIN b ON conversation_id = query_id GROUP BY 1""")
def a23_body_hits(v: Views) -> DataFrame:
    bodies = _ranked(v).join(v.documents.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("body")), "doc_id")
    users = v.events.select(F.col("user_id").alias("u")).distinct().join(v.benchmark, F.col("item_id") == F.col("u") % 40)
    answer = F.when(F.col("u") % 2 == 0, (F.col("u") % 100).cast("string")).otherwise(F.regexp_extract("text", "^[A-Za-z]+", 0))
    return t.body_hits(bodies, users.select(F.concat(F.lit("c"), F.col("u").cast("string")).alias("query_id"), answer.alias("answer")))


@query("""WITH a AS (SELECT DISTINCT conversation_id, id FROM cited), b AS (SELECT DISTINCT conversation_id, id FROM surfaced),
p AS (SELECT coalesce(a.conversation_id, b.conversation_id) AS conversation_id, count(a.id) AS t, count(b.id) AS f, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS r FROM a FULL JOIN b ON a.conversation_id = b.conversation_id AND a.id = b.id GROUP BY 1),
q AS (SELECT conversation_id, CASE WHEN f > 0 THEN r / f END AS p, CASE WHEN t > 0 THEN r / t END AS c FROM p)
SELECT conversation_id, p AS precision, c AS recall, CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) END AS f1 FROM q""")
def a27_extraction_scores(v: Views) -> DataFrame:
    return t.precision_recall(v.cited, v.surfaced, "conversation_id", "id").select("conversation_id", "precision", "recall", "f1")


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL), p AS (SELECT unnest([50, 95]) AS percent)
SELECT percent, value FROM s, p WHERE i = floor(percent / 100 * (n - 1))""")
def a27_percentiles(v: Views) -> DataFrame:
    return t.nearest_rank(v.events, "value", [50, 95])


@query("SELECT count(*) AS n, count(*) FILTER (quality <> toxic) / count(*) AS decisive, count(*) FILTER (quality > toxic) / count(*) AS win, count(*) FILTER (quality < toxic) / count(*) AS harm FROM labels")
def a28_verdict_gate(v: Views) -> DataFrame:
    n = F.count(F.lit(1))
    rate = lambda c: F.count_if(F.expr(c)) / n
    return v.labels.agg(n.alias("n"), rate("quality <> toxic").alias("decisive"), rate("quality > toxic").alias("win"), rate("quality < toxic").alias("harm"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders)
SELECT CASE WHEN o_totalprice <= q[1] THEN 1 WHEN o_totalprice <= q[2] THEN 2 WHEN o_totalprice <= q[3] THEN 3 ELSE 4 END AS quartile, count(*) AS n FROM orders, q GROUP BY 1""")
def a29_quartiles(v: Views) -> DataFrame:
    edges = t.percentiles(v.orders, "o_totalprice", [25, 50, 75]).agg(F.sort_array(F.collect_list("value")).alias("q"))
    q, x = F.col("q"), F.col("o_totalprice")
    place = F.when(x <= q[0], 1).when(x <= q[1], 2).when(x <= q[2], 3).otherwise(4)
    return v.orders.crossJoin(F.broadcast(edges)).groupBy(place.alias("quartile")).agg(F.count(F.lit(1)).alias("n"))  # one row of three numbers


HALF = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda x: lower(x)))"


@query(f"""WITH p AS (SELECT doc_id, {HALF.format("substr(text, 1, length(text) // 2)")} AS a, {HALF.format("substr(text, length(text) // 2 + 1)")} AS b, source IN ('src0', 'src1') AS m FROM documents)
SELECT floor(avg(m::INT::DOUBLE) * 1e4 + 0.5) / 1e4 AS match_rate, floor(avg(CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END) * 1e4 + 0.5) / 1e4 AS mean_jaccard FROM p""")
def a30_parity(v: Views) -> DataFrame:
    """The halves of each whole text play two runs that found words."""
    a, b = token_set(F.expr("substring(text, 1, int(length(text) div 2))")), token_set(F.expr("substring(text, int(length(text) div 2) + 1)"))
    rows = v.documents.select(a.alias("a"), b.alias("b"), F.col("source").isin("src0", "src1").alias("m"))
    both_empty = F.size(F.array_union("a", "b")) == 0
    return rows.agg(rounded(F.avg(F.col("m").cast("double"))).alias("match_rate"), rounded(F.avg(F.when(both_empty, 1.0).otherwise(jaccard(F.col("a"), F.col("b"))))).alias("mean_jaccard"))


@query("""SELECT kind, CASE WHEN confidence IS NULL THEN 'none' WHEN confidence < 0.4 THEN '<.4' WHEN confidence < 0.6 THEN '.4-.6' WHEN confidence < 0.8 THEN '.6-.8' ELSE '>=.8' END AS band, count(*) AS n FROM facts GROUP BY 1, 2""")
def a31_reprocess_cohort(v: Views) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c.isNull(), "none").when(c < 0.4, "<.4").when(c < 0.6, ".4-.6").when(c < 0.8, ".6-.8").otherwise(">=.8")
    return v.facts.groupBy("kind", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, count(*) AS n FROM sessions GROUP BY 1")
def a32_status_tallies(v: Views) -> DataFrame:
    return v.sessions.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, repo, model, kind, epoch_us(ts) AS ts_us FROM signals WHERE repo = 'r3' AND kind = 'gate' AND ts >= $now - INTERVAL 20 DAY ORDER BY ts DESC, event_id DESC LIMIT 5000")
def s5_signal_scan(v: Views) -> DataFrame:
    """The newest signals of a scope; the cap is the scan's own contract, and a parameter."""
    found = t.since(v.signals, NOW, 20).filter("repo = 'r3' and kind = 'gate'")
    return found.orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id", "repo", "model", "kind", micros(F.col("ts")).alias("ts_us"))


@query("""SELECT event_id, (json_extract_string(props, '$.k'))::BIGINT AS k FROM events WHERE ts >= $now - INTERVAL 3 DAY AND json_extract_string(props, '$.k') IS NOT NULL""")
def s6_log_reader(v: Views) -> DataFrame:
    from ..sources.logs import parsed

    rows = t.since(v.events, NOW, 3)
    return parsed(rows, "props", "k LONG").filter("k is not null").select("event_id", "k")


@query("SELECT event_id, epoch_us(ts) AS ts_us FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def s7_log_tail(v: Views) -> DataFrame:
    return v.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", micros(F.col("ts")).alias("ts_us"))


@query("""WITH sig AS (SELECT session_id AS id, bool_or(outcome <> 'pass') AS neg FROM signals GROUP BY 1), e AS (SELECT to_session AS id, bool_or(kind IN ('supersedes', 'replaces')) AS r, bool_or(kind = 'continues') AS c FROM edges GROUP BY 1),
pairs AS (SELECT from_session AS a, to_session AS b FROM edges WHERE kind = 'replaces'), again AS (SELECT DISTINCT unnest([a, b]) AS id FROM pairs), cit AS (SELECT DISTINCT id FROM cited),
o AS (SELECT s.id, CASE WHEN neg THEN 'overturned' WHEN neg IS NOT NULL THEN 'held' WHEN status IN ('superseded', 'replaced') OR coalesce(r, false) THEN 'overturned'
  WHEN coalesce($then - ended_at >= INTERVAL 14 DAY, false) THEN 'held' WHEN coalesce(c, false) THEN 'built-upon' WHEN again.id IS NOT NULL THEN 're-derived-later' ELSE 'unobserved' END AS verdict,
  CASE WHEN neg IS NOT NULL THEN 'A' ELSE 'B' END AS tier, cit.id IS NOT NULL AS cited
FROM sessions s LEFT JOIN sig USING (id) LEFT JOIN e USING (id) LEFT JOIN again USING (id) LEFT JOIN cit USING (id))
SELECT id, verdict, tier, verdict = 'unobserved' AND cited AS degraded FROM o""")
def a14_outcomes(v: Views) -> DataFrame:
    return _outcomes(v)


def _outcomes(v: Views) -> DataFrame:
    pairs = v.edges.filter("kind = 'replaces'").select(F.col("from_session").alias("a"), F.col("to_session").alias("b"))
    return t.outcome_verdicts(v.sessions, v.signals, v.edges, pairs, v.cited, NOW_SESSIONS)


@query("""WITH sig AS (SELECT session_id AS id, bool_or(outcome <> 'pass') AS neg FROM signals GROUP BY 1), e AS (SELECT to_session AS id, bool_or(kind IN ('supersedes', 'replaces')) AS r, bool_or(kind = 'continues') AS c FROM edges GROUP BY 1),
again AS (SELECT DISTINCT unnest([from_session, to_session]) AS id FROM edges WHERE kind = 'replaces')
SELECT CASE WHEN neg THEN 'overturned' WHEN neg IS NOT NULL THEN 'held' WHEN status IN ('superseded', 'replaced') OR coalesce(r, false) THEN 'overturned'
  WHEN coalesce($then - ended_at >= INTERVAL 14 DAY, false) THEN 'held' WHEN coalesce(c, false) THEN 'built-upon' WHEN again.id IS NOT NULL THEN 're-derived-later' ELSE 'unobserved' END AS verdict, count(*) AS n
FROM sessions s LEFT JOIN sig USING (id) LEFT JOIN e USING (id) LEFT JOIN again USING (id) GROUP BY 1""")
def a15_outcome_coverage(v: Views) -> DataFrame:
    return _outcomes(v).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]*'), lambda x: lower(x))[1] AS first, len(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_.-]*')) AS n FROM documents")
def fn_tokens(v: Views) -> DataFrame:
    found = tokens(F.col("text"))
    return v.documents.select("doc_id", F.get(found, 0).alias("first"), F.size(found).cast("long").alias("n"))
