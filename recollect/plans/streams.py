"""Queries of streams: ST1-ST10, run over all that is available, with the same rows as their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import micros
from ..streaming import pipelines as p
from .registry import Views, query


def _events(v: Views) -> DataFrame:
    return p.opened(v.spark, f"{v.sf_dir}/events.parquet")


CLOSED = "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)"


@query(f"SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING epoch_us(any_value(ts)) // 3600000000 * 3600000000 + 3600000000 <= {CLOSED}")
def st1_tumbling(v: Views) -> DataFrame:
    return p.available(p.windowed(_events(v), "event_type", "1 hour"))


@query(f"SELECT start_us, event_type, count(*) AS n FROM (SELECT event_type, unnest(range(epoch_us(ts) // 86400000000 - 13, epoch_us(ts) // 86400000000 + 1)) * 86400000000 AS start_us FROM events) GROUP BY 1, 2 HAVING start_us + 14 * 86400000000 <= {CLOSED}")
def st8_sliding(v: Views) -> DataFrame:
    return p.available(p.windowed(_events(v), "event_type", "14 days", "1 day"))


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 7200000000)::INT, 0) AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS span FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY user_id, span HAVING max(us) + 7200000000 <= {CLOSED}""")
def st2_session_windows(v: Views) -> DataFrame:
    return p.available(p.activity(_events(v), "user_id", "2 hours"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def st6_deduplicated(v: Views) -> DataFrame:
    twice = _events(v).select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return p.available(p.deduplicated(twice, ["event_id"])).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def st4_upserted(v: Views) -> DataFrame:
    return p.upserted(_events(v), "user_id", "ts").select("user_id", "event_id", "event_type")


ALERTS = """WITH e AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events), i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, event_id FROM i WHERE NOT ok QUALIFY row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) = 2"""


AGAIN = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type <> 'error' AS ok FROM events), i AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
bad AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) AS r FROM i WHERE NOT ok),
f AS (SELECT user_id, island, event_id, us FROM bad WHERE r = 2 UNION ALL SELECT b.user_id, b.island, b.event_id, b.us FROM f JOIN bad b ON b.user_id = f.user_id AND b.island = f.island
  AND b.event_id = (SELECT min(c.event_id) FROM bad c WHERE c.user_id = f.user_id AND c.island = f.island AND c.event_id > f.event_id AND c.us - f.us >= 3600000000))
SELECT user_id, event_id FROM f"""


@query(AGAIN)
def st10_alerts(v: Views) -> DataFrame:
    """Fires on the second failure in a row, and again after an hour of failures."""
    rows = _events(v).select("user_id", "event_id", micros(F.col("ts")).alias("us"), (F.col("event_type") != "error").alias("ok"))
    return p.available(p.alerts(rows, "user_id", "ok", again_us=3_600_000_000))


@query(ALERTS)
def st10_alerts_batch(v: Views) -> DataFrame:
    rows = v.events.select("user_id", "event_id", (F.col("event_type") != "error").alias("ok"))
    return p.alerts_batch(rows, "user_id", "ok", "event_id")


LISTED = 2_400_000_000


@query(f"""SELECT 'd' || doc_id AS path, n_chars AS size FROM documents WHERE doc_id % 3 <> 2 AND doc_id % 40 >= 15""")
def st3_changed_files(v: Views) -> DataFrame:
    """Two listings: a third of the files is new in the second one, a third has grown; some were just written."""
    name, k = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id")
    rows = p.opened(v.spark, f"{v.sf_dir}/documents.parquet")
    listings = F.array(
        F.when(k % 3 != 0, F.struct((F.col("n_chars") - (k % 3 == 1).cast("int")).cast("long").alias("size"), F.lit(0).cast("long").alias("modified_us"), F.lit(LISTED // 2).cast("long").alias("listed_us"))),
        F.struct(F.col("n_chars").cast("long").alias("size"), F.when(k % 3 == 2, 0).otherwise(LISTED - (k % 40) * 60_000_000).cast("long").alias("modified_us"), F.lit(LISTED).cast("long").alias("listed_us")),
    )
    stream = rows.select(name, F.explode(F.array_compact(listings)).alias("x")).select("path", "x.*")
    return p.available(p.changed_files(stream)).filter(F.col("listed_us") == LISTED).select("path", "size")


@query("""WITH a AS (SELECT 'd' || doc_id AS path, doc_id, n_chars, unnest(range(1, 6)) AS nth FROM documents), b AS (SELECT *, CASE WHEN doc_id % 7 = 0 AND nth >= 3 THEN 1 ELSE 0 END AS grown, (doc_id + nth) % 5 <> 0 AS failed FROM a),
c AS (SELECT *, sum(CASE WHEN NOT failed THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY nth) AS island FROM b), d AS (SELECT *, CASE WHEN failed THEN row_number() OVER (PARTITION BY path, island, grown, failed ORDER BY nth) ELSE 0 END AS failures FROM c)
SELECT path, nth, failures::INT AS failures, CASE WHEN failures >= 3 THEN 'dead' WHEN failed THEN 'retry' WHEN doc_id % 4 = 0 THEN 'skipped' ELSE 'done' END AS verdict FROM d""")
def st5_dead_letters(v: Views) -> DataFrame:
    """Five attempts at each document; the size of some changes with the third."""
    k, rows = F.col("doc_id"), p.opened(v.spark, f"{v.sf_dir}/documents.parquet")
    each = rows.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("nth"))
    size = F.col("n_chars") + ((k % 7 == 0) & (F.col("nth") >= 3)).cast("int")
    stream = each.select(F.concat(F.lit("d"), k.cast("string")).alias("path"), F.col("nth").cast("long").alias("nth"), size.cast("long").alias("size"), ((k + F.col("nth")) % 5 != 0).alias("failed"), F.when(k % 4 == 0, 0.2).otherwise(0.9).alias("confidence"))
    return p.available(p.retried(stream, min_confidence=0.5))


@query("SELECT 'signals' AS sink, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'sessions', count(DISTINCT user_id) FROM events")
def st7_signal_drain(v: Views) -> DataFrame:
    """Signals have a sink of their own, that is written before sessions are made of the same batch."""
    found = p.drained(_events(v), {"signals": lambda b: b.filter("event_type = 'error'").select("event_id"), "sessions": lambda b: b.select("user_id").distinct()})
    one = lambda name, n: found[name].agg(n.alias("n")).select(F.lit(name).alias("sink"), "n")
    return one("signals", F.count(F.lit(1))).union(one("sessions", F.countDistinct("user_id")))


@query("""WITH s AS (SELECT 'c' || user_id AS conversation_id, 's' || (event_id % 300) AS id, epoch_us(ts) AS us FROM events), g AS (SELECT *, coalesce((us - lag(us) OVER (PARTITION BY conversation_id ORDER BY us, id) > 86400000000)::INT, 0) AS new FROM s),
k AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS memo FROM g) SELECT conversation_id, id, min(us) AS us FROM k GROUP BY conversation_id, memo, id""")
def st9_surfaced_memo(v: Views) -> DataFrame:
    rows = _events(v).select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("conversation_id"), F.concat(F.lit("s"), (F.col("event_id") % 300).cast("string")).alias("id"), "ts")
    return p.available(p.surfaced_first(rows))
