"""The work digest of local days: active time by topic, focus, coverage, and what was decided and left open.

A day is one of a time zone's calendar, so that days of 23 and 25 hours are what they are. Activity is cut at midnight: spans are islands of
the timestamps that one session has on one day. Spans of all sessions on a day are merged, and each merged interval goes to the session
with most timestamps in it. An interval is made of whole spans, so that counting needs no join by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import micros, rounded
from .tables import written
from .timeline import islands


def local_day(us: Column, zone: str) -> Column:
    """The calendar day of a moment (microseconds since 1970) in a time zone; the session's own zone is UTC."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def day_spans(activity: DataFrame, zone: str, idle_minutes: float = 5.0) -> DataFrame:
    """(day, session, span, start_us, end_us, n) of timestamps (session, ts): islands of each session on each local day."""
    rows = activity.filter("ts is not null").select("session", micros(F.col("ts")).alias("us")).withColumn("day", local_day(F.col("us"), zone))
    w = Window.partitionBy("session", "day").orderBy("us")
    rows = rows.withColumn("new", F.coalesce((F.col("us") - F.lag("us").over(w) > int(idle_minutes * 60e6)).cast("int"), F.lit(0)))
    rows = rows.withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("day", "session", "span").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


def segments(spans: DataFrame, sessions: DataFrame) -> DataFrame:
    """(day, island, start_us, end_us, session, topic): a day's merged intervals, each with the session that has most timestamps in it; of several
    the first by start and id. `sessions` has (session, topic, started_at)."""
    rows = islands(spans, ["day"])
    of = rows.groupBy("day", "island", "session").agg(F.sum("n").alias("n"), F.min("start_us").alias("a"), F.max("end_us").alias("b"))
    named = of.join(sessions.select("session", "topic", "started_at"), "session")
    best = F.min_by(F.struct("session", "topic"), F.struct(-F.col("n"), F.col("started_at"), F.col("session")))
    return named.groupBy("day", "island").agg(F.min("a").alias("start_us"), F.max("b").alias("end_us"), best.alias("of")).select("day", "island", "start_us", "end_us", "of.session", "of.topic")


def _minutes() -> Column:
    return (F.col("end_us") - F.col("start_us")) / 60e6


def by_topic(found: DataFrame) -> DataFrame:
    """(day, topic, active_minutes, share) of `segments`."""
    per = found.groupBy("day", "topic").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    total = per.groupBy("day").agg(F.sum("us").alias("all_us"))
    share = F.when(F.col("all_us") == 0, F.lit(0.0)).otherwise(rounded(F.col("us") / F.col("all_us"), 2))
    return per.join(total, "day").select("day", "topic", rounded(F.col("us") / 60e6, 1).alias("active_minutes"), share.alias("share"))


def focus(found: DataFrame, deep_minutes: float = 25.0) -> DataFrame:
    """(day, active_minutes, context_switches, longest_block_min, deep_work_ratio, projects): neighbouring segments of one topic are a block."""
    w = Window.partitionBy("day").orderBy("island")
    rows = found.withColumn("new", F.coalesce((F.lag("topic").over(w) != F.col("topic")).cast("int"), F.lit(0)))
    rows = rows.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = rows.groupBy("day", "block", "topic").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    deep = F.coalesce(F.sum(F.when(F.col("us") >= int(deep_minutes * 60e6), F.col("us"))), F.lit(0))
    ratio = F.when(F.sum("us") == 0, F.lit(0.0)).otherwise(rounded(deep / F.sum("us"), 2))
    return blocks.groupBy("day").agg(
        rounded(F.sum("us") / 60e6, 1).alias("active_minutes"), (F.count(F.lit(1)) - 1).alias("context_switches"), rounded(F.max("us") / 60e6, 1).alias("longest_block_min"),
        ratio.alias("deep_work_ratio"), F.countDistinct("topic").alias("projects"),
    )


def coverage(sessions: DataFrame, spans: DataFrame, zone: str) -> DataFrame:
    """(day, sessions, measured, skipped, decisions, open_loops): the sessions that are under way on each local day, those with and without activity
    on it, and how many different decisions and open questions they hold. `sessions` has (session, started_at, ended_at, decisions, open)."""
    days = F.sequence(local_day(micros(F.col("started_at")), zone), local_day(micros(F.greatest("started_at", F.coalesce("ended_at", "started_at"))), zone))
    on = written(sessions.filter("started_at is not null").select("session", F.explode(days).alias("day"), "decisions", "open"), "days")
    counts = on.join(spans.select("day", "session", F.lit(True).alias("active")).distinct(), ["day", "session"], "left")
    counts = counts.groupBy("day").agg(F.count(F.lit(1)).alias("sessions"), F.count("active").alias("measured"), F.count_if(F.col("active").isNull()).alias("skipped"))
    different = lambda c: on.select("day", F.explode(c).alias("x")).distinct().groupBy("day").agg(F.count("x").alias(c))
    out = counts.join(different("decisions"), "day", "left").join(different("open"), "day", "left")
    return out.select("day", "sessions", "measured", "skipped", F.coalesce("decisions", F.lit(0)).alias("decisions"), F.coalesce("open", F.lit(0)).alias("open_loops"))


def daily(queries: DataFrame, now: str, is_probe: Column, top: int = 5) -> DataFrame:
    """(part, name, n) of the morning digest over a query log (ts, source, query, n_results): `source` counts and the `query`s asked most in the last
    24 hours, and of the last 7 days `week` counts: all, real ones (not probes), and those that found something. Ties go to the name."""
    end = F.lit(now).cast("timestamp")
    rows = queries.withColumn("probe", F.coalesce(is_probe, F.lit(False))).filter((F.col("ts").cast("timestamp") >= end - F.expr("INTERVAL 7 DAY")) & (F.col("ts").cast("timestamp") <= end))
    day = rows.filter((F.col("ts").cast("timestamp") >= end - F.expr("INTERVAL 1 DAY")) & ~F.col("probe"))
    sources = day.groupBy(F.coalesce("source", F.lit("?")).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("part"), "name", "n")
    asked = day.filter("query <> ''").groupBy(F.col("query").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(top).select(F.lit("query").alias("part"), "name", "n")
    week = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("probe")).alias("real"), F.count_if(F.col("n_results") > 0).alias("surfaced"))
    week = week.select(F.explode(F.create_map(F.lit("total"), "total", F.lit("real"), "real", F.lit("surfaced"), "surfaced")).alias("name", "n")).select(F.lit("week").alias("part"), "name", "n")
    return sources.union(asked).union(week)
