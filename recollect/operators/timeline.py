"""Activity over time: spans between gaps, unions of intervals, attribution of spans, runs of a topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import micros
from .tables import by_range, written


def spans(events: DataFrame, key: str, ts: str = "ts", gap_minutes: float = 5.0) -> DataFrame:
    """(key, span, start_us, end_us, n): islands of events whose gaps are at most `gap_minutes`, both ends included."""
    w = Window.partitionBy(key).orderBy("us")
    rows = events.select(key, micros(F.col(ts)).alias("us"))
    rows = rows.withColumn("new", (F.col("us") - F.lag("us").over(w) > int(gap_minutes * 60e6)).cast("int"))
    rows = rows.withColumn("span", F.coalesce(F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return rows.groupBy(key, "span").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


def islands(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """`intervals` (keys, start_us, end_us, ...) with `island`, the number of the union's part that each is in, from 0 for each key.

    A scan over ranges: rows are dealt in the order of keys, start and end; each task needs no more of the ones before than the largest end and
    the number of islands of each key, which are a row a task and key. So a key with most of the rows, or none at all, is no task of its own.
    """
    rows = by_range(intervals, *keys, "start_us", "end_us")
    inside = Window.partitionBy("part_", *keys).orderBy("start_us", "end_us")
    earlier = Window.partitionBy(*keys, F.lit(1)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("part_", *keys).agg(F.max("end_us").alias("e_")).withColumn("e_", F.max("e_").over(earlier))
    place = [F.col(c) for c in ("part_", *keys)]
    joined = lambda left, right: left.join(right.select(*(c.alias(f"r{i}_") for i, c in enumerate(place)), right.columns[-1]), [c.eqNullSafe(F.col(f"r{i}_")) for i, c in enumerate(place)]).drop(*(f"r{i}_" for i in range(len(place))))
    before = F.greatest(F.max("end_us").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("e_"))
    marked = written(joined(rows, ends).withColumn("new_", F.coalesce((F.col("start_us") > before).cast("long"), F.lit(0))).drop("e_"), "islands")
    counts = marked.groupBy("part_", *keys).agg(F.sum("new_").alias("n_")).withColumn("n_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)))
    out = joined(marked, counts).withColumn("island", F.col("n_") + F.sum("new_").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("part_", "new_", "n_")


def merged(intervals: DataFrame, key: str | None = None) -> DataFrame:
    """(key, start_us, end_us, minutes): the union of overlapping or touching intervals, of each key or of all."""
    keys = [key] if key else []
    found = islands(intervals.select(*keys, "start_us", "end_us"), keys).groupBy(*keys, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    return found.select(*keys, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 60e6).alias("minutes"))


def attributed(span_rows: DataFrame, events: DataFrame, key: str, topic: str, ts: str = "ts") -> DataFrame:
    """Each span with the topic of most of its events; ties go to the first by name. A key's spans don't overlap.

    Spans and events are sorted together by key and time: an event is in the last span that has begun, if that hasn't ended. One pass for each key,
    however many spans it has.
    """
    span = F.struct("span", "start_us", "end_us")
    begun = span_rows.select(key, F.col("start_us").alias("us"), F.lit(0).alias("kind"), span.alias("of"), F.lit(None).cast(events.schema[topic].dataType).alias(topic))
    e = events.select(key, micros(F.col(ts)).alias("us"), F.lit(1).alias("kind"), F.lit(None).cast(begun.schema["of"].dataType).alias("of"), topic)
    w = Window.partitionBy(key).orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = begun.union(e).withColumn("of", F.last("of", ignorenulls=True).over(w)).filter("kind = 1 and us <= of.end_us")
    n = inside.groupBy(key, "of.span", "of.start_us", "of.end_us", topic).agg(F.count(F.lit(1)).alias("hits"))
    first = Window.partitionBy(key, "span").orderBy(F.desc("hits"), topic)
    return n.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def runs(segments: DataFrame, key: str, topic: str) -> DataFrame:
    """(key, run, topic, start_us, end_us): consecutive segments of one topic as one."""
    w = Window.partitionBy(key).orderBy("start_us", "span")
    rows = segments.withColumn("new", (F.lag(topic).over(w) != F.col(topic)).cast("int"))
    rows = rows.withColumn("run", F.coalesce(F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return rows.groupBy(key, "run", topic).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def focus(run_rows: DataFrame, key: str, topic: str, deep_minutes: int = 25) -> DataFrame:
    """(key, switches, longest_us, deep_us, active_us, topics) of each key's runs."""
    length = F.col("end_us") - F.col("start_us")
    return run_rows.groupBy(key).agg(
        (F.count(F.lit(1)) - 1).alias("switches"), F.max(length).alias("longest_us"), F.sum(F.when(length >= deep_minutes * 60_000_000, length).otherwise(0)).alias("deep_us"),
        F.sum(length).alias("active_us"), F.countDistinct(topic).alias("topics"),
    )
