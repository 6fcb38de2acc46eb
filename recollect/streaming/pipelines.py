"""Structured Streaming pipelines: event-time windows with watermarks, deduplication, upserts, keyed state.

Sinks and checkpoints are folders in the cluster's shared folder; a caller that names one gets a stream that goes on where
the last run ended. Each function takes a stream and gives a stream; `available` runs one over all that is there now and
gives the sink's rows. State that is keyed by path, conversation or source is a few values for each key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.score import micros
from ..operators import tables


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{tables.shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def opened(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a path, with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # As a pattern, so that a table of one file can be a stream as well as a folder.
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def available(stream: DataFrame, at: str | None = None, progress: list | None = None) -> DataFrame:
    """Runs an append-mode stream over all that is available, and reads its sink. The order of the columns stays.

    With a folder `at`, the next run goes on after the rows that this one has read. `progress` gets what Spark reports of each batch.
    """
    at = at or shared_dir(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


def _timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed(stream: DataFrame, key: str, size: str, slide: str | None = None, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(start_us, key, n): tumbling or sliding counts. A window comes out when the watermark has passed its end; later rows are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _timed(stream, ts, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(micros(F.col("w.start")).alias("start_us"), key, "n")


def activity(stream: DataFrame, key: str, gap: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(key, start_us, end_us, n): spans of activity; a span comes out when nothing can join it any more."""
    rows = _timed(stream, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    return rows.select(key, micros(F.col("w.start")).alias("start_us"), micros(F.col("last")).alias("end_us"), "n")


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose key didn't come before within the watermark; state is bounded by it."""
    return _timed(stream, ts, delay).dropDuplicatesWithinWatermark(keys)


def upserted(stream: DataFrame, key: str, order: str, at: str | None = None, buckets: int = 64) -> DataFrame:
    """The last row of each key after all that is available, by foreachBatch over a table that is cut by a hash of the key.

    A batch writes the buckets that it has rows for, and reads those alone; of a bucket the newest batch counts. A batch
    that is run again writes the same folder again, so that a lost driver does no harm, and `at` names a table to go on with.
    """
    from ..operators.facts import latest

    spark, at = stream.sparkSession, at or shared_dir(stream.sparkSession)
    schema = stream.schema

    def merge(batch: DataFrame, epoch: int) -> None:
        own = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        rows = own
        if epoch:
            _compacted(batch.sparkSession, at, epoch)
            old = _current(batch.sparkSession, at, schema, epoch)
            rows = own.unionByName(old.join(F.broadcast(own.select("bucket").distinct()), "bucket", "left_semi").select(own.columns))  # `buckets` rows
        latest(rows, [key], F.desc(order), F.desc("event_id")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/table/epoch={epoch}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _current(spark, at, schema, None).select(schema.names)


def _current(spark: SparkSession, at: str, schema, before: int | None) -> DataFrame:
    """Rows of the newest batch of each bucket, of those before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/table")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).withColumns({"epoch": F.lit(0), "bucket": F.lit(0)})
    rows = spark.read.schema(StructType([*schema.fields, StructField("epoch", IntegerType()), StructField("bucket", IntegerType())])).parquet(f"{at}/table")
    rows = rows if before is None else rows.filter(F.col("epoch") < before)
    newest = rows.select("bucket", "epoch").groupBy("bucket").agg(F.max("epoch").alias("epoch"))  # a row for each bucket
    return rows.join(F.broadcast(newest), ["bucket", "epoch"], "left_semi")


def _compacted(spark: SparkSession, at: str, before: int) -> None:
    """Deletes buckets that a later batch has written again, of batches before `before`, which are committed and never run again. A folder name for each
    bucket and batch is all that is listed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/table")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return
    held: dict[str, list] = {}
    for e in fs.listStatus(path):
        name = e.getPath().getName()
        if name.startswith("epoch=") and int(name[6:]) < before:
            for b in fs.listStatus(e.getPath()):
                held.setdefault(b.getPath().getName(), []).append((int(name[6:]), b.getPath()))
    for name, found in held.items():
        if name.startswith("bucket="):
            for _, old in sorted(found, key=lambda x: x[0])[:-1]:
                fs.delete(old, True)


def _keyed(stream: DataFrame, keys: list[str], schema: str, state: str, step: Callable, order: list[str], timeout: str = "NoTimeout") -> DataFrame:
    """Rows that `step(key, rows in order, state or None)` gives with the new state, for each key."""

    def run(name: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out, now, until = step(name, rows, tuple(held.get) if held.exists else None)
        held.update(now)
        if until is not None:
            held.setTimeoutTimestamp(max(until, held.getCurrentWatermarkMs() + 1))
        yield out

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, state, "append", timeout)


#: The state store that timers need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Forgetting(StatefulProcessor):
    """A few values for each key, which are dropped when the key has been quiet for `forget_us` by the watermark."""

    def __init__(self, step: Callable, state: str, order: list[str], us: str, forget_us: int):
        self.step, self.state, self.order, self.us, self.forget_us = step, state, order, us, forget_us

    def init(self, handle) -> None:
        self.handle, self.held, self.last = handle, handle.getValueState("held", self.state), handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        held, last = (tuple(self.held.get()), self.last.get()[0]) if self.held.exists() else (None, None)
        if last is not None and int(frame[self.us].iloc[0]) - last > self.forget_us:
            held = None  # its timer is due, but hasn't come yet
        out, now, _ = self.step(key, frame, held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        last = max(last or 0, int(frame[self.us].max()))
        self.held.update(now)
        self.last.update((last,))
        self.handle.registerTimer(max((last + self.forget_us) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _forgetting(stream: DataFrame, keys: list[str], schema: str, state: str, step: Callable, order: list[str], us: str, forget_us: int | None, delay: str = "10 minutes") -> DataFrame:
    """As `_keyed`; with `forget_us`, a key whose rows are so much older, by their microseconds `us`, than the watermark has no state any more."""
    if forget_us is None:
        return _keyed(stream, keys, schema, state, step, order)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = stream.withColumn("at_", F.timestamp_micros(us)).withWatermark("at_", delay)
    return timed.groupBy(*keys).transformWithStateInPandas(_Forgetting(step, state, order, us, forget_us), schema, "append", "EventTime")


def alerts(stream: DataFrame, key: str, ok: str, threshold: int = 2, again_us: int | None = None, forget_us: int | None = None) -> DataFrame:
    """(key, event_id): fires at the `threshold`-th failure in a row, and while failures go on, again with the first one
    that is `again_us` after the last alert (never, if it isn't given). The stream has event_id, us and ok. A key that is quiet for longer than
    `forget_us` starts anew, and takes no room until then."""

    def step(name: tuple, rows: pd.DataFrame, held):
        run, last = held or (0, 0)
        out = []
        for event, us, fine in zip(rows["event_id"], rows["us"], rows[ok], strict=True):
            run = 0 if fine else run + 1
            if run == threshold or run > threshold and again_us is not None and us - last >= again_us:
                out.append(event)
                last = int(us)
        return pd.DataFrame({key: [name[0]] * len(out), "event_id": out}).astype({"event_id": "int64"}), (run, last), None

    return _forgetting(stream, [key], f"{key} long, event_id long", "run int, last long", step, ["event_id"], "us", forget_us)


def changed_files(stream: DataFrame, idle_us: int = 15 * 60_000_000, forget_us: int | None = None) -> DataFrame:
    """(path, size, listed_us) of files to parse whole: of another size than when they were parsed last, and quiet for a
    while when they were listed. The stream is of listings (path, size, modified_us, listed_us). A path that hasn't been listed for
    `forget_us` is forgotten; should it come back, it is parsed again."""

    def step(name: tuple, rows: pd.DataFrame, held):
        size = held[0] if held else -1
        out = []
        for now, modified, listed in zip(rows["size"], rows["modified_us"], rows["listed_us"], strict=True):
            if now != size and listed - modified >= idle_us:
                out.append((name[0], now, listed))
                size = int(now)
        return pd.DataFrame(out, columns=["path", "size", "listed_us"]).astype({"size": "int64", "listed_us": "int64", "path": "str"}), (size,), None

    return _forgetting(stream, ["path"], "path string, size long, listed_us long", "size long", step, ["listed_us"], "listed_us", forget_us)


def retried(stream: DataFrame, most: int = 3, min_confidence: float = 0.0, forget_us: int | None = None) -> DataFrame:
    """(path, nth, failures, verdict) of attempts (path, nth, size, failed, confidence): `done`, `skipped` for a result of low
    confidence, `retry`, and `dead` from the `most`-th failure in a row on. A path whose size changed starts anew, as does one without an attempt
    for `forget_us`, for which attempts need `us`."""

    def step(name: tuple, rows: pd.DataFrame, held):
        size, failures = held or (-1, 0)
        out = []
        for nth, now, failed, sure in zip(rows["nth"], rows["size"], rows["failed"], rows["confidence"], strict=True):
            failures = (failures if now == size else 0) + 1 if failed else 0
            size = int(now)
            verdict = ("dead" if failures >= most else "retry") if failed else "skipped" if sure < min_confidence else "done"
            out.append((name[0], nth, failures, verdict))
        return pd.DataFrame(out, columns=["path", "nth", "failures", "verdict"]), (size, failures), None

    return _forgetting(stream, ["path"], "path string, nth long, failures int, verdict string", "size long, failures int", step, ["nth"], "us", forget_us)


def surfaced_first(stream: DataFrame, conversation: str = "conversation_id", dormant_us: int = 24 * 3_600_000_000, ts: str = "ts") -> DataFrame:
    """(conversation, id, us): ids that a conversation hasn't been shown yet. A conversation that is quiet for longer than
    `dormant_us` is forgotten: by the order of its rows at once, and by the watermark for what stays quiet."""
    timed = _timed(stream, ts, "10 minutes").select(conversation, "id", ts, micros(F.col(ts)).alias("us"))

    def step(name: tuple, rows: pd.DataFrame, held):
        ids, last = (set(held[0]), held[1]) if held else (set(), None)
        out = []
        for i, us in zip(rows["id"], rows["us"], strict=True):
            if last is not None and us - last > dormant_us:
                ids = set()
            last = int(us)
            if i not in ids:
                ids.add(i)
                out.append((name[0], i, last))
        frame = pd.DataFrame(out, columns=[conversation, "id", "us"]).astype({"us": "int64"})
        return frame, (sorted(ids), last), (last + dormant_us) // 1000

    return _keyed(timed, [conversation], f"{conversation} string, id string, us long", "ids array<string>, last long", step, ["us", "id"], "EventTimeTimeout")


def drained(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], at: str | None = None) -> dict[str, DataFrame]:
    """Each sink's rows after all that is available. Sinks are written one after the other, the first ones before, and
    whatever becomes of, the later ones; a batch that is run again writes the same folders."""
    spark, at = stream.sparkSession, at or shared_dir(stream.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        for name, made in sinks.items():
            made(batch).write.mode("overwrite").parquet(f"{at}/{name}/epoch={epoch}")
        batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    return {name: spark.read.schema(made(empty).schema).option("recursiveFileLookup", True).parquet(f"{at}/{name}") for name, made in sinks.items()}


def alerts_batch(rows: DataFrame, key: str, ok: str, order: str, threshold: int = 2) -> DataFrame:
    """The same over a table, as islands of failures."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    island = F.count_if(F.col(ok)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    bad = rows.withColumn("island", island).filter(~F.col(ok))
    place = F.row_number().over(Window.partitionBy(key, "island").orderBy(order))
    return bad.withColumn("r", place).filter(F.col("r") == threshold).select(key, order)
