"""JSONL logs: tolerant readers with explicit schemas, and the append sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_LOG = "ts string, conversation_id string, source string, runtime string, query string, entity string, kind string, mode string, limit int, n_results int, returned_ids array<string>, intent string"
FACT_LOG = "ts string, conversation_id string, source string, runtime string, query string, subject string, predicate string, kind string, mode string, limit int, n_results int, returned_ids array<string>"
CITATION_LOG = "ts string, conversation_id string, cited_id string, kind string, response_preview string"
MISS_LOG = "ts string, conversationId string, missedId string, kind string, surfacedCount int"
HOOK_LOG = "ts string, conversationId string, promptPreview string, gate string, hits array<struct<id:string,score:double>>, wouldInject array<string>, estTokens int, mode string"
SUPERSEDENCE_LOG = "ts string, predecessor_id string, successor_id string, reason string, source string"


def read_log(spark: SparkSession, path: str, schema: str, now: str | None = None, days: int | None = None) -> DataFrame:
    """Rows of a JSONL log with `ts` as a timestamp; blank and bad lines and lines without a time are skipped."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    rows = rows.withColumn("ts", F.try_to_timestamp("ts")).filter("ts is not null")
    if now and days:
        rows = rows.filter(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY"))
    return rows


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """`rows` with the fields of a JSON column beside the others; what doesn't parse gives nulls."""
    return rows.withColumn("_json", F.from_json(column, schema)).select(*rows.columns, "_json.*")


def append_log(rows: DataFrame, path: str, conversation: str | None = None) -> None:
    """Appends to a JSONL log; rows whose conversation can't be attributed are dropped."""
    from ..operators.telemetry import attributable

    (rows.filter(attributable(F.col(conversation))) if conversation else rows).write.mode("append").json(path)
