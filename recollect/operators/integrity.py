"""Integrity checks: each gives (check, n), and its samples on request."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTI_VALUED = ("stack", "integration", "dependency")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("from_session = to_session").select(F.col("from_session").alias("sample"))


def unexplained(sessions: DataFrame, edges: DataFrame, status: str, kind: str) -> DataFrame:
    """Sessions of a status without an incoming edge of its kind."""
    incoming = edges.filter(F.col("kind") == kind).select(F.col("to_session").alias("id"))
    return sessions.filter(F.col("status") == status).join(incoming, "id", "left_anti").select(F.col("id").alias("sample"))


def dangling_edges(edges: DataFrame, sessions: DataFrame) -> DataFrame:
    ends = edges.select(F.col("from_session").alias("id")).union(edges.select(F.col("to_session").alias("id")))
    return ends.join(sessions.select("id"), "id", "left_anti").select(F.col("id").alias("sample"))


def several_current(facts: DataFrame, multi_valued: bool) -> DataFrame:
    """Subjects and predicates with more than one current fact; predicates that may have several are told apart."""
    test = F.col("predicate").isin(*MULTI_VALUED)
    rows = facts.filter("superseded_by is null and retired = 0").filter(test if multi_valued else ~test)
    return rows.groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.concat_ws(" ", "subject", "predicate").alias("sample"))


def dangling_versions(facts: DataFrame) -> DataFrame:
    return facts.filter("superseded_by is not null").select("id", F.col("superseded_by").alias("other")).join(facts.select(F.col("id").alias("other")), "other", "left_anti").select(F.col("id").alias("sample"))


def missing(rows: DataFrame, key: str, others: DataFrame, other: str) -> DataFrame:
    return rows.select(F.col(key).alias("k")).join(others.select(F.col(other).alias("k")), "k", "left_anti").select(F.col("k").cast("string").alias("sample"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of all checks; those without a finding have 0."""
    return reduce(DataFrame.union, (rows.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n")) for name, rows in checks.items()))


def repaired_status(sessions: DataFrame, edges: DataFrame) -> DataFrame:
    """Sessions, where a superseded or replaced status without an edge became closed."""
    explained = edges.filter(F.col("kind").isin("supersedes", "replaces")).select(F.col("to_session").alias("id"), F.when(F.col("kind") == "supersedes", "superseded").otherwise("replaced").alias("status")).distinct()
    known = explained.withColumn("known", F.lit(True))
    rows = sessions.join(known, ["id", "status"], "left")
    orphan = F.col("status").isin("superseded", "replaced") & F.col("known").isNull()
    return rows.withColumn("status", F.when(orphan, "closed").otherwise(F.col("status"))).select(sessions.columns)
