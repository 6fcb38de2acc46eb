"""Facts: versioned subject-predicate-value triples, their keyword score, corroboration and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as s
from ..functions.text import token_set

#: Fixed weights of a fact's keyword score.
VALUE, SUBJECT, PREDICATE = 3, 1, 1


def current(facts: DataFrame) -> DataFrame:
    return facts.filter("superseded_by is null and retired = 0")


def accepted(superseded: bool = False, min_confidence: float = 0.0, kind: str | None = None) -> Column:
    """Retired facts never pass, not even where superseded ones do."""
    test = (F.col("retired") == 0) & (F.col("confidence") >= min_confidence)
    if not superseded:
        test = test & F.col("superseded_by").isNull()
    return test & (F.col("kind") == kind) if kind else test


def keyword_score(query: Column) -> Column:
    shared = lambda c: F.size(F.array_intersect(query, token_set(F.col(c))))
    return VALUE * shared("value") + SUBJECT * shared("subject") + PREDICATE * shared("predicate")


def latest(facts: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The newest row of each key, by rank and not by gathering."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return facts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def collapsed(facts: DataFrame) -> DataFrame:
    """(id, winner): every older fact of a subject and predicate with the id that replaces it."""
    w = Window.partitionBy("subject", "predicate").orderBy(F.desc("created_at"), F.desc("id"))
    rows = facts.select("id", F.row_number().over(w).alias("n"), F.first("id").over(w).alias("winner"))
    return rows.filter("n > 1").select("id", "winner")


def history(facts: DataFrame) -> DataFrame:
    """Versions of each subject and predicate, newest first."""
    w = Window.partitionBy("subject", "predicate").orderBy(F.desc("created_at"), F.desc("id"))
    return facts.withColumn("version", F.row_number().over(w))


def corroborated(facts: DataFrame) -> DataFrame:
    """(subject, predicate, value, sessions, factor), over all facts, superseded and retired ones too."""
    n = facts.groupBy("subject", "predicate", "value").agg(F.countDistinct("session_id").alias("sessions"))
    return n.withColumn("factor", s.corroboration(F.col("sessions")))


def related(facts: DataFrame, entities: DataFrame, min_confidence: float = 0.7, min_sessions: int = 2, k: int = 5) -> DataFrame:
    """The best corroborated current facts about some entities: one value for each subject and predicate, then the k best."""
    about = facts.filter(accepted(min_confidence=min_confidence)).join(entities.select(F.col("entity").alias("subject")).distinct(), "subject", "left_semi")
    # Corroboration is counted for those subjects only, over all of their facts.
    subjects = about.select("subject").distinct()
    known = corroborated(facts.join(subjects, "subject", "left_semi")).filter(F.col("sessions") >= min_sessions)
    rows = about.join(known, ["subject", "predicate", "value"])
    best = latest(rows, ["subject", "predicate"], F.desc("sessions"), F.desc("confidence"), F.col("value"), F.col("id"))
    return best.orderBy(F.desc("sessions"), F.desc("confidence"), "id").limit(k)


def related_to_hits(facts: DataFrame, hits: DataFrame, entities: DataFrame, query: str, min_confidence: float = 0.7, min_sessions: int = 2, k: int = 5, top_hits: int = 5, most_entities: int = 8, newest: int = 50) -> DataFrame:
    """(query, subject, predicate, value, sessions, rank): the facts to show beside each query's hits (query, session_id, rank).

    The entities (session_id, entity, position) of the first hits count in the order of hits and positions, trimmed, the first `most_entities` of them;
    of each the `newest` current facts, of which the sure and corroborated ones are kept: one value for each predicate, then the k best. These limits are
    the operator's. Corroboration is counted over all facts of those subjects, whatever their state.
    """
    named = entities.select("session_id", F.trim("entity").alias("subject"), "position").filter("subject <> ''")
    seen = hits.filter(F.col("rank") <= top_hits).join(named, "session_id").groupBy(query, "subject").agg(F.min(F.struct("rank", "position", "subject")).alias("at"))
    wanted = seen.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy("at"))).filter(F.col("n") <= most_entities).select(query, "subject")
    subjects = wanted.select("subject").distinct()
    listed = current(facts).join(subjects, "subject", "left_semi")
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("created_at"), F.desc("id")))).filter(F.col("n") <= newest)
    known = corroborated(facts.join(subjects, "subject", "left_semi")).filter(F.col("sessions") >= min_sessions)
    sure = listed.filter(F.col("confidence") >= min_confidence).join(known, ["subject", "predicate", "value"])
    best = latest(sure, ["subject", "predicate"], F.desc("sessions"), F.desc("confidence"), F.col("value"), F.col("id"))
    order = Window.partitionBy(query).orderBy(F.desc("sessions"), F.desc("confidence"), "id")
    rows = wanted.join(best, "subject").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.select(query, "subject", "predicate", "value", "sessions", "rank")
