"""Changes as batch jobs: each takes the old tables and gives the new ones. Event-sourced overlays keep the last write."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_key, short_id
from .graph import numbered, survivors
from .tables import dropped, written


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """New rows over old ones: columns in `keep` never change, those in `fill` change only to values, others are overwritten."""
    o, n = (df.select(F.col(key), F.struct(*[c for c in old.columns if c != key]).alias(name)) for df, name in ((old, "o"), (new.select(old.columns), "n")))
    rows = o.join(n, key, "full_outer")

    def pick(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keep:
            return F.when(F.col("o").isNotNull(), a).otherwise(b)
        if c in fill:
            return F.coalesce(b, a)
        return F.when(F.col("n").isNotNull(), b).otherwise(a)

    return rows.select(key, *(pick(c).alias(c) for c in old.columns if c != key)).select(old.columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents that `new` has are replaced; others stay."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key isn't there yet, once each; the first in the order of all columns."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or [F.lit(1)])
    fresh = new.join(old.select(*keys), keys, "left_anti").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
    return old.unionByName(fresh.select(old.columns))


def prune_snapshots(snapshots: DataFrame, day: str, retention_days: int, today: str) -> DataFrame:
    """Snapshots to delete: those at least `retention_days` old."""
    return snapshots.filter(F.datediff(F.lit(today).cast("date"), F.col(day).cast("date")) >= retention_days)


#: Kinds of actions -> (type of subject, payload field, whether an empty value takes the setting back).
ACTIONS = {
    "dismiss": ("alert", None, False), "retire_entity": ("entity", None, False), "label_entity": ("entity", "new_type", False), "rename_entity": ("entity", "to", True),
    "resolve_open": ("open_question", None, False), "promote_open": ("open_question", "resolution", False), "dismiss_decision": ("decision", None, False),
    "revise_decision": ("decision", "to", True), "merge_entity": ("entity", "into", True), "set_coherence": ("entity", "state", True), "snooze": (None, "snoozed_until", False),
}


def overlay(actions: DataFrame, now: str) -> DataFrame:
    """(kind, subject_type, subject_id, value) that hold after all actions in the order of their ids.

    The last action that says something decides: an empty rename, revision or merge, and an unknown coherence, take the
    setting back; others without a value, and snoozes that are over, say nothing. Malformed payloads count as empty.
    """
    rows = actions.filter("reverted_by is null")
    value = F.lit(None).cast("string")
    says = F.lit(False)
    valid = F.lit(False)
    for kind, (subject, field, clears) in ACTIONS.items():
        mine = (F.col("kind") == kind) & ((F.col("subject_type") == subject) if subject else F.col("subject_type").isin("alert", "entity"))
        got = F.trim(F.get_json_object("payload", f"$.{field}")) if field else F.lit("")
        got = F.coalesce(got, F.lit(""))
        if kind == "set_coherence":
            got = F.when(got.isin("active", "sparse", "stale"), got).otherwise("")
        if kind == "rename_entity":
            got = F.when(got == F.col("subject_id"), "").otherwise(got)
        speaks = F.lit(True) if clears or not field else (got > now.replace(" ", "T")) if kind == "snooze" else (got != "")
        value = F.when(mine, got).otherwise(value)
        says = F.when(mine, speaks).otherwise(says)
        valid = valid | mine
    rows = rows.filter(valid).select("id", "kind", "subject_type", "subject_id", value.alias("value"), says.alias("says")).filter("says")
    last = Window.partitionBy("kind", "subject_type", "subject_id").orderBy(F.desc("id"))
    rows = rows.withColumn("_r", F.row_number().over(last)).filter("_r = 1")
    clearing = F.col("kind").isin(*(k for k, (_, _, c) in ACTIONS.items() if c)) & (F.col("value") == "")
    return rows.filter(~clearing).select("kind", "subject_type", "subject_id", "value")


def projected(entities: DataFrame, laid: DataFrame, key: str = "entity") -> DataFrame:
    """(entity, n, state): entities with their overlay: merged counts added to the target, retired and snoozed ones marked."""
    one = lambda kind, name: laid.filter((F.col("kind") == kind) & (F.col("subject_type") == "entity")).select(F.col("subject_id").alias(key), F.col("value").alias(name))
    into = entities.join(one("merge_entity", "into"), key, "left").select(F.coalesce("into", key).alias(key), "n")
    sums = into.groupBy(key).agg(F.sum("n").alias("n"))
    rows = sums.join(one("retire_entity", "_retired"), key, "left").join(one("snooze", "_snoozed"), key, "left")
    state = F.when(F.col("_retired").isNotNull(), "retired").when(F.col("_snoozed").isNotNull(), "snoozed").otherwise("active")
    return rows.select(key, "n", state.alias("state"))


def with_decisions(items: DataFrame, laid: DataFrame) -> DataFrame:
    """(session_id, id, kind, text): a session's open questions and decisions under the overlay.

    `items` has (session_id, id, kind, text) with kind `open` or `decision`. Resolved questions go, promoted ones become
    decisions with their resolution, dismissed decisions go, and revised ones have their new text.
    """
    of = lambda kind, subject, name: laid.filter((F.col("kind") == kind) & (F.col("subject_type") == subject)).select(F.col("subject_id").alias("id"), F.col("value").alias(name))
    rows = items
    for kind, subject, name in (("resolve_open", "open_question", "_resolved"), ("promote_open", "open_question", "_promoted"), ("dismiss_decision", "decision", "_dismissed"), ("revise_decision", "decision", "_revised")):
        rows = rows.join(of(kind, subject, name), "id", "left")
    asked, decided = F.col("kind") == "open", F.col("kind") == "decision"
    gone = asked & F.col("_resolved").isNotNull() & F.col("_promoted").isNull() | decided & F.col("_dismissed").isNotNull()
    text = F.when(asked, F.coalesce("_promoted", "text")).otherwise(F.coalesce("_revised", "text"))
    return rows.filter(~gone).select("session_id", "id", F.when(asked & F.col("_promoted").isNotNull(), "decision").otherwise(F.col("kind")).alias("kind"), text.alias("text"))


def superseded_sessions(sessions: DataFrame, edges: DataFrame, facts: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, edges, facts) after the marks (predecessor, successor) whose verdict is `ok`.

    A predecessor has one successor: of several marks the last one by id counts, and earlier edges of that kind go. Its
    status becomes `superseded`. Each of its facts is superseded by a current fact of the successor with the same subject and
    predicate (of several the last one by id), whatever it was superseded by before, and loses its embedding; without such a fact nothing
    changes. All marks see the facts as they were before.
    """
    good = marks.filter("verdict = 'ok'").groupBy(F.col("predecessor").alias("id")).agg(F.max("successor").alias("successor"))
    now = sessions.join(good.select("id", F.lit(True).alias("_hit")), "id", "left").withColumn("status", F.when(F.col("_hit"), "superseded").otherwise(F.col("status"))).drop("_hit")
    other = edges.join(good.select(F.col("id").alias("to_session"), F.lit("supersedes").alias("kind")), ["to_session", "kind"], "left_anti").select("from_session", "to_session", "kind")
    links = other.union(good.select("successor", "id", F.lit("supersedes")))
    heirs = facts.filter("superseded_by is null").groupBy(F.col("session_id").alias("successor"), "subject", "predicate").agg(F.max("id").alias("heir"))
    owned = facts.join(good.withColumnRenamed("id", "session_id"), "session_id", "left").join(heirs, ["successor", "subject", "predicate"], "left")
    return now, links, owned.select("id", F.coalesce("heir", "superseded_by").alias("superseded_by"), F.col("heir").isNotNull().alias("cascaded"))


def fact_writes(facts: DataFrame, writes: DataFrame) -> DataFrame:
    """`writes` (id, action, by, pos) with `error`: a fact that supersedes itself (`self`), a fact that isn't there (`missing`), or whose
    successor isn't (`missing target`); null for those that can be done."""
    known = lambda side, name: facts.select(F.col("id").alias(side), F.lit(True).alias(name))
    rows = writes.join(known("id", "_id"), "id", "left").join(known("by", "_by"), "by", "left")
    links = (F.col("action") == "supersede") & F.col("by").isNotNull()
    error = F.when(links & (F.col("id") == F.col("by")), "self").when(F.col("_id").isNull(), "missing").when(links & F.col("_by").isNull(), "missing target")
    return rows.select("id", "action", "by", "pos", error.alias("error"))


def fact_versions(facts: DataFrame, writes: DataFrame) -> DataFrame:
    """(id, superseded_by, retired, embedded) after writes (id, action, by) in the order of `pos`; those with an error do nothing.

    `supersede` by a fact, or by null, which makes it current again; `retire` by `1` or `0`; `embed`. Of each action the last
    write counts. A fact that is superseded or retired loses its embedding, and doesn't get it back by being current again, only by a later
    `embed`. Facts that begin current and not retired begin with an embedding.
    """
    good = fact_writes(facts, writes).filter("error is null")
    last = lambda where, name: F.max_by(F.struct("by"), F.when(where, F.col("pos"))).alias(name)
    is_ = lambda action: F.col("action") == action
    gone = is_("supersede") & F.col("by").isNotNull() | is_("retire") & (F.col("by") == "1")
    embeds = F.max_by(is_("embed"), F.when(gone | is_("embed"), F.col("pos"))).alias("_e")
    rows = facts.join(good.groupBy("id").agg(last(is_("supersede"), "_s"), last(is_("retire"), "_r"), embeds), "id", "left")
    by = F.when(F.col("_s").isNotNull(), F.col("_s.by")).otherwise(F.col("superseded_by"))
    retired = F.when(F.col("_r").isNotNull(), F.col("_r.by").cast("int")).otherwise(F.col("retired"))
    before = F.col("superseded_by").isNull() & (F.col("retired") == 0)
    return rows.select("id", by.alias("superseded_by"), retired.alias("retired"), F.coalesce("_e", before).alias("embedded"))


def ingested_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, superseded_by) after the facts of some sessions were replaced by a batch: the batch's last fact of a subject
    and predicate supersedes every other current one. `new` has `pos`, the order of arrival."""
    stay = old.join(new.select("session_id").distinct(), "session_id", "left_anti").select("id", "subject", "predicate", "superseded_by")
    winners = new.groupBy("subject", "predicate").agg(F.max_by("id", "pos").alias("winner"))
    rows = stay.unionByName(new.select("id", "subject", "predicate", F.lit(None).cast("string").alias("superseded_by"))).join(winners, ["subject", "predicate"], "left")
    return rows.select("id", F.coalesce("superseded_by", F.when(F.col("winner") != F.col("id"), F.col("winner"))).alias("superseded_by"))


def merge_errors(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target, error): merges that can't be done: of an entity with itself, or with a missing or retired one."""
    known = lambda side: entities.select(F.col("entity").alias(side), F.col("retired").alias(f"_{side}"))
    rows = merges.join(known("source"), "source", "left").join(known("target"), "target", "left")
    error = F.when(F.col("source") == F.col("target"), "self").when(F.col("_source").isNull() | F.col("_target").isNull(), "missing").when(F.col("_source") | F.col("_target"), "retired")
    return rows.select("source", "target", error.alias("error"))


def merged_entities(links: DataFrame, merges: DataFrame, sessions: DataFrame) -> DataFrame:
    """(entity, n, first_us, last_us) after merges (source, target): links move to where chains of merges end, doubles go,
    spans widen."""
    ends = survivors(merges.select(F.col("source").alias("entity"), "target"), "entity", "target").withColumnRenamed("survivor", "target")
    moved = links.join(ends, "entity", "left").select("session_id", F.coalesce("target", "entity").alias("entity")).distinct()
    rows = moved.join(sessions.select(F.col("id").alias("session_id"), F.unix_micros(F.col("started_at").cast("timestamp")).alias("us")), "session_id")
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def repointed(variants: DataFrame, merges: DataFrame) -> DataFrame:
    """(name, canonical, retired): variants point to where their canonical entity went, merged entities themselves to it."""
    ends = survivors(merges.select(F.col("source").alias("entity"), "target"), "entity", "target")
    rows = variants.join(ends.select(F.col("entity").alias("canonical"), F.col("survivor").alias("_to")), "canonical", "left").select("name", F.coalesce("_to", "canonical").alias("canonical"))
    own = ends.select(F.col("entity").alias("name"), F.col("survivor").alias("canonical"), F.lit(True).alias("retired"))
    stay = rows.join(own.select("name"), "name", "left_anti").withColumn("retired", F.lit(False))
    return stay.unionByName(own)


def merged_streams(streams: DataFrame, counts: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(streams, counts) after merges (source, target): sources are retired and point to their survivor; the counts of an
    entity are added. `counts` has (id, entity, n)."""
    ends = survivors(merges.select(F.col("source").alias("id"), "target"), "id", "target")
    now = streams.join(ends, "id", "left").select(*[c for c in streams.columns if c not in ("retired", "merged_into")], F.col("survivor").isNotNull().alias("retired"), F.col("survivor").alias("merged_into"))
    sums = counts.join(ends, "id", "left").groupBy(F.coalesce("survivor", "id").alias("id"), "entity").agg(F.sum("n").alias("n"))
    return now, sums


def bound(asked: DataFrame, streams: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id, how): the stream of each name: by its normalised label, else by an alias, else a new one, whose id comes
    from the name. Of several streams with one label the first by id."""
    key = lambda c: label_key(F.col(c))
    labels = streams.groupBy(key("label").alias("k")).agg(F.min("id").alias("_direct"))
    other = aliases.groupBy(key("alias").alias("k")).agg(F.min("id").alias("_alias"))
    rows = asked.select("name", key("name").alias("k")).distinct().join(labels, "k", "left").join(other, "k", "left")
    how = F.when(F.col("_direct").isNotNull(), "label").when(F.col("_alias").isNotNull(), "alias").otherwise("created")
    return rows.select("name", F.coalesce("_direct", "_alias", F.concat(F.lit("ws_"), short_id(F.col("k")))).alias("id"), how.alias("how"))


def verdicts(exemplars: DataFrame, labels: DataFrame) -> DataFrame:
    """Exemplars with their label; a human's label is never replaced by a model's."""
    best = Window.partitionBy("id").orderBy(F.desc(F.col("source") == "human"), F.desc("ts"), "survived")
    last = labels.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("id", "survived", "source")
    return exemplars.select("id").join(last, "id", "left")


def derived_scopes(parts: DataFrame, group: str, scope: str) -> DataFrame:
    """(group, scope): the scope that all members share; null if they differ or one has none."""
    n = parts.groupBy(group).agg(F.countDistinct(scope).alias("kinds"), F.count_if(F.col(scope).isNull()).alias("none"), F.min(scope).alias("one"))
    return n.select(group, F.when((F.col("kinds") == 1) & (F.col("none") == 0), F.col("one")).alias("scope"))


def cascaded_scopes(sessions: DataFrame, children: DataFrame, scope: str = "scope") -> DataFrame:
    """(id, scope, filled): children (id, session_id, scope) without a scope take their session's."""
    rows = children.join(sessions.select(F.col("id").alias("session_id"), F.col(scope).alias("_own")), "session_id", "left")
    return rows.select("id", F.coalesce(scope, "_own").alias(scope), (F.col(scope).isNull() & F.col("_own").isNotNull()).alias("filled"))


def stamped(rows: DataFrame, found: DataFrame, columns: list[str], parents: DataFrame) -> DataFrame:
    """(id, columns, persona, parent, outcome) after a backfill: columns that are empty are filled with what was found,
    others never change; persona and parent come from ids `agent-<persona>@<parent>`. The outcome is `unknown-parent`,
    `stamped` (something was filled), `already` (all was there) or `no-op` (nothing was found)."""
    pattern = "^agent-([^@]+)@(.+)$"
    part = lambda k: F.nullif(F.regexp_extract("id", pattern, k), F.lit(""))
    both = rows.join(found.select("id", *(F.col(c).alias(f"_{c}") for c in columns)), "id", "left").withColumn("persona", part(1)).withColumn("parent", part(2))
    both = both.join(parents.select(F.col("id").alias("parent"), F.lit(True).alias("_known")), "parent", "left")
    fills, missing = F.lit(False), F.lit(False)
    for c in columns:
        fills = fills | F.col(c).isNull() & F.col(f"_{c}").isNotNull()
        missing = missing | F.col(c).isNull()
    outcome = F.when(F.col("parent").isNotNull() & F.col("_known").isNull(), "unknown-parent").when(fills, "stamped").when(~missing, "already").otherwise("no-op")
    return both.select("id", *(F.coalesce(c, f"_{c}").alias(c) for c in columns), "persona", "parent", outcome.alias("outcome"))


def pruned_exemplars(exemplars: DataFrame, scope: str | None = None, older_than: str | None = None) -> DataFrame:
    """(id, reason) of exemplars to delete, with their vectors: those of an installation's scope whose code didn't survive (`reverted`), and
    those of any scope from before a time (`old`). A reverted one is named as that."""
    never = F.lit(False)
    reverted = (F.col("scope") == scope) & (F.col("survived") == 0) if scope is not None else never
    old = F.col("ts") < F.lit(older_than).cast(exemplars.schema["ts"].dataType) if older_than is not None else never
    reason = F.when(reverted, "reverted").when(old, "old")
    return exemplars.select("id", reason.alias("reason")).filter("reason is not null")


def pending(rows: DataFrame, done: DataFrame, key: str, after: object = None) -> DataFrame:
    """What a resumable job has left, in the order of its key."""
    left = rows.join(done.select(key), key, "left_anti")
    return left.filter(F.col(key) > F.lit(after)) if after is not None else left


def resumed(rows: DataFrame, key: str, lane: dict[str, str], work: Callable[[DataFrame], DataFrame], at: str, size: int = 1_000_000) -> DataFrame:
    """What `work` gives for all rows, kept in the folder `at`: a job that is killed goes on where it was.

    Rows are worked on in the order of their key, `size` at a time; what a part gives is written before the next one begins, and has the keys of
    all rows that it is done with. The keys that are written are the set of what is done, so that the two can't differ. A lane (a provider
    and a model, say) has a set of its own: another one starts anew.
    """
    spark = rows.sparkSession
    path = f"{at}/lane={hashlib.sha256(json.dumps(lane, sort_keys=True).encode()).hexdigest()[:16]}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    left = pending(rows, spark.read.parquet(path), key) if there else rows
    parts = numbered(left.withColumn("one_", F.lit(1)), "one_", [key]).withColumn("at_", F.floor((F.col("position") - 1) / size)).drop("one_", "position")
    parts = written(parts, "pending")
    for part in range((parts.agg(F.max("at_")).first()[0] if parts.limit(1).count() else -1) + 1):
        work(parts.filter(F.col("at_") == part).drop("at_")).write.mode("append").parquet(path)
    dropped(parts)
    if not there and not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        work(rows.limit(0)).write.parquet(path)
    return spark.read.parquet(path)
