"""The projected dataset: coherence, alerts, runtimes, samples, overlays of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import micros, rounded


def coherence(n: Column, age: Column) -> Column:
    return F.when(n == 0, "sparse").when(F.coalesce(age, F.lit(999)) > 30, "stale").when(n >= 3, "active").otherwise("sparse")


def stale_alerts(entities: DataFrame, dismissed: DataFrame, key: str = "entity") -> DataFrame:
    age = F.col("age")
    rows = entities.filter(age > 30).join(dismissed, key, "left_anti")
    return rows.select(key, "age", F.when(age > 60, "high").when(age > 45, "medium").otherwise("low").alias("severity"))


def alert_id(entity: Column) -> Column:
    return F.concat(F.lit("stale_"), F.regexp_replace(entity, "[^A-Za-z0-9]", "_"))


def alert_summaries(entities: DataFrame, hidden: DataFrame, opens: DataFrame) -> DataFrame:
    """(alert_id, entity, severity, age, summary), high before medium before low, oldest first within each.

    `entities` has (entity, n, age, status), `hidden` the alert ids that are dismissed or snoozed, `opens` (entity, at, id, question).
    An entity without sessions or age, or that is retired or snoozed itself, has no alert. The summary names the first of at most
    two open questions.
    """
    age = F.col("age")
    live = (F.col("n") > 0) & (age > 30) & ~F.coalesce("status", F.lit("")).isin("retired", "snoozed")
    rows = entities.filter(live).withColumn("alert_id", alert_id(F.col("entity"))).join(hidden, "alert_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("entity").orderBy("at", "id"))
    two = opens.withColumn("_r", place).filter("_r <= 2").groupBy("entity").agg(F.count(F.lit(1)).alias("_k"), F.min_by("question", "_r").alias("_first"))
    label = F.when(F.col("_k") == 1, "question").otherwise("questions")
    tail = F.concat(F.lit(" · "), F.col("_k").cast("string"), F.lit(" unresolved open "), label, F.lit(': "'), F.substring("_first", 1, 80), F.lit('"'))
    summary = F.concat(F.lit("Last touch "), age.cast("string"), F.lit(" days ago"), F.coalesce(tail, F.lit("")))
    severity = F.when(age > 60, "high").when(age > 45, "medium").otherwise("low")
    found = rows.join(two, "entity", "left").select("alert_id", "entity", severity.alias("severity"), "age", summary.alias("summary"))
    return found.orderBy(F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2), F.desc("age"), "entity")


def scope_coverage(rows: DataFrame) -> DataFrame:
    """(surface, scope, total, stamped, unstamped, fraction) of (surface, scope) rows.

    A line a surface and scope that is set, one a surface with `*` for its scope, and one for all with `*` in both.
    """
    counts = rows.groupBy("surface", "scope").agg(F.count(F.lit(1)).alias("_n"))
    stamped = F.sum(F.when(F.col("scope").isNotNull(), F.col("_n")).otherwise(0)).alias("stamped")
    total = F.sum("_n").alias("total")
    each = counts.filter("scope IS NOT NULL").groupBy("surface", "scope").agg(total, stamped)
    whole = counts.groupBy("surface").agg(total, stamped).withColumn("scope", F.lit("*"))
    overall = counts.agg(total, stamped).withColumns({"surface": F.lit("*"), "scope": F.lit("*")})
    found = each.unionByName(whole).unionByName(overall.withColumns({"total": F.coalesce("total", F.lit(0)), "stamped": F.coalesce("stamped", F.lit(0))}))
    share = F.when(F.col("total") == 0, 0.0).otherwise(F.col("stamped") / F.col("total"))
    return found.withColumns({"unstamped": F.col("total") - F.col("stamped"), "fraction": rounded(share)})


def runtimes(sessions: DataFrame, now: str) -> DataFrame:
    """(runtime, total, week, last_us, state) of each runtime."""
    name = F.coalesce(F.nullif(F.trim("runtime"), F.lit("")), F.lit("unknown"))
    age = micros(F.lit(now)) - micros(F.col("started_at"))
    rows = sessions.groupBy(name.alias("runtime")).agg(F.count(F.lit(1)).alias("total"), F.count_if(age <= 7 * 86_400_000_000).alias("week"), F.max(micros(F.col("started_at"))).alias("last_us"))
    old = micros(F.lit(now)) - F.col("last_us")
    return rows.withColumn("state", F.when(old <= 3_600_000_000, "active").when(old <= 86_400_000_000, "idle").otherwise("dormant"))


def stratified(rows: DataFrame, key: str, stratum: str, n: int) -> DataFrame:
    """A sample of n, shared among strata by largest remainders, in an order of a hash of the key."""
    every = Window.partitionBy(F.lit(1))
    counts = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    share = counts.withColumn("_x", F.col("_n") * float(n) / F.sum("_n").over(every))
    rest = F.row_number().over(every.orderBy(F.desc(F.col("_x") - F.floor("_x")), stratum))
    share = share.withColumn("_k", F.floor("_x") + (rest <= n - F.sum(F.floor("_x")).over(every)).cast("int"))
    order = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key)
    picked = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    return picked.join(share.select(stratum, "_k"), stratum).filter("_r <= _k").select(key, stratum)


def length_bucket(n: Column) -> Column:
    return F.when(n < 3_000, "short").when(n < 10_000, "medium").otherwise("long")


def gold_sample(rows: DataFrame, cited: DataFrame, key: str, stratum: str, n: int, max_share: float = 0.6) -> DataFrame:
    """(key, chosen_by): at most `max_share` of n rows from those cited, the rest as a sample by strata of what is left."""
    target = max(0, min(n, rows.limit(max(n, 0)).count()))
    known = rows.join(cited.select(key).distinct(), key, "left_semi")
    picked = known.orderBy(F.md5(F.col(key).cast("string")), key).limit(int(target * max_share)).select(key)
    taken = picked.count()
    rest = rows.join(picked, key, "left_anti")
    fill = stratified(rest, key, stratum, target - taken).select(key, F.lit("stratum").alias("chosen_by"))
    return picked.select(key, F.lit("citation").alias("chosen_by")).unionByName(fill)


def eligibility(rows: DataFrame, known: DataFrame, key: str, text: str, shortest: int) -> DataFrame:
    """(key, reason): the first rule that excludes a row, else `eligible`."""
    digest = rows.select(key, F.md5(text).alias("_d"), F.length(text).alias("_n"))
    first = digest.groupBy("_d").agg(F.min(key).alias("_first"))
    each = digest.join(first, "_d").join(known.select(F.col(key), F.lit(True).alias("_known")).distinct(), key, "left")
    reason = F.when(F.col("_n") < shortest, "short").when(F.col(key) != F.col("_first"), "duplicate").when(F.col("_known").isNull(), "unresolved").otherwise("eligible")
    return each.select(key, reason.alias("reason"))


#: Fixed value: a line of a block that is at least so long, and stands in a prompt, has come from it.
LEAKED = 20


def eligible(rows: DataFrame, blocks: DataFrame, key: str, text: str, order: str, shortest: int = 15) -> DataFrame:
    """(key, reason): the first rule that excludes a prompt, else `eligible`: too short (`short`), the text of an earlier prompt by `order` that
    wasn't (`duplicate`), no reconstructed block (`unresolved`), or a line of its own block in it (`leakage`). `blocks` has (key, block); a null
    block isn't resolved. A prompt only meets its own block, so that a line is looked for where both lie.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+\z", "")
    given = rows.select(key, order, F.coalesce(text, F.lit("")).alias("_t"), F.md5(trimmed).alias("_d"), (F.length(trimmed) < shortest).alias("_short"))
    first = given.filter("not _short").groupBy("_d").agg(F.min(F.struct(F.col(order).alias("o"), F.col(key).alias("k"))).alias("_first"))
    each = given.join(first, "_d", "left").join(blocks.select(key, F.col("block").alias("_b")).filter("_b is not null"), key, "left")
    long = F.filter(F.transform(F.split("_b", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: F.length(x) >= LEAKED)
    reason = F.when(F.col("_short"), "short").when(F.col("_first.k") != F.col(key), "duplicate").when(F.col("_b").isNull(), "unresolved").when(F.exists(long, lambda x: F.contains(F.col("_t"), x)), "leakage")
    return each.select(key, F.coalesce(reason, F.lit("eligible")).alias("reason"))


def recall_coverage(log: DataFrame, *tables: DataFrame, window: int = 200) -> DataFrame:
    """(surface, returned, found, scoped, fraction): how many of the ids that the newest `window` entries of a query log (ts, entry, source, ids)
    returned are known, and have a scope; by surface, and as `*` over all. Each table has (id, scope); an id counts as the first of them that has it.
    Each id counts once a surface. The window is the report's."""
    newest = log.orderBy(F.desc("ts"), F.desc("entry")).limit(window)
    ids = newest.select(F.col("source").alias("surface"), F.explode("ids").alias("id")).filter("id is not null")
    ids = ids.union(ids.select(F.lit("*"), "id")).distinct()
    rows, found = ids, F.lit(None).cast("int")
    for i, t in enumerate(tables):
        rows = rows.join(t.select("id", F.col("scope").alias(f"_s{i}"), F.lit(True).alias(f"_t{i}")).dropDuplicates(["id"]), "id", "left")
    scope, found = F.lit(None).cast("string"), F.lit(False)
    for i in reversed(range(len(tables))):
        scope, found = F.when(F.col(f"_t{i}"), F.col(f"_s{i}")).otherwise(scope), found | F.coalesce(f"_t{i}", F.lit(False))
    n = rows.select("surface", found.alias("f"), (found & scope.isNotNull()).alias("s")).groupBy("surface").agg(F.count(F.lit(1)).alias("returned"), F.count_if("f").alias("found"), F.count_if("s").alias("scoped"))
    return n.withColumn("fraction", F.when(F.col("found") == 0, F.lit(0.0)).otherwise(rounded(F.col("scoped") / F.col("found"))))


def catalogue(entities: DataFrame, laid: DataFrame) -> DataFrame:
    """(entity, n, type, display, status, coherence_computed, coherence) of entities (entity, n, age, type, display, status) under an overlay.

    A merged entity's own count is added to that of its target, where there is one; its row stays, as `retired`. Retired goes before snoozed, which goes
    before the status that was. Coherence is computed from the folded count, and an override stands beside it.
    """
    one = lambda kind, name: laid.filter((F.col("kind") == kind) & (F.col("subject_type") == "entity")).select(F.col("subject_id").alias("entity"), F.col("value").alias(name))
    rows = entities
    for kind, name in (("merge_entity", "_into"), ("retire_entity", "_retired"), ("snooze", "_snoozed"), ("label_entity", "_type"), ("rename_entity", "_display"), ("set_coherence", "_state")):
        rows = rows.join(one(kind, name), "entity", "left")
    more = entities.join(one("merge_entity", "_to"), "entity").groupBy(F.col("_to").alias("entity")).agg(F.sum("n").alias("_more"))
    rows = rows.join(more, "entity", "left").withColumn("n", F.col("n") + F.coalesce("_more", F.lit(0)))
    status = F.when(F.col("_retired").isNotNull() | F.col("_into").isNotNull(), "retired").when(F.col("_snoozed").isNotNull(), "snoozed").otherwise(F.col("status"))
    state = coherence(F.col("n"), F.col("age"))
    return rows.select("entity", "n", F.coalesce("_type", "type").alias("type"), F.coalesce("_display", "display").alias("display"), status.alias("status"), state.alias("coherence_computed"), F.coalesce("_state", state).alias("coherence"))


def metrics(sessions: DataFrame, entities: DataFrame, now: str) -> DataFrame:
    """One row: sessions of this week and of the last one, entities with sessions by effective coherence (healthy, sparse, stale), and decisions of
    sessions that are neither superseded nor replaced. Sessions have (started_at, status, decisions), a number; entities are a `catalogue`."""
    age = (micros(F.lit(now)) - micros(F.col("started_at"))) / F.lit(86_400_000_000)
    live = ~F.coalesce(F.col("status").isin("superseded", "replaced"), F.lit(False))
    a = sessions.agg(F.count_if((age >= 0) & (age < 7)).alias("this_week"), F.count_if((age >= 7) & (age < 14)).alias("last_week"), F.coalesce(F.sum(F.when(live, F.col("decisions"))), F.lit(0)).alias("closed_decisions"))
    known, state = F.col("n") > 0, F.coalesce("coherence", F.lit("sparse"))
    b = entities.agg(F.count_if(known & (state == "active")).alias("healthy"), F.count_if(known & ~state.isin("active", "stale")).alias("sparse"), F.count_if(known & (state == "stale")).alias("stale"))
    return a.crossJoin(b)  # one row each


def facets(entities: DataFrame, alerts: DataFrame) -> DataFrame:
    """(facet, value, n): alerts by `severity`, with `all`; and for each coherence its entities by number of sessions, and those with an override."""
    severity = alerts.select(F.explode(F.array(F.lit("all"), "severity")).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).select(F.lit("severity").alias("facet"), "value", "n")
    size = F.when(F.col("n") == 1, "1").when(F.col("n") <= 5, "2-5").otherwise("6+")
    other = F.when(F.col("coherence") != F.col("coherence_computed"), "overridden")
    each = entities.filter("n > 0").select(F.col("coherence").alias("facet"), F.explode(F.array_compact(F.array(F.lit("any"), size, other))).alias("value"))
    return severity.union(each.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).select("facet", "value", "n"))
