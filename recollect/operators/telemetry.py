"""Roll-ups over append-only logs: counts, rates, precision, failure modes, outcomes, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import micros, rounded
from ..functions.text import normalised


def since(log: DataFrame, now: str, days: float, ts: str = "ts") -> DataFrame:
    """Rows of the last `days` before `now`; a range of the column's own type, that reaches the Parquet scan."""
    kind = log.schema[ts].dataType.simpleString()
    return log.filter(F.col(ts) >= F.lit(now).cast(kind) - F.expr(f"INTERVAL '{int(days * 24)}' HOUR"))


def hit_stats(log: DataFrame, n_results: str = "n_results") -> DataFrame:
    hits = F.count_if(F.col(n_results) > 0)
    total = F.count(F.lit(1))
    return log.agg(total.alias("total"), hits.alias("with_results"), F.when(total > 0, rounded(hits / total, 3)).otherwise(0.0).alias("hit_rate"))


def counts_by(log: DataFrame, key: Column, name: str, top: int | None = None, distinct: str | None = None) -> DataFrame:
    """(name, n) by count, then name; with `distinct`, also the distinct values of that column."""
    aggs = [F.count(F.lit(1)).alias("n"), *([F.countDistinct(distinct).alias(f"distinct_{distinct}")] if distinct else [])]
    out = log.groupBy(key.alias(name)).agg(*aggs)
    return out.orderBy(F.desc("n"), name).limit(top) if top else out


#: What test traffic says, as a part of a query and as a whole one.
PROBE_WORDS = ("probe", "beacon", "smoke", "path test", "recall test", "cutover-test")
PROBE_EXACT = ("pgvector", "hono", "x", "")


def is_probe(query: Column) -> Column:
    """Test traffic, by the whole query or a part of it; null is none."""
    q = normalised(query)
    part = F.lit(False)
    for w in PROBE_WORDS:
        part = part | F.contains(q, F.lit(w))
    return F.coalesce(q.isin(*PROBE_EXACT) | part, F.lit(False))


def attributable(conversation: Column) -> Column:
    return F.coalesce(~conversation.isin("", "unknown", "mcp_tool") & ~conversation.rlike("^(conv_)?test"), F.lit(False))


#: Fixed value: ids that are shorter say nothing when they are found in a text.
MIN_ID = 6


def _of_server(server: str) -> Column:
    return F.col("name").rlike(f"^mcp__[^_]*{server}[^_]*__")


def citations(surfaced: DataFrame, calls: DataFrame, prose: DataFrame, conversation: str, server: str = "memory") -> DataFrame:
    """(conversation, id, kind): surfaced ids that a tool call's input holds, or else the answer's prose; each once.

    `surfaced` has (conversation, id), `calls` (conversation, name, input), `prose` (conversation, text). Only tools of the
    memory's server count; explicit citations don't, as they are logged where they are made.
    """
    ids = surfaced.filter(F.length("id") >= MIN_ID).select(conversation, "id").distinct()
    own = calls.filter(_of_server(server) & ~F.col("name").endswith("__cite_session")).select(conversation, F.col("input").alias("said"), F.lit(0).alias("kind"))
    said = own.union(prose.select(conversation, F.col("text").alias("said"), F.lit(1).alias("kind")))
    hits = said.join(ids, conversation).filter(F.contains("said", "id")).groupBy(conversation, "id").agg(F.min("kind").alias("kind"))
    return hits.select(conversation, "id", F.when(F.col("kind") == 0, "tool_use").otherwise("prose").alias("kind"))


def misses(surfaced: DataFrame, calls: DataFrame, conversation: str, pos: str, server: str = "memory") -> DataFrame:
    """(conversation, id, kind): ids that a call names outright without having been surfaced; the first call counts."""
    kind = F.when(F.col("name").endswith("__get_session"), "get_session").when(F.col("name").endswith("__cite_session"), "cite_session")
    asked = calls.filter(_of_server(server)).select(conversation, pos, F.get_json_object("input", "$.id").alias("id"), kind.alias("kind")).filter((F.length("id") >= MIN_ID) & F.col("kind").isNotNull())
    return asked.join(surfaced.select(conversation, "id"), [conversation, "id"], "left_anti").groupBy(conversation, "id").agg(F.min_by("kind", pos).alias("kind"))


def precision(surfaced: DataFrame, cited: DataFrame, conversation: str = "conversation_id", key: str = "id") -> DataFrame:
    """(conversation, surfaced, cited, precision) of the distinct surfaced ids of each conversation."""
    shown = surfaced.select(conversation, key).distinct()
    used = cited.select(conversation, key, F.lit(1).alias("used")).distinct()
    per = shown.join(used, [conversation, key], "left").groupBy(conversation).agg(F.count(F.lit(1)).alias("n_surfaced"), F.count("used").alias("n_cited"))
    return per.withColumn("precision", F.col("n_cited") / F.col("n_surfaced"))


def precision_by_source(surfaced: DataFrame, cited: DataFrame, source: str = "source") -> DataFrame:
    """(source, conversations, macro precision)."""
    shown = surfaced.select(source, "conversation_id", "id").distinct()
    used = cited.select("conversation_id", "id", F.lit(1).alias("used")).distinct()
    per = shown.join(used, ["conversation_id", "id"], "left").groupBy(source, "conversation_id").agg((F.count("used") / F.count(F.lit(1))).alias("p"))
    return per.groupBy(source).agg(F.count(F.lit(1)).alias("conversations"), rounded(F.avg("p")).alias("precision"))


def failure_modes(signals: DataFrame, min_samples: int = 10, min_rate: float = 0.2, top: int | None = None) -> DataFrame:
    failed = F.count_if(F.col("outcome").isin("fail", "exhausted"))
    groups = signals.groupBy("repo", "model", "kind", F.coalesce("step", F.lit("")).alias("step"))
    modes = groups.agg(F.count(F.lit(1)).alias("samples"), failed.alias("failures"), F.max("ts").alias("last_seen"))
    modes = modes.withColumn("rate", F.col("failures") / F.col("samples")).filter((F.col("samples") >= min_samples) & (F.col("rate") >= min_rate))
    return modes.orderBy(F.desc("rate"), F.desc("samples"), "repo", "model", "kind", "step").limit(top) if top else modes


def recommendations(modes: DataFrame) -> DataFrame:
    """What to do about failure modes: swap a model that fails half of the time; add a rule for a named step."""
    kinds = F.array_compact(F.array(F.when(F.col("rate") >= 0.5, F.lit("swap")), F.when(F.col("step") != "", F.lit("rule"))))
    return modes.withColumn("action", F.explode(kinds)).select("repo", "model", "kind", "step", "action")


def outcome_verdicts(sessions: DataFrame, signals: DataFrame, edges: DataFrame, pairs: DataFrame, citations: DataFrame, now: str, held_days: int = 14) -> DataFrame:
    """(id, verdict, tier, degraded): the first rule that holds, over evidence that was summed for each session.

    `pairs` has (a, b); sessions have id, status, ended_at.
    """
    signalled = signals.groupBy(F.col("session_id").alias("id")).agg(F.max(F.col("outcome") != "pass").alias("negative"))
    incoming = edges.groupBy(F.col("to_session").alias("id")).agg(F.max(F.col("kind").isin("supersedes", "replaces")).alias("replaced"), F.max(F.col("kind") == "continues").alias("continued"))
    again = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct().withColumn("again", F.lit(True))
    cited = citations.select("id").distinct().withColumn("cited", F.lit(True))
    rows = sessions.join(signalled, "id", "left").join(incoming, "id", "left").join(again, "id", "left").join(cited, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    old = (micros(F.lit(now)) - micros(F.col("ended_at"))) >= held_days * 86_400_000_000
    verdict = (
        F.when(F.col("negative"), "overturned").when(F.col("negative").isNotNull(), "held")
        .when(F.col("status").isin("superseded", "replaced") | yes("replaced"), "overturned").when(F.coalesce(old, F.lit(False)), "held")
        .when(yes("continued"), "built-upon").when(yes("again"), "re-derived-later").otherwise("unobserved")
    )
    out = rows.select("id", verdict.alias("verdict"), F.when(F.col("negative").isNotNull(), "A").otherwise("B").alias("tier"), yes("cited").alias("cited"))
    return out.withColumn("degraded", (F.col("verdict") == "unobserved") & F.col("cited")).drop("cited")


def quiet_hook(fires: DataFrame, sessions_yesterday: int, min_fires: int = 10) -> DataFrame:
    """Two alarms over (live, injecting) flags: sessions but no live fire, and many fires that never inject."""
    live, injecting = F.count_if("live"), F.count_if(F.col("live") & F.col("injecting"))
    return fires.agg(live.alias("fires"), injecting.alias("injecting")).select(
        "fires", "injecting", ((F.lit(sessions_yesterday) > 0) & (F.col("fires") == 0)).alias("dead"), ((F.col("fires") >= min_fires) & (F.col("injecting") == 0)).alias("mute"),
    )


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, k: int = 5, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(queries, recall at 1, 3, k, mean reciprocal rank) over queries with gold; ranked has (query, key, rank)."""
    best = ranked.join(gold.select(query, key).distinct(), [query, key], "left_semi").groupBy(query).agg(F.min("rank").alias("rank"))
    each = gold.select(query).distinct().join(best, query, "left")
    at = lambda n: rounded(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)))
    mrr = rounded(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))))
    return each.agg(F.count(F.lit(1)).alias("queries"), at(1).alias("recall_1"), at(3).alias("recall_3"), at(k).alias("recall_k"), mrr.alias("mrr"))


def miss_classes(ranked: DataFrame, candidates: DataFrame, gold: DataFrame, k: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(class, n): a gold document in the first k is a hit, further down or among candidates a ranking miss, else a candidate miss."""
    hit = ranked.filter(F.col("rank") <= k).join(gold, [query, key], "left_semi").select(query).distinct().withColumn("hit", F.lit(True))
    known = candidates.join(gold, [query, key], "left_semi").select(query).distinct().withColumn("known", F.lit(True))
    each = gold.select(query).distinct().join(hit, query, "left").join(known, query, "left")
    kind = F.when(F.col("hit"), "hit").when(F.col("known"), "ranking-miss").otherwise("candidate-miss")
    return each.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def floor_calibration(scored: DataFrame, floors: list[float], min_kept: float = 0.95) -> DataFrame:
    """(floor, gold_kept, noise_cut, recommended) for absolute score floors; `scored` has (score, gold)."""
    table = F.explode(F.array(*(F.lit(float(x)) for x in floors)))
    each = scored.select("score", "gold", table.alias("floor"))
    kept = F.avg(F.when(F.col("gold"), (F.col("score") >= F.col("floor")).cast("double")))
    cut = F.avg(F.when(~F.col("gold"), (F.col("score") < F.col("floor")).cast("double")))
    rows = each.groupBy("floor").agg(rounded(kept).alias("gold_kept"), rounded(cut).alias("noise_cut"))
    fit = Window.partitionBy(F.col("gold_kept") >= min_kept).orderBy(F.desc("noise_cut"), F.desc("floor"))
    return rows.withColumn("recommended", (F.col("gold_kept") >= min_kept) & (F.row_number().over(fit) == 1))


def relative_floors(hits: DataFrame, gold: DataFrame, floors: list[float], min_kept: float = 0.95) -> DataFrame:
    """(floor, gold_kept, noise_cut, recommended) for floors relative to the median score of a hit's fire.

    `hits` has (fire, conversation_id, id, score), `gold` (conversation_id, id); fires of conversations without gold are left out. Of an
    even number of scores the upper middle one is the median; where it isn't above 0, relative scores are 0. The floor that cuts most
    noise and keeps enough gold is recommended, the lowest on a tie. Equal scores of a fire are counted before any window.
    """
    known = hits.join(gold.select("conversation_id").distinct(), "conversation_id", "left_semi")
    counts = known.groupBy("fire", "score").agg(F.count(F.lit(1)).alias("_n"))
    fire = Window.partitionBy("fire")
    upto = F.sum("_n").over(fire.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"_upto": upto, "_total": F.sum("_n").over(fire)})
    medians = ranked.filter("_upto > floor(_total / 2)").groupBy("fire").agg(F.min("score").alias("_median"))
    used = gold.select("conversation_id", "id", F.lit(True).alias("_gold")).distinct()
    rows = known.join(medians, "fire").join(used, ["conversation_id", "id"], "left")
    share = F.when(F.col("_median") > 0, F.col("score") / F.col("_median")).otherwise(0.0)
    found = floor_calibration(rows.select(share.alias("score"), F.coalesce("_gold", F.lit(False)).alias("gold")), floors, min_kept)
    fit = Window.partitionBy(F.col("gold_kept") >= min_kept).orderBy(F.desc("noise_cut"), "floor")
    return found.withColumn("recommended", (F.col("gold_kept") >= min_kept) & (F.row_number().over(fit) == 1))


def body_hits(returned: DataFrame, answers: DataFrame, k: int = 5, query: str = "query_id") -> DataFrame:
    """(query, body_hit): whether one of the first k bodies holds the answer, both lower-cased, with a space for all that is
    neither letter nor digit.

    `returned` has (query, rank, body), `answers` (query, answer), one a query. An answer of one word and under four characters must
    stand between word boundaries (of A-Z, a-z, 0-9 and _); an empty one is never held.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    asked = answers.select(query, plain(F.coalesce("answer", F.lit(""))).alias("_answer"))
    edge = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
    body, answer = plain(F.col("body")), F.col("_answer")
    short = ~F.contains(answer, F.lit(" ")) & (F.length(answer) < 4)
    held = F.when(short, F.regexp_like(body, F.concat(F.lit(edge), answer, F.lit(edge)))).otherwise(F.contains(body, answer))
    first = returned.filter(F.col("rank") <= k).join(asked.filter("_answer <> ''"), query).groupBy(query).agg(F.max(held).alias("_held"))
    return asked.join(first, query, "left").select(query, F.coalesce("_held", F.lit(False)).cast("int").alias("body_hit"))


def boosted(ranked: DataFrame, citations: DataFrame, alpha: float = 0.15) -> DataFrame:
    """Adds alpha * ln(1 + citations by other conversations) to scores above 0; `ranked` has (conversation_id, id, score)."""
    total = citations.groupBy("id").agg(F.count(F.lit(1)).alias("total"))
    own = citations.groupBy("id", "conversation_id").agg(F.count(F.lit(1)).alias("own"))
    rows = ranked.join(total, "id", "left").join(own, ["id", "conversation_id"], "left")
    others = F.coalesce("total", F.lit(0)) - F.coalesce("own", F.lit(0))
    return rows.withColumn("boosted", F.when(F.col("score") > 0, F.col("score") + alpha * F.log1p(others.cast("double"))).otherwise(F.col("score"))).drop("total", "own")


def reranked(boosted: DataFrame, gold: DataFrame, conversation: str = "conversation_id", key: str = "id") -> DataFrame:
    """(conversations, mrr_before, mrr_after, improved, hurt): the first gold row's rank by score and by boosted score."""
    rank = lambda c: F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(c), key))
    rows = boosted.withColumn("_x", rank("score")).withColumn("_y", rank("boosted")).join(gold.select(conversation, key).distinct(), [conversation, key], "left_semi")
    best = rows.groupBy(conversation).agg(F.min("_x").alias("x"), F.min("_y").alias("y"))
    return best.agg(F.count(F.lit(1)).alias("conversations"), rounded(F.avg(1 / F.col("x"))).alias("mrr_before"), rounded(F.avg(1 / F.col("y"))).alias("mrr_after"), F.count_if(F.col("y") < F.col("x")).alias("improved"), F.count_if(F.col("y") > F.col("x")).alias("hurt"))


def precision_recall(truth: DataFrame, found: DataFrame, case: str, item: str) -> DataFrame:
    """(case, precision, recall, f1) of found items against true ones, null where there is nothing to divide by."""
    both = truth.select(case, item, F.lit(1).alias("t")).distinct().join(found.select(case, item, F.lit(1).alias("f")).distinct(), [case, item], "full_outer")
    per = both.groupBy(case).agg(F.count("t").alias("true"), F.count("f").alias("found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("right"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    per = per.withColumn("precision", ratio("right", "found")).withColumn("recall", ratio("right", "true"))
    return per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def nearest_rank(values: DataFrame, column: str, percents: list[int], buckets: int = 256) -> DataFrame:
    """(percent, value): the value at floor(p / 100 * (n - 1)) in sorted order, exactly."""
    found, total = _at_ranks(values, column, lambda n: {p * (n - 1) // 100 for p in percents}, buckets)
    table = values.sparkSession.createDataFrame([(p, p * (total - 1) // 100) for p in percents], "percent int, rank long")
    return found.join(F.broadcast(table), "rank").select("percent", "value")


def percentiles(values: DataFrame, column: str, percents: list[int], buckets: int = 256) -> DataFrame:
    """(percent, value): the value at p / 100 * (n - 1) in sorted order, between two rows by their distance."""
    found, total = _at_ranks(values, column, lambda n: {p * (n - 1) // 100 + k for p in percents for k in (0, 1)}, buckets)
    table = values.sparkSession.createDataFrame([(p, p * (total - 1) // 100, p * (total - 1) % 100 / 100) for p in percents], "percent int, rank long, part double")
    upper = found.select((F.col("rank") - 1).alias("rank"), F.col("value").alias("upper"))
    both = found.join(F.broadcast(table), "rank").join(upper, "rank", "left")
    return both.select("percent", (F.col("value") + F.col("part") * F.coalesce(F.col("upper") - F.col("value"), F.lit(0.0))).alias("value"))


def _at_ranks(values: DataFrame, column: str, ranks, buckets: int) -> tuple[DataFrame, int]:
    """(rank, value) of the ranks (from 0) that a function of the number of values asks for, and that number.

    Approximate quantiles only cut the values into buckets; the buckets' counts tell which of them hold the ranks that are
    asked for, and only those are sorted, each in a task of its own and with equal values as one row.
    """
    rows = values.filter(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    edges = rows.agg(F.percentile_approx("value", [k / buckets for k in range(1, buckets)], 10_000).alias("edges")).first()["edges"] or []
    place = F.size(F.filter(F.array(*(F.lit(e) for e in sorted(set(edges)))) if edges else F.array(), lambda e: e < F.col("value")))
    counts = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", place)
    sums = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most `buckets` rows
    total, before, wanted = sum(sums.values()), 0, []
    for bucket in sorted(sums):
        wanted += [(r, bucket, r - before) for r in sorted(ranks(total)) if before <= r < before + sums[bucket]]
        before += sums[bucket]
    want = values.sparkSession.createDataFrame(wanted, "rank long, bucket int, inside long")
    run = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    held = counts.join(F.broadcast(want.select("bucket").distinct()), "bucket", "left_semi").withColumn("upto", F.sum("n").over(run))
    return held.join(F.broadcast(want), "bucket").filter("upto > inside and upto - n <= inside").select("rank", "value"), total
