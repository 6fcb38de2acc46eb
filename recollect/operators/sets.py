"""Set joins: equal sets, similar sets, shared members. Pairs come from equi-joins on members, never from all pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..functions.score import jaccard
from .recall import small
from .tables import Steps, by_range, dropped, written


def set_key(array: Column) -> Column:
    """Equal for equal sets."""
    return F.array_join(F.array_sort(F.array_distinct(array)), "\u0001")


def predecessors(sessions: DataFrame, key: str, members: str, started: str, tie: str, as_of: bool = True) -> DataFrame:
    """(key, predecessor): the latest other session with exactly the same set; `as_of`: only earlier ones.

    Rows are sorted over all tasks by set and time, so that a frequent set is cut too; the first row of a task takes the
    last one of the task before.
    """
    rows = sessions.select(F.col(key).alias("key_"), set_key(F.col(members)).alias("k"), F.col(started).alias("at_"), F.col(tie).alias("tie_"))
    key_, started, tie, key = key, "at_", "tie_", "key_"
    if as_of:
        dealt = by_range(rows, "k", started, tie).withColumnRenamed("part_", "part")
        inside = dealt.withColumn("predecessor", F.lag(key).over(Window.partitionBy("part", "k").orderBy(started, tie)))
        last = dealt.groupBy("k", "part").agg(F.max_by(key, F.struct(started, tie)).alias("last"))  # a row for each task and set
        last = last.select("k", "part", F.lag("last").over(Window.partitionBy("k").orderBy("part")).alias("before"))
        return inside.join(last, ["k", "part"]).select(F.col(key).alias(key_), F.coalesce("predecessor", "before").alias("predecessor")).filter("predecessor is not null")
    last = Window.partitionBy("k").orderBy(F.desc(started), F.desc(tie))
    newest = rows.withColumn("r", F.row_number().over(last)).filter("r <= 2").groupBy("k").agg(F.max(F.when(F.col("r") == 1, F.col(key))).alias("one"), F.max(F.when(F.col("r") == 2, F.col(key))).alias("two"))
    return rows.join(newest, "k").select(F.col(key).alias(key_), F.when(F.col("one") != F.col(key), F.col("one")).otherwise(F.col("two")).alias("predecessor")).filter("predecessor is not null")


#: Sets that are indexed under one item and size in one task; more are split.
SPLIT = 2000


def similar_sets(sets: DataFrame, key: str, items: str, similarity: float) -> DataFrame:
    """(a, b, similarity) with a < b of keys whose sets are similar enough, exactly.

    Equal sets are one beforehand. Items have a global order from the rarest on. Of two sets at similarity t the smaller one, of n items, shares
    one of its first n - ceil(2t / (1 + t) n) + 1 items with the first n - ceil(t n) + 1 of the larger: an index of the one is probed by the other,
    under the item and the class of the smaller one's size; a class is as wide as the sizes that one set may meet, so that it probes two of them.
    Where the shared item stands says how many more there can be after it (positional filter), and 64 bits of each set, one for each item's hash, how
    many items of one the other lacks at least (bitmap filter), so that most pairs end there and are never written. An item that very many sets are
    indexed under is split into blocks, each of which all its probes visit. Each step is a job of its own, whose shuffle files go with it.
    """
    rows = sets.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(items)).alias("s")).filter(F.size("s") > 0)
    member = written(rows.groupBy("s").agg(F.min("key").alias("rep"), F.collect_list("key").alias("keys")), "sets")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    bits = F.reduce("s", F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x)))
    each = member.select("rep", F.size("s").alias("n"), bits.alias("bits"), F.explode("s").alias("item"))
    often = each.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "item"))
    prefix = lambda share: F.col("n") - F.ceil(F.round(F.lit(share) * F.col("n"), 9)) + 1
    first = written(each.join(often, "item").withColumn("at", place).filter(F.col("at") <= prefix(similarity)).select("rep", "n", "item", "at", "bits"), "prefixes")
    least = lambda n: F.ceil(F.round(F.lit(similarity) * n, 9))
    step = max(-math.log(similarity), 1e-9)
    size = lambda n: F.floor(F.log(n) / step).alias("size")
    index = first.filter(F.col("at") <= prefix(2 * similarity / (1 + similarity))).select(F.col("rep").alias("y"), F.col("n").alias("ny"), size(F.col("n")), "item", F.col("at").alias("aty"), F.col("bits").alias("by"))
    sizes = F.explode(F.sequence(size(least(F.col("n"))), size(F.col("n"))))
    probe = first.select(F.col("rep").alias("x"), F.col("n").alias("nx"), "item", F.col("at").alias("atx"), F.col("bits").alias("bx"), sizes.alias("size"))
    many = index.groupBy("item", "size").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("blocks")).filter("blocks > 1")
    many = small(written(many, "many"))  # one row at most for every SPLIT index rows
    blocks = F.coalesce("blocks", F.lit(1))
    index = index.join(many, ["item", "size"], "left").withColumn("block", F.pmod(F.xxhash64("y"), blocks)).drop("blocks")
    probe = probe.join(many, ["item", "size"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long")))).drop("blocks")
    reach = 1 + F.least(F.col("nx") - F.col("atx"), F.col("ny") - F.col("aty"))
    lacks = lambda a, b: F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))
    reach = F.least(reach, F.col("nx") - lacks("bx", "by"), F.col("ny") - lacks("by", "bx"))
    enough = F.ceil(F.round(F.lit(similarity / (1 + similarity)) * (F.col("nx") + F.col("ny")), 9))
    other = (F.col("ny") >= least(F.col("nx"))) & ((F.col("ny") < F.col("nx")) | (F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))
    pairs = written(probe.join(index, ["item", "size", "block"]).filter(other & (reach >= enough)).select("x", "y").distinct(), "pairs")
    dropped(first)
    s = lambda n: member.select(F.col("rep").alias(n), F.col("s").alias(f"s{n}"), F.col("keys").alias(f"k{n}"))
    both = pairs.join(s("x"), "x").join(s("y"), "y").withColumn("similarity", jaccard(F.col("sx"), F.col("sy"))).filter(F.col("similarity") >= similarity)
    apart = both.select(F.explode("kx").alias("p"), "ky", "similarity").select("p", F.explode("ky").alias("q"), "similarity")
    equal = member.filter(F.size("keys") > 1).select(F.explode("keys").alias("p"), "keys").select("p", F.explode("keys").alias("q"), F.lit(1.0).alias("similarity")).filter("p < q")
    return apart.union(equal).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def rederived(sessions: DataFrame, members: DataFrame, links: DataFrame, gap_days: int = 7, similarity: float = 0.5) -> DataFrame:
    """(a, b, similarity): sessions with similar decisions that share a member, aren't linked, and lie apart.

    Sessions have id, started_at and decisions (an array of tokens). Similar decisions come first, as they are rare;
    members, of which some are in a large share of sessions, only test pairs that are known. Links are pairs (a, b).
    """
    sessions = written(sessions.select("id", F.col("started_at").cast("timestamp").alias("t"), "decisions"), "sessions")
    pairs = written(similar_sets(sessions, "id", "decisions", similarity), "similar")
    own = members.groupBy("id").agg(F.collect_set("member").alias("m"))
    known = written(sessions.select("id", "t").join(own, "id"), "known")
    s = lambda n: known.select(F.col("id").alias(n), F.col("t").alias(f"t{n}"), F.col("m").alias(f"m{n}"))
    far = pairs.join(s("a"), "a").join(s("b"), "b").filter(F.abs(F.unix_timestamp("ta") - F.unix_timestamp("tb")) > gap_days * 86400)
    found = written(far.filter(F.arrays_overlap("ma", "mb")).select("a", "b", "similarity"), "apart")
    dropped(sessions, pairs, known)
    both = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return found.join(both, ["a", "b"], "left_anti")


def merge_suggestions(streams: DataFrame, min_score: float) -> DataFrame:
    """(a, b, score): the mean of entity similarity, session similarity and label similarity, of pairs that share a member.

    Streams have id, label, entities, sessions. Pairs without a common entity or session reach a third at most, so
    `min_score` must be above it. Then one of the two set similarities is at least (3 * min_score - 1) / 2, and the pairs
    are found by the prefix filter on either.
    """
    if min_score <= 1 / 3:
        raise ValueError("min_score must be above 1/3")
    least = (3 * min_score - 1) / 2
    pairs = similar_sets(streams, "id", "entities", least).union(similar_sets(streams, "id", "sessions", least)).select("a", "b").distinct()
    s = lambda n: streams.select(F.col("id").alias(n), x.label_key(F.col("label")).alias(f"l{n}"), F.col("entities").alias(f"e{n}"), F.col("sessions").alias(f"s{n}"))
    both = pairs.join(s("a"), "a").join(s("b"), "b")
    longest = F.greatest(F.length("la"), F.length("lb"))
    label = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein("la", "lb") / longest)
    score = (jaccard(F.col("ea"), F.col("eb")) + jaccard(F.col("sa"), F.col("sb")) + label) / 3
    return both.select("a", "b", score.alias("score")).filter(F.col("score") >= min_score)


def same_fold(entities: DataFrame, name: str, count: str) -> DataFrame:
    """(source, target): names that fold to the same key; the target has the largest count, then is first by name."""
    rows = entities.select(F.col(name).alias("source"), F.col(count).alias("n"), x.folded(F.col(name)).alias("fold"))
    best = rows.groupBy("fold").agg(F.min_by("source", F.struct(-F.col("n"), "source")).alias("target"))
    return rows.join(best, "fold").filter("source <> target").select("source", "target")


def suggested(entities: DataFrame, name: str, count: str, order: str) -> DataFrame:
    """(source, target, class, round): merges as a greedy pass suggests them, each name a source once at most.

    First names of one fold go to the fold's target (`safe`). Then likely pairs of what is left are taken in the order of the list, by their first
    and then their second name in `order`: a pair counts if neither name has been a source before, and its source is one from then on.
    The pass in rounds: a pair that is the first one left of both its names can be decided at once, as nothing before it touches either, and
    takes all other pairs of its source with it. Suggestions applied by class and round never merge into a name that is gone.
    """
    steps = Steps()
    safe = written(same_fold(entities, name, count), "safe")
    rest = entities.join(safe.select(F.col("source").alias(name)), name, "left_anti")
    at = lambda side: rest.select(F.col(name).alias(side), F.struct(F.col(order).alias("o"), F.col(name).alias("n")).alias(f"at_{side}"))
    pairs = likely_pairs(rest, name, count).join(at("source"), "source").join(at("target"), "target")
    left = steps.keep(pairs.select("source", "target", F.struct(F.least("at_source", "at_target").alias("a"), F.greatest("at_source", "at_target").alias("b")).alias("turn")), "left")
    found, taken = safe.select("source", "target", F.lit("safe").alias("class"), F.lit(0).alias("round")), []
    while left.limit(1).count():
        first = left.select("turn", F.explode(F.array("source", "target")).alias("n")).groupBy("n").agg(F.min("turn").alias("turn"))
        of = lambda side, first=first: first.select(F.col("n").alias(side), "turn")
        ready = written(left.join(of("source"), ["source", "turn"]).join(of("target"), ["target", "turn"]).select("source", "target"), "ready")
        taken.append(ready.select("source", "target", F.lit("likely"), F.lit(len(taken) + 1)))
        for side in ("source", "target"):
            left = left.join(ready.select(F.col("source").alias(side)), side, "left_anti")
        left = steps.keep(left.select("source", "target", "turn"), "left")
    for t in taken:
        found = found.union(t)
    steps.done()
    return found


def likely_pairs(entities: DataFrame, name: str, count: str) -> DataFrame:
    """(source, target): names that differ by a plural s or a repository suffix, by two equi-joins on derived keys."""
    rows = entities.select(name, count, x.folded(F.col(name)).alias("fold"))
    rows = rows.withColumn("base", x.repo_base(F.col("fold")))
    a = rows.select(F.col(name).alias("na"), F.col(count).alias("ca"), F.col("fold").alias("fa"), F.col("base").alias("ba"))
    b = rows.select(F.col(name).alias("nb"), F.col(count).alias("cb"), F.col("fold").alias("fb"), F.col("base").alias("bb"))
    plural = a.join(b, F.concat("fa", F.lit("s")) == F.col("fb"))
    suffix = a.join(b, F.col("ba") == F.col("bb")).filter("na < nb and fa != fb")
    pairs = plural.select("na", "ca", "nb", "cb").union(suffix.select("na", "ca", "nb", "cb")).distinct()
    first = (F.col("ca") > F.col("cb")) | (F.col("ca") == F.col("cb")) & (F.col("na") <= F.col("nb"))
    return pairs.select(F.when(first, F.col("nb")).otherwise(F.col("na")).alias("source"), F.when(first, F.col("na")).otherwise(F.col("nb")).alias("target"))


def overlapping(members: DataFrame, wanted: DataFrame, key: str, member: str, k: int) -> DataFrame:
    """The keys that share most members with `wanted`."""
    hits = members.join(wanted.select(member).distinct(), member, "left_semi").groupBy(key).agg(F.countDistinct(member).alias("overlap"))
    return hits.orderBy(F.desc("overlap"), key).limit(k)
