"""Ranked retrieval: BM25 over postings, exact nearest vectors, banded merges, and the final ranking.

Queries are a table, so that one plan serves many of them. Postings are kept only for the queries' terms before anything
is shuffled by document; N and the average length are over all documents, before any filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as s
from ..functions.text import index_tokens, phrases, plain_letters, token_set, tokens
from . import blocks
from .tables import written

#: Fixed values of the keyword ranking.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6
WEIGHTS = {"label": 10.0, "summary": 4.0, "body": 1.0}
#: Rows, and bytes of their texts, up to which the queries' side counts as small enough to copy to all executors.
SMALL, SMALL_BYTES = 200_000, 64 << 20
#: What lies between the places of two fields' tokens.
FAR = 1 << 40
#: Tokens in a row that are looked up as one term.
RUN = 4


def small(df: DataFrame, limit: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """`df` with a broadcast hint, if it has at most `limit` rows and its texts `size` bytes; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if is_small(df, limit, size) else df


def is_small(df: DataFrame, limit: int | None = None, size: int = SMALL_BYTES) -> bool:
    limit = SMALL if limit is None else limit
    texts = [F.octet_length(F.col(c)) for c, t in df.dtypes if t == "string"]
    n, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(map(lambda x: F.coalesce(x, F.lit(0)), texts), F.lit(8).cast("long"))), F.lit(0))).first()
    return n <= limit and total <= size


def query_phrases(queries: DataFrame, query: str, text: str) -> DataFrame:
    """(query, phrase, times): a query's tokens as phrases of index tokens; a repeated one counts as often as it is there."""
    return queries.select(query, F.explode(phrases(F.col(text))).alias("phrase")).groupBy(query, "phrase").agg(F.count(F.lit(1)).alias("times"))


def positions(docs: DataFrame, key: str, weights: dict[str, float] = WEIGHTS, lengths: tuple[int, ...] = (1,)) -> DataFrame:
    """(key, term, at, w): a row for each index token of each field with its place and the field's weight, and one without a term whose w is
    the number of all tokens. For other `lengths` than 1 a term is so many tokens in a row, joined by spaces, at the place of the first one; it's null
    where the field ends before. Places of different fields and lengths lie apart, so that no phrase runs from one to the next."""
    each = docs.select(key, *(index_tokens(F.col(c)).alias(f"_{i}") for i, c in enumerate(weights)))
    if max(lengths) > 1:  # else tokens lose their diacritics one by one, after others have gone
        each = each.select(key, *(F.transform(f"_{i}", plain_letters).alias(f"_{i}") for i in range(len(weights))))

    def runs(i: int, length: int) -> Column:
        own = F.col(f"_{i}")
        rest = lambda x, at: F.concat(x, *(y for k in range(1, length) for y in (F.lit(" "), F.get(own, at + k))))
        return own if length == 1 else F.transform(own, rest)

    kinds = [(i, length) for i in range(len(weights)) for length in lengths]
    sizes = [F.size(f"_{i}") for i, _ in kinds]
    ends = [sum(sizes[: k + 1], F.lit(0)) for k in range(len(kinds))]
    every = F.concat(F.array(F.lit("")), *(runs(*kind) for kind in kinds))
    tokens_in = sum((F.size(f"_{i}") for i in range(len(weights))), F.lit(0)).cast("double")
    rows = each.select(key, tokens_in.alias("_n"), *(e.alias(f"_e{k}") for k, e in enumerate(ends)), F.posexplode(every).alias("_pos", "term"))
    at, weight = F.when(F.col("_pos") == 0, F.lit(-FAR)), F.when(F.col("_pos") == 0, F.col("_n"))
    values = list(weights.values())
    for k, (i, _) in enumerate(kinds):
        inside = F.col("_pos") <= F.col(f"_e{k}")
        at, weight = at.when(inside, F.col("_pos") + k * FAR), weight.when(inside, F.lit(float(values[i])))
    term = F.col("term") if max(lengths) > 1 else plain_letters(F.col("term"))
    return rows.select(key, term.alias("term"), at.cast("long").alias("at"), weight.alias("w"))


def matches(docs: DataFrame, wanted: DataFrame, key: str, weights: dict[str, float] = WEIGHTS) -> tuple[DataFrame, bool]:
    """(key, n, m, at, w, off) of the places where `wanted` phrases (phrase, n) are, and whether some phrases are of several pieces.

    A phrase of up to `RUN` tokens is one term, of which each match is an occurrence; so a word that is in many phrases isn't paired with all of them
    wherever it stands. A longer one is m pieces of `RUN` tokens each, whose matches have to reach the same place `at`, once they are moved back by `off`.
    """
    parts, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    starts = F.when(size <= RUN, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(size - RUN, F.lit(0)), F.lit(RUN)), F.array(size - RUN))))
    of = wanted.select("n", parts.alias("parts"), F.size(starts).alias("m"), F.explode(starts).alias("off"))
    of = of.select("n", "m", "off", F.array_join(F.slice("parts", F.col("off") + 1, F.lit(RUN)), " ").alias("term"))
    length = wanted.sparkSession.createDataFrame([(-1, 1, 0, "")], "n long, m int, off int, term string")
    there = {r[0] for r in wanted.select(F.least(size, F.lit(RUN + 1))).distinct().collect()}  # RUN + 1 numbers at most
    lengths = tuple(sorted({min(x, RUN) for x in there})) or (1,)
    at = F.when(F.col("m") > 1, F.col("at") - F.col("off")).alias("at")
    return positions(docs, key, weights, lengths).join(small(of.unionByName(length)), "term").select(key, "n", "m", at, "w", "off"), RUN + 1 in there


def postings(docs: DataFrame, wanted: DataFrame, key: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(key, n, f): the weighted counts of the `wanted` phrases (phrase, n), and for n = -1 the length of the document.

    One pass over the texts: what nobody asks for ends in the scan's own stage. Long phrases are matched by intersecting the places of their
    pieces; a place that all of them reach is an occurrence.
    """
    rows, pieces = matches(docs, wanted, key, weights)
    if not pieces:
        return rows.groupBy(key, "n").agg(F.sum("w").alias("f"))
    found = rows.groupBy(key, "n", "m", "at").agg(F.count(F.lit(1)).alias("there"), F.sum(F.when(F.col("off") == 0, F.col("w"))).alias("w"))
    return found.filter("m = 1 or there = m").groupBy(key, "n").agg(F.sum("w").alias("f"))


def keyword_scores(docs: DataFrame, queries: DataFrame, key: str, query: str, text: str, weights: dict[str, float] = WEIGHTS, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query, key, score) of all documents that share a phrase with a query, or of the k best of each query, ties, after rounding
    to `digits`, to the smaller key.

    A query's tokens are phrases of index tokens (`foo-bar.ts` is foo, bar and ts in a row, in one field); each phrase has its own
    document frequency. Postings are written once; a document's own row then has all that its scores need.
    """
    asked = query_phrases(queries, query, text)
    wanted = written(asked.select("phrase").distinct().withColumn("n", F.monotonically_increasing_id()), "phrases")
    every = postings(docs, wanted, key, weights)
    held = F.filter(F.sort_array(F.collect_list(F.struct("n", "f"))), lambda x: x["n"] >= 0)
    by_doc = written(every.groupBy(key).agg(held.alias("held"), F.max(F.when(F.col("n") < 0, F.col("f"))).alias("length")), "postings")
    n_docs, avg_len = by_doc.agg(F.count(F.lit(1)), F.coalesce(F.avg("length"), F.lit(1.0))).first()
    spread = by_doc.select(F.explode("held.n").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("df"))
    rough = F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = spread.select("n", F.when(rough <= 0, F.lit(MIN_IDF)).otherwise(rough).alias("idf"))
    weighed = asked.join(wanted, "phrase").join(idf, "n").groupBy(F.col(query).alias("query")).agg(F.sort_array(F.collect_list(F.struct("n", (F.col("times") * F.col("idf")).alias("w")))).alias("all"))
    held_docs = by_doc.filter("size(held) > 0").select(F.col(key).alias("doc"), F.col("held.n").alias("phrases"), F.col("held.f").alias("f"), "length", F.lit(float(avg_len)).alias("avg_len"))
    found = blocks.scored(held_docs, weighed.select("query", F.col("all.n").alias("phrases"), F.col("all.w").alias("weights")), k, digits, K1, B)
    return found.select(F.col("query").alias(query), F.col("doc").alias(key), "score")


def top(scored: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with their rank, ties to the smaller key; limited in each task before the shuffle."""
    order = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, query: str, k: int, vector: str = "embedding", group: str | None = None, others: bool = False, digits: int | None = None) -> DataFrame:
    """(query, key or group, distance, rank): exact, filters first, the least distance of each group. `others`: a query
    whose own row is among the vectors (the same key) isn't its own neighbour. `digits`: distances that are equal when they
    are rounded are ties.
    """
    return blocks.nearest(vectors, queries, key, query, k, vector, group, others, digits)


def hybrid(primary: DataFrame, secondary: DataFrame, query: str, key: str) -> DataFrame:
    """Banded merge of two legs (query, key, score): every hit of the primary leg stands above all others."""
    a, b = primary.select(query, key, F.col("score").alias("p")), secondary.select(query, key, F.col("score").alias("x"))
    top_a = a.groupBy(query).agg(F.max("p").alias("p_max"))
    top_b = b.groupBy(query).agg(F.max("x").alias("x_max"))
    both = a.join(b, [query, key], "full_outer").join(top_a, query, "left").join(top_b, query, "left")
    zero = F.lit(0.0)
    score = s.band(F.col("p"), F.coalesce("p_max", zero), F.col("x"), F.coalesce("x_max", zero))
    return both.select(query, key, score.alias("score"), F.col("p").isNotNull().alias("in_primary"), F.col("x").isNotNull().alias("in_secondary"))


def finalise(hits: DataFrame, now: str, query: str, key: str, k: int, half_life: float = s.RECENCY_HALF_LIFE_DAYS) -> DataFrame:
    """Score x recency x supersede penalty x tiebreak, rounded; `total` counts the candidates before the limit.

    `hits` has score, started_at, status, tiebreak.
    """
    final = s.rounded(F.col("score") * s.recency(F.col("started_at"), now, half_life) * F.when(F.col("status") == "superseded", s.SUPERSEDED_FACTOR).otherwise(1.0) * F.col("tiebreak"))
    rows = hits.withColumn("final", final).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(query)))
    return top(rows, query, key, k, "final")


def match_fields(text: dict[str, Column], query: Column) -> Column:
    """Names of the fields that share a token with the query, in order."""
    return F.array_compact(F.array(*(F.when(F.arrays_overlap(tokens(c), query), F.lit(name)) for name, c in text.items())))


def successors(hits: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """`hits` with `successor`, the largest newer id that supersedes a hit."""
    newer = edges.filter("kind = 'supersedes'").groupBy(F.col("to_session").alias(key)).agg(F.max("from_session").alias("successor"))
    return hits.join(newer, key, "left")


def select_hits(hits: DataFrame, surfaced: DataFrame, query: str, key: str, threshold: float, floor: float = 0.0, per_fire: int = 3, per_conversation: int = 10) -> DataFrame:
    """What a fire surfaces: above a score, above a share of the upper median, not surfaced before, within two budgets."""
    n = Window.partitionBy(query)
    rows = hits.withColumn("_i", F.row_number().over(n.orderBy("score", key))).withColumn("_n", F.count(F.lit(1)).over(n))
    rows = rows.withColumn("_mid", F.max(F.when(F.col("_i") == F.floor(F.col("_n") / 2) + 1, F.col("score"))).over(n))
    rows = rows.filter((F.col("score") >= threshold) & (F.col("score") >= floor * F.col("_mid")))
    used = surfaced.groupBy(query).agg(F.countDistinct(key).alias("_used"))
    rows = rows.join(surfaced.select(query, key), [query, key], "left_anti").join(used, query, "left")
    budget = F.least(F.lit(per_fire), F.greatest(F.lit(0), per_conversation - F.coalesce("_used", F.lit(0))))
    return rows.withColumn("pick", F.row_number().over(n.orderBy(F.desc("score"), key))).filter(F.col("pick") <= budget).select(query, key, "score", "pick")


def code_search(exemplars: DataFrame, queries: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Nearest other exemplars with penalties: 0.05 for code that didn't survive, 0.1 for negative outcomes."""
    penalty = F.when(F.col("survived") == 0, 0.05).otherwise(0.0) + F.when(F.col("negative"), 0.1).otherwise(0.0)
    found = blocks.nearest(exemplars, queries, key, query, k, "embedding", others=True, digits=4, penalty=penalty)
    return found.join(exemplars.select(key, "negative"), key).select(query, key, "negative", F.col("distance").alias("cost"), "rank")


def shared_terms(docs: DataFrame, queries: DataFrame, key: str, query: str, text: str, fields: list[str]) -> DataFrame:
    """(query, key, term, field) of the distinct terms that a query shares with a document's fields, by an equi-join."""
    terms = queries.select(query, F.explode(token_set(F.col(text))).alias("term"))

    def named(field: str) -> Column:
        return F.transform(token_set(F.col(field)), lambda t: F.struct(t.alias("term"), F.lit(field).alias("field")))

    each = F.flatten(F.array(*map(named, fields)))
    rows = docs.select(key, F.explode(each).alias("t")).select(key, "t.term", "t.field")
    return rows.join(small(terms), "term").select(query, key, "term", "field")


def holding(docs: DataFrame, passages: DataFrame, key: str, passage: str, text: str = "text") -> DataFrame:
    """(passage, key) of the documents whose text contains the passage's `text`, character by character.

    A passage's inner words (between single spaces) are words of any text that holds it. The longest one is its anchor: an
    equi-join on it gives the candidates. Passages of fewer than three words have no anchor and are compared with all.
    """
    words = F.split("_p", " ")
    inner = F.filter(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2)), lambda w: w != "")
    longest = F.reduce(inner, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    asked = passages.select(passage, F.col(text).alias("_p")).filter("_p is not null").withColumn("_w", longest)
    anchored, bare = asked.filter("_w <> ''"), asked.filter("_w = ''")
    each = docs.select(key, text, F.explode(F.array_distinct(F.split(text, " "))).alias("_w"))
    if is_small(anchored):  # one stage: a text is compared where it was read
        found = each.join(F.broadcast(anchored), "_w").filter(F.contains(text, "_p"))
    else:  # candidates first, so that a text isn't sent once for each of its words
        pairs = each.select(key, "_w").join(anchored.select(passage, "_w"), "_w").select(key, passage)
        found = docs.select(key, text).join(pairs, key).join(anchored.select(passage, "_p"), passage).filter(F.contains(text, "_p"))
    rest = docs.select(key, text).join(small(bare.select(passage, "_p")), F.contains(text, "_p"))
    return found.select(passage, key).union(rest.select(passage, key)).distinct()
