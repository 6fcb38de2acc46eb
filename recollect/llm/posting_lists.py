"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

Index: centroids come from k-means on a bounded sample, where too large clusters are split and too small ones dropped
(balance). Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M the largest norm of all
vectors. Each vector goes to its nearest list, and if it lies at a boundary, to the other lists whose centroid is at
most `closure` times as far. Centroids are searched by a graph of their neighbours, in memory, walked from fixed entry
nodes as far as distances stay within the ratio that is asked for.

Search: a query walks the graph and takes the nearest lists that hold k others for certain, and those whose centroid is
within a ratio of the last one's distance. The ratio is the least of a ladder at which the table's own queries (`measured`
of them, all if there are fewer) find `recall` of their true neighbours by that walk, and all but a fiftieth of them
`least`; it ends with all lists. True neighbours are sought among all vectors by brute force, as queries may lie elsewhere
than vectors do, and a sample may lack the nearest. Lists are packed into shards of bounded size (a longer list is cut by a hash of its vectors). A query goes
to the shards of its lists only, and a shard's vectors once for each block of queries that ask it; each task returns a
query's best of a shard.

Equal vectors are one class with its smallest ids, as only those can be among the nearest. Every vector is indexed.
Cases: vectors that are null, empty, zero or hold null or non-finite components, those of another length than most, and
null ids take no part; repeated ids count as one; with fewer than k candidates a query returns all that it found; components
keep the type that they have; columns of other names are left behind; an empty table, and one without a query, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, written
from .vectors import in_order, kind_of, plain_zero, sampled, stack, usable


@dataclass(frozen=True)
class PostingParams:
    k: int = 20
    #: Bound of the sample that the index is fitted on; lists are `spread` times the root of the vectors, at least
    #: `min_lists` and at most an eighth of the sample.
    sample: int = 20_000
    spread: float = 0.5
    min_lists: int = 8
    replicas: int = 4
    closure: float = 1.08
    recall: float = 0.95
    least: float = 0.8
    measured: int = 512
    degree: int = 24
    entries: int = 8
    shard: int = 40_000
    query_block: int = 8192
    seed: int = 3


class Centroids:
    """Centroids and the graph of their neighbours."""

    def __init__(self, at: np.ndarray, degree: int, entries: int, seed: int):
        self.at = at
        n, random = len(at), np.random.default_rng(seed)
        self.edges = np.zeros((n, 0), np.int64)
        if n > 1:
            near = min(degree, n - 1)
            own = np.empty((n, near), np.int64)
            for s in range(0, n, 512):
                d = _squares(at[s : s + 512], at)
                d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
                own[s : s + 512] = np.argpartition(d, near - 1, axis=1)[:, :near]
            self.edges = np.concatenate([own, random.integers(0, n, (n, 4)), np.roll(np.arange(n), -1)[:, None]], 1)
        self.entry = random.permutation(n)[:entries]

    def near(self, x: np.ndarray, ratio: float, sizes: np.ndarray | None = None, need: int = 0) -> np.ndarray:
        """Squared distances (rows x centroids), infinite where the walk didn't come or found a distance beyond the ratio
        of the nearest one's, or of that up to which lists of these sizes hold `need` entries."""
        dist = np.full((len(x), len(self.at)), np.inf)
        dist[:, self.entry] = _squares(x, self.at[self.entry])
        done = np.zeros(dist.shape, bool)
        while True:
            row, col = np.nonzero((dist <= _limit(dist, max(ratio, 1.05), sizes, need)) & np.isfinite(dist) & ~done)
            if not len(row):
                break
            done[row, col] = True
            new = np.zeros(dist.shape, bool)
            new[np.repeat(row, self.edges.shape[1]), self.edges[col].ravel()] = True
            row, col = np.nonzero(new & np.isinf(dist))
            for s in range(0, len(row), 65536):
                r, c = row[s : s + 65536], col[s : s + 65536]
                dist[r, c] = ((x[r] - self.at[c]) ** 2).sum(1)
        dist[dist > _limit(dist, ratio, sizes, need)] = np.inf
        return dist


def _limit(dist: np.ndarray, ratio: float, sizes: np.ndarray | None, need: int) -> np.ndarray:
    """The squared distance of each row up to which lists are taken; infinite where those known don't hold enough."""
    if np.isinf(ratio):
        return np.full((len(dist), 1), np.inf)
    base = dist.min(1, keepdims=True)
    if sizes is not None:
        left, m = np.arange(len(dist)), 32
        while len(left):  # mostly a few lists are enough
            m = min(m, dist.shape[1])
            some = np.argpartition(dist[left], m - 1, axis=1)[:, :m]
            far = np.take_along_axis(dist[left], some, 1)
            order = np.argsort(far, axis=1, kind="stable")
            enough = np.cumsum(sizes[np.take_along_axis(some, order, 1)], axis=1) >= need
            last = np.take_along_axis(np.take_along_axis(far, order, 1), enough.argmax(1)[:, None], 1)[:, 0]
            base[left, 0] = np.where(enough.any(1), last, np.inf)
            left = left[~enough.any(1)] if m < dist.shape[1] else left[:0]
            m *= 8
    return base * ratio**2 + 1e-12


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def balanced_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """About k centres; clusters above twice the mean size are split, those under an eighth dropped, round by round."""
    random = np.random.default_rng(seed)
    at = x[random.permutation(len(x))[:k]].copy()
    for turn in range(rounds):
        own = np.concatenate([_squares(x[s : s + 2048], at).argmin(1) for s in range(0, len(x), 2048)])
        size = np.bincount(own, minlength=len(at))
        total = np.zeros_like(at)
        np.add.at(total, own, x)
        at = total / np.maximum(1, size)[:, None]
        mean = len(x) / k
        if turn < rounds - 2:
            extra = [x[m[random.integers(len(m))]] for c in np.flatnonzero(size > 2 * mean) if len(m := np.flatnonzero(own == c))]
            at = np.concatenate([at[size > mean / 8], np.array(extra).reshape(-1, x.shape[1])])
        else:
            at = at[size > 0]
    return np.unique(at, axis=0)


def _augment(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(1)))[:, None]], 1)


def _query(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1)


def fit(x: np.ndarray, most: float, n_all: int, p: PostingParams) -> tuple[Centroids, float]:
    """What indexing needs, from sampled vectors: the centroids, and the square of the largest norm as it came."""
    k = int(max(1, min(max(p.min_lists, p.spread * np.sqrt(n_all)), len(x) // 8)))
    return Centroids(balanced_means(_augment(x, most), k, p.seed), p.degree, p.entries, p.seed), most


def probed(centroids: Centroids, x: np.ndarray, ratio: float, sizes: np.ndarray, p: PostingParams) -> np.ndarray:
    """Which lists (queries x lists) a query asks; the nearest ones hold k + 1 vectors, though each may be in `replicas` lists."""
    return np.isfinite(centroids.near(_query(x), ratio, sizes, p.replicas * (p.k + 1)))


def widest(centroids: Centroids, sizes: np.ndarray, x: np.ndarray, weight: np.ndarray, true: pd.DataFrame, p: PostingParams) -> float:
    """The least ratio at which queries x, each standing for `weight` rows, find enough of their true neighbours.

    `true` has (query, share, lists): the place of a query in x, what part of its neighbours this one is, the lists that hold it.
    """
    query, share = true["query"].to_numpy(), true["share"].to_numpy()
    which, of = np.repeat(np.arange(len(true)), true["lists"].str.len()), np.concatenate([np.zeros(0, np.int64), *true["lists"]]).astype(np.int64)
    some = np.unique(query)  # a query without any candidate has nothing to find

    def enough(ratio: float) -> bool:
        asked = probed(centroids, x, ratio, sizes, p)
        got = np.zeros(len(true), bool)
        np.logical_or.at(got, which, asked[query[which], of])
        found = np.bincount(query, share * got, len(x))[some]
        return np.average(found, weights=weight[some]) >= p.recall and np.average(found >= p.least, weights=weight[some]) >= 0.98

    ladder = [*np.arange(1.0, 2.0, 0.02), *np.arange(2.0, 4.0, 0.2), np.inf]
    low, high = 0, len(ladder) - 1
    while low < high and len(some):  # a wider ratio finds no less
        middle = (low + high) // 2
        low, high = (low, middle) if enough(ladder[middle]) else (middle + 1, high)
    return float(ladder[high])


def assign(centroids: Centroids, points: np.ndarray, p: PostingParams) -> np.ndarray:
    """Up to `replicas` lists of each point, nearest first; -1 fills the rest."""
    dist = centroids.near(points, p.closure)
    n = min(p.replicas, dist.shape[1])
    order = np.argsort(dist, axis=1, kind="stable")[:, :n]
    out = np.full((len(points), p.replicas), -1)
    out[:, :n] = np.where(np.isinf(np.take_along_axis(dist, order, 1)), -1, order)
    return out


def _best(q: np.ndarray, v: np.ndarray, reps: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (rep, exact score) of its k best rows, ties to the smaller rep."""
    rough, out = q @ v.T, []
    n = min(k, len(reps))
    bar = -np.partition(-rough, n - 1, axis=1)[:, n - 1] - 1e-9 * (1 + np.abs(rough).max(1))
    for i in range(len(q)):
        at = np.flatnonzero(rough[i] >= bar[i])
        exact = in_order(v[at], q[i][None, :])
        order = np.lexsort((reps[at], -exact))[:k]
        out.append((reps[at[order]], exact[order]))
    return out


def _measured(asked: DataFrame, classes: DataFrame, lists: DataFrame, p: PostingParams) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    """Some queries' vectors, how many sampled rows have each, and their true neighbours among all vectors, as `widest` takes them."""
    some = sampled(asked, "vec_id", p.measured).select("vec_id", "embedding")
    some = classes.select("rep", "embedding").join(F.broadcast(some), "embedding").toPandas()  # at most about `measured` rows
    weight = some.groupby("rep").size()
    some = some.drop_duplicates("rep").sort_values("rep")
    own, k = some["rep"].to_numpy(), p.k + 1
    x = stack(some["embedding"])
    shared = classes.sparkSession.sparkContext.broadcast(x)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        score, rep, copies = np.full((len(q), k), -np.inf), np.full((len(q), k), -1), np.zeros((len(q), k), np.int64)
        for pdf in batches:
            for s in range(0, len(pdf), 4096):
                part = pdf.iloc[s : s + 4096]
                every = [(score, q @ stack(part["embedding"]).T), (rep, part["rep"].to_numpy()), (copies, part["copies"].to_numpy())]
                every = [np.concatenate([old, np.broadcast_to(new, (len(q), len(part)))], 1) for old, new in every]
                row, col = np.nonzero(every[0] >= -np.partition(-every[0], k - 1, axis=1)[:, k - 1 : k])
                order = np.lexsort((every[1][row, col], -every[0][row, col], row))  # ties at the last place to the smaller rep
                top = col[order[np.searchsorted(row, np.arange(len(q)))[:, None] + np.arange(k)]]
                score, rep, copies = (np.take_along_axis(z, top, 1) for z in every)
        row, col = np.nonzero(copies)
        yield pd.DataFrame({"query": row, "rep": rep[row, col], "score": score[row, col], "copies": copies[row, col]})

    found = classes.select("rep", "embedding", F.size("ids").alias("copies")).mapInPandas(best, "query long, rep long, score double, copies long")
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k)
    found = lists.select("rep", "list").join(F.broadcast(found), "rep").groupBy("query", "rep", "r", "copies").agg(F.collect_set("list").alias("lists"))
    true = found.toPandas().sort_values(["query", "r"])
    rows = true["copies"] - (true["rep"].to_numpy() == own[true["query"].to_numpy(np.int64)])
    before = rows.groupby(true["query"]).cumsum() - rows
    rows = rows.clip(upper=(p.k - before).clip(lower=0))
    true["share"] = rows / rows.groupby(true["query"]).transform("sum").clip(lower=1)
    return x, weight.to_numpy(np.float64), true[rows > 0]


def nearest(vectors: DataFrame, is_query, p: PostingParams = PostingParams(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that `is_query` (a condition on vec_id) picks."""
    spark, k = vectors.sparkSession, p.k
    kind = kind_of(vectors, vector)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("embedding"))
    rows = rows.filter(usable("embedding") & F.col("vec_id").isNotNull()).withColumn("embedding", plain_zero("embedding", kind))
    rows = written(rows.groupBy("vec_id", "embedding").agg(F.lit(1).alias("one")).drop("one"), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("embedding") == dims["d"])
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)  # limited in each task before the shuffle
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter(is_query)
    classes = classes.join(asked.groupBy("embedding").agg(F.lit(True).alias("asked")), "embedding", "left")
    classes = written(classes.select(F.col("ids")[0].alias("rep"), "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")), "classes")
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = classes.agg(F.max(square).alias("most"), F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("q")).first()
    if not stats["q"]:
        return spark.createDataFrame([], schema)
    sample = np.array(sampled(classes.select("rep", "embedding"), "rep", p.sample).orderBy("rep").toPandas()["embedding"].tolist(), np.float64)
    centroids, most = fit(sample, stats["most"], stats["n"], p)
    shared = spark.sparkContext.broadcast((centroids, most))  # at most sample / 8 centroids

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, most = shared.value
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                part = pdf.iloc[s : s + 1024]
                found = assign(graph, _augment(stack(part["embedding"]), most), p)
                row, slot = np.nonzero(found >= 0)
                yield pd.DataFrame({"list": found[row, slot].astype(np.int32), "rep": part["rep"].to_numpy()[row], "embedding": part["embedding"].to_numpy()[row]})

    lists = written(classes.select("rep", "embedding").mapInPandas(index, f"list int, rep long, embedding array<{kind}>"), "lists")
    # Lists are packed into shards: at most sample / 8 sizes come to the driver.
    place, used, shard, sizes = {}, 0, 0, np.zeros(len(centroids.at), np.int64)
    for r in lists.groupBy("list").count().orderBy("list").collect():
        sizes[r["list"]] = r["count"]
        parts = -(-r["count"] // p.shard)
        for part in range(parts):
            size = -(-r["count"] // parts)
            if used and used + size > p.shard:
                shard, used = shard + 1, 0
            used += size
            place.setdefault(r["list"], []).append(shard)
    where = spark.sparkContext.broadcast({c: np.array(s) for c, s in place.items()})
    ratio = widest(centroids, sizes, *_measured(asked, classes, lists, p), p)
    within = spark.sparkContext.broadcast((sizes, ratio))

    def to_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(shard=np.array([where.value[c][r * 2654435761 % (1 << 32) % len(where.value[c])] for c, r in zip(pdf["list"], pdf["rep"], strict=True)], np.int32))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (graph, _), (sizes, ratio) = shared.value, within.value
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                part = pdf.iloc[s : s + 1024]
                out = []
                for rep, vec, take in zip(part["rep"], part["embedding"], probed(graph, stack(part["embedding"]), ratio, sizes, p), strict=True):
                    by: dict[int, list[int]] = {}
                    for c in np.flatnonzero(take):
                        for x in where.value.get(int(c), ()):
                            by.setdefault(int(x), []).append(int(c))
                    out += [(x, rep, vec, sorted(set(c))) for x, c in by.items()]
                yield pd.DataFrame(out, columns=["shard", "rep", "embedding", "lists"])

    def search(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(q) or not len(v):
            return none
        qx, vx, names, of, reps = stack(q["embedding"]), stack(v["embedding"]), q["rep"].to_numpy(), v["list"].to_numpy(), v["rep"].to_numpy()
        found: dict[int, list] = {}
        flat = np.concatenate([np.asarray(x) for x in q["lists"]])
        row = np.repeat(np.arange(len(q)), [len(x) for x in q["lists"]])
        for c in np.unique(of):
            own, mine = np.flatnonzero(of == c), row[flat == c]
            for s in range(0, len(mine), 512):
                for i, got in zip(mine[s : s + 512], _best(qx[mine[s : s + 512]], vx[own], reps[own], k + 1), strict=True):
                    found.setdefault(int(i), []).append(got)
        out = []
        for i, parts in found.items():
            r, x = (np.concatenate(z) for z in zip(*parts, strict=True))
            r, at = np.unique(r, return_index=True)
            order = np.lexsort((r, -x[at]))[: k + 1]
            out.append(pd.DataFrame({"query": names[i], "rep": r[order], "score": x[at][order]}))
        return pd.concat(out) if out else none

    q = written(classes.filter("asked").select("rep", "embedding").mapInPandas(ask, f"shard int, rep long, embedding array<{kind}>, lists array<int>"), "asked")
    blocks = q.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / p.query_block).cast("int").alias("blocks"))
    q = q.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    v = lists.mapInPandas(to_shards, f"list int, rep long, embedding array<{kind}>, shard int").join(blocks, "shard")
    v = v.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    hits = q.groupBy("shard", "block").cogroup(v.groupBy("shard", "block")).applyInPandas(search, "query long, rep long, score double")
    hits = hits.dropDuplicates(["query", "rep"])
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= k + 1)
    hits = hits.join(classes.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    best = hits.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    best = best.join(classes.select(F.col("rep").alias("query"), "embedding"), "query").select("embedding", "found")
    out = asked.join(best, "embedding").select(F.col("vec_id").alias("query_id"), F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")).alias("found"))
    out = out.select("query_id", F.posexplode(F.slice("found", 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
