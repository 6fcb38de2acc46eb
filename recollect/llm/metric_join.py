"""Embedding near-duplicates: an exact metric range join.

Vectors are points on the unit sphere, where cosine >= t is distance <= r = sqrt(2 - 2 t). Pivots partition them: a
vector's home is its nearest pivot's cell. A vector y within r of some x at home in cell p can't lie farther than r behind
the plane between p and its own pivot q, as |x - y| <= r: (d(y,p)^2 - d(y,q)^2) / (2 d(p,q)) <= r. Where that holds, y is
replicated to cell p, if p comes before its own: a link across cells is found in the first of the two, and counts for both
ends there. Cells join independently; in a cell, blocks are sorted by distance to the pivot, and pairs of blocks whose
ranges lie more than r apart are skipped (triangle inequality).

Equal vectors are one beforehand. A cell with many vectors at home is cut into rings by their distance to the pivot, and a
member only goes to the rings that lie within r of its own distance (triangle inequality again). Rings and members are
compared in blocks of bounded size, tasks return counts and stars of links, never all pairs. Blocks are multiplied as
matrices; a cosine within 1e-9 of the threshold is computed again in a fixed order, so that both ends agree.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with
nothing; vectors of different lengths don't link; components keep the type that they have; rows with a repeated id are different vectors of one node; a null id
links with nothing, and has a null component and kept = true; columns of other names are left behind. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import dropped, written
from .vectors import exact_cosine, kind_of, plain_zero, sampled, scaled, stack, usable

SLACK = 1e-9


@dataclass(frozen=True)
class MetricJoinParams:
    cosine: float = 0.98
    #: Vectors of the largest label for each pivot, and the least and most pivots; they only steer how the work is cut.
    per_pivot: int = 1000
    min_pivots: int = 8
    max_pivots: int = 512
    #: Rings of a cell with more than one block at home.
    rings: int = 64
    #: Rows of a task: of home vectors, and of members that they are compared with.
    home_block: int = 2048
    member_block: int = 4096


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _pivots(classes: DataFrame, p: MetricJoinParams) -> dict[int, np.ndarray]:
    """Unit vectors by dimension, far from each other as far as a sample has such; a bounded number of them."""
    sizes = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    n = int(min(p.max_pivots, max(p.min_pivots, sizes // p.per_pivot)))
    found: dict[int, list] = {}
    for row in sampled(classes.select("rep", "dim", "embedding"), "rep", 8 * n).orderBy("rep").limit(16 * n).collect():
        found.setdefault(row["dim"], []).append(row["embedding"])
    return {d: _apart(np.unique(_unit(np.array(x, np.float64)), axis=0), n) for d, x in found.items()}


def _apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x: each next one is the farthest from those before."""
    pick, far = [0], 2 - 2 * x @ x[0]
    while len(pick) < min(n, len(x)):
        pick.append(int(far.argmax()))
        far = np.minimum(far, 2 - 2 * x @ x[pick[-1]])
    return x[pick]


def _cells(classes: DataFrame, p: MetricJoinParams, kind: str) -> DataFrame:
    """A row for each class and cell that it belongs to, with its distance to the pivot."""
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes, p))  # max_pivots vectors
    r = np.sqrt(2 - 2 * p.cosine) + SLACK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                x, at = _unit(stack(part["embedding"])), pivots.value.get(dim)
                if at is None:  # no pivot has this length: one cell
                    home, dist, keep = np.zeros(len(x), int), np.ones((len(x), 1)), np.ones((len(x), 1), bool)
                else:
                    dist = np.sqrt(np.maximum(0, 2 - 2 * x @ at.T))
                    home = dist.argmin(1)
                    apart = np.sqrt(np.maximum(1e-12, 2 - 2 * at @ at.T))[home]
                    keep = (dist**2 - dist.min(1, keepdims=True) ** 2) / (2 * apart) <= r
                    keep &= np.arange(len(at)) < home[:, None]
                    keep[np.arange(len(x)), home] = True
                row, cell = np.nonzero(keep)
                out = part.iloc[row].reset_index(drop=True)
                yield out.assign(cell=cell.astype(np.int32), home=home[row] == cell, dist=dist[row, cell])

    schema = f"rep long, label int, dim int, copies long, embedding array<{kind}>, cell int, home boolean, dist double"
    return classes.select("rep", "label", "dim", "copies", "embedding").mapInPandas(run, schema)


def _placed(cells: DataFrame, p: MetricJoinParams) -> DataFrame:
    """Rows of `cells` for each task (label, dim, cell, ring, i, j): home vectors and what they are compared with."""
    key = ["label", "dim", "cell"]
    r = np.sqrt(2 - 2 * p.cosine) + SLACK
    shares = [k / p.rings for k in range(1, p.rings)]
    sizes = cells.groupBy(*key).agg(F.count_if("home").alias("homes"), F.percentile_approx(F.when(F.col("home"), F.col("dist")), F.array(*map(F.lit, shares)), 1000).alias("edges")).filter("homes > 0")
    big = F.col("homes") > p.home_block
    sizes = sizes.select(*key, F.when(big, F.array_distinct("edges")).otherwise(F.array().cast("array<double>")).alias("edges"))
    rows = cells.join(sizes, key)
    ring = lambda d: F.size(F.filter("edges", lambda e: e < d)).cast("int")
    homes = rows.filter("home").withColumn("ring", ring(F.col("dist")))
    members = rows.withColumn("ring", F.explode(F.sequence(ring(F.col("dist") - r), ring(F.col("dist") + r))))
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    hashed = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    nm = members.groupBy(*key, "ring").agg(F.ceil(F.count(F.lit(1)) / p.member_block).alias("nm"))
    blocks = homes.groupBy(*key, "ring").agg(F.ceil(F.count(F.lit(1)) / p.home_block).alias("nh")).join(nm, [*key, "ring"])
    names = [*key, "ring", "i", "j", "rep", "copies", "embedding", "dist", "home"]
    left = homes.join(blocks, [*key, "ring"]).withColumn("i", hashed("nh")).withColumn("j", spread("nm")).select(*names, F.lit(True).alias("as_home"))
    right = members.join(blocks, [*key, "ring"]).withColumn("j", hashed("nm")).withColumn("i", spread("nh")).select(*names, F.lit(False).alias("as_home"))
    return left.union(right)


def _compare(pdf: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Rows (a, b, n): `b` null gives n links of a; else a link of a star."""
    own = pdf[pdf["as_home"]].sort_values(["dist", "rep"])
    other = pdf[~pdf["as_home"]].sort_values(["dist", "rep"])
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
    if not len(own) or not len(other):
        return none
    sx, sy = scaled(stack(own["embedding"])), scaled(stack(other["embedding"]))
    x, y = (s / np.sqrt((s * s).sum(1, keepdims=True)) for s in (sx, sy))
    dx, dy, weight = own["dist"].to_numpy(), other["dist"].to_numpy(), other["copies"].to_numpy()
    ix, iy, r = own["rep"].to_numpy(), other["rep"].to_numpy(), np.sqrt(2 - 2 * cosine) + SLACK
    names, col = np.unique(np.concatenate([ix, iy]), return_inverse=True)
    cx, cy = col[: len(ix)], col[len(ix) :]
    foreign, mine = ~other["home"].to_numpy(), own["copies"].to_numpy()
    count, star = np.zeros(len(names), np.int64), np.arange(len(names))
    for s in range(0, len(ix), 256):
        lo, hi = np.searchsorted(dy, [dx[s] - r, dx[min(s + 255, len(ix) - 1)] + r])
        c = x[s : s + 256] @ y[lo:hi].T
        near = c >= cosine
        a, b = np.nonzero(np.abs(c - cosine) < 1e-9)
        near[a, b] = exact_cosine(sx[s + a], sy[lo + b]) >= cosine
        near &= ix[s : s + 256, None] != iy[None, lo:hi]
        count[cx[s : s + 256]] += near @ weight[lo:hi]
        far = np.flatnonzero(foreign[lo:hi])
        count[cy[lo + far]] += near[:, far].T @ mine[s : s + 256]
        a, b = np.nonzero(near)
        star = _merge(star, cx[s + a], cy[lo + b])
    moved = np.flatnonzero(star != np.arange(len(names)))
    some = np.flatnonzero(count)
    return pd.DataFrame({
        "a": np.concatenate([names[some], names[star[moved]]]),
        "b": pd.array(np.concatenate([np.zeros(len(some), np.int64), names[moved]]), "Int64"),
        "n": np.concatenate([count[some], np.zeros(len(moved), np.int64)]),
    }) if len(some) + len(moved) else none


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (least members) after links a-b."""
    while len(a):
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], least)
        np.minimum.at(now, label[b], least)
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def metric_links(vectors: DataFrame, p: MetricJoinParams = MetricJoinParams(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    kind = kind_of(vectors, vector)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("embedding"))
    ok = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.filter(ok).withColumn("embedding", plain_zero("embedding", kind))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.withColumn("dim", F.size("embedding")), "classes")
    cells = written(_cells(classes, p, kind), "cells")
    compare = lambda pdf: _compare(pdf, p.cosine)
    found = written(_placed(cells, p).groupBy("label", "dim", "cell", "ring", "i", "j").applyInPandas(compare, "a long, b long, n long"), "found")
    dropped(cells)
    counts = found.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    comp = components(found.filter("n = 0"), "a", "b").withColumnRenamed("node", "rep")
    named = classes.join(counts, "rep", "left").join(comp, "rep", "left")
    named = named.select("label", "embedding", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n", "c")
    alone = rows.filter(~F.coalesce(ok, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c"))
    return linked.union(alone).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(True)).alias("kept"))
