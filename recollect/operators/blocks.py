"""A question table against all rows, in blocks: every task holds a part of each side and gives back the best of its own.

A few questions, of a checked number and size, go to where the rows are, which then aren't shuffled. More of them are dealt to blocks,
and each task gets one block of questions and one of rows. What tasks compare is a matrix product; what is close to a
limit is computed again in a fixed order, so that ties are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Questions, and numbers in them, up to which they are copied to all executors.
FEW, NUMBERS = 4096, 4 << 20
#: Rows and questions of a task otherwise.
ROWS, ASKED = 8192, 1024


def pairwise(rows: DataFrame, asked: DataFrame, compare: Callable[[pa.Table, pa.Table], pa.Table], schema: str, width: Column, few: int | None = None) -> DataFrame:
    """What `compare` gives for blocks of `asked` and `rows`. `width`: how many numbers a question holds."""
    few = FEW if few is None else few
    n, numbers = asked.limit(few + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    if n <= few and numbers <= NUMBERS:
        shared = rows.sparkSession.sparkContext.broadcast(asked.toArrow())  # its size was counted

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from compare(shared.value, pa.Table.from_batches([b])).to_batches()

        return rows.mapInArrow(run, schema)
    nr, na = (max(1, -(-df.count() // size)) for df, size in ((rows, ROWS), (asked, ASKED)))
    dealt = lambda df, mine, n_mine, other, n_other: df.withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.lit(n_mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    left, right = dealt(asked, "i_", na, "j_", nr), dealt(rows, "j_", nr, "i_", na)
    plain = lambda t: t.drop_columns(["i_", "j_"])
    return left.groupBy("i_", "j_").cogroup(right.groupBy("i_", "j_")).applyInArrow(lambda a, r: compare(plain(a), plain(r)), schema)


def first(found: DataFrame, query: str, item: str, value: str, k: int) -> DataFrame:
    """The first k of each query with their rank; ties to the smaller item. Limited in each task before the shuffle."""
    order = Window.partitionBy(query).orderBy(value, item)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are as long as most of the column's, and their numbers."""
    column = column.combine_chunks()
    lens = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    return lens, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and a matrix for each length that vectors have."""
    lens, flat = _matrix(column)
    ends = np.cumsum(np.maximum(lens, 0))
    out = {}
    for d in np.unique(lens[lens > 0]):
        at = np.flatnonzero(lens == d)
        out[int(d)] = at, flat[(ends[at] - d)[:, None] + np.arange(d)]
    return out


def _order(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values, equal for equal ones."""
    return np.unique(column.to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().to_numpy(zero_copy_only=False), return_inverse=True)[1]


def best(row: np.ndarray, key: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values of each row, ties to the smaller key."""
    order = np.lexsort((key, value, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[place < k]


def nearest(rows: DataFrame, asked: DataFrame, key: str, query: str, k: int, vector: str, group: str | None = None, others: bool = False, digits: int | None = None, penalty: Column | None = None, few: int | None = None) -> DataFrame:
    """(query, key or group, distance): the k least euclidean distances that each task found; see `recall.nearest`.

    Distances come from one product of two matrices; those that may be among the k best are then summed in the order of the
    components. Vectors of different lengths have no distance, nor have null ones.
    """
    item = group or key
    extra = F.lit(0.0) if penalty is None else penalty.cast("double")
    given = rows.select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("x"), extra.alias("extra")).filter("x is not null")
    wanted = asked.select(F.col(query).alias("query"), F.col(vector).cast("array<double>").alias("q")).filter("q is not null")
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    scale = None if digits is None else 10.0**digits

    def compare(qs: pa.Table, xs: pa.Table) -> pa.Table:
        names, values = ["query", "item", "distance"], []
        sides = _by_length(qs["q"]), _by_length(xs["x"])
        for d in sides[0].keys() & sides[1].keys():
            (qi, q), (xi, x) = sides[0][d], sides[1][d]
            far = (x * x).sum(1)
            keys, items, more = _order(xs["key"].take(xi)), _order(xs["item"].take(xi)), xs["extra"].to_numpy()[xi]
            own = np.zeros((len(qi), len(xi)), bool)
            if others:
                own = qs["query"].take(qi).to_numpy(zero_copy_only=False)[:, None] == xs["key"].take(xi).to_numpy(zero_copy_only=False)[None, :]
            for s in range(0, len(qi), 256):
                part, near = q[s : s + 256], (q[s : s + 256] ** 2).sum(1)
                square = near[:, None] + far[None, :] - 2 * part @ x.T
                slack = 1e-14 * d * (near[:, None] + far[None, :]) + 1e-300
                low, high = np.sqrt(np.maximum(square - slack, 0)) + more, np.sqrt(np.maximum(square, 0) + slack) + more
                low[own[s : s + 256]] = high[own[s : s + 256]] = np.inf
                if group:
                    least = np.full((len(part), items.max() + 1), np.inf)
                    np.minimum.at(least.T, items, high.T)
                else:
                    least = high
                limit = np.partition(least, k - 1, axis=1)[:, k - 1] if k <= least.shape[1] else np.full(len(part), np.inf)
                a, r = np.nonzero((low <= limit[:, None] + (0 if scale is None else 1 / scale)) & np.isfinite(low))
                exact = np.concatenate([np.sqrt(np.cumsum((x[r[t : t + 65536]] - part[a[t : t + 65536]]) ** 2, axis=1)[:, -1]) for t in range(0, len(a), 65536)] or [np.zeros(0)]) + more[r]
                if scale is not None:
                    exact = np.floor(exact * scale + 0.5) / scale
                if group:
                    order = np.lexsort((exact, items[r], a))
                    once = np.ones(len(order), bool)
                    once[1:] = (a[order][1:] != a[order][:-1]) | (items[r[order]][1:] != items[r[order]][:-1])
                    order = order[once]
                    a, r, exact = a[order], r[order], exact[order]
                top = best(a, items[r] if group else keys[r], exact, k)
                values.append((qs["query"].take(qi[s + a[top]]), xs["item"].take(xi[r[top]]), pa.chunked_array([exact[top]])))
        if not values:
            return pa.table([qs["query"].slice(0, 0), xs["item"].slice(0, 0), pa.array([], pa.float64())], names)
        return pa.table([pa.chunked_array([c for v in values for c in v[i].chunks], values[0][i].type) for i in range(3)], names)

    found = pairwise(given, wanted, compare, f"query {kind(wanted, 'query')}, item {kind(given, 'item')}, distance double", F.size("q"), few)
    if group:  # a group's least distance may have come from several tasks
        found = found.groupBy("query", "item").agg(F.min("distance").alias("distance"))
    return first(found, "query", "item", "distance", k).select(F.col("query").alias(query), F.col("item").alias(item), "distance", "rank")


def scored(docs: DataFrame, asked: DataFrame, k: int | None, digits: int | None, k1: float, b: float, few: int | None = None) -> DataFrame:
    """(query, doc, score) of documents (doc, phrases, f, length, avg_len) that share a phrase with questions (query, phrases, weights).

    A block's score is the product of its documents' saturated counts and the questions' weights. With `k` a task gives the k best of each question,
    ties, after rounding to `digits`, to the smaller document.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()

    def compare(qs: pa.Table, ds: pa.Table) -> pa.Table:
        flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lens = lambda t: t["phrases"].combine_chunks().value_lengths().to_numpy()
        known, at = np.unique(flat(qs, "phrases"), return_inverse=True)
        row = np.repeat(np.arange(len(qs)), lens(qs))
        doc, phrase = np.repeat(np.arange(len(ds)), lens(ds)), flat(ds, "phrases")
        place = np.searchsorted(known, phrase)
        held = np.flatnonzero((place < len(known)) & (known[np.minimum(place, max(len(known) - 1, 0))] == phrase)) if len(known) else np.zeros(0, np.int64)
        f, share = flat(ds, "f")[held], (ds["length"].to_numpy() / ds["avg_len"].to_numpy())[doc[held]]
        doc, place, value = doc[held], place[held], f * (k1 + 1) / (f + k1 * (1 - b + b * share))
        order, step, out = _order(ds["doc"]), max(1, (4 << 20) // max(len(known), 1)), []
        for s in range(0, len(qs), 256):
            mine = (row >= s) & (row < s + 256)
            weight = np.zeros((len(known), min(256, len(qs) - s)))
            np.add.at(weight, (at[mine], row[mine] - s), flat(qs, "weights")[mine])
            found = []
            for t in range(0, len(ds), step):
                lo, hi = np.searchsorted(doc, [t, t + step])
                x = np.zeros((min(step, len(ds) - t), len(known)))
                np.add.at(x, (doc[lo:hi] - t, place[lo:hi]), value[lo:hi])
                score = x @ weight
                d, q = np.nonzero(score > 0)
                found.append((q + s, d + t, score[d, q]))
            q, d, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if k is not None:
                top = best(q, order[d], -(score if digits is None else np.floor(score * 10.0**digits + 0.5)), k)
                q, d, score = q[top], d[top], score[top]
            out.append((q, d, score))
        q, d, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([qs["query"].take(pa.array(q)), ds["doc"].take(pa.array(d)), pa.array(score)], ["query", "doc", "score"])

    return pairwise(docs, asked, compare, f"query {kind(asked, 'query')}, doc {kind(docs, 'doc')}, score double", F.size("phrases"), few)
