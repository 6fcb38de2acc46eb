"""Hard-negative mining: bit-sliced integer products.

An anchor's positives are the rows of its label with the highest scores; a hard negative of anchor and positive is a row of
another label whose score lies in a window below the positive's. Scores are inner products of integers.

Candidates are sliced into bit-planes, two's complement, and an anchor's product with them is summed from the most significant
planes on. The upper planes are one slice, one matrix product for many anchors and rows. After it what a candidate still can add lies
between 2^b - 1 times the sums of the anchor's negative and of its positive components, b planes being left, so that every pair has an
interval for its score. A pair is dropped once its interval cannot qualify: once it lies outside of every window, or not above as
many candidates as a window takes, that were found before. The lower planes are added for the pairs left only, one by one (or once more
as a matrix product where most are left); scores are exact then. b is as large as leaves intervals narrow against the anchors' own lengths.

Rows are met in the order of their ids, so that a later row with the score of the last one taken is dropped too; few rows come first, then ever more,
as what they leave is the bound for all others.

Anchors, a stated part of the rows, meet all rows in blocks of bounded size: positives by label, negatives over all. A block pair
gives back as many rows for each anchor and window as are asked for, and the best of all blocks are taken, never all pairs. A label that a third
of all rows have is cut into blocks like any other. A row is sent once for every block of anchors, an anchor once for every block of rows, so that blocks
are large; the groups are dealt over a stated number of tasks, as their work is not in their bytes.

Cases: rows with a null id or label, a null vector, or a null or non-finite component take no part, and neither do those with
a component beyond 2^26, whose scores may pass a long; zero vectors do take part; vectors of different lengths don't meet;
rows that agree in id, label and integers count once, and an anchor never meets a row of its own id; ties go to the smaller id; an
anchor without positives, or whose positives score below 0, has no rows; columns of other names are left behind; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import dropped, written

LARGEST = 1 << 26
NEVER = 1 << 62
#: Rows that are multiplied at once: at first, and at most.
FIRST, WIDEST = 256, 4096
#: Rows of the table of blocks up to which it is copied to all executors, and tasks that groups are dealt over.
FEW_KEYS, MOST_TASKS = 100_000, 2000


@dataclass(frozen=True)
class MiningParams:
    positives: int = 5
    negatives: int = 3
    #: A negative's score is between these shares of the positive's, in hundredths.
    least: int = 50
    most: int = 95
    #: Rows of a group: anchors, and what they are compared with, fewer where vectors are long; anchors that are multiplied at once.
    anchor_block: int = 8192
    block: int = 65536
    components: int = 1 << 22
    rows_at_once: int = 256
    #: Pairs are carried on one by one if at most this share of them is left.
    few: float = 0.1


def _slice_end(anchors: np.ndarray, bits: int, slack: float) -> int:
    """How many planes the first slice leaves: as many as keep the mean width of an interval within `slack` of an anchor's product with itself."""
    width, own, b = np.abs(anchors).sum(1).mean(), (anchors.astype(np.float64) ** 2).sum(1).mean(), 0
    while b + 1 < bits and ((2 << b) - 1) * width <= slack * own:
        b += 1
    return b


def _merged(score: np.ndarray, row: np.ndarray, w: int, a: np.ndarray, r: np.ndarray, value: np.ndarray) -> None:
    """Takes pairs of anchors and rows into the best ones of window w, in place."""
    who, k = np.unique(a), score.shape[2]
    a, r, value = np.concatenate([a, np.repeat(who, k)]), np.concatenate([r, row[who, w].ravel()]), np.concatenate([value, score[who, w].ravel()])
    order = np.lexsort((r, -value, a))
    place = np.arange(len(order)) - np.searchsorted(a[order], a[order])
    order, place = order[place < k], place[place < k]
    score[a[order], w, place], row[a[order], w, place] = value[order], r[order]


def best(anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, open_, lo: np.ndarray, hi: np.ndarray, k: int, few: float = 0.1, at_once: int = 256, slack: float = 0.03):
    """(anchor, window, row, score) of the k best rows of each anchor and window [lo, hi], of the pairs in `open_`: a matrix, or a
    function of pairs (anchor, row)."""
    none = np.zeros(0, np.int64)
    if not len(anchors) or not len(rows):
        return none, none, none, none
    is_open = open_ if callable(open_) else lambda a, r: open_[a, r]
    order = np.argsort(ids, kind="stable")
    rows = rows[order]
    bits = int(max(np.abs(rows).max(initial=0), 1)).bit_length() + 1
    largest = int(np.abs(anchors).sum(1).max(initial=0)) << (bits - 1)
    kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64  # in which all sums are exact
    limit = min(largest + 1, NEVER)
    b = _slice_end(anchors, bits, slack)
    upper, lower = (rows >> b << b).astype(kind), rows & ((1 << b) - 1)
    found = []
    for s in range(0, len(anchors), at_once):
        part = slice(s, s + at_once)
        own, least, most = anchors[part], lo[part], hi[part]
        left, real = own.astype(kind), least <= most
        if not real.any():
            continue
        down, up = (f(own, 0).sum(1) * ((1 << b) - 1) for f in (np.minimum, np.maximum))
        score, row = np.full((*least.shape, k), -NEVER), np.full((*least.shape, k), -1)
        start, width = 0, FIRST
        while start < len(rows):
            here, start, width = slice(start, start + width), start + width, min(2 * width, WIDEST)
            total = left @ upper[here].T
            need = np.where(real, np.maximum(least, score[:, :, -1] + 1), NEVER)
            floor, ceiling = need.min(1) - up, np.where(real, most, -NEVER).max(1) - down
            seen = total >= np.clip(floor, -limit, limit).astype(kind)[:, None]
            seen &= total <= np.clip(ceiling, -limit, limit).astype(kind)[:, None]
            a, r = np.divmod(np.flatnonzero(seen), total.shape[1])
            value = total[a, r].astype(np.int64)
            live, many = is_open(s + a, order[here.start + r]), len(a) > few * seen.size
            live &= np.logical_or.reduce([(value + up[a] >= need[a, w]) & (value + down[a] <= most[a, w]) for w in range(lo.shape[1])])
            a, r, value = a[live], r[live], value[live]
            if b and many:
                value += (left @ lower[here].T.astype(kind))[a, r].astype(np.int64)
            elif b:
                for t in range(0, len(a), 1 << 16):
                    some = slice(t, t + (1 << 16))
                    value[some] += np.einsum("ij,ij->i", own[a[some]], lower[here.start + r[some]])
            for w in range(lo.shape[1]):
                inside = np.flatnonzero((value >= need[a, w]) & (value <= most[a, w]))
                if len(inside):
                    _merged(score, row, w, a[inside], here.start + r[inside], value[inside])
        a, w, place = np.nonzero(row >= 0)
        found.append((s + a, w, order[row[a, w, place]], score[a, w, place]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none, none)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _meet(rows: DataFrame, anchors: DataFrame, key: list[str], same_label: bool, k: int, p: MiningParams) -> DataFrame:
    """(row_, w, vec_id, score): the k best of each block pair, for each anchor `row_` and window w."""
    size = lambda most: F.least(F.lit(most), F.greatest(F.lit(64), F.floor(F.lit(p.components) / F.greatest("dim", F.lit(1)))))
    n = lambda df, most, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name)).withColumn(name, F.ceil(F.col(name) / size(most)).cast("int"))
    blocks = n(anchors, p.anchor_block, "na").join(n(rows, p.block, "nr"), key)
    groups, keys = blocks.agg(F.coalesce(F.sum(F.col("na").cast("long") * F.col("nr")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = F.broadcast(blocks) if keys <= FEW_KEYS else blocks
    part = lambda c: F.pmod(F.xxhash64("row_"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    names = [*dict.fromkeys([*key, "i", "j", "row_", "vec_id", "label", "x"])]
    no_window = F.lit(None).cast("array<bigint>")
    left = anchors.join(blocks, key).withColumn("i", part("na")).withColumn("j", spread("nr")).select(*names, "lo", "hi", F.lit(True).alias("anchor"))
    right = rows.join(blocks, key).withColumn("j", part("nr")).withColumn("i", spread("na")).select(*names, no_window.alias("lo"), no_window.alias("hi"), F.lit(False).alias("anchor"))

    def compare(table: pa.Table) -> pa.Table:
        is_anchor = table["anchor"].to_numpy()
        own, other = table.filter(pa.array(is_anchor)), table.filter(pa.array(~is_anchor))
        found = []
        if len(own) and len(other):
            x, y, lo, hi = _matrix(own["x"], np.int64), _matrix(other["x"], np.int32), _matrix(own["lo"], np.int64), _matrix(own["hi"], np.int64)
            a_id, r_id, a_label, r_label, a_row = (t[c].to_numpy() for t, c in ((own, "vec_id"), (other, "vec_id"), (own, "label"), (other, "label"), (own, "row_")))
            is_open = lambda a, r: (a_id[a] != r_id[r]) & (same_label | (a_label[a] != r_label[r]))
            a, w, r, score = best(x, y, r_id, is_open, lo, hi, k, p.few, p.rows_at_once)
            found.append((a_row[a], w, r_id[r], score))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        return pa.table({name: pa.array(c.astype(np.int64)) for name, c in zip(("row_", "w", "vec_id", "score"), columns)})

    # A stated number of tasks: Spark would put groups of few bytes into one, however long they take.
    dealt = left.union(right).repartition(max(1, min(3 * groups, MOST_TASKS)), *key, "i", "j")
    return dealt.groupBy(*key, "i", "j").applyInArrow(compare, "row_ long, w long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and window, with their rank."""
    order = Window.partitionBy("row_", "w").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def integers(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label and the floors of the components, of rows that take part, each once."""
    bad = F.exists("v_", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v_"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v_").isNotNull() & ~bad)
    return rows.select("vec_id", "label", F.transform("v_", lambda x: F.floor(x).cast("int")).alias("x")).distinct()


def mine(vectors: DataFrame, anchors: Column, p: MiningParams = MiningParams(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which `anchors`, a condition on the id, holds. Components are floored: scale them before.
    """
    rows = integers(vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("l")), "vec_id", "v", "l")
    rows = written(rows.withColumns({"row_": F.monotonically_increasing_id(), "dim": F.size("x")}), "vectors")
    asked = rows.filter(F.coalesce(anchors, F.lit(False)))
    whole = asked.withColumns({"lo": F.array(F.lit(-NEVER)), "hi": F.array(F.lit(NEVER))})
    near = _first(_meet(rows, whole, ["dim", "label"], True, p.positives, p), p.positives)
    near = written(near.select("row_", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    none = [F.lit(NEVER), F.lit(-NEVER)]
    windows = near.groupBy("row_").agg(F.map_from_entries(F.collect_list(F.struct("w", "positive_score"))).alias("p"))
    bound = lambda j, share, up: F.coalesce(F.transform(F.sequence(F.lit(0), F.lit(p.positives - 1)), lambda w: F.coalesce(_hundredths(F.col("p")[w], share, up), none[j])), F.array())
    windows = windows.select("row_", bound(0, p.least, True).alias("lo"), bound(1, p.most, False).alias("hi"))
    found = _first(_meet(rows, asked.join(windows, "row_"), ["dim"], False, p.negatives, p), p.negatives)
    named = near.join(asked.select("row_", F.col("vec_id").alias("anchor_id")), "row_")
    out = written(found.select("row_", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["row_", "w"]), "negatives")
    dropped(rows, near)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _hundredths(score: Column, share: int, up: bool) -> Column:
    """score * share / 100, rounded up or down, in integers."""
    n = score * share + (99 if up else 0)
    return F.call_function("div", n - F.pmod(n, F.lit(100)), F.lit(100))


#: The same in DuckDB SQL, all pairs of anchors and rows.
ORACLE = """WITH r AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.x, b.x)::BIGINT AS s
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
pos AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s DESC, id))::INT AS rank, id AS negative_id, positive_score, s AS negative_score
FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s DESC, id) <= 3
"""
