"""Toxicity: a linear classifier over character n-grams whose binary features are scaled by naive Bayes log-count ratios.

Texts are lower-cased and cut into n-grams of code points that are hashed to a table of fixed size. A document has a
feature or not, however often. The log-count ratio of a bucket scales its feature, and a logistic regression is fitted on
the scaled features; weight and ratio are folded into one table, so that scoring is one sum over a document's buckets.

Cases: null and empty texts, and texts shorter than the shortest n-gram, score as a document without features; very long
texts are read piece by piece into one set of features; without labelled rows of both classes every score is the share of
label 1 (0 if there are none); repeated ids are scored row by row; a table without rows gives none; other columns than the
id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .supervised import fit_in_task, label_sample, pack, ragged, sigmoid, with_sample


@dataclass(frozen=True)
class ToxicityParams:
    orders: tuple[int, ...] = (4, 6)
    bits: int = 18
    #: Bound of the labelled rows that the classifier is fitted on.
    max_fit_rows: int = 6000
    smoothing: float = 1.0
    min_docs: int = 3
    #: Buckets with a smaller log-count ratio say nothing.
    min_ratio: float = 0.5
    ridge: float = 1e-3
    rounds: int = 70
    seed: int = 7


def _buckets(data: np.ndarray, offs: np.ndarray, p: ToxicityParams) -> Iterator[np.ndarray]:
    """The distinct buckets of each row of a block."""
    if tb.is_long(data, offs):
        seen = np.zeros(1 << p.bits, bool)
        for chars, _ in tb.pieces(data, max(p.orders) - 1):
            chars = tb.lowered(chars)
            for n in p.orders:
                seen[tb.gram_buckets(chars, n, p.bits, p.seed)] = True
        yield np.flatnonzero(seen).astype(np.uint32)
        return
    chars, starts = tb.code_points(data, offs)
    chars = tb.lowered(chars)
    grams = [(n, tb.gram_buckets(chars, n, p.bits, p.seed)) for n in p.orders]
    seen = np.zeros(1 << p.bits, bool)
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        parts = [g[s : e - n + 1] for n, g in grams if e - s >= n]
        if not parts:
            yield np.zeros(0, np.uint32)
        elif e - s < 20_000:
            every = np.concatenate(parts)
            every.sort()
            yield every[np.concatenate([[True], every[1:] != every[:-1]])]
        else:
            for x in parts:
                seen[x] = True
            found = np.flatnonzero(seen).astype(np.uint32)
            seen[found] = False
            yield found


def features(rows: DataFrame, p: ToxicityParams) -> DataFrame:
    """(label, buckets as bytes) of rows with columns text and _label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tb.text_blocks(b.column("text")):
                got = [x.astype(np.uint32).tobytes() for x in _buckets(data, offs, p)]
                yield pa.RecordBatch.from_arrays([b.column("_label").slice(lo, hi - lo), pa.array(got, pa.binary())], ["label", "buckets"])

    return rows.select("text", "_label").mapInArrow(run, "label int, buckets binary")


def fit(table: pa.Table | None, p: ToxicityParams) -> bytes:
    size = 1 << p.bits
    empty = pack(weight=np.zeros(size, np.float32), bias=np.float64(-35.0))
    if table is None or not table.num_rows:
        return empty
    y = np.array(table.column("label").to_pylist(), np.float64)
    if y.min() == y.max():
        return pack(weight=np.zeros(size, np.float32), bias=np.float64(35.0 if y[0] else -35.0))
    flat, lens = ragged(table.column("buckets"), np.uint32)
    del table
    pos = np.bincount(flat[np.repeat(y > 0, lens)], minlength=size)
    both = np.bincount(flat, minlength=size)
    n1, n0 = y.sum(), len(y) - y.sum()
    ratio = np.log((pos + p.smoothing) / (n1 + 2 * p.smoothing)) - np.log((both - pos + p.smoothing) / (n0 + 2 * p.smoothing))
    keep = (both >= p.min_docs) & (np.abs(ratio) >= p.min_ratio)
    # Blocks of rows, so that what a step needs beside the features stays small.
    names, place, blocks = np.flatnonzero(keep), np.cumsum(keep, dtype=np.int32) - 1, []
    offs = np.concatenate([[0], np.cumsum(lens)])
    for s in range(0, len(y), 256):
        part = flat[offs[s] : offs[min(s + 256, len(y))]]
        kept = keep[part]
        row = np.repeat(np.arange(min(256, len(y) - s), dtype=np.uint8), lens[s : s + 256])[kept]
        blocks.append((place[part[kept]], row, y[s : s + 256]))
    del flat
    r = ratio[names]
    w, b = np.zeros(len(names)), float(np.log(n1 / n0))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, p.rounds + 1):  # full gradients with per-weight steps
        gw, gb, scaled = np.zeros(len(names)), 0.0, w * r
        for index, row, truth in blocks:
            g = sigmoid(np.bincount(row, scaled[index], len(truth)) + b) - truth
            gw += np.bincount(index, g[row], len(names))
            gb += g.sum()
        gw, gb = gw * r / len(y) + p.ridge * w, gb / len(y)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.03 / (1 + k / 40)
        w -= step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        b -= step * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    weight = np.zeros(size, np.float32)
    weight[names] = w * r
    return pack(weight=weight, bias=np.float64(b))


def train(docs: DataFrame, labels: DataFrame, train_rows, p: ToxicityParams = ToxicityParams(), key: str = "doc_id", label: str = "toxic") -> dict:
    """The model: a table of 2^bits weights and a bias. `train_rows` is a condition on the labels' rows."""
    sample = label_sample(labels, key, label, p.max_fit_rows, train_rows)
    rows = with_sample(docs, sample, key, [F.col("text")])
    return fit_in_task(features(rows, p), lambda t: fit(t, p))


def score(docs: DataFrame, model: dict, keep: list[str], p: ToxicityParams = ToxicityParams(), out: str = "score") -> DataFrame:
    """Columns `keep` of every row and, as `out`, its score between 0 and 1, from the whole text."""
    text = "text" if "text" in keep else "_text"
    shared = docs.sparkSession.sparkContext.broadcast((model["weight"], float(model["bias"])))  # 2^bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = shared.value
        for b in batches:
            got = [float(weight[x].sum(dtype=np.float64)) for _, _, data, offs in tb.text_blocks(b.column(text)) for x in _buckets(data, offs, p)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sigmoid(np.array(got, np.float64) + bias))], [*keep, out])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in keep), f"`{out}` double"]))
