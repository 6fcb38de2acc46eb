"""Quality: a factorisation machine over hashed words, statistics of the text's structure, and metadata.

A text gives a sparse vector: its words' hashed buckets with weights sqrt(count), scaled to length 1, and binned
structure statistics (shares of letters, digits, symbols, capitals and spaces, word and line lengths, repeated lines and
words) and its length as metadata. Scores are linear terms plus low-rank pairwise interactions, computed in time linear
in the vector: 0.5 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Cases: null and empty texts have only structure features; very long texts are summed piece by piece; without labelled rows
of both classes every score is 1 or 0 as the labels are (0 without any); repeated ids are scored row by row; a table
without rows gives none; other columns than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .supervised import fit_in_task, label_sample, pack, sigmoid, with_sample

BINS = 12
STATS = ("letters", "digits", "symbols", "capitals", "spaces", "word_length", "symbol_words", "line_words", "line_repeats", "word_repeats", "words", "bytes", "doubled")
#: Upper edges of the bins, for shares and for lengths.
SHARES = np.array([0.001, 0.005, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.85])
LENGTHS = np.array([2, 4, 5, 6, 8, 12, 20, 50, 200, 1000, 5000.0])


@dataclass(frozen=True)
class QualityParams:
    bits: int = 16
    rank: int = 8
    #: Bound of the labelled rows that the machine is fitted on.
    max_fit_rows: int = 8000
    ridge: float = 1e-5
    rounds: int = 60
    seed: int = 5


def size_of(p: QualityParams) -> int:
    return (1 << p.bits) + len(STATS) * BINS


def _vectors(data: np.ndarray, offs: np.ndarray, p: QualityParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each row of a block."""
    for s, e in zip(offs[:-1], offs[1:], strict=True):
        yield _vector(data[s:e], p)


class _Sums:
    """What a text's structure comes to, piece by piece; a word or line that goes on is carried to the next piece."""

    def __init__(self, p: QualityParams):
        self.p = p
        self.counts: np.ndarray | None = None  # of a long text's words by bucket
        self.kinds: list[np.ndarray] = []
        #: letters, digits, symbols, capitals, spaces, doubled symbols, letters of words, words with symbols, words, lines, bytes
        self.n = np.zeros(11, np.int64)
        self.lines: list[np.ndarray] = []
        self.word, self.length, self.symbols = np.uint64(0), 0, 0  # of the word that goes on
        self.line, self.line_words, self.last = np.uint64(0), 0, 32

    def add(self, d: np.ndarray, end: bool) -> None:
        n = len(d)
        space = (d == 32) | (d >= 9) & (d <= 13)
        upper, lower = (d >= 65) & (d <= 90), (d >= 97) & (d <= 122)
        high, digit = d >= 128, (d >= 48) & (d <= 57)
        letter = upper | lower | high
        symbol = ~(space | letter | digit)
        low = np.where(upper, d + 32, d).astype(np.uint64)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        doubled = int((symbol[1:] & symbol[:-1] & (d[1:] == d[:-1])).sum()) + int(n > 0 and bool(symbol[0]) and d[0] == self.last)
        goes_on = n > 0 and not space[0] and self.length > 0
        if self.length and not goes_on and n:  # the carried word ended with its piece
            ended = np.array([self.word])
            self._words(ended, np.array([self.length]), np.array([self.symbols]))
            self.line, self.line_words = (ended * np.uint64(3) + np.uint64(1) + self.line)[0], self.line_words + 1
            self.word, self.length, self.symbols = np.uint64(0), 0, 0
        at = np.zeros(n, np.uint64)
        at[starts] = starts
        at = np.maximum.accumulate(at) if n else at
        place = np.arange(n, dtype=np.uint64) - at
        if goes_on:
            place[: ends[0]] += np.uint64(self.length)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((low + np.uint64(1)) * tb.mix64(place), out=sums[1:])
        sym = np.concatenate([[0], np.cumsum(symbol)])
        words, lens, syms = sums[ends] - sums[starts], ends - starts, sym[ends] - sym[starts]
        if goes_on:
            words[:1] += self.word
            lens[0] += self.length
            syms[0] += self.symbols
            self.word, self.length, self.symbols = np.uint64(0), 0, 0
        open_word = len(words) > 0 and not end and not space[-1]
        done = len(words) - open_word
        self._words(words[:done], lens[:done], syms[:done])
        # Lines are told by their words; the first one may go on, and the last one is carried.
        breaks = np.flatnonzero(d == 10)
        in_line = np.concatenate([[0], np.searchsorted(starts, breaks), [len(words)]])
        in_line = np.minimum(in_line, done)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words[:done] * np.uint64(3) + np.uint64(1))])
        lines, size = sums[in_line[1:]] - sums[in_line[:-1]], np.diff(in_line)
        lines[:1] += self.line
        size[0] += self.line_words
        self.line, self.line_words = lines[-1], size[-1]
        if not end:
            lines, size = lines[:-1], size[:-1]
        lines = lines[size > 0]
        self.lines.append(np.unique(lines))
        if len(self.lines) > 64:
            self.lines = [np.unique(np.concatenate(self.lines))]
        if open_word:
            self.word, self.length, self.symbols = words[-1], int(lens[-1]), int(syms[-1])
        self.last = int(d[-1]) if n and symbol[-1] else 32
        self.n += [letter.sum(), digit.sum(), symbol.sum(), upper.sum(), space.sum(), doubled, 0, 0, 0, len(lines), n]

    def _words(self, words: np.ndarray, lens: np.ndarray, syms: np.ndarray) -> None:
        self.kinds.append(tb.mix64(words) >> np.uint64(64 - self.p.bits))
        if len(self.kinds) > 64:
            if self.counts is None:
                self.counts = np.zeros(1 << self.p.bits, np.int64)
            for k in self.kinds:
                self.counts += np.bincount(k.astype(np.int64), minlength=len(self.counts))
            self.kinds = []
        self.n[6:9] += [lens.sum(), (syms >= 2).sum(), len(words)]

    def vector(self) -> tuple[np.ndarray, np.ndarray]:
        p = self.p
        kinds, counts = np.unique(np.concatenate(self.kinds or [np.zeros(0, np.uint64)]), return_counts=True)
        if self.counts is not None:
            np.add.at(self.counts, kinds.astype(np.int64), counts)
            kinds = np.flatnonzero(self.counts)
            counts = self.counts[kinds]
        values = np.sqrt(counts)
        values /= max(1e-9, np.sqrt((values**2).sum()))
        letter, digit, symbol, upper, space, doubled, length, odd, words, lines, size = (int(x) for x in self.n)
        one, w = max(1, size), max(1, words)
        distinct = len(np.unique(np.concatenate(self.lines or [np.zeros(0, np.uint64)])))
        stats = [
            letter / one, digit / one, symbol / one, upper / max(1, letter), space / one, length / w,
            odd / w, w / max(1, lines), 1 - distinct / max(1, lines), 1 - len(kinds) / w, words, size, doubled / one,
        ]
        got = np.array(stats, float)
        bins = np.where(_LENGTHS, np.searchsorted(LENGTHS, got), np.searchsorted(SHARES, got))
        at = (1 << p.bits) + np.arange(len(STATS)) * BINS + bins
        return np.concatenate([kinds.astype(np.int64), at]), np.concatenate([values, np.full(len(STATS), 0.5)])


_LENGTHS = np.array([x in ("word_length", "line_words", "words", "bytes") for x in STATS])


def _vector(d: np.ndarray, p: QualityParams, size: int = tb.LONG) -> tuple[np.ndarray, np.ndarray]:
    sums = _Sums(p)
    for s, e in tb.cut_points(d, size) if len(d) else [(0, 0)]:
        sums.add(d[s:e], e == len(d))
    return sums.vector()


def features(rows: DataFrame, p: QualityParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in tb.text_blocks(b.column("text")):
                index, value = zip(*((i.astype(np.uint32).tobytes(), x.astype(np.float32).tobytes()) for i, x in _vectors(data, offs, p)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("_label").slice(lo, hi - lo), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["label", "index", "value"])

    return rows.select("text", "_label").mapInArrow(run, "label int, index binary, value binary")


def machine(index: np.ndarray, value: np.ndarray, offs: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and each row's sums of v x, by the sum-of-squares identity."""
    vx = v[index] * value[:, None]
    sums = tb.row_sums(vx, offs)
    pairs = 0.5 * (sums**2 - tb.row_sums(vx**2, offs)).sum(1)
    return bias + tb.row_sums(w[index] * value, offs) + pairs, sums


def fit(table: pa.Table | None, p: QualityParams) -> bytes:
    size, random = size_of(p), np.random.default_rng(p.seed)
    constant = lambda b: pack(w=np.zeros(size, np.float32), v=np.zeros((size, p.rank), np.float32), bias=np.float64(b))
    if table is None or not table.num_rows:
        return constant(-35.0)
    y = np.array(table.column("label").to_pylist(), float)
    if y.min() == y.max():
        return constant(35.0 if y[0] else -35.0)
    index = [np.frombuffer(x, np.uint32) for x in table.column("index").to_pylist()]
    lens = np.array([len(x) for x in index])
    names, index = np.unique(np.concatenate(index), return_inverse=True)
    value = np.concatenate([np.frombuffer(x, np.float32) for x in table.column("value").to_pylist()])
    at = np.concatenate([[0], np.cumsum(lens)])
    w, v = np.zeros(len(names)), random.normal(0, 0.05, (len(names), p.rank))
    bias, gw2, gv2, gb2 = float(np.log(y.mean() / (1 - y.mean()))), np.full(len(names), 1e-6), np.full(v.shape, 1e-6), 1e-6
    order = np.arange(len(y))
    for k in range(p.rounds):
        random.shuffle(order)
        for rows in np.array_split(order, max(1, len(y) // 1000)):
            ln = lens[rows]
            offs = np.concatenate([[0], np.cumsum(ln)])
            pos = np.repeat(at[rows] - offs[:-1], ln) + np.arange(offs[-1])
            ix, x = index[pos], value[pos].astype(float)
            out, sums = machine(ix, x, offs, w, v, bias)
            g = (sigmoid(out) - y[rows]) / len(rows)
            gx = np.repeat(g, ln) * x
            gw = np.bincount(ix, gx, len(names)) + p.ridge * w
            own = np.repeat(sums, ln, axis=0) - v[ix] * x[:, None]
            gv = np.stack([np.bincount(ix, gx * own[:, f], len(names)) for f in range(p.rank)], 1) + p.ridge * v
            gw2 += gw**2
            gv2 += gv**2
            gb2 += g.sum() ** 2
            w -= 0.1 * gw / np.sqrt(gw2)
            v -= 0.03 * gv / np.sqrt(gv2)
            bias -= 0.1 * g.sum() / np.sqrt(gb2)
    full_w, full_v = np.zeros(size, np.float32), np.zeros((size, p.rank), np.float32)
    full_w[names], full_v[names] = w, v
    return pack(w=full_w, v=full_v, bias=np.float64(bias))


def train(docs: DataFrame, labels: DataFrame, train_rows, p: QualityParams = QualityParams(), key: str = "doc_id", label: str = "quality") -> dict:
    sample = label_sample(labels, key, label, p.max_fit_rows, train_rows)
    return fit_in_task(features(with_sample(docs, sample, key, [F.col("text")]), p), lambda t: fit(t, p))


def score(docs: DataFrame, model: dict, keep: list[str], p: QualityParams = QualityParams(), out: str = "score") -> DataFrame:
    """Columns `keep` of every row and, as `out`, its score between 0 and 1, from the whole text."""
    text = "text" if "text" in keep else "_text"
    shared = docs.sparkSession.sparkContext.broadcast((model["w"], model["v"], float(model["bias"])))  # 2^bits x (rank + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v, bias = shared.value
        for b in batches:
            got = []
            for _, _, data, offs in tb.text_blocks(b.column(text)):
                index, value = zip(*_vectors(data, offs, p), strict=True)
                at = np.concatenate([[0], np.cumsum([len(x) for x in index])])
                got.append(machine(np.concatenate(index), np.concatenate(value), at, w, v, bias)[0])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sigmoid(np.concatenate(got) if got else np.zeros(0)))], [*keep, out])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes if c in keep), f"`{out}` double"]))
