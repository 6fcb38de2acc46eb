"""SentencePiece encoding and decoding with a public BPE vocabulary, by a max-plus parallel scan.

A sequence of pieces is the encoding of its text if and only if every two neighbours are the encoding of their own
concatenation. So encoding is a best path through the lattice of pieces in the max-plus semiring, with weight 0 for a
compatible pair and minus infinity for any other: a path of weight 0 exists, and it is the only one. The state at a
position is the last piece.

A text longer than `chunk` code points is cut into chunks. The state at a cut is the piece that covers or ends at it and
how far it reaches beyond. For each chunk a transfer matrix tells which states at its end each state at its start leads
to with weight 0. Before a word's first space mark every path ends a piece, so the matrix through such a place has rank
one, and only the text before the first and after the last such place has to be walked; without one the whole chunk is.
Matrices are combined associatively for each document (a scan over small sparse matrices; a text of 2 GB, the most that
Spark holds, gives 32,768 of them), and each chunk is then traced on its own between the states that the scan found.

Space marks in a row merge last, from the left, to pieces of up to 16; a cut never falls between two of them. A run of marks
longer than a chunk is parted where such pieces end, and the parts are texts of their own, whose ids follow each other. A
character without a piece becomes its UTF-8 bytes.

Cases: null texts give null ids, empty texts no ids; repeated rows each get theirs; a table without rows gives none; columns
that carry names of the result are replaced, others pass through. Decoding gives the text with the
space mark U+2581 as a space, as the vocabulary can't tell them apart.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import written

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class PieceParams:
    #: The vocabulary file, read on the driver; executors get its pieces.
    model: str = DEFAULT_MODEL
    chunk: int = 32768
    #: Words and pairs that a worker remembers, each.
    memory: int = 300_000


def load_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id; type 1 is a normal piece, 6 a byte."""
    import sentencepiece as sp

    model = sp.SentencePieceProcessor(model_file=path)
    kind = lambda i: 6 if model.is_byte(i) else 3 if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else 1
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


class Encoder:
    """Pieces of one vocabulary. A state is (last piece or None, code points that it reaches beyond the cut)."""

    def __init__(self, vocabulary: list[tuple[str, float, int]], memory: int):
        self.pieces = [p for p, _, _ in vocabulary]
        self.ids = {p: i for i, (p, _, kind) in enumerate(vocabulary) if kind == 1}
        self.score = {p: s for p, s, kind in vocabulary if kind == 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == 6}
        self.value = {i: b for b, i in self.bytes.items()}
        #: What each id stands for, where one id is enough to tell, and which ids are parts of longer characters.
        self.shown = [chr(self.value[i]) if self.value.get(i, 128) < 128 else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.high = np.array([self.value.get(i, 0) >= 128 for i in range(len(self.pieces))])
        self.longest = max(map(len, self.ids))
        self.memory, self.words, self.units, self.pairs = memory, {}, {}, {}
        #: Pieces that are their own encoding; no other is ever in an encoding.
        self.halves: dict[str, tuple[str, str]] = {}
        self.whole = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        #: Two code points between which some piece goes on; between any others every path ends a piece.
        self.inside = {p[i : i + 2] for p in self.whole for i in range(len(p) - 1)}
        self.parts: dict[str, list[str]] = {}
        self.reach: dict[str, int] = {}  # the longest of them by its first three code points
        for p in self.whole:
            if len(p) > 2:
                self.reach[p[:3]] = max(self.reach.get(p[:3], 2), len(p))
        self.runs = [p for p in self.ids if set(p) == {MARK}]
        self.run = max(map(len, self.runs), default=0)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, by merging the best pair again and again."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if len(parts) == 2 and text in self.ids:
                self.halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str | None, b: str) -> bool:
        """Weight 0 or not: whether b may follow a."""
        x, y = self.whole.get(a), self.whole.get(b)
        if x is None or y is None:  # the beginning, or a character without a piece, that merges with nothing
            return True
        got = self.pairs.get(x << 24 | y)
        if got is None:
            if len(self.pairs) >= self.memory:
                self.pairs.clear()
            got = self.pairs[x << 24 | y] = self.apart(a, b)
        return got

    def apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses from a to b: undoes the later of their last merges, down to characters, and looks
        for a merge across that would have come before what was undone."""
        score, floor, strict = self.score, -np.inf, True
        while True:
            across = score.get(a + b)
            if across is not None and (across > floor or across == floor and not strict):
                return False
            sa = score[a] if len(a) > 1 else np.inf
            sb = score[b] if len(b) > 1 else np.inf
            if sa == sb == np.inf:
                return True
            if sa < sb:
                floor, strict, a = sa, True, self.halves[a][1]
            else:
                floor, strict, b = sb, False, self.halves[b][0]

    def at(self, text: str, start: int, stop: int) -> Iterator[str]:
        """Pieces that begin at `start` and end by `stop`; a character without one stands for itself."""
        yield text[start]
        for end in range(start + 2, min(start + self.longest, stop) + 1):
            piece = text[start:end]
            if piece in self.whole:
                yield piece

    def walk(self, text: str, begin: int, stop: int, state: str | None, reach: int | None = None) -> list:
        """The only last piece of weight 0 at each position up to `reach`, from `state` that ends at `begin`; else None."""
        reach = stop if reach is None else reach
        last: list = [None] * (reach - begin + 1)
        for pos in range(begin, stop):
            before = last[pos - begin] if pos > begin else state
            if before is None and pos > begin:
                continue
            for piece in self.at(text, pos, reach):
                k = pos + len(piece) - begin
                if last[k] is None and self.compatible(before, piece):
                    last[k] = piece
        return last

    @staticmethod
    def trace(last: list, end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out += [self.bytes[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(i)
        return out

    def split(self, text: str) -> Iterator[str]:
        """A text without two marks in a row, cut where no piece goes on: there the matrix has rank one."""
        inside, start = self.inside, 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                yield text[start:i]
                start = i
        yield text[start:]

    def word(self, text: str) -> list[str]:
        return [p for part in self.split(text) for p in self.path(part)]

    def word_ids(self, text: str) -> bytes:
        """Ids of a word as 32-bit numbers. Its parts are often seen again, in other words."""
        inside, parts, out, start = self.inside, self.parts, b"", 0
        for i in range(1, len(text) + 1):
            if text[i - 1 : i + 1] not in inside:  # at the end one code point is left, that is in no pair
                part = text[start:i]
                got = parts.get(part)
                if got is None:
                    if len(parts) > self.memory:
                        parts.clear()
                    got = parts[part] = array("i", self.path_ids(part)).tobytes()
                out += got
                start = i
        return out

    def path(self, text: str) -> list[str]:
        return [self.pieces[i] if i >= 0 else chr(-i - 1) for i in self.path_of(text)]

    def path_ids(self, text: str) -> list[int]:
        ids = self.path_of(text)
        if min(ids) >= 0:
            return ids
        return [x for i in ids for x in ((i,) if i >= 0 else (self.bytes[b] for b in chr(-i - 1).encode("utf-8", "replace")))]

    def path_of(self, text: str) -> list[int]:
        """Ids on the only path of weight 0; a character c without a piece is -1 - c. The path is searched from the longest
        piece on, and a position from which it can't go on is closed, as only one piece can end there."""
        whole, reach, pairs = self.whole, self.reach, self.pairs
        n, pos, before, ids, starts, closed = len(text), 0, -1, [], [], ()
        end = min(n, reach.get(text[:3], 2))
        while pos < n:
            while end > pos:
                if end not in closed:
                    y = whole.get(text[pos:end])
                    if y is not None:
                        if before < 0:
                            break
                        ok = pairs.get(before << 24 | y)
                        if ok is None:
                            ok = self.compatible(self.pieces[before], self.pieces[y])
                        if ok:
                            break
                    elif end == pos + 1:
                        y = -1 - ord(text[pos])
                        break
                end -= 1
            if end > pos:
                ids.append(y)
                starts.append(pos)
                before, pos = y, end
                end = pos + reach.get(text[pos : pos + 3], 2)
                if end > n:
                    end = n
            else:
                closed = {pos, *closed}
                end = pos - 1
                pos = starts.pop()
                ids.pop()
                before = ids[-1] if ids else -1
        return ids

    def spaced(self, n: int) -> list[str]:
        """The pieces of n marks in a row."""
        if self.run < 2:
            return [MARK] * n
        return [MARK * self.run] * (n // self.run) + ([MARK * (n % self.run)] if n % self.run else [])

    def unit(self, text: str) -> list[str]:
        """The pieces of marks and the word after them."""
        n = len(text) - len(text.lstrip(MARK))
        if n < 2:
            return self.word(text)
        if n == len(text):
            return self.spaced(n)
        rest = self.word(text[n - 1 :])
        return [*self.spaced(n), *rest[1:]] if rest[0] == MARK else [*self.spaced(n - 1), *rest]

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet, each once. What isn't in use is forgotten when memory is full."""
        if len(self.words) + len(words) > self.memory:
            self.words = {w: ids for w in words if (ids := self.words.get(w)) is not None}
        known = self.words
        for w in words.difference(known):
            known[w] = self.word_ids(MARK + w) if w else b""

    def encoded(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of texts that are one chunk each. Texts without two spaces in a row are looked up word by word."""
        plain = [None if not t or "  " in t or t[0] == " " or t[-1] == " " or MARK in t else t.split(" ") for t in texts]
        self.learn(set().union(*(w for w in plain if w)))
        find = self.words.__getitem__
        return [None if t is None else np.frombuffer(b"".join(map(find, w)), np.int32) if w else self.encode(t) for t, w in zip(texts, plain, strict=True)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of any text that is one chunk."""
        return np.fromiter(self.ids_of_units(MARK + text.replace(" ", MARK)) if text else (), np.int32)

    def ids_of_units(self, marked: str) -> Iterator[int]:
        known = self.units
        for u in _UNIT.findall(marked):
            got = known.get(u)
            if got is None:
                if len(known) > self.memory // 8:
                    known.clear()
                got = known[u] = self.to_ids(self.unit(u))
            yield from got

    def whole_words(self, marked: str) -> np.ndarray:
        """Ids of a text that begins with a mark, up to where another mark begins a word."""
        if not marked or MARK * 2 in marked:
            return np.fromiter(self.ids_of_units(marked), np.int32)
        words = marked[1:].split(MARK)
        self.learn(set(words))
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if not self.high[ids].any():
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
            return text[1:] if text[:1] == " " else text
        out: list[str] = []
        raw = bytearray()
        for i in ids.tolist():
            b = self.value.get(i)
            if b is None:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.pieces[i])
            else:
                raw.append(b)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text[:1] == " " else text

    # The scan over chunks. `left` and `right` are the code points around a chunk.

    def states(self, left: str, text: str) -> list[tuple[str, int]]:
        """States that may hold at the start of `text`: every piece that ends there or covers it."""
        out, both, cut = [], left + text[: self.longest], len(left)
        for start in range(max(0, cut - self.longest), cut):
            for piece in self.at(both, start, len(both)):
                if start + len(piece) >= cut:
                    out.append((piece, start + len(piece) - cut))
        return out

    def transfer(self, left: str, text: str, right: str) -> list[tuple[tuple, tuple]]:
        """The finite entries of a chunk's matrix, as (state at its start, state at its end)."""
        both, n = text + right[: self.longest], len(text)
        starts = [("", 0)] if not left else self.states(left, both)
        first, last = hard_marks(text)
        out = []
        if first is not None:
            tail = self.ends(both, last, n, None)
            for s in starts:
                if s[1] <= first and self.meets(both, s, first):
                    out += [(s, e) for e in tail]
            return out
        for s in starts:
            if s[1] >= n:
                out.append((s, (s[0], s[1] - n)))
            else:
                out += [(s, e) for e in self.ends(both, s[1], n, s[0] or None)]
        return out

    def ends(self, both: str, begin: int, n: int, state: str | None) -> list[tuple[str, int]]:
        """States at the end of a chunk of n, on paths from `state` at `begin`."""
        last = self.walk(both, begin, n, state, len(both))
        return [(x, begin + k - n) for k, x in enumerate(last) if x is not None and begin + k >= n > begin + k - len(x)]

    def meets(self, both: str, state: tuple, stop: int) -> bool:
        if state[1] == stop:
            return True
        return self.walk(both, state[1], stop, state[0] or None)[stop - state[1]] is not None

    def traced(self, text: str, right: str, start: tuple, end: tuple) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, between its states."""
        both, n = text + right[: self.longest], len(text)
        if start[1] >= n:
            return np.zeros(0, np.int32)
        stop, (first, last) = n + end[1], hard_marks(text, start[1])
        if first is None:
            return np.array(self.to_ids(self.between(both, start, stop)), np.int32)
        head = self.to_ids(self.between(both, start, first)) if first > start[1] else []
        tail = self.to_ids(self.between(both, ("", last), stop))
        return np.concatenate([np.array(head, np.int32), self.whole_words(both[first:last]), np.array(tail, np.int32)])

    def between(self, both: str, start: tuple, stop: int) -> list[str]:
        begin = start[1]
        return self.trace(self.walk(both, begin, stop, start[0] or None), stop - begin)


#: Marks with the word after them, or a word without a mark.
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: A mark after another character: no piece goes across.
_HARD = re.compile(f"(?<=[^{MARK}]){MARK}")


def hard_marks(text: str, begin: int = 0) -> tuple[int | None, int | None]:
    """The first and the last mark from `begin` on that comes after another character."""
    found = _HARD.search(text, begin)
    if not found:
        return None, None
    last = text.rfind(MARK)
    while text[last - 1] == MARK:
        last = text.rfind(MARK, 0, last)
    return found.start(), last


def compose(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """The max-plus product of two sparse matrices of weights 0 and minus infinity."""
    rows: dict = {}
    for x, y in b:
        rows.setdefault(x, []).append(y)
    return list({(x, z) for x, y in a for z in rows.get(y, ())})


def scan(matrices: list[list[tuple]]) -> list[tuple[tuple, tuple]]:
    """(state at the start, state at the end) of each chunk on the only path of weight 0 through all of them."""
    level, tree = matrices, [matrices]
    while len(level) > 1:  # up: products of neighbours
        level = [compose(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        tree.append(level)
    ends = [next(e for e in level[0] if e[0] == ("", 0) and e[1][1] == 0)]
    for below in tree[-2::-1]:  # down: the state in the middle of each pair
        split = []
        for i, (x, z) in enumerate(ends):
            if 2 * i + 1 < len(below):
                after = {y for y, w in below[2 * i + 1] if w == z}
                y = next(y for w, y in below[2 * i] if w == x and y in after)
                split += [(x, y), (y, z)]
            else:
                split.append((x, z))
        ends = split
    return ends


def cuts(marked: str, chunk: int) -> list[int]:
    """Where chunks begin: every `chunk` code points, or as soon after as no mark stands before the cut."""
    out, at = [0], chunk
    while at < len(marked):
        while at < len(marked) and marked[at - 1] == MARK:
            at += 1
        if at >= len(marked):
            break
        out.append(at)
        at += chunk
    return out


def parts(marked: str, chunk: int, run: int) -> list[tuple[int, int]]:
    """(begin, end) of a text's parts: one, unless a run of marks is longer than a chunk. `run` is the longest piece of marks."""
    step, out, begin = max(1, chunk // run) * run, [], 0
    for m in _RUN.finditer(marked):
        at = m.start() + step
        while at + 2 * run <= m.end():
            out.append((begin, at))
            begin, at = at, at + step
    return [*out, (begin, len(marked))]


_RUN = re.compile(f"{MARK}{MARK}+")
_held: list[tuple[list, Encoder]] = []


def _encoder(shared, memory: int) -> Encoder:
    """One for each worker and vocabulary, so that what it remembers serves later tasks. A worker has one copy of a broadcast."""
    if not _held or _held[0][0] is not shared.value:
        _held[:] = [(shared.value, Encoder(shared.value, memory))]
    return _held[0][1]


def _list(arrays: list[np.ndarray | None]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([a for a in arrays if a is not None]) if any(a is not None for a in arrays) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()), mask=pa.array([a is None for a in arrays])) if len(arrays) else pa.array([], pa.list_(pa.int32()))


def vocabulary(spark: SparkSession, p: PieceParams):
    return spark.sparkContext.broadcast([(a, float(b), int(c)) for a, b, c in load_vocabulary(p.model)])  # one vocabulary


def encode(docs: DataFrame, p: PieceParams = PieceParams(), keep: list[str] | None = None, text: str = "text", shared=None) -> DataFrame:
    """Columns `keep` (default: all but the text), ids array<int>, and decoded_ok: whether decoding gives the text back.

    Columns of these two names are replaced.
    """
    shared = shared or vocabulary(docs.sparkSession, p)
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded_ok")] if keep is None else keep
    rows = docs.select(*keep, F.col(text).alias("_piece_text"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + (", " if keep else "")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, p.memory)
        for b in batches:
            column = b.column("_piece_text")
            for lo in range(0, len(column), 256):
                texts = column.slice(lo, 256).to_pylist()
                ids = enc.encoded(texts)
                ok = [None if t is None else enc.decode(i) == t.replace(MARK, " ") for t, i in zip(texts, ids, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, 256) for c in keep), _list(ids), pa.array(ok, pa.bool_())], [*keep, "ids", "decoded_ok"])

    is_long = F.length("_piece_text") >= p.chunk
    few = rows.filter(~F.coalesce(is_long, F.lit(False))).mapInArrow(short, schema + "ids array<int>, decoded_ok boolean")

    context = max(len(piece) for piece, _, kind in shared.value if kind == 1)
    run = max((len(piece) for piece, _, kind in shared.value if kind == 1 and set(piece) == {MARK}), default=1)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, t in zip(pdf["_piece_name"], pdf["_piece_text"], strict=True):
                marked, c = MARK + t.replace(" ", MARK), 0
                for g, (begin, end) in enumerate(parts(marked, p.chunk, run)):
                    part = marked[begin:end]
                    at = [*cuts(part, p.chunk), len(part)]
                    for s, e in zip(at[:-1], at[1:], strict=True):
                        yield pd.DataFrame({"_piece_name": [name], "g": [g], "c": [c], "before": [part[max(0, s - context) : s]], "part": [part[s:e]], "after": [part[e : e + context]]})
                        c += 1

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared, p.memory)
        for pdf in batches:
            got = [enc.transfer(x, y, z) for x, y, z in zip(pdf["before"], pdf["part"], pdf["after"], strict=True)]
            yield pd.DataFrame({"_piece_name": pdf["_piece_name"], "g": pdf["g"], "c": pdf["c"], "m": [[(*x, *y) for x, y in g] for g in got]})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("c")
        ends = scan([[((r["s"], r["k"]), (r["t"], r["j"])) for r in m] for m in pdf["m"]])
        return pd.DataFrame({"_piece_name": pdf["_piece_name"], "c": pdf["c"], "s": [x[0] for x, _ in ends], "k": [x[1] for x, _ in ends], "t": [y[0] for _, y in ends], "j": [y[1] for _, y in ends]})

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared, p.memory)
        for pdf in batches:
            got = [enc.traced(r.part, r.after, (r.s, r.k), (r.t, r.j)) for r in pdf.itertuples()]
            yield pd.DataFrame({"_piece_name": pdf["_piece_name"], "c": pdf["c"], "part_ids": got})

    name = F.sha2("_piece_text", 256).alias("_piece_name")
    long_rows = rows.filter(is_long)
    chunks = long_rows.select(name, "_piece_text").dropDuplicates(["_piece_name"]).mapInPandas(split, "_piece_name string, g int, c int, before string, part string, after string")
    # Written once, as matrices and traces both read them, and dealt out by chunk and not by document.
    chunks = written(chunks.repartition("_piece_name", "c"), "chunks")
    matrices = chunks.mapInPandas(matrix, "_piece_name string, g int, c int, m array<struct<s:string,k:int,t:string,j:int>>")
    ends = matrices.groupBy("_piece_name", "g").applyInPandas(combine, "_piece_name string, c int, s string, k int, t string, j int")
    traced = chunks.join(ends, ["_piece_name", "c"]).mapInPandas(back, "_piece_name string, c int, part_ids array<int>")
    ids = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("c", "part_ids"))), lambda x: x["part_ids"]))
    whole = traced.groupBy("_piece_name").agg(ids.alias("ids"))
    joined = long_rows.withColumn("_piece_name", F.sha2("_piece_text", 256)).join(whole, "_piece_name")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, p.memory)
        for b in batches:
            ok = [enc.decode(np.asarray(i.values)) == t.as_py().replace(MARK, " ") for i, t in zip(b.column("ids"), b.column("_piece_text"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), b.column("ids"), pa.array(ok, pa.bool_())], [*keep, "ids", "decoded_ok"])

    return few.union(joined.select(*keep, "ids", "_piece_text").mapInArrow(check, schema + "ids array<int>, decoded_ok boolean"))


def decode(rows: DataFrame, p: PieceParams = PieceParams(), ids: str = "ids", out: str = "text", shared=None) -> DataFrame:
    """All columns but `ids`, and the text; null ids give null."""
    shared = shared or vocabulary(rows.sparkSession, p)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        enc = _encoder(shared, p.memory)
        return column.map(lambda x: None if x is None else enc.decode(np.asarray(x, np.int64)))

    return rows.select(*[c for c in rows.columns if c not in (ids, out)], text(ids).alias(out))
