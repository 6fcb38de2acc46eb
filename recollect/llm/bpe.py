"""BPE encoding and decoding with a public vocabulary, by forced boundaries.

A merge that crosses the place between two symbols makes a token that holds the two side by side. So where two symbols stand
side by side inside no token of the vocabulary, no merge ever crosses: the place is a certain cut, the fragments on either
side are encoded independently, and their ids concatenated are the ids of the whole. A symbol is a byte, or a word's last
byte with the mark of the word's end; the mark stands inside no token, so that every word's end is a certain cut as well.
A worker remembers the ids of words, up to a bound.

What precedes the merges is the vocabulary's own: special tokens are found in the raw text, what lies between them is
normalised (NFC, white space, lower case by code point) and split into words by the vocabulary's pattern. Decoding joins the
ids' tokens by one space, as a vocabulary without a decoder does.

Every text is encoded where it is read, nothing is shuffled. A text of any length goes through in slices that end before
white space, which is a cut for every one of the steps above. Fragments of all words that a worker doesn't know are merged together,
a round at a time, as they don't depend on each other; a very long fragment is merged by itself in time n log n.

Cases: null texts are taken as empty, and empty texts have no ids and decode to the empty text; repeated rows each get
theirs; an empty table gives no rows; columns that carry names of the result are replaced, others pass through whatever
their names. Ids that the vocabulary doesn't have decode to nothing; null ids decode to null. Which characters are letters
and digits follows the regex module's Unicode tables; letters that a newer Unicode added may be told apart otherwise elsewhere.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

DEFAULT_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
WORD_END = "</w>"
NEVER = 1 << 60
#: Symbols of a fragment that is merged by itself.
LONG = 200


@dataclass(frozen=True)
class BpeParams:
    #: The vocabulary file, read on the driver; executors get its tokens and merges.
    vocabulary: str = DEFAULT_VOCABULARY
    #: Code points of a slice of a long text, and of what is merged together.
    slice: int = 1 << 20
    #: Words that a worker remembers, and their longest.
    memory: int = 300_000
    longest: int = 48


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where it prints, else the next free one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What the encoder needs of a vocabulary file: tokens by id, merges in order, special tokens, the pattern of words."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, (split, _) = found["model"], found["pre_tokenizer"]["pretokenizers"]
    steps = [s["type"] for s in found["normalizer"]["normalizers"]]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or steps != ["NFC", "Replace", "Lowercase"] or found["decoder"]:
        raise ValueError(f"{path} isn't a vocabulary of words in lower case with marked ends")
    special = {t["content"]: t["id"] for t in found["added_tokens"]}
    size = 1 + max(*model["vocab"].values(), *special.values())
    tokens: list[str | None] = [None] * size
    for token, i in chain(model["vocab"].items(), special.items()):
        tokens[i] = token
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return {"tokens": tokens, "merges": merges, "special": special, "pattern": split["pattern"]["Regex"]}


class Encoder:
    """A vocabulary ready for use, with what it remembers."""

    def __init__(self, vocabulary: dict, p: BpeParams):
        letters = byte_letters()
        place = {c: b for b, c in enumerate(letters)}
        ids = {t: i for i, t in enumerate(vocabulary["tokens"]) if t is not None and t not in vocabulary["special"]}
        #: Symbol b is byte b, symbol 256 + b is byte b at a word's end.
        self.ids = np.array([ids[c] for c in letters] + [ids[c + WORD_END] for c in letters], np.int64)
        self.inside = np.zeros((512, 512), bool)
        for token in ids:
            ends = token.endswith(WORD_END) and token != WORD_END
            codes = [place[c] for c in (token[: -len(WORD_END)] if ends else token)]
            codes[-1] += 256 * ends
            self.inside[codes[:-1], codes[1:]] = True
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(vocabulary["merges"])}
        self.size = len(vocabulary["tokens"])
        pairs = sorted((a * self.size + b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        self.special, self.p = vocabulary["special"], p
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.find = regex.compile(vocabulary["pattern"]).findall
        #: The same on text of ASCII letters only, where it is faster.
        self.find_ascii = re.compile(vocabulary["pattern"].replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.words: dict[str, bytes] = {}
        self.texts = pa.array(vocabulary["tokens"], pa.large_string())

    def paired(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks and new ids of pairs; a rank of NEVER for those that don't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.made[at]

    def encoded(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit numbers. All fragments between certain cuts are merged at once, each at its own pair of least rank."""
        data = [w.encode() for w in words]
        lens = np.array([len(d) for d in data])
        ends = np.cumsum(lens)
        codes = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        codes[ends - 1] += 256
        begins = np.ones(len(codes), bool)
        begins[1:] = ~self.inside[codes[:-1], codes[1:]]
        fragment, ids, place = np.cumsum(begins) - 1, self.ids[codes], np.arange(len(codes))
        edge = np.append(begins[1:], True)
        rank, new = self.paired(ids, np.append(ids[1:], 0))
        rank[edge] = NEVER
        done = []
        long = np.bincount(fragment)[fragment] > LONG
        if long.any():
            for f in np.unique(fragment[long]):
                at = np.flatnonzero(fragment == f)
                left = self.alone(ids[at].tolist())
                done.append((at[[i for i, x in enumerate(left) if x is not None]], np.array([x for x in left if x is not None])))
        live = ~long
        ids, rank, new, fragment, place = (x[live] for x in (ids, rank, new, fragment, place))
        while len(ids):
            starts = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(ids))))
            over = least == NEVER
            if over.any():
                done.append((place[over], ids[over]))
                ids, rank, new, fragment, place, least = (x[~over] for x in (ids, rank, new, fragment, place, least))
            hit = np.flatnonzero(rank == least)
            if len(hit):  # of places that overlap every second one, from the left
                head = np.append(True, np.diff(hit) != 1)
                run = np.arange(len(hit)) - np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
                hit = hit[run % 2 == 0]
                ids[hit] = new[hit]
                stay = np.ones(len(ids), bool)
                stay[hit + 1] = False
                now = hit - np.arange(len(hit))
                ids, rank, new, fragment, place = (x[stay] for x in (ids, rank, new, fragment, place))
                again = np.stack([now - 1, now], 1).ravel()  # in order, as places are
                again = again[np.append(again[1:] != again[:-1], True) & (again >= 0)]
                inner = np.append(fragment[1:] == fragment[:-1], False)[again]
                rank[again[~inner]] = NEVER
                again = again[inner]
                rank[again], new[again] = self.paired(ids[again], ids[again + 1])
        at = np.concatenate([d[0] for d in done])
        order = np.argsort(at)
        found = np.concatenate([d[1] for d in done])[order].astype(np.int32).tobytes()
        cut = (4 * np.searchsorted(at[order], np.append(0, ends))).tolist()
        return [found[a:b] for a, b in zip(cut, cut[1:])]

    def alone(self, ids: list[int]) -> list[int | None]:
        """A long fragment, by a heap of its pairs: its ids where each of them begins, and nothing elsewhere."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[pair][0], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:  # one of the two has been merged since
                continue
            ids[i], ids[j], after[i] = merges[pair][1], None, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (pair := (ids[left], ids[right])) in merges:
                    heapq.heappush(heap, (merges[pair][0], left, pair))
        return ids

    def segments(self, text: str) -> Iterator[str | int]:
        """Slices of normal text, and the ids of special tokens between them."""
        at = 0
        for m in self.marks.finditer(text):
            yield from self.slices(text, at, m.start())
            yield self.special[m.group()]
            at = m.end()
        yield from self.slices(text, at, len(text))

    def slices(self, text: str, at: int, end: int) -> Iterator[str]:
        while end - at > self.p.slice:
            cut = max(text.rfind(c, at + 1, at + self.p.slice) for c in " \n")
            if cut < 0:
                found = [x for c in " \n" if (x := text.find(c, at + self.p.slice, end)) >= 0]
                cut = min(found, default=end)
            yield text[at:cut]
            at = cut
        yield text[at:end]

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text. Slices are collected until they are enough for the words of all that isn't known to be merged together."""
        parts: list[list[bytes]] = []
        held, size = [], 0
        for text in texts:
            parts.append([])
            for part in self.segments(text or ""):
                if isinstance(part, int):
                    parts[-1].append(array("i", [part]).tobytes())
                elif part:
                    low = lowered(part)
                    held.append((parts[-1], len(parts[-1]), (self.find_ascii if low.isascii() else self.find)(low)))
                    parts[-1].append(b"")
                    size += len(part)
                    if size >= self.p.slice:
                        self.fill(held)
                        held, size = [], 0
        self.fill(held)
        return [np.frombuffer(b"".join(p), np.int32) for p in parts]

    def fill(self, held: list) -> None:
        """Ids for slices, given as their words."""
        if len(self.words) > self.p.memory:
            self.words.clear()
        unknown = [*set().union(*(words for *_, words in held)).difference(self.words)]
        self.words.update(zip(unknown, self.encoded(unknown)) if unknown else ())
        for part, at, words in held:
            part[at] = b"".join(map(self.words.__getitem__, words))
        for word in unknown:
            if len(word) > self.p.longest:
                del self.words[word]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Each row's tokens, joined by a space."""
        known = pc.and_(pc.greater_equal(ids.flatten(), 0), pc.less(ids.flatten(), len(self.texts)))
        tokens = self.texts.take(pc.if_else(known, ids.flatten(), None))
        lens = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        if tokens.null_count:
            there = tokens.is_valid().to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(there)])[offsets]
            tokens = tokens.drop_null()
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), tokens), pa.scalar(" ", pa.large_string()))
        return pc.if_else(ids.is_valid(), joined, None)


def lowered(text: str) -> str:
    """NFC and lower case by code point; a sigma at a word's end is like any other. White space stays, as words never hold any."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_ready: dict[int, Encoder] = {}


def _encoder(shared, p: BpeParams) -> Encoder:
    """One for each worker and vocabulary, so that what it remembers serves later tasks."""
    vocabulary = shared.value
    if id(vocabulary) not in _ready:
        _ready.clear()
        _ready[id(vocabulary)] = Encoder(vocabulary, p)
        _ready[id(vocabulary)].vocabulary = vocabulary  # keeps the number taken
    return _ready[id(vocabulary)]


def _shared(spark: SparkSession, p: BpeParams):
    return spark.sparkContext.broadcast(load_vocabulary(p.vocabulary))  # one vocabulary


def _field(column: str, kind: str) -> str:
    return f"`{column.replace('`', '``')}` {kind}"


def _added(df: DataFrame, source: str, kinds: dict[str, str], work) -> DataFrame:
    """`df` with columns that `work` makes of each batch's column `source`; columns of their names are replaced."""
    kept = [c for c in df.columns if c.lower() not in {k.lower() for k in kinds}]
    renamed = [f"c{i}" for i in range(len(kept))]
    fields = [*zip(renamed, (df.schema[c].dataType.simpleString() for c in kept)), *kinds.items()]
    source_at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:source_at], *work(b.column(source_at))], [*renamed, *kinds])

    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    given = df.select(*(df[quoted(c)].alias(r) for c, r in zip(kept, renamed)), df[quoted(source)].alias("source_"))
    return given.mapInArrow(run, ", ".join(_field(c, k) for c, k in fields)).toDF(*kept, *kinds)


def encode(docs: DataFrame, p: BpeParams = BpeParams(), text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """`docs` with the ids of each text, and on request, in the same pass, the text that these decode to."""
    shared = _shared(docs.sparkSession, p)

    def work(texts: pa.Array) -> list[pa.Array]:
        encoder = _encoder(shared, p)
        rows = encoder.encode(t.as_py() for t in texts)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        flat = pa.array(np.concatenate([np.zeros(0, np.int32), *rows]))
        found = pa.ListArray.from_arrays(pa.array(offsets), flat)
        return [found, encoder.decode(found).cast(pa.string())] if decoded else [found]

    return _added(docs, text, {ids: "array<int>"} | ({decoded: "string"} if decoded else {}), work)


def decode(rows: DataFrame, p: BpeParams = BpeParams(), ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`rows` with the text of each row's ids."""
    shared = _shared(rows.sparkSession, p)
    return _added(rows, ids, {text: "string"}, lambda column: [_encoder(shared, p).decode(column).cast(pa.string())])
