"""Language identification by mixture inference.

A document is a mixture of languages. Its units are words; a unit's likelihood in a language is the product of the
likelihoods of the character n-grams in it. Expectation-maximisation estimates the document's language proportions; the
set of languages is chosen along the path of largest proportions by a likelihood that is penalised for each language.
The language models are counts of hashed n-grams, learned from labelled documents, with a bounded sample per language.

A very long text is read piece by piece and held as its distinct words with their counts.

Cases: null texts and texts without a letter give `und` with score 0 and no proportions; without any labelled document
every text gives `und`; ties between languages go to the one that sorts first; repeated ids are judged row by row; a table
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


@dataclass(frozen=True)
class LanguageParams:
    orders: tuple[int, ...] = (1, 3)
    bits: int = 15
    #: About how many documents each language is learned from.
    docs_per_language: int = 1500
    smoothing: float = 0.1
    #: Likelihoods of one word differ by e^`cap` at most, so that a single odd word can't outweigh the rest.
    cap: float = 12.0
    #: Sizes of the set that are tried for every text; larger ones are for as long as the last one was the best.
    least_tries: int = 3
    rounds: int = 8
    penalty: float = 1.0
    min_share: float = 0.02
    seed: int = 11


#: Steps of the hash that rows are sampled by.
STEPS = 1 << 40


def _grams(chars: np.ndarray, p: LanguageParams) -> list[tuple[int, np.ndarray]]:
    return [(n, tb.gram_buckets(chars, n, p.bits, p.seed)) for n in p.orders]


def _clean(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with every non-letter as a space, row offsets, and which are letters."""
    chars, starts = tb.code_points(data, offs)
    is_letter = tb.letters(chars)
    return np.where(is_letter, tb.lowered(chars), np.uint32(32)), starts, is_letter


def train(docs: DataFrame, train_rows, p: LanguageParams = LanguageParams(), lang: str = "lang", key: str = "doc_id") -> dict:
    """{"langs": names, "logp": 2^bits x languages}. `train_rows` is a condition on the rows of `docs`."""
    seen = docs.filter(train_rows & F.col(lang).isNotNull())
    counts = seen.groupBy(lang).count().collect()
    langs = sorted(r[0] for r in counts)
    if not langs:
        return {"langs": [], "logp": np.zeros((1 << p.bits, 0), np.float32)}
    share = {r[0]: min(1.0, p.docs_per_language / r["count"]) for r in counts}
    limit = F.coalesce(*(F.when(F.col(lang) == k, F.lit(int(v * STEPS))) for k, v in share.items()))
    sample = seen.filter(F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(STEPS)) < limit)
    place = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(p.orders) * len(langs), 1 << p.bits), np.int64)
        for b in batches:
            names = b.column("_lang").to_pylist()
            for lo, _, data, offs in tb.text_blocks(b.column("_text")):
                if tb.is_long(data, offs):
                    most = max(p.orders)
                    for chars, kept in tb.pieces(data, most - 1):
                        chars = np.where(tb.letters(chars), tb.lowered(chars), np.uint32(32))
                        for k, (n, g) in enumerate(_grams(chars, p)):
                            total[k * len(langs) + place[names[lo]]] += np.bincount(g[max(0, kept - n + 1) :], minlength=1 << p.bits)
                    continue
                chars, starts, _ = _clean(data, offs)
                grams = _grams(chars, p)
                for i, (s, e) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    for k, (n, g) in enumerate(grams):
                        got = g[s : max(s, e - n + 1)]
                        total[k * len(langs) + place[names[lo + i]]] += np.bincount(got, minlength=1 << p.bits) if len(got) > 30_000 else 0
                        if len(got) <= 30_000:
                            u, c = np.unique(got, return_counts=True)
                            total[k * len(langs) + place[names[lo + i]], u] += c
        rows, buckets = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(total[rows, buckets])], ["row", "bucket", "n"])

    found = sample.select(F.col("text").alias("_text"), F.col(lang).alias("_lang")).mapInArrow(run, "row int, bucket int, n long")
    found = found.groupBy("row", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most orders x languages x 2^bits rows
    total = np.zeros((len(p.orders), len(langs), 1 << p.bits))
    row = np.array(found["row"])
    total[row // len(langs), row % len(langs), np.array(found["bucket"])] = np.array(found["n"])
    logp = np.log(total + p.smoothing) - np.log((total + p.smoothing).sum(2, keepdims=True))
    return {"langs": langs, "logp": logp.transpose(0, 2, 1).astype(np.float32).copy()}


def _word_sums(grams: list[tuple[int, np.ndarray]], size: int, at: np.ndarray, word: np.ndarray, n_words: int, logp: np.ndarray, row: np.ndarray | None) -> np.ndarray:
    """Log-likelihoods (words x languages): of the n-grams around each letter (at), where they lie in its row."""
    unit = np.zeros((n_words, logp.shape[2]))
    for k, (n, g) in enumerate(grams):
        back = n // 2
        fits = (at >= back) & (at - back + n <= size)
        if row is not None:
            left, right = np.maximum(at - back, 0), np.minimum(at - back + n - 1, size - 1)
            fits &= (row[left] == row[at]) & (row[right] == row[at])
        own, w = at[fits], word[fits]
        if len(w):
            cut = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            unit[w[cut]] += np.add.reduceat(logp[k][g[own - back]], cut, axis=0, dtype=np.float64)
    return unit


def _long_units(data: np.ndarray, logp: np.ndarray, p: LanguageParams, size: int = tb.BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of one long text: their log-likelihoods and how often each is there.

    A word is told by the sum of hashes of its letters at their places. A word that goes on into the next piece is carried.
    The text's first and last word have no neighbour on one side, and stand for themselves.
    """
    most, n_lang = max(p.orders), logp.shape[2]
    names, counts, units = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, n_lang))
    fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, c, u = (np.concatenate(x) for x in zip((names, counts, units), *fresh, strict=True))
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        return h, np.bincount(back, c, len(h)).astype(np.int64), u[first]

    left, held, length, begun = np.zeros(0, np.uint32), None, 0, False  # held: hash and sums of the word that goes on
    for s, e in tb.cut_points(data, size):
        after = min(len(data), e + 4 * most)
        while after < len(data) and data[after] & 0xC0 == 0x80:
            after += 1
        new = tb.code_points(data[s:after], np.array([0, e - s, after - s]))
        n_in = int(new[1][1])
        raw = np.concatenate([left, new[0]])
        is_letter = tb.letters(raw)
        chars = np.where(is_letter, tb.lowered(raw), np.uint32(32))
        base, end = len(left), len(left) + n_in
        at = np.flatnonzero(is_letter[base:end]) + base
        left = raw[max(0, end - most) : end]
        if not len(at):
            if held is not None:
                fresh.append((held[0], np.ones(1, np.int64), held[1]))
                held = None
            continue
        first = ~is_letter[at - 1] if base else np.concatenate([[True], ~is_letter[at[1:] - 1]])
        goes_on = held is not None and not first[0]
        if held is not None and not goes_on:
            fresh.append((held[0], np.ones(1, np.int64), held[1]))
        word = np.cumsum(first) - (0 if goes_on else 1)
        n_words = int(word[-1]) + 1
        unit = _word_sums(_grams(chars, p), len(chars), at, word, n_words, logp, None)
        begin = np.searchsorted(word, np.arange(n_words))
        place = np.arange(len(at)) - begin[word] + np.where(word == 0, length if goes_on else 0, 0)
        hashes = np.add.reduceat(tb.mix64((place.astype(np.uint64) << np.uint64(21)) | chars[at].astype(np.uint64)), begin)
        if goes_on:
            unit[0] += held[1][0]
            hashes[:1] += held[0]
        elif not begun:
            hashes[:1] += np.uint64(0x5851F42D4C957F2D)
        begun = True
        open_end = at[-1] == end - 1 and (end < len(raw) and bool(is_letter[end]))
        length = int(place[-1]) + 1 if open_end else 0
        held = (hashes[-1:], unit[-1:])  # the last word of a piece, whether it goes on or not
        done = n_words - 1
        h, index, c = np.unique(hashes[:done], return_index=True, return_counts=True)
        fresh.append((h, c, unit[:done][index]))
        if not open_end and at[-1] < len(raw) - 1:  # something follows it, so that it isn't the text's last one
            fresh.append((held[0], np.ones(1, np.int64), held[1]))
            held = None
        if len(fresh) > 64:
            names, counts, units = merged()
            fresh = []
    if held is not None:
        fresh.append((held[0] + np.uint64(0x2545F4914F6CDD1D), np.ones(1, np.int64), held[1]))
    names, counts, units = merged()
    return units, counts


def _mixtures(data: np.ndarray, offs: np.ndarray, logp: np.ndarray, p: LanguageParams) -> tuple[np.ndarray, np.ndarray]:
    """Each row's proportions (rows x languages; 0 outside the chosen set) and the rows that have a letter."""
    rows, n_lang = len(offs) - 1, logp.shape[2]
    if n_lang and tb.is_long(data, offs):
        unit, often = _long_units(data, logp, p)
        if not len(unit):
            return np.zeros((1, n_lang)), np.zeros(1, bool)
        return _chosen(unit, np.array([0, len(unit)]), often.astype(np.float64), p), np.ones(1, bool)
    chars, starts, is_letter = _clean(data, offs)
    out = np.zeros((rows, n_lang))
    has = tb.row_sums(is_letter.astype(np.float64)[:, None], starts)[:, 0] > 0
    if not has.any() or not n_lang:
        return out, has
    row = tb.doc_of(starts)
    first = is_letter & np.concatenate([[True], ~is_letter[:-1] | (row[1:] != row[:-1])])
    word = np.cumsum(first) - 1  # of letters, and of what follows up to the next word
    at = np.flatnonzero(is_letter)
    unit = _word_sums(_grams(chars, p), len(chars), at, word[at], int(first.sum()), logp, row)
    out[has] = _chosen(unit, np.searchsorted(row[first], np.arange(rows + 1)), None, p)[has]
    return out, has


def _chosen(unit: np.ndarray, edges: np.ndarray, often: np.ndarray | None, p: LanguageParams) -> np.ndarray:
    """Proportions (rows x languages) of the best set of each row, whose words are unit[edges[i] : edges[i + 1]]; `often`
    says how often a word counts."""
    rows, n_lang = len(edges) - 1, unit.shape[1]
    best = unit.max(1)
    like = np.exp(np.maximum(unit - best[:, None], -p.cap))
    counted = (lambda x: x) if often is None else (lambda x: x * (often if x.ndim == 1 else often[:, None]))
    base = tb.row_sums(counted(best), edges)
    n_words = np.diff(edges).astype(np.float64) if often is None else tb.row_sums(often, edges)
    sizes, of_word = np.diff(edges), np.repeat(np.arange(rows), np.diff(edges))

    def em(allowed: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods of the rows `which`."""
        n = n_words[which]
        cut = np.concatenate([[0], np.cumsum(sizes[which])])
        of = np.repeat(np.arange(len(which)), sizes[which])
        own = like if len(which) == rows else like[np.isin(of_word, which)]
        pi = allowed / np.maximum(1, allowed.sum(1, keepdims=True))
        for _ in range(p.rounds):
            got = own * pi[of]
            got /= np.maximum(got.sum(1, keepdims=True), 1e-300)
            pi = tb.row_sums(counted(got), cut) / np.maximum(1, n)[:, None]
        total = tb.row_sums(counted(np.log(np.maximum((own * pi[of]).sum(1), 1e-300))), cut)
        return pi, total + base[which]

    which = np.arange(rows)
    every, _ = em(np.ones((rows, n_lang)), which)
    # Order of entry into the set: the language that explains the whole text best, then by proportion.
    alone = tb.row_sums(counted(np.log(like)), edges)
    rank = every.copy()
    rank[np.arange(rows), alone.argmax(1)] = 2
    order = np.argsort(-rank, axis=1, kind="stable")
    pick, top = np.zeros((rows, n_lang)), np.full(rows, -np.inf)
    for size in range(1, n_lang + 1):
        allowed = np.zeros((len(which), n_lang))
        np.put_along_axis(allowed, order[which, :size], 1, axis=1)
        pi, total = em(allowed, which) if size > 1 else (allowed, alone[which, order[:, 0]] + base)
        value = total - p.penalty * size * np.log(np.maximum(2, n_words[which]))
        more = value > top[which]
        pick[which[more]], top[which[more]] = pi[more], value[more]
        if size >= p.least_tries:
            which = which[more]
        if not len(which):
            break
    pick[pick < p.min_share] = 0
    return pick / np.maximum(pick.sum(1, keepdims=True), 1e-300)


def mixtures(docs: DataFrame, model: dict, keep: list[str], p: LanguageParams = LanguageParams(), out: tuple[str, str, str] = ("lang_pred", "score", "proportions")) -> DataFrame:
    """Columns `keep`, and as `out` the language, its proportion, and all proportions of the chosen set as a map."""
    text = "text" if "text" in keep else "_text"
    shared = docs.sparkSession.sparkContext.broadcast((model["langs"], model["logp"]))  # 2^bits x languages numbers a gram order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        for b in batches:
            pred, score, mixed = [], [], []
            for lo, hi, data, offs in tb.text_blocks(b.column(text)):
                share, has = _mixtures(data, offs, logp, p) if langs else (np.zeros((hi - lo, 1)), np.zeros(hi - lo, bool))
                top = share.argmax(1)
                pred += [langs[k] if ok else "und" for k, ok in zip(top, has, strict=True)]
                score += np.where(has, share.max(1), 0.0).clip(0, 1).tolist()
                mixed += [[(langs[k], float(x[k])) for k in np.flatnonzero(x)] if ok else [] for x, ok in zip(share, has, strict=True)]
            arrays = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], [*keep, *out])

    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").alias(text))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes if c in keep]
    return rows.mapInArrow(run, ", ".join([*kept, f"`{out[0]}` string, `{out[1]}` double, `{out[2]}` map<string,double>"]))
