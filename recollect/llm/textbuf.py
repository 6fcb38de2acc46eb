"""Array views over Arrow text columns, so that operators work on whole batches without a Python string for each row.

A batch is cut into blocks of about `BLOCK` bytes, so that temporary arrays stay small whatever the batch; a document
that is longer than a block makes a block of its own. One longer than `LONG` bytes is worked on in pieces, from which
sums and sets are carried, so that it needs no array of its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
LONG = 1 << 20

_LOWER = np.arange(0x600, dtype=np.uint32)
for _c in range(0x600):
    if len(chr(_c).lower()) == 1:
        _LOWER[_c] = ord(chr(_c).lower())
#: Unicode's letters (categories L*), of all code points.
_LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)

MIX = np.uint64(0x9E3779B97F4A7C15)


def text_blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block. Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offs = np.frombuffer(offs, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + block, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and the offsets of its rows in them."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return chars, starts[offs]


def lowered(chars: np.ndarray) -> np.ndarray:
    """Lower case where it is one code point below U+0600."""
    return np.where(chars < 0x600, _LOWER[np.minimum(chars, 0x5FF)], chars)


def letters(chars: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    return _LETTER[chars]


def is_long(data: np.ndarray, offs: np.ndarray) -> bool:
    return len(offs) == 2 and len(data) > LONG


def cut_points(data: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(begin, end) of pieces of about `size` bytes that begin and end between characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield at, end
        at = end


def pieces(data: np.ndarray, before: int, size: int = BLOCK) -> Iterator[tuple[np.ndarray, int]]:
    """(code points, how many of them are of the piece before) of a long text's pieces; up to `before` are kept."""
    kept = np.zeros(0, np.uint32)
    for s, e in cut_points(data, size):
        chars = np.concatenate([kept, code_points(data[s:e], np.array([0, e - s]))[0]])
        yield chars, len(kept)
        kept = chars[max(0, len(chars) - before) :]


def doc_of(offs: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def row_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of each row's elements, 0 for empty rows; values may have several columns. `offs` covers all of them.

    Each row is summed on its own, so that equal rows have equal sums wherever they stand.
    """
    out, some = np.zeros((len(offs) - 1, *values.shape[1:])), offs[1:] > offs[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, offs[:-1][some], axis=0, dtype=np.float64)
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_buckets(chars: np.ndarray, n: int, bits: int, seed: int = 0) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; the last n-1 are missing."""
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    h = np.full(m, (n * 0x9E3779B1 + seed) & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ chars[k : k + m].astype(np.uint32)) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)
