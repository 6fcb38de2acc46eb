"""Fitting on a bounded sample of labelled rows: sample, features on executors, one task that fits, a model of fixed size."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_mod(column: str, mod: int):
    """crc32 of the id as text, modulo `mod`; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)


def label_sample(labels: DataFrame, key: str, label: str, max_rows: int, train) -> DataFrame:
    """At most `max_rows` labelled keys in an order of a hash of the key; repeated keys take their largest label.

    Keys far behind in that order are left out before the sort, so that it is small however many labels there are.
    """
    rows = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & train)
    rows = rows.groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).cast("int").alias("_label"))
    n, place = rows.count(), F.pmod(F.xxhash64("_key"), F.lit(1 << 40))
    if n > 2 * max_rows:
        rows = rows.filter(place < int((1.3 * max_rows + 300) / n * (1 << 40)))
    return rows.orderBy(place, "_key").limit(max_rows)


def with_sample(docs: DataFrame, sample: DataFrame, key: str, columns: list) -> DataFrame:
    """The sampled rows with their label. The sample has a proven bound (its limit), so it is broadcast."""
    return docs.select(F.col(key).alias("_key"), *columns).join(F.broadcast(sample), "_key")


def pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def ragged(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a binary column's rows in one array, and the rows' lengths, without a copy for each row."""
    flat, lens = [], []
    for c in column.chunks:
        _, offs, data = c.buffers()
        at = np.frombuffer(offs, np.int32)[c.offset : c.offset + len(c) + 1]
        if len(c):
            flat.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind) if data is not None and at[-1] > at[0] else np.zeros(0, kind))
            lens.append(np.diff(at) // np.dtype(kind).itemsize)
    return np.concatenate(flat or [np.zeros(0, kind)]), np.concatenate(lens or [np.zeros(0, np.int64)]).astype(np.int64)


def fit_in_task(features: DataFrame, fit: Callable[[pa.Table], bytes]) -> dict[str, np.ndarray]:
    """Runs `fit` over the rows in one task (they are a bounded sample) and brings back the model, whose size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        table = [pa.Table.from_batches(got) if got else None]
        got.clear()
        model = fit(table.pop())  # which is then the only holder of the features, and can let them go
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = features.repartition(1).mapInArrow(run, "model binary").collect()
    return unpack(bytes(rows[0]["model"]) if rows else fit(None))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))
