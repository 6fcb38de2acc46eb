"""What the two vector operators share: which vectors take part, equal vectors as one, bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """Not null or empty, no null or non-finite component, not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def plain_zero(column: str, kind: str):
    """-0.0 as 0.0, so that equal vectors are equal keys."""
    return F.transform(column, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))


def kind_of(df: DataFrame, column: str) -> str:
    """The type that holds the components as they are: float only for floats."""
    return "float" if dict(df.dtypes)[column] == "array<float>" else "double"


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows (all, if there are fewer), by a hash of the key."""
    n = df.count()
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


def stack(column) -> np.ndarray:
    return np.stack(list(column)).astype(np.float64) if len(column) else np.zeros((0, 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest component is about 1; this rounds nothing."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of scaled vectors, the same for (a, b) and (b, a)."""
    return in_order(a, b) / np.sqrt(in_order(a, a) * in_order(b, b))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from left to right in double precision."""
    return np.cumsum(a * b, axis=1)[:, -1]
