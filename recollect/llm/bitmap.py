"""Bitmaps of hashed ids: a filter of bounded size that a scan applies before any row is shuffled.

A bit that several ids share lets through rows that aren't meant; an exact join after it takes them out again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 32 MB; beyond some 4 million ids more rows pass the filter, none fewer.
MOST_BITS = 1 << 28


def place(column: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def id_bitmap(ids: DataFrame, column: str, most: int = MOST_BITS) -> tuple[np.ndarray, int]:
    """The bitmap and its number of bits: 64 an id, and at most `most`. It is built in parts of 4 KB."""
    bits = 1 << 15
    n = ids.count()
    while bits < min(64 * n, most):
        bits *= 2
    at = place(column, bits) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most `most` / 32,768 rows
        out[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out, bits


def without(rows: DataFrame, ids: DataFrame, column: str, most: int = MOST_BITS) -> DataFrame:
    """`rows` whose `column` isn't in `ids` (both without nulls). Only rows that the bitmap can't tell are shuffled."""
    found, bits = id_bitmap(ids, column, most)
    shared = rows.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def hit(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    told = rows.withColumn("_hit", hit(place(column, bits)))
    doubtful = told.filter("_hit").join(ids.select(column), column, "left_anti")
    return told.filter("not _hit").unionByName(doubtful).select(rows.columns)
