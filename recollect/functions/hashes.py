"""FNV-1a with 64 bits over UTF-16 units, as a column expression.

Longs don't wrap here, so the hash is kept as two halves of 32 bits: h * (2^40 + 435) has the low half lo * 435, and the
high half hi * 435 + lo * 2^8, each with what it carries, modulo 2^32.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a, 64 bits: the offset's halves, and the prime 2^40 + 435.
HIGH, LOW, FACTOR = 0xCBF29CE4, 0x84222325, 435
_MASK = 0xFFFFFFFF


def fnv_12(text: Column) -> Column:
    """The first 12 hex digits; null for null."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "utf-16be")), F.lit("(....)"), 1), lambda u: F.conv(u, 16, 10).cast("long"))

    def step(h: Column, unit: Column) -> Column:
        changed = h["lo"].bitwiseXOR(unit)
        low = changed * FACTOR
        high = h["hi"] * FACTOR + F.shiftright(low, 32) + F.shiftleft(changed.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), low.bitwiseAND(F.lit(_MASK)).alias("lo"))

    start = F.struct(F.lit(HIGH).cast("long").alias("hi"), F.lit(LOW).cast("long").alias("lo"))
    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.when(text.isNotNull(), F.aggregate(units, start, step, lambda h: F.substring(F.concat(half(h["hi"]), half(h["lo"])), 1, 12)))

