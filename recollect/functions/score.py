"""Scores as column expressions. Everything rounds half up, so that other engines give the same digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking.
RECENCY_HALF_LIFE_DAYS, RECENCY_FLOOR = 180.0, 0.25
DECISION_WEIGHT, ENTITY_WEIGHT = 0.13, 0.02
SUPERSEDED_FACTOR = 0.7
CORROBORATION_CAP = 2.0


def rounded(x: Column, digits: int = 4) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def micros(ts: Column) -> Column:
    """Microseconds since 1970; times without a zone are the session's."""
    return F.unix_micros(ts.cast("timestamp"))


def age_days(ts: Column, now: str) -> Column:
    return (micros(F.lit(now)) - micros(ts)) / F.lit(86_400_000_000.0)


def recency(ts: Column, now: str, half_life: float = RECENCY_HALF_LIFE_DAYS, floor: float = RECENCY_FLOOR) -> Column:
    """2^(-age / half life), at least `floor`; 1 for the future and unknown times; a half life of 0 turns it off."""
    if half_life <= 0:
        return F.lit(1.0)
    age = age_days(ts, now)
    return F.when(ts.isNull() | (age <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(floor), F.pow(F.lit(2.0), -age / half_life)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def cosine_of_l2(d: Column) -> Column:
    """Of unit vectors."""
    return rounded(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d * d / 2)))


def tiebreak(query: Column, decisions: Column, entities: Column) -> Column:
    """Arrays of tokens; a factor from 1 to 1.15."""
    n = F.size(F.array_distinct(query))
    share = lambda other: F.size(F.array_intersect(query, other)) / n
    return F.when(n == 0, F.lit(1.0)).otherwise(1 + DECISION_WEIGHT * share(decisions) + ENTITY_WEIGHT * share(entities))


def band(primary: Column, primary_max: Column, secondary: Column, secondary_max: Column) -> Column:
    """Hits of the primary leg lie in [0.5, 1], those of the secondary alone in [0, 0.5]; maxima below 1 aren't stretched."""
    return F.when(primary.isNotNull(), 0.5 + 0.5 * primary / F.greatest(F.lit(1.0), primary_max)).otherwise(0.5 * secondary / F.greatest(F.lit(1.0), secondary_max))


def corroboration(n: Column, cap: float = CORROBORATION_CAP) -> Column:
    return rounded(F.least(F.lit(cap), 1 + F.log10(F.greatest(F.lit(1), n).cast("double"))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
