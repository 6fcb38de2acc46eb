"""Tenants and scopes: predicates that reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenant(rows: DataFrame, tenant_id: str) -> DataFrame:
    if not tenant_id:
        raise ValueError("a tenant is needed")
    return rows.filter(F.col("tenant_id") == tenant_id)


def scoped(rows: DataFrame, scope: str | None, everything: bool = False, with_global: bool = True) -> DataFrame:
    """A scope with what is global; without a scope only what is global; or everything. Signals never see `global`."""
    if everything:
        return rows
    if scope is None:
        return rows.filter(F.col("scope") == "global")
    return rows.filter(F.col("scope").isin(scope, "global") if with_global else F.col("scope") == scope)


def clamp_limit(limit: float | None, most: int = 100) -> int:
    """Between 1 and `most`; what isn't a number is 1."""
    try:
        return max(1, min(most, int(limit)))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return 1


def clamped(limit: Column, most: int = 100) -> Column:
    """The same for a column of doubles."""
    return F.when(limit.isNull() | F.isnan(limit) | (limit < 1), F.lit(1)).when(limit > most, F.lit(most)).otherwise(F.floor(limit).cast("int"))
