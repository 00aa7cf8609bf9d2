"""Conditional functions and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

coalesce = ifnull = nvl = F.coalesce
least, greatest = F.least, F.greatest


def if_(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def cast_int(x: Column, kind: str = "int") -> Column:
    """Floating point to integer rounds half to even."""
    return F.bround(x.cast("double")).cast(kind)


def distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def in_list(x: Column, values: list) -> Column:
    """NULL-aware: without a match, NULL if the list has one."""
    found = x.isin([v for v in values if v is not None])
    return F.when(found, F.lit(True)).when(F.lit(None in values), F.lit(None).cast("boolean")).otherwise(found)
