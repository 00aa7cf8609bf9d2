"""Ordering, limits and distinct rows with the dialect's null placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asc(c: Column | str) -> Column:
    """Ascending, nulls last."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    """Descending, nulls first."""
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_first()


def order_by(df: DataFrame, *keys: Column | str | int, descending: tuple[int, ...] = ()) -> DataFrame:
    """Keys may be columns, names or ordinals from 1; ``descending`` has the positions of descending keys."""
    cols = [F.col(df.columns[k - 1]) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[desc(c) if i in descending else asc(c) for i, c in enumerate(cols)])


def limit(df: DataFrame, n: int | None, offset: int = 0) -> DataFrame:
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)


def top_k(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """A bounded heap in every partition, merged at the end; no full sort."""
    return df.orderBy(*keys).limit(k)
