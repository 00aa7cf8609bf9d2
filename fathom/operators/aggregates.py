"""Aggregates with FILTER, and grouping by everything that isn't one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filtered(agg, x: Column, where: Column) -> Column:
    """agg(x) FILTER (WHERE where)."""
    return agg(F.when(where, x))


def count_if(where: Column) -> Column:
    return F.count(F.when(where, F.lit(1)))


def string_agg(x: Column, sep: str = ",", distinct: bool = False) -> Column:
    """Values in ascending order; none gives NULL."""
    values = F.collect_set(x) if distinct else F.collect_list(x)
    return F.when(F.count(x) > 0, F.array_join(F.sort_array(values), sep))


def group_all(df: DataFrame, keys: Sequence[Column], aggs: Sequence[Column], having: Column | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(*aggs)
    return out if having is None else out.filter(having)
