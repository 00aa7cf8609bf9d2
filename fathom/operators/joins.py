"""Joins. Which side is built or broadcast is left to the optimizer, which knows the sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

KINDS = ("inner", "left", "right", "full")


def join(a: DataFrame, b: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    if how not in KINDS:
        raise ValueError(f"unknown join {how!r}")
    return a.join(b, on, how)


def using(a: DataFrame, b: DataFrame, *cols: str, how: str = "inner") -> DataFrame:
    """The shared columns come out once."""
    return a.join(b, list(cols), how)


def natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """On all columns the sides have in common; without any, the product."""
    low = {c.lower() for c in b.columns}
    common = [c for c in a.columns if c.lower() in low]
    return a.join(b, common, how) if common else a.crossJoin(b)


def semi(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b, on, "left_semi")


def anti(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return a.join(b, on, "left_anti")
