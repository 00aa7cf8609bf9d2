"""Set operations by position, with one common type for each column: text wins, then floating point, then the wider integer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if T.StringType() in (a, b):
        return T.StringType()
    if a in _INTS and b in _INTS:
        return _INTS[max(_INTS.index(a), _INTS.index(b))]
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    raise TypeError(f"no common type for {a.simpleString()} and {b.simpleString()}")


def aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} columns against {len(b.columns)}")
    kinds = [common_type(x.dataType, y.dataType) for x, y in zip(a.schema, b.schema)]
    names = a.columns
    cast = lambda df: df.toDF(*[f"c{i}" for i in range(len(names))]).select(*[F.col(f"c{i}").cast(k).alias(n) for i, (k, n) in enumerate(zip(kinds, names))])
    return cast(a), cast(b)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = aligned(a, b)
    return a.unionAll(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return union_all(a, b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = aligned(a, b)
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = aligned(a, b)
    return a.subtract(b)


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = aligned(a, b)
    return a.intersectAll(b)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = aligned(a, b)
    return a.exceptAll(b)
