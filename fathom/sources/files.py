"""Readers of CSV, JSON and Parquet with the dialect's type rules, a reader by file extension, and series."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.sources import custom

SAMPLE_ROWS = 100
_TIME = re.compile(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?$")
_INT = re.compile(r"[+-]?\d{1,19}$")
_REAL = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet", "arrow": "arrow", "feather": "arrow", "ipc": "arrow", "avro": "avro", "xlsx": "xlsx", "db": "sqlite", "sqlite": "sqlite", "sqlite3": "sqlite"}


def sniff(values: list[str | None]) -> T.DataType:
    """TIMESTAMP, BIGINT, DOUBLE or VARCHAR by a sample; a plain date stays text."""
    seen = [v for v in values if v not in (None, "")]
    for pattern, kind in ((_TIME, T.TimestampNTZType()), (_INT, T.LongType()), (_REAL, T.DoubleType())):
        if seen and all(pattern.match(v) for v in seen):
            return kind
    return T.StringType()


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """All files of a glob. Types come from the first rows, so the data is read once; fields that don't parse are NULL."""
    opts = {"sep": delimiter, "header": str(header).lower(), "quote": '"', "escape": '"', "multiLine": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "enforceSchema": "false" if header else "true"}
    if schema is None:
        sample = spark.read.options(**opts).csv(path).limit(SAMPLE_ROWS)
        rows = sample.collect()
        schema = T.StructType([T.StructField(c, sniff([r[i] for r in rows])) for i, c in enumerate(sample.columns)])
    return spark.read.options(**opts).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array or lines of objects; nested values become their JSON text."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0][0].lstrip().startswith("[")
    df = spark.read.option("multiLine", str(array).lower()).option("primitivesAsString", "false").json(path)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_file(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """By extension."""
    ext = path.rsplit(".", 1)[-1].lower()
    kind = EXTENSIONS.get(ext)
    if kind is None:
        raise OSError(f"no reader for the extension of {path!r}")
    if kind in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if kind == "tsv" else ",")
    if kind == "json":
        return read_json(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path)
    return custom.read(spark, kind, path, table)


def generate_series(spark: SparkSession, *args: int) -> DataFrame:
    """(stop), (start, stop) or (start, stop, step), inclusive; 10 million rows at most."""
    start, stop, step = (0, args[0], 1) if len(args) == 1 else (*args, 1)[:3]
    if step == 0:
        raise ValueError("the step of a series can't be 0")
    end = stop + (1 if step > 0 else -1)
    if len(range(start, end, step)) > 10_000_000:
        raise ValueError("a series has 10 million rows at most")
    return spark.range(start, end, step).select(F.col("id").alias("generate_series"))
