"""A stream of the whole lines of a growing text file; the offset is a byte position, so a restart goes on where it was.

The driver looks only for the last line end; the executors read the bytes, in ranges
of ``RANGE``. A line belongs to the range in which it begins, however long it is.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE = 64 << 20
_STEP = 1 << 20


def last_line_end(path: str, least: int = 0) -> int:
    """Position after the last line end at or beyond ``least``; ``least`` if there is none."""
    if not os.path.exists(path):
        return least
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > least:
            step = min(_STEP, at - least)
            f.seek(at - step)
            i = f.read(step).rfind(b"\n")
            if i >= 0:
                return at - step + i + 1
            at -= step
    return least


def lines_between(path: str, begin: int, end: int, first: int) -> Iterator[str]:
    """Lines that begin in begin..end; a line begins at ``first`` and after every line end. Only ``\\n`` ends a line; a ``\\r`` before it goes."""
    with open(path, "rb") as f:
        if begin > first:
            f.seek(begin - 1)
            f.readline()  # the line that began before
        else:
            f.seek(begin)
        while f.tell() < end:
            line = f.readline()
            if not line.endswith(b"\n"):
                return
            yield line[:-1].removesuffix(b"\r").decode()


def ranges(begin: int, end: int, size: int | None = None) -> list[tuple[int, int]]:
    size = size or RANGE
    return [(a, min(a + size, end)) for a in range(begin, end, size)]


@dataclass
class _Range(InputPartition):
    begin: int
    end: int
    first: int


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fathom_tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"])


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _head(self) -> str:
        """Of the first line, which stays while a file only grows."""
        if not os.path.exists(self.path):
            return ""
        with open(self.path, "rb") as f:
            line = f.readline(4096)
        return hashlib.sha256(line).hexdigest() if line.endswith(b"\n") or len(line) == 4096 else ""

    def initialOffset(self) -> dict:
        return {"at": 0, "head": ""}

    def latestOffset(self) -> dict:
        return {"at": last_line_end(self.path), "head": self._head()}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        rewritten = end["at"] < start["at"] or start["head"] and start["head"] != end["head"]
        begin = 0 if rewritten else start["at"]
        return [_Range(a, b, begin) for a, b in ranges(begin, end["at"])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for line in lines_between(self.path, partition.begin, partition.end, partition.first):
            held.append(line)
            if len(held) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def lines(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The same lines as a batch, column ``value``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array(list(lines_between(path, a, e, begin)), pa.string())], ["value"])

    parts = ranges(begin, end)
    return spark.createDataFrame(parts, "a long, e long").repartition(max(1, len(parts))).mapInArrow(run, "value string")


def tail(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("fathom_tail").option("path", path).load()


def tail_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a growing CSV file without its header line (a line that equals the column names)."""
    header = ",".join(x.split()[0].strip("`") for x in schema.split(","))
    return tail(spark, path).filter(F.col("value") != header).select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")


def tumbling(df: DataFrame, time_col: str, width: str, keys: list[str], aggs: list, late: str | None = None) -> DataFrame:
    """Counts and the like by window and keys; with ``late`` the state of windows older than that is dropped."""
    src = df.withWatermark(time_col, late) if late else df
    return src.groupBy(F.window(time_col, width), *keys).agg(*aggs).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *[c for c in _names(aggs)])


def _names(aggs: list) -> list:
    return [F.col(a._jc.toString().rsplit(" AS ", 1)[-1]) for a in aggs]
