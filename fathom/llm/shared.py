"""What the corpus operators have in common: shared storage and Arrow maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs on this machine (tests) a
    temporary folder is made and set; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fathom-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratches: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scratches:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Collects the paths given out in the block and deletes what is left in the list at its end: take out what must stay."""
    made: list[str] = []
    _scratches.append(made)
    try:
        yield made
    finally:
        _scratches.remove(made)
        for path in made:
            delete_path(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def rename(spark: SparkSession, old: str, new: str) -> None:
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {old} to {new}")


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def byte_size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


def others(columns: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Columns whose names don't clash (Spark ignores case) with ``taken``."""
    low = {t.lower() for t in taken}
    return [c for c in columns if c.lower() not in low]


def unused(columns: Sequence[str], name: str) -> str:
    """``name``, made longer until no column is called so."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def arrow_map(
    df: DataFrame,
    inputs: Sequence[str],
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], Sequence[pa.Array]]],
) -> DataFrame:
    """Columns computed batch by batch in Python from ``inputs``.

    ``keep`` columns pass through (those that clash with a new field are
    replaced, as ``withColumn`` does). ``make`` runs once in each task and
    returns the function from a batch of ``inputs`` to the new arrays.
    """
    keep = others(keep, [f.name for f in fields])
    tmp = [f"__in{i}" for i in range(len(inputs))]
    src = df.select(*[F.col(quoted(c)).alias(t) for c, t in zip(inputs, tmp)], *[F.col(quoted(c)) for c in keep])
    schema = T.StructType([*(src.schema[len(tmp) + i] for i in range(len(keep))), *fields])
    k = len(tmp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        names = [*keep, *(x.name for x in fields)]
        for b in batches:
            if b.num_rows:
                made = f(pa.RecordBatch.from_arrays(b.columns[:k], tmp))
                yield pa.RecordBatch.from_arrays([*b.columns[k:], *made], names)

    return src.mapInArrow(run, schema)
