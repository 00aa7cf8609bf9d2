"""COPY targets: one file of exactly the given name, written by one task, or, for a path that ends in ``/``, a folder of parts written in parallel."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.storage import delete_path, move


def _one_file(df: DataFrame, path: str, write) -> None:
    """Writes beside the target, then renames the only part file, so readers never see half a file."""
    spark = df.sparkSession
    jvm = spark._jvm
    draft = f"{path}.{uuid.uuid4().hex}"
    write(df.coalesce(1).write, draft)
    p = jvm.org.apache.hadoop.fs.Path(draft)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-"))
    move(spark, part.toString(), path)
    delete_path(spark, draft)
    target = jvm.org.apache.hadoop.fs.Path(path)
    delete_path(spark, jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.crc").toString())


def _parts(df: DataFrame, path: str, fmt: str, delimiter: str, header: bool) -> None:
    w = df.write.mode("overwrite")
    if fmt in ("csv", "tsv"):
        w.options(sep=delimiter, header=str(header).lower(), quote='"', escape='"', emptyValue="", timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)
    elif fmt in ("json", "ndjson"):
        w.option("ignoreNullFields", "false").json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise OSError(f"no writer of parts for format {fmt!r}")


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True) -> None:
    """Fields are quoted for delimiters, quotes, line ends and leading ``= + - @``; NULL is empty."""
    special = f"[{''.join(chr(92) + c for c in (delimiter, chr(34)))}\n\r]|^[=+\\-@]"

    def field(f: T.StructField):
        s = F.col(f"`{f.name}`").cast("string")
        text = isinstance(f.dataType, T.StringType)
        quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(s.rlike(special), quoted).otherwise(s) if text else s, F.lit(""))

    names = delimiter.join(f.name for f in df.schema)
    lines = df.select(F.concat_ws(delimiter, *[field(f) for f in df.schema]).alias("value"))
    if header:
        first = df.sparkSession.createDataFrame([(names,)], "value string").coalesce(1)
        lines = first.unionAll(lines.coalesce(1))
    _one_file(lines, path, lambda w, d: w.text(d))


def write_json(df: DataFrame, path: str, array: bool = True) -> None:
    """An array of objects, or lines of them."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    if array:
        at = rows.coalesce(1).withColumn("k", F.monotonically_increasing_id())
        body = at.select(F.concat(F.when(F.col("k") == 0, "  ").otherwise(", "), "value").alias("value"))
        edge = lambda s: df.sparkSession.createDataFrame([(s,)], "value string").coalesce(1)
        rows = edge("[").unionAll(body).unionAll(edge("]"))
    _one_file(rows, path, lambda w, d: w.text(d))


def write_parquet(df: DataFrame, path: str) -> None:
    _one_file(df, path, lambda w, d: w.parquet(d))


def write_arrow(df: DataFrame, path: str) -> None:
    """Batch by batch in one task; the file system must be one of pyarrow's."""
    draft = f"{path}.{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, name = fs.FileSystem.from_uri(draft) if "://" in draft or draft.startswith("file:") else (fs.LocalFileSystem(), draft)
        writer = None
        with where.open_output_stream(name) as out:
            for b in batches:
                writer = writer or pa.ipc.new_file(out, b.schema)
                writer.write_batch(b)
            (writer or pa.ipc.new_file(out, empty)).close()
        yield pa.RecordBatch.from_arrays([pa.array([True])], ["done"])

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(df.schema)
    df.coalesce(1).mapInArrow(run, "done boolean").collect()
    move(df.sparkSession, draft, path)


def copy_to(df: DataFrame, path: str, fmt: str | None = None, delimiter: str = ",", header: bool = True) -> None:
    fmt = (fmt or {"json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "parquet": "parquet", "arrow": "arrow", "feather": "arrow", "tsv": "tsv"}.get(path.rstrip("/").rsplit(".", 1)[-1].lower(), "csv")).lower()
    if path.endswith("/"):
        _parts(df, path, fmt, "\t" if fmt == "tsv" else delimiter, header)
    elif fmt in ("csv", "tsv"):
        write_csv(df, path, "\t" if fmt == "tsv" else delimiter, header)
    elif fmt in ("json", "ndjson"):
        write_json(df, path, fmt == "json")
    elif fmt == "parquet":
        write_parquet(df, path)
    elif fmt == "arrow":
        write_arrow(df, path)
    else:
        raise OSError(f"no writer for format {fmt!r}")
