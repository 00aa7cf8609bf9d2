"""Formats Spark has no reader for here: Arrow, Avro, XLSX and SQLite, as Python data sources.

A glob gives a partition for each file; SQLite tables are cut by rowid range and
Arrow files by record batch, so that large ones are read in parallel.
"""

from __future__ import annotations

import glob
import json
import re
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SQLITE_SLICE, ARROW_SLICE = 1_000_000, 16


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(path)) if re.search(r"[*?\[]", path) else [path]
    if not found:
        raise OSError(f"no file {path!r}")
    return found


class _Part(InputPartition):
    def __init__(self, file: str, start: int = 0, stop: int = 0):
        super().__init__((file, start, stop))
        self.file, self.start, self.stop = file, start, stop


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"fathom_{cls.kind}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self, schema, self.options)


class _Reader(DataSourceReader):
    def __init__(self, source: _Source, schema: T.StructType, options):
        self.source, self.schema, self.path, self.table = type(source), schema, options["path"], options.get("table")

    def partitions(self) -> list[_Part]:
        return [p for f in _files(self.path) for p in self.source.parts(f, self.table)]

    def read(self, part: _Part) -> Iterator:
        return self.source.rows(part, self.schema, self.table)


# -- Arrow -----------------------------------------------------------------------


def _open_arrow(file: str) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(pa.memory_map(file))


class ArrowSource(_Source):
    kind = "arrow"

    def schema(self) -> T.StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_open_arrow(_files(self.options["path"])[0]).schema, prefer_timestamp_ntz=True)

    @staticmethod
    def parts(file: str, table: str | None) -> list[_Part]:
        n = _open_arrow(file).num_record_batches
        return [_Part(file, i, min(n, i + ARROW_SLICE)) for i in range(0, n, ARROW_SLICE)]

    @staticmethod
    def rows(part: _Part, schema: T.StructType, table: str | None) -> Iterator[pa.RecordBatch]:
        r = _open_arrow(part.file)
        for i in range(part.start, part.stop):
            yield r.get_batch(i)


# -- Avro ------------------------------------------------------------------------

_AVRO = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "null": T.NullType(), "enum": T.StringType()}


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.raw[self.at]
            self.at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return (n >> 1) ^ -(n & 1)


def _avro_type(kind) -> T.DataType:
    if isinstance(kind, list):
        rest = [k for k in kind if k != "null"]
        if len(rest) != 1:
            raise ValueError("only unions with null are read")
        return _avro_type(rest[0])
    if isinstance(kind, dict):
        logical = kind.get("logicalType")
        if logical == "date":
            return T.DateType()
        if logical in ("timestamp-millis", "timestamp-micros", "local-timestamp-millis", "local-timestamp-micros"):
            return T.TimestampNTZType()
        if logical in ("time-millis", "time-micros"):
            return T.StringType()
        return _avro_type(kind["type"])
    return _AVRO[kind]


def _avro_value(kind, b: _Bytes):
    if isinstance(kind, list):
        return _avro_value(kind[b.long()], b)
    if isinstance(kind, dict):
        v, logical = _avro_value(kind["type"], b), kind.get("logicalType", "")
        if kind["type"] == "enum":
            return kind["symbols"][v]
        if logical == "date":
            return date(1970, 1, 1) + timedelta(days=v)
        if logical.startswith("time"):
            micros = v * 1000 if logical.endswith("millis") else v
            at = datetime(1970, 1, 1) + timedelta(microseconds=micros)
            return at if "timestamp" in logical else at.strftime("%H:%M:%S")
        if logical.startswith("local-timestamp"):
            return datetime(1970, 1, 1) + timedelta(microseconds=v * 1000 if logical.endswith("millis") else v)
        return v
    if kind == "null":
        return None
    if kind == "boolean":
        return b.take(1) == b"\1"
    if kind in ("int", "long", "enum"):
        return b.long()
    if kind == "float":
        return struct.unpack("<f", b.take(4))[0]
    if kind == "double":
        return struct.unpack("<d", b.take(8))[0]
    raw = b.take(b.long())
    return raw.decode() if kind == "string" else raw


def _avro_open(file: str) -> tuple[dict, str, _Bytes, bytes]:
    with open(file, "rb") as f:
        b = _Bytes(f.read())
    if b.take(4) != b"Obj\1":
        raise OSError(f"{file!r} is no Avro file")
    meta = {}
    while n := b.long():
        if n < 0:
            b.long()
            n = -n
        for _ in range(n):
            key = b.take(b.long()).decode()
            meta[key] = b.take(b.long())
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise OSError(f"Avro codec {codec!r} isn't read")
    return json.loads(meta["avro.schema"]), codec, b, b.take(16)


class AvroSource(_Source):
    kind = "avro"

    def schema(self) -> T.StructType:
        spec = _avro_open(_files(self.options["path"])[0])[0]
        return T.StructType([T.StructField(f["name"], _avro_type(f["type"])) for f in spec["fields"]])

    @staticmethod
    def parts(file: str, table: str | None) -> list[_Part]:
        return [_Part(file)]

    @staticmethod
    def rows(part: _Part, schema: T.StructType, table: str | None) -> Iterator[tuple]:
        spec, codec, b, mark = _avro_open(part.file)
        kinds = [f["type"] for f in spec["fields"]]
        while b.at < len(b.raw):
            n, raw = b.long(), b.take(b.long())
            block = _Bytes(zlib.decompress(raw, -15) if codec == "deflate" else raw)
            if b.take(16) != mark:
                raise OSError(f"{part.file!r} is damaged")
            for _ in range(n):
                yield tuple(_avro_value(k, block) for k in kinds)


# -- XLSX --------------------------------------------------------------------------

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet(file: str) -> list[list[str | float | None]]:
    with zipfile.ZipFile(file) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        name = min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))
        out: list[list] = []
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_NS}row"):
            cells: list = []
            for c in row:
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = len(cells)
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                cells += [None] * (at - len(cells) + 1)
                v, kind = c.find(f"{_NS}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text if kind in ("str", "b", "e") else float(v.text)
            out.append(cells)
        return out


class XlsxSource(_Source):
    """First sheet, names in row 1; a column is BIGINT, DOUBLE or VARCHAR."""

    kind = "xlsx"

    def schema(self) -> T.StructType:
        head, *rows = _sheet(_files(self.options["path"])[0]) or [[]]
        fields = []
        for i, name in enumerate(head):
            seen = [r[i] for r in rows if i < len(r) and r[i] is not None]
            number = bool(seen) and all(isinstance(v, float) for v in seen)
            kind = (T.LongType() if all(v == int(v) for v in seen) else T.DoubleType()) if number else T.StringType()
            fields.append(T.StructField(str(name), kind))
        return T.StructType(fields)

    @staticmethod
    def parts(file: str, table: str | None) -> list[_Part]:
        return [_Part(file)]

    @staticmethod
    def rows(part: _Part, schema: T.StructType, table: str | None) -> Iterator[tuple]:
        def fit(v, kind):
            if v is None:
                return None
            if isinstance(kind, T.StringType):
                return f"{v:g}" if isinstance(v, float) else v
            return (int(v) if isinstance(kind, T.LongType) else v) if isinstance(v, float) else None

        for r in _sheet(part.file)[1:]:
            yield tuple(fit(r[i] if i < len(r) else None, f.dataType) for i, f in enumerate(schema))


# -- SQLite ----------------------------------------------------------------------------


def _lite(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def sqlite_tables(path: str) -> list[str]:
    with _lite(_files(path)[0]) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


class SqliteSource(_Source):
    kind = "sqlite"

    def schema(self) -> T.StructType:
        with _lite(_files(self.options["path"])[0]) as con:
            cols = con.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not cols:
            raise OSError(f"no table {self.options['table']!r}")
        kind = lambda t: T.LongType() if "INT" in t else T.DoubleType() if any(x in t for x in ("REAL", "FLOA", "DOUB")) else T.StringType()
        return T.StructType([T.StructField(c[1], kind((c[2] or "").upper())) for c in cols])

    @staticmethod
    def parts(file: str, table: str | None) -> list[_Part]:
        with _lite(file) as con:
            try:
                lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {_name(table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID
                return [_Part(file, 0, -1)]
        return [] if lo is None else [_Part(file, i, min(i + SQLITE_SLICE - 1, hi)) for i in range(lo, hi + 1, SQLITE_SLICE)]

    @staticmethod
    def rows(part: _Part, schema: T.StructType, table: str | None) -> Iterator[tuple]:
        fits = {T.LongType: int, T.DoubleType: float, T.StringType: str}
        cols = ", ".join(_name(c) for c in schema.fieldNames())
        where = f" WHERE rowid BETWEEN {part.start} AND {part.stop}" if part.stop >= part.start else ""
        with _lite(part.file) as con:
            for r in con.execute(f"SELECT {cols} FROM {_name(table)}{where}"):
                yield tuple(None if v is None else fits[type(f.dataType)](v) for v, f in zip(r, schema))


SOURCES = {s.kind: s for s in (ArrowSource, AvroSource, XlsxSource, SqliteSource)}


def read(spark: SparkSession, kind: str, path: str, table: str | None = None) -> DataFrame:
    spark.dataSource.register(SOURCES[kind])
    if kind == "sqlite" and table is None:
        names = sqlite_tables(path)
        if len(names) != 1:
            raise OSError(f"{path!r} has {len(names)} tables; name one")
        table = names[0]
    r = spark.read.format(f"fathom_{kind}").option("path", path)
    return (r.option("table", table) if table else r).load()
