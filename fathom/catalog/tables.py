"""Versioned tables of parts.

A table is a list of part folders. Rows are added as a new part, of which alone the
constraints are checked (and its keys against the others'); changing or deleting
rows writes the touched parts anew. Parts are never changed, so readers are never
disturbed and a transaction is a snapshot of the lists. ``vacuum`` removes parts that
no table holds.
"""

from __future__ import annotations

import copy
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.errors import BindFailure, CatalogFailure, ConstraintFailure
from fathom.storage import delete_path, read_text, write_text


@dataclass
class Table:
    name: str
    schema: str  # JSON
    parts: list[str] = field(default_factory=list)  # folders of the current version
    key: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    limits: dict[str, int] = field(default_factory=dict)  # VARCHAR(n)

    @property
    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Catalog:
    """Tables by name (case doesn't matter), kept under ``root``; ``root`` must be shared storage on a cluster."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.tables: dict[str, Table] = {}
        self.views: dict[str, str] = {}
        self.before: tuple | None = None
        self.written: set[str] = set()
        self._file = f"{root}/catalog.json"
        if held := read_text(spark, self._file):
            held = json.loads(held)
            self.tables = {k: Table(**v) for k, v in held["tables"].items()}
            self.views = held["views"]
            for t in self.tables.values():
                self._show(t)

    def save(self) -> None:
        write_text(self.spark, self._file, json.dumps({"tables": {k: asdict(t) for k, t in self.tables.items()}, "views": self.views}))

    def vacuum(self) -> int:
        """Deletes the parts written here that neither a table nor an open transaction holds; how many."""
        held = {p for tables in (self.tables, self.before[0] if self.before else {}) for t in tables.values() for p in t.parts}
        gone = self.written - held
        for p in gone:
            delete_path(self.spark, p)
        self.written &= held
        return len(gone)

    def get(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise CatalogFailure(f"there is no table {name!r}")
        return self.tables[name.lower()]

    def _read(self, t: Table, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(t.struct).parquet(*parts) if parts else self.spark.createDataFrame([], t.struct)

    def frame(self, t: Table) -> DataFrame:
        return self._read(t, t.parts)

    def _show(self, t: Table) -> None:
        self.frame(t).createOrReplaceTempView(t.name)

    def create(self, t: Table, rows: DataFrame | None = None, replace: bool = False, if_missing: bool = False) -> None:
        if t.name.lower() in self.tables and not replace:
            if if_missing:
                return
            raise CatalogFailure(f"there is a table {t.name!r} already")
        if rows is not None:
            t.parts = [self._part(t, rows)]
        self.tables[t.name.lower()] = t
        self._show(t)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if self.tables.pop(name.lower(), None) is None and not if_exists:
            raise CatalogFailure(f"there is no table {name!r}")
        self.spark.catalog.dropTempView(name)

    def _part(self, t: Table, rows: DataFrame) -> str:
        new = f"{self.root}/{t.name.lower()}/{uuid.uuid4().hex}"
        rows.write.parquet(new)
        self.written.add(new)
        return new

    def _set(self, t: Table, parts: list[str]) -> None:
        t.parts = parts
        self._show(t)

    def check(self, t: Table, rows: DataFrame, others: list[str], columns: set[str] | None = None) -> None:
        """The constraints on ``rows`` (on these columns, all by default), whose keys mustn't be in the parts ``others`` either."""
        of = lambda c: columns is None or c.lower() in columns
        bad = {f"{t.name}.{c} can't be NULL": F.col(f"`{c}`").isNull() for c in dict.fromkeys([*t.required, *t.key]) if of(c)}
        bad |= {f"{t.name}.{c} holds {n} characters at most": F.length(f"`{c}`") > n for c, n in t.limits.items() if of(c)}
        if bad:  # one pass for all
            found = rows.agg(*[F.max(c.cast("int")).alias(f"c{i}") for i, c in enumerate(bad.values())]).first()
            for i, said in enumerate(bad):
                if found[i]:
                    raise ConstraintFailure(said)
        if t.key and any(map(of, t.key)):
            keys = [f"`{c}`" for c in t.key]
            twice = not rows.groupBy(*keys).count().filter("count > 1").isEmpty()
            if twice or others and not rows.select(*keys).join(self._read(t, others).select(*keys), t.key, "left_semi").isEmpty():
                raise ConstraintFailure(f"the primary key of {t.name} isn't unique")

    def insert(self, name: str, rows: DataFrame, columns: list[str] | None = None) -> int:
        t = self.get(name)
        names = t.struct.fieldNames()
        given = columns or names
        if len(given) != len(rows.columns) or len({c.lower() for c in given}) != len(given):
            raise CatalogFailure(f"{len(rows.columns)} values for the columns {given}")
        self._known(t, given)
        low = {c.lower(): i for i, c in enumerate(given)}
        rows = rows.toDF(*[f"c{i}" for i in range(len(given))])
        full = rows.select(*[(F.col(f"c{low[f.name.lower()]}") if f.name.lower() in low else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.struct])
        new = self._part(t, full)
        self.check(t, self._read(t, [new]), t.parts)
        self._set(t, [*t.parts, new])
        return self._read(t, [new]).count()

    @staticmethod
    def _known(t: Table, columns) -> None:
        known = {c.lower() for c in t.struct.fieldNames()}
        for c in columns:
            if c.lower() not in known:
                raise BindFailure(f"there is no column {c!r} in {t.name}")

    def _touched(self, t: Table, hits: DataFrame) -> dict[str, int]:
        """Part -> number of the rows of ``hits``, which is a filter of the frame."""
        if not t.parts:
            return {}
        part = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]{32})/[^/]*$", 1)
        found = {r[0]: r[1] for r in hits.groupBy(part).count().collect()}
        return {p: found[p.rsplit("/", 1)[-1]] for p in t.parts if p.rsplit("/", 1)[-1] in found}

    def _replace(self, t: Table, touched: dict[str, int], rows: DataFrame, columns: set[str] | None, more: list[str] = ()) -> None:
        rest = [p for p in t.parts if p not in touched]
        new = [self._part(t, rows)] if touched else []
        if columns is not None and new:
            self.check(t, self._read(t, new), [*rest, *more], columns)
        self._set(t, [*rest, *new, *more])

    def update(self, name: str, sets: dict[str, str], where: str | None) -> int:
        t = self.get(name)
        self._known(t, sets)
        hit = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        touched = self._touched(t, self.frame(t).filter(hit))
        low = {k.lower(): v for k, v in sets.items()}
        df = self._read(t, list(touched))
        new = df.select(*[F.when(hit, F.expr(low[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")).alias(f.name) if f.name.lower() in low else F.col(f"`{f.name}`") for f in t.struct])
        self._replace(t, touched, new, set(low))
        return sum(touched.values())

    def delete(self, name: str, where: str | None) -> int:
        t = self.get(name)
        if where is None:
            n = self.frame(t).count()
            self._set(t, [])
            return n
        hit = F.coalesce(F.expr(where), F.lit(False))
        touched = self._touched(t, self.frame(t).filter(hit))
        self._replace(t, touched, self._read(t, list(touched)).filter(~hit), None)
        return sum(touched.values())

    def merge(self, name: str, source: DataFrame, key: tuple[str, str], sets: dict[str, str] | None, insert: tuple[list[str], list[str]] | None, alias: str) -> int:
        """Matches of the key are updated, in the parts that have any, the other rows of ``source`` become a new part.

        A key that is several times in the source and matches is an error; equal rows of the target are all updated.
        """
        t = self.get(name)
        self._known(t, [*(sets or {}), *(insert[0] if insert else [])])
        src = source.alias(alias)
        mine = self.frame(t).alias(name)
        theirs, ours = self._sides(src, key)
        keys = src.select(F.expr(theirs).alias("__key"))
        target = self.frame(t).alias(name).select(F.expr(ours).alias("__key"))
        if not keys.groupBy("__key").count().filter("count > 1").join(target, "__key", "left_semi").isEmpty():
            raise ConstraintFailure("a row of the target matches several of the source")
        changed, more = 0, []
        on = F.expr(f"{key[0]} = {key[1]}")
        if insert:
            new = dict(zip([c.lower() for c in insert[0]], insert[1]))
            rows = src.join(mine, on, "left_anti").select(*[F.expr(new.get(f.name.lower(), "null")).cast(f.dataType).alias(f.name) for f in t.struct])
            part = self._part(t, rows)
            self.check(t, self._read(t, [part]), t.parts)
            changed, more = self._read(t, [part]).count(), [part]
        touched: dict[str, int] = {}
        low = {k.lower(): v for k, v in (sets or {}).items()}
        if low:
            touched = self._touched(t, mine.join(src, on, "left_semi"))
            changed += sum(touched.values())
        rows = self._read(t, list(touched)).alias(name)
        if touched:
            both = rows.join(src.withColumn("__s", F.lit(True)).alias(alias), on, "left")
            cols = [F.when(F.col("__s"), F.expr(low[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f"{name}.`{f.name}`")).alias(f.name) if f.name.lower() in low else F.col(f"{name}.`{f.name}`").alias(f.name) for f in t.struct]
            rows = both.select(*cols)
        self._replace(t, touched, rows, set(low) if low else None, more)
        return changed

    @staticmethod
    def _sides(src: DataFrame, key: tuple[str, str]) -> tuple[str, str]:
        """The source's side of the condition, then the target's."""
        from pyspark.errors import AnalysisException

        for a, b in (key[::-1], key):
            try:
                src.select(F.expr(a)).schema  # noqa: B018 - resolved or not
                return a, b
            except AnalysisException:
                continue
        raise BindFailure(f"neither side of {key[0]} = {key[1]} is a column of the source")

    def alter(self, name: str, schema: T.StructType, rows: DataFrame | None = None) -> None:
        """A new schema; without ``rows`` the parts stay, and columns they lack are NULL."""
        t = self.get(name)
        if rows is not None:
            parts = [self._part(t, rows)] if t.parts else []
        else:
            parts = t.parts
        t.schema = schema.json()
        self._set(t, parts)

    # -- transactions ------------------------------------------------------------

    def begin(self) -> None:
        if self.before:
            raise CatalogFailure("a transaction is open already")
        self.before = (copy.deepcopy(self.tables), dict(self.views))

    def commit(self) -> None:
        if not self.before:
            raise CatalogFailure("no transaction is open")
        self.before = None

    def rollback(self) -> None:
        if not self.before:
            raise CatalogFailure("no transaction is open")
        gone = set(self.tables) - set(self.before[0])
        (self.tables, self.views), self.before = self.before, None
        for name in gone:
            self.spark.catalog.dropTempView(name)
        for t in self.tables.values():
            self._show(t)
