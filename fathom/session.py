"""The engine: SQL in the dialect over files, tables and views of one Spark session."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.catalog.tables import Catalog, Table
from fathom.catalog.views import LiveView
from fathom.errors import BindFailure, CatalogFailure, SyntaxFailure, translated
from fathom.operators import windows as W
from fathom.plans import rewriter as R
from fathom.plans.arithmetic import Arithmetic, decide
from fathom.plans.lexer import Token, closing, split_args, split_statements, text, tokens, words
from fathom.plans.names import TYPES, type_name
from fathom.sources import files, sinks
from fathom.storage import fresh_path

_NAME = r'("(?:[^"]|"")+"|\w+)'
_SHOWN = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "binary": "BLOB", "smallint": "SMALLINT", "tinyint": "TINYINT", "void": "NULL"}


def _plain(name: str) -> str:
    return name[1:-1].replace('""', '"') if name.startswith('"') else name


class Result:
    """A lazy result."""

    def __init__(self, df: DataFrame):
        self.df = df
        self._rows: list | None = None
        self._at = 0

    @property
    def column_names(self) -> list[str]:
        return self.df.columns

    def _all(self) -> list[tuple]:
        if self._rows is None:
            self._rows = [tuple(r) for r in self.df.collect()]
        return self._rows

    @property
    def row_count(self) -> int:
        return len(self._all())

    def fetchall(self) -> list[tuple]:
        return self._all()

    def fetchone(self) -> tuple | None:
        self._at += 1
        return self._all()[self._at - 1] if self._at <= len(self._all()) else None

    def fetchdf(self):
        return self.df.toPandas()

    def fetchnumpy(self) -> dict:
        return {c: v.to_numpy() for c, v in self.df.toPandas().items()}

    def show(self, n: int = 20) -> None:
        self.df.show(n, truncate=False)


class Engine:
    def __init__(self, spark: SparkSession | None = None, path: str | None = None):
        self.spark = spark or SparkSession.builder.appName("fathom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.cteRecursionLevelLimit", "1000").getOrCreate()
        self.spark.conf.set("spark.sql.debug.maxToStringFields", "100000")  # types are read from plans
        self.path = path
        self.catalog = Catalog(self.spark, path or fresh_path(self.spark, "database"))
        self.live: dict[str, LiveView] = {}
        self.extensions: dict[str, object] = {}
        self._views = 0
        self.closed = False

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed and self.path:
            self.catalog.save()
            self.catalog.vacuum()
        self.closed = True

    # -- entry points --------------------------------------------------------------

    def sql(self, sql: str) -> Result:
        """All statements in turn; the result of the last."""
        out = None
        try:
            for s in split_statements(sql):
                out = self._statement(s)
        except Exception as e:
            made = translated(e)
            if made is e:
                raise
            raise made from e
        if out is None:
            raise SyntaxFailure("no statement")
        return Result(out)

    execute = sql

    def table(self, name: str) -> DataFrame:
        return self.catalog.frame(self.catalog.get(name))

    def register_function(self, name: str, f: Callable, kind: str | T.DataType) -> None:
        """A Python function that gets and returns a pandas Series, callable from SQL; Arrow batches, not rows."""
        self.spark.udf.register(name, F.pandas_udf(f, kind))

    def load_extension(self, module: str) -> None:
        """Imports a module by name and calls its ``register(engine)``."""
        import importlib

        if not re.fullmatch(r"[A-Za-z_][\w.]*", module):
            raise CatalogFailure("extensions are named, not pathed")
        loaded = importlib.import_module(module)
        loaded.register(self)
        self.extensions[module] = loaded

    def unload_extension(self, module: str) -> None:
        """Calls the module's ``unregister(engine)``, if it has one, and forgets it."""
        if module not in self.extensions:
            raise CatalogFailure(f"the extension {module!r} isn't loaded")
        getattr(self.extensions.pop(module), "unregister", lambda engine: None)(self)

    # -- queries ---------------------------------------------------------------------

    def _view(self, df: DataFrame) -> str:
        self._views += 1
        name = f"__source_{self._views}"
        df.createOrReplaceTempView(name)
        return name

    def _sources(self, toks: list[Token]) -> list[Token]:
        """File literals and table functions in the place of a table, and views, by name of a temporary view.

        A place of a table is what follows FROM, JOIN or a comma of the FROM list at the
        same depth of a query; FROM inside a call (EXTRACT, TRIM) isn't one.
        """
        out: list[Token] = []
        levels = [{"query": True, "from": False, "table": False}]
        i = 0
        while i < len(toks):
            t, now = toks[i], levels[-1]
            before = [x.up for x in out if x.kind != "space"][-2:]
            nxt = next((j for j in range(i + 1, len(toks)) if toks[j].kind != "space"), None)
            after = toks[nxt] if nxt is not None else None
            if t.kind == "space":
                out.append(t)
                i += 1
                continue
            ready = now["table"]
            now["table"] = False
            if t.kind == "string" and ready:
                out.append(Token("word", self._view(files.read_file(self.spark, t.text[1:-1].replace("''", "'")))))
            elif t.kind == "word" and ready and t.up in R.TABLE_FUNCTIONS and after is not None and after.text == "(":
                end = closing(toks, nxt)
                args = [text(a).strip() for a in split_args(toks[nxt + 1 : end])]
                out.append(Token("word", self._view(self._table_function(t.up, args))))
                i = end
            elif t.text == "(":
                out.append(t)
                levels.append({"query": ready, "from": ready, "table": ready})
            elif t.text == ")":
                out.append(t)
                if len(levels) > 1:
                    levels.pop()
            else:
                if t.kind == "word" and t.up in ("SELECT", "VALUES", "WITH"):
                    now.update(query=True, **{"from": False})
                elif t.kind == "word" and now["query"] and (t.up == "FROM" and not (before[-1:] == ["DISTINCT"] and before[:1] in (["IS"], ["NOT"])) or t.up == "JOIN"):
                    now.update({"from": True, "table": True})
                elif t.kind == "word" and t.up in ("WHERE", "GROUP", "ORDER", "HAVING", "QUALIFY", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW"):
                    now["from"] = False
                elif t.text == "," and now["from"]:
                    now["table"] = True
                elif t.kind == "word" and t.up == "LATERAL" and ready:
                    now["table"] = True
                name = t.text.lower() if t.kind == "word" else _plain(t.text).lower() if t.kind == "quoted" else None
                if ready and name in self.live:
                    self.live[name].current(self.spark).createOrReplaceTempView(name)
                elif ready and name in self.catalog.views:
                    self.query(self.catalog.views[name]).createOrReplaceTempView(name)
                out.append(t)
            i += 1
        return out

    def _table_function(self, name: str, args: list[str]) -> DataFrame:
        if name == "GENERATE_SERIES":
            return files.generate_series(self.spark, *[int(a.replace(" ", "")) for a in args])
        paths = [a[1:-1].replace("''", "'") for a in args if a.startswith("'")]
        if name == "SQLITE_SCAN":
            return files.custom.read(self.spark, "sqlite", paths[0], paths[1] if len(paths) > 1 else None)
        kind = name.split("_")[1].lower()
        read = {"csv": files.read_csv, "json": files.read_json, "parquet": files.read_parquet}
        return read[kind](self.spark, paths[0]) if kind in read else files.custom.read(self.spark, kind, paths[0])

    def rewrite(self, sql: str, table: str | None = None) -> str:
        """The Spark SQL of a query, or of an expression over ``table``."""
        toks = R.filter_over(R.qualify(R.values_names(self._sources(tokens(sql)))))
        toks = R.names_and_functions(Arithmetic()(toks))
        whole = "{}" if table is None else f"SELECT ({{}}) AS x FROM {table}"
        return decide(text(R.null_order(toks)), lambda s: self.spark.sql(whole.replace("{}", s))._jdf.queryExecution().analyzed().toString())

    def query(self, sql: str) -> DataFrame:
        return W.distributed(self._planned(sql))

    def _planned(self, sql: str) -> DataFrame:
        out = self.spark.sql(self.rewrite(sql))
        if re.match(r"\s*VALUES\b", sql, re.I):
            return out.toDF(*[f"column{i}" for i in range(len(out.columns))])
        return out

    # -- statements -------------------------------------------------------------------

    def _message(self, schema: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def _count(self, n: int) -> DataFrame:
        return self._message("Count bigint", (n,))

    def _statement(self, s: str) -> DataFrame:
        for pattern, f in self._STATEMENTS:
            if m := re.match(pattern, s, re.I | re.S):
                out = f(self, m)
                return out if out is not None else self._count(0)
        return self.query(s)

    def _create(self, m: re.Match) -> None:
        name, replace, missing = _plain(m["name"]), bool(m["replace"]), bool(m["missing"])
        if m["body"]:
            df = self.query(m["body"])
            self.catalog.create(Table(name, df.schema.json()), df, replace, missing)
            return
        t, fields = Table(name, ""), []
        toks = tokens(m["cols"])
        for spec in split_args(toks):
            spec = [spec[i] for i in words(spec)]
            if spec[0].up == "PRIMARY":
                t.key = [_plain(x.text) for x in spec[3:-1] if x.text != ","]
                continue
            col = _plain(spec[0].text)
            kind = spec[1].up
            rest = " ".join(x.up for x in spec[2:])
            if kind in ("VARCHAR", "CHAR", "TEXT", "STRING") and (n := re.match(r"\( (\d+) \)", rest)):
                t.limits[col] = int(n[1])
            ddl = TYPES.get(kind, kind.lower())
            fields.append(self.spark.createDataFrame([], f"`{col}` {ddl}").schema[0])
            if "PRIMARY KEY" in rest:
                t.key = [col]
            if "NOT NULL" in rest:
                t.required.append(col)
        t.schema = T.StructType(fields).json()
        self.catalog.create(t, None, replace, missing)

    def _view_statement(self, m: re.Match) -> None:
        name, body = _plain(m["name"]), m["body"]
        low = name.lower()
        if not m["replace"] and (low in self.catalog.views or low in self.live or low in self.catalog.tables):
            raise CatalogFailure(f"there is a relation {name!r} already")
        if not m["live"]:
            self.catalog.views[low] = body
            return
        found = re.findall(r"(?:FROM|JOIN)\s+(?:read_\w+\s*\(\s*)?'([^']+)'", body, re.I)
        if len(found) != 1 or re.search(r"\bJOIN\b", body, re.I):
            raise BindFailure("a live view reads exactly one file")
        grows = bool(re.fullmatch(r"\s*SELECT\s+\*\s+FROM\s+'[^']+\.(?:csv|tsv)'\s*", body, re.I))
        self.live[low] = LiveView(found[0], lambda: self.query(body), self._stored, grows, "\t" if found[0].endswith(".tsv") else ",")

    def _stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.catalog.root}/live/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, m: re.Match) -> None:
        name = _plain(m["name"])
        if m["kind"].upper() == "VIEW":
            if self.catalog.views.pop(name.lower(), None) is None and self.live.pop(name.lower(), None) is None and not m["exists"]:
                raise CatalogFailure(f"there is no view {name!r}")
        else:
            self.catalog.drop(name, bool(m["exists"]))

    def _alter(self, m: re.Match) -> None:
        name, what = _plain(m["name"]), m["what"].upper()
        t = self.catalog.get(name)
        df = self.catalog.frame(t)
        words_ = re.findall(_NAME, m["rest"])
        if what == "ADD":
            if _plain(words_[0]).lower() in {c.lower() for c in df.columns}:
                raise BindFailure(f"there is a column {words_[0]} already")
            added = T.StructType([*t.struct, T.StructField(_plain(words_[0]), self.spark.createDataFrame([], f"x {type_name(words_[1])}").schema[0].dataType)])
            self.catalog.alter(name, added)
            return
        if _plain(words_[0]).lower() not in {c.lower() for c in df.columns}:
            raise BindFailure(f"there is no column {words_[0]}")
        df = df.drop(_plain(words_[0])) if what == "DROP" else df.withColumnRenamed(_plain(words_[0]), _plain(words_[-1]))
        self.catalog.alter(name, df.schema, df)

    def _insert(self, m: re.Match) -> DataFrame:
        cols = [_plain(c) for c in re.findall(_NAME, m["cols"])] if m["cols"] else None
        return self._count(self.catalog.insert(_plain(m["name"]), self.query(m["body"]), cols))

    def _sets(self, sets: str, table: str) -> dict[str, str]:
        out = {}
        for a in split_args(tokens(sets)):
            c, _, e = text(a).partition("=")
            out[_plain(c.strip().split(".")[-1])] = self.rewrite(e.strip(), table)
        return out

    def _update(self, m: re.Match) -> DataFrame:
        name = _plain(m["name"])
        return self._count(self.catalog.update(name, self._sets(m["sets"], f"`{name}`"), self.rewrite(m["where"], f"`{name}`") if m["where"] else None))

    def _delete(self, m: re.Match) -> DataFrame:
        name = _plain(m["name"])
        return self._count(self.catalog.delete(name, self.rewrite(m["where"], f"`{name}`") if m["where"] else None))

    def _merge(self, m: re.Match) -> DataFrame:
        name, src = _plain(m["name"]), _plain(m["src"])
        source = self.catalog.frame(self.catalog.get(src)) if src.lower() in self.catalog.tables else self.spark.table(src)
        up = re.search(r"WHEN\s+MATCHED\s+THEN\s+UPDATE\s+SET\s+(.*?)(?=\s+WHEN\s+NOT|\s*$)", m["when"], re.I | re.S)
        ins = re.search(r"WHEN\s+NOT\s+MATCHED\s+THEN\s+INSERT\s*(\([^)]*\))?\s*VALUES\s*\((.*)\)", m["when"], re.I | re.S)
        insert = None
        if ins:
            cols = [_plain(c) for c in re.findall(_NAME, ins[1])] if ins[1] else self.catalog.get(name).struct.fieldNames()
            insert = (cols, [self.rewrite(text(a).strip(), f"`{src}`") for a in split_args(tokens(ins[2]))])
        return self._count(self.catalog.merge(name, source, (m["a"], m["b"]), self._sets(up[1], f"`{name}` JOIN `{src}`") if up else None, insert, src))

    def _copy(self, m: re.Match) -> DataFrame:
        opts = {k.lower(): v.strip("'") for k, v in re.findall(r"(FORMAT|DELIMITER|HEADER)\s+('[^']*'|\w+)", m["opts"] or "", re.I)}
        path, what = m["path"], m["what"].strip()
        if m["way"].upper() == "FROM":
            t = self.catalog.get(_plain(what))
            kind = opts.get("format", "").lower()
            rows = files.read_csv(self.spark, path, opts.get("delimiter", ","), opts.get("header", "true").lower() != "false", None if opts.get("header", "true").lower() != "false" else t.struct) if kind == "csv" or not kind and path.endswith((".csv", ".tsv")) else files.read_file(self.spark, path)
            return self._count(self.catalog.insert(t.name, rows))
        df = self.query(what[1:-1]) if what.startswith("(") else self.query(f"SELECT * FROM {what}")
        seen = Observation()
        sinks.copy_to(df.observe(seen, F.count(F.lit(1)).alias("n")), path, opts.get("format"), opts.get("delimiter", ","), opts.get("header", "true").lower() != "false")
        return self._count(seen.get["n"])

    def _columns(self, df: DataFrame, t: Table | None = None) -> list[tuple]:
        key, req = (t.key, t.required) if t else ([], [])
        shown = lambda f: f"VARCHAR({t.limits[f.name]})" if t and f.name in t.limits else _SHOWN.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
        return [(f.name, shown(f), "NO" if f.name in key or f.name in req else "YES", "PRI" if f.name in key else None, None, None) for f in df.schema]

    def _describe(self, m: re.Match) -> DataFrame:
        what = m["what"].strip()
        t = self.catalog.tables.get(_plain(what).lower())
        df = self.catalog.frame(t) if t else self._planned(what if re.match(r"(SELECT|WITH|VALUES)\b", what, re.I) else f"SELECT * FROM {what}")
        return self._message("column_name string, column_type string, `null` string, key string, `default` string, extra string", *self._columns(df, t))

    def _show(self, m: re.Match) -> DataFrame:
        what, like = m["what"].upper(), m["like"]
        fits = lambda n: like is None or re.fullmatch(re.escape(like).replace("%", ".*").replace("_", "."), n) is not None
        if what == "TABLES":
            names = sorted([t.name for t in self.catalog.tables.values()] + list(self.catalog.views) + list(self.live))
            return self._message("name string", *[(n,) for n in names if fits(n)])
        if what == "DATABASES" or what == "SCHEMAS":
            return self._message("database_name string", ("main",))
        return self._describe(re.match(r"(?P<what>.*)", m["of"]))

    def _pragma(self, m: re.Match) -> DataFrame:
        if m["name"].lower() == "database_list":
            return self._message("seq bigint, name string, file string", (0, "main", self.path))
        if m["name"].lower() == "table_info":
            t = self.catalog.get(m["arg"])
            rows = [(i, c[0], c[1], c[2] == "NO", c[4], c[3] == "PRI") for i, c in enumerate(self._columns(self.catalog.frame(t), t))]
            return self._message("cid bigint, name string, type string, notnull boolean, dflt_value string, pk boolean", *rows)
        raise SyntaxFailure(f"unknown pragma {m['name']}")

    def _explain(self, m: re.Match) -> DataFrame:
        return self._message("plan string", (self._planned(m["body"])._jdf.queryExecution().toString(),))

    def _transaction(self, m: re.Match) -> None:
        {"BEGIN": self.catalog.begin, "COMMIT": self.catalog.commit, "ROLLBACK": self.catalog.rollback}[m[1].upper()]()

    def _truncate(self, m: re.Match) -> None:
        self.catalog.delete(_plain(m["name"]), None)

    _STATEMENTS = (
        (rf"CREATE\s+(?P<replace>OR\s+REPLACE\s+)?TABLE\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?(?P<name>{_NAME})\s*(?:AS\s+(?P<body>.*)|\((?P<cols>.*)\))\s*$", _create),
        (rf"CREATE\s+(?P<replace>OR\s+REPLACE\s+)?(?P<live>LIVE\s+)?VIEW\s+(?P<name>{_NAME})\s+AS\s+(?P<body>.*)$", _view_statement),
        (rf"DROP\s+(?P<kind>TABLE|VIEW)\s+(?P<exists>IF\s+EXISTS\s+)?(?P<name>{_NAME})\s*$", _drop),
        (rf"ALTER\s+TABLE\s+(?P<name>{_NAME})\s+(?P<what>ADD|DROP|RENAME)\s+(?:COLUMN\s+)?(?P<rest>.*)$", _alter),
        (rf"TRUNCATE\s+(?:TABLE\s+)?(?P<name>{_NAME})\s*$", _truncate),
        (rf"INSERT\s+INTO\s+(?P<name>{_NAME})\s*(?:\((?P<cols>[^()]*)\)\s*)?(?P<body>(?:VALUES|SELECT|WITH)\b.*)$", _insert),
        (rf"UPDATE\s+(?P<name>{_NAME})\s+SET\s+(?P<sets>.*?)(?:\s+WHERE\s+(?P<where>.*))?$", _update),
        (rf"DELETE\s+FROM\s+(?P<name>{_NAME})(?:\s+WHERE\s+(?P<where>.*))?\s*$", _delete),
        (rf"MERGE\s+INTO\s+(?P<name>{_NAME})\s+USING\s+(?P<src>{_NAME})\s+ON\s+(?P<a>[\w.]+)\s*=\s*(?P<b>[\w.]+)\s+(?P<when>WHEN\b.*)$", _merge),
        (rf"COPY\s+(?P<what>\(.*\)|{_NAME})\s+(?P<way>TO|FROM)\s+'(?P<path>[^']+)'\s*(?:WITH\s*)?(?P<opts>\(.*\))?\s*$", _copy),
        (r"(?:DESCRIBE|DESC)\s+(?P<what>.*)$", _describe),
        (r"SHOW\s+(?P<what>TABLES|DATABASES|SCHEMAS|COLUMNS)(?:\s+FROM\s+(?P<of>\S+))?(?:\s+LIKE\s+'(?P<like>[^']*)')?\s*$", _show),
        (r"PRAGMA\s+(?P<name>\w+)\s*(?:\(\s*'?(?P<arg>\w+)'?\s*\))?\s*$", _pragma),
        (r"EXPLAIN\s+(?P<body>.*)$", _explain),
        (r"(BEGIN|COMMIT|ROLLBACK)(?:\s+TRANSACTION)?\s*$", _transaction),
    )


def connect(path: str | None = None, spark: SparkSession | None = None) -> Engine:
    return Engine(spark, path)


__all__ = ["Engine", "Result", "connect"]
