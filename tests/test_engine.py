import hashlib
import json
import sqlite3
import struct
import zipfile

import pyarrow as pa
import pyarrow.feather as feather
import pytest

from fathom.errors import BindFailure, CatalogFailure, ConstraintFailure, SyntaxFailure
from fathom.plans.lexer import split_statements
from fathom.session import connect


@pytest.fixture
def db(spark):
    with connect(spark=spark) as e:
        yield e


def rows(db, sql):
    return db.sql(sql).fetchall()


@pytest.fixture
def sales(db):
    db.sql("CREATE OR REPLACE TABLE sales (name VARCHAR, dept VARCHAR, amount INTEGER)")
    db.sql("INSERT INTO sales VALUES ('Alice','Engineering',100),('Bob','Engineering',200),('Charlie','Sales',150),('Diana','Sales',300),('Eve','Sales',250)")
    return db


def test_qualify_and_windows(sales):
    assert rows(sales, "SELECT name FROM sales QUALIFY ROW_NUMBER() OVER (PARTITION BY dept ORDER BY amount DESC) = 1 ORDER BY name") == [("Bob",), ("Diana",)]
    assert rows(sales, "SELECT name, RANK() OVER (ORDER BY amount DESC) AS r FROM sales QUALIFY r <= 2 ORDER BY r") == [("Diana", 1), ("Eve", 2)]
    assert sorted(rows(sales, "SELECT DISTINCT dept, SUM(amount) OVER (PARTITION BY dept) AS s FROM sales")) == [("Engineering", 300), ("Sales", 700)]
    assert rows(sales, "SELECT n FROM (SELECT name AS n, dept FROM sales QUALIFY ROW_NUMBER() OVER (PARTITION BY dept ORDER BY amount) = 1) ORDER BY n") == [("Alice",), ("Charlie",)]


def test_division_and_functions(db):
    db.sql("CREATE OR REPLACE TABLE d AS SELECT * FROM (VALUES (7, 2, 7.0), (-7, 2, 1.0), (5, 0, 2.0)) AS v(a, b, c)")
    assert rows(db, "SELECT a / b AS q FROM d ORDER BY q") == [(-3,), (3,), (None,)]
    assert rows(db, "SELECT c / b AS q FROM d WHERE b <> 0 ORDER BY q") == [(0.5,), (3.5,)]
    assert rows(db, "SELECT SUM(a) / COUNT(*) AS q FROM d") == [(1,)]
    assert rows(db, "SELECT 7 / 2 AS q, 7 / 0 AS z") == [(3, None)]
    assert rows(db, "SELECT LOG(1000) AS l, SUBSTRING('hello', 0, 3) AS s, LEFT('hello', -2) AS f, CHR(128175) AS c, CONCAT('a', NULL, 'b') AS k, SQRT(-1) AS q") == [(3.0, "he", "hel", "💯", "ab", None)]
    assert rows(db, "SELECT EXTRACT(DOW FROM DATE '2024-01-07') AS d, DATE_TRUNC('decade', TIMESTAMP '2024-05-06 01:02:03') AS t, MONTHNAME(DATE '2024-02-01') AS m")[0][::2] == (0, "February")
    assert rows(db, "SELECT REGEXP_REPLACE('a1b2', '([a-z])([0-9])', '\\2\\1') AS r, REGEXP_EXTRACT('abc', 'x') AS e, REGEXP_MATCHES('abc', 'b') AS m, STRFTIME(TIMESTAMP '2024-05-06 01:02:03', '%Y/%m/%d') AS f") == [("1a2b", None, True, "2024/05/06")]
    assert rows(db, "SELECT DATE_ADD('month', 1, DATE '2024-01-31') = TIMESTAMP '2024-02-29 00:00:00' AS a, DATEDIFF(DATE '2024-01-05', DATE '2024-01-01') AS d, DATE_DIFF('month', DATE '2024-01-31', DATE '2024-02-29') AS m, GCD(48, 18) AS g, LCM(4, 6) AS l, FACTORIAL(5) AS f") == [(True, 4, 0, 6, 12, 120)]
    assert rows(db, "SELECT 'it''s' AS \"Odd name\", 2.5 AS x -- comment; here") == [("it's", 2.5)]
    assert rows(db, "SELECT x FROM (VALUES (1), (NULL), (2)) AS v(x) ORDER BY x") == [(1,), (2,), (None,)]
    assert rows(db, "SELECT x FROM (VALUES (1), (NULL), (2)) AS v(x) ORDER BY x DESC LIMIT 1") == [(None,)]
    assert rows(db, "VALUES (1, 'a')") == [(1, "a")] and db.sql("VALUES (1, 'a')").column_names == ["column0", "column1"]
    assert rows(db, "SELECT dept, COUNT(*) AS n FROM (SELECT 'x' AS dept) GROUP BY ALL") == [("x", 1)]
    assert rows(db, "SELECT COUNT(*) AS n FROM generate_series(1, 10, 3)") == [(4,)]


def test_identifiers_and_places_of_tables(db, tmp_path):
    """Type names are names; only a string in a table's place is a file."""
    (tmp_path / "d.csv").write_text("doc_id,text,timestamp\n1,a,5\n2,b,6\n")
    f = f"'{tmp_path}/d.csv'"
    assert rows(db, f"SELECT doc_id, text, timestamp FROM {f} ORDER BY 1") == [(1, "a", 5), (2, "b", 6)]
    assert db.sql("SELECT 1 AS text, 2 AS char, 3 AS timestamp").column_names == ["text", "char", "timestamp"]
    assert rows(db, "SELECT TRIM(LEADING 'x' FROM 'xxab') AS t, EXTRACT(YEAR FROM DATE '2024-02-03') AS y, 'x.csv' AS tag") == [("ab", 2024, "x.csv")]
    assert rows(db, "SELECT * FROM (VALUES (1, 'a'))") == [(1, "a")] and db.sql("SELECT * FROM (VALUES (1, 'a')) AS t").column_names == ["column0", "column1"]
    assert rows(db, f"SELECT x.doc_id FROM ({f} x JOIN {f} y ON x.doc_id = y.doc_id), {f} z WHERE z.text = 'a' AND x.text IS DISTINCT FROM 'b'") == [(1,)]
    assert rows(db, f"SELECT COUNT(*) AS n FROM {f} WHERE text IN ('a', 'b.csv')") == [(1,)]


def test_arithmetic_rules(db):
    """Overflow and zero divisors give NULL, integers divide to integers wherever they come from, casts round half to even."""
    db.sql("CREATE OR REPLACE TABLE d AS SELECT * FROM (VALUES (7, 2, 7.0), (-7, 2, 1.0), (5, 0, 2.0)) AS v(a, b, c)")
    assert rows(db, "SELECT q FROM (SELECT a / b AS q FROM d) ORDER BY q") == [(-3,), (3,), (None,)]
    assert rows(db, "WITH t AS (SELECT a / b AS q FROM d) SELECT q / 2 AS h FROM t ORDER BY h") == [(-1,), (1,), (None,)]
    assert rows(db, "SELECT a / b AS q, COUNT(*) AS n FROM d GROUP BY a / b ORDER BY q") == [(-3, 1), (3, 1), (None, 1)]
    assert rows(db, "SELECT (SELECT MAX(a) / 2 FROM d) AS m, a / (SELECT MIN(b) + 2 FROM d) AS q FROM d ORDER BY a") == [(3, -3), (3, 2), (3, 3)]
    assert rows(db, "SELECT 2147483647 + 1 AS o, 3000000 * 3000000 AS m, -2147483647 - 5 AS s, 5 % 0 AS z, ABS(CAST(-2147483648 AS INTEGER)) AS a, 7 / 2 / 2 AS q, 7 / 2.0 AS r") == [(None, None, None, None, None, 1, 3.5)]
    assert rows(db, "SELECT CAST(2.5 AS INTEGER) AS a, 3.5::BIGINT AS b, CAST('12' AS INTEGER) AS c, CAST(a > 0 AS INTEGER) AS d, CAST(c / 2 AS INTEGER) AS e FROM d ORDER BY a, c, e") == [(2, 4, 12, 0, 0), (2, 4, 12, 1, 1), (2, 4, 12, 1, 4)]
    assert rows(db, "SELECT CASE WHEN a > 0 THEN -1 + a * 2 - 1 ELSE -b END AS z FROM d ORDER BY z") == [(-2,), (8,), (12,)]
    assert rows(db, "SELECT a FROM d ORDER BY a LIMIT 4 / 2 OFFSET 2 - 1") == [(5,), (7,)]
    assert rows(db, "UPDATE d SET a = a / 2 WHERE b / 2 = 1") == [(2,)] and rows(db, "SELECT a FROM d ORDER BY a") == [(-3,), (3,), (5,)]


def test_functions_by_name(db):
    assert rows(db, "SELECT ISINF(1.0) AS i, ISFINITE(2.0) AS f, TRUNCATE(2.77, 1) AS t, INITCAP('foo-bar baz2qux') AS ic, SPLIT_PART('a,b', ',', 0) AS s0, SPLIT_PART('abc', '', 2) AS s1, HEX(-1) AS h, MILLENNIUM(DATE '2024-01-01') AS m") == [(False, True, 2.7, "Foo-Bar Baz2Qux", "", "b", "FFFFFFFF", 3)]
    assert rows(db, "SELECT FORMAT_TIMESTAMP(TIMESTAMP '2024-05-06 01:02:03', '%Y-%m') AS f, DATE_FORMAT(DATE '2024-05-06', '%Y') AS g, LENGTH(CURTIME()) AS c, LOCALTIMESTAMP > TIMESTAMP '2020-01-01 00:00:00' AS l") == [("2024-05", "2024", 8, True)]
    assert rows(db, "SELECT SHA512('x') AS s, SHA2_256('x') AS t") == [(hashlib.sha512(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest())]
    assert [str(v) for v in rows(db, "SELECT DATE_SUB(DATE '2024-03-01', 1) AS a, DATE_ADD('month', 1, DATE '2024-01-31') AS b, DATE_SUB('hour', 2, TIMESTAMP '2024-01-01 01:00:00') AS c")[0]] == ["2024-02-29", "2024-02-29", "2023-12-31 23:00:00"]
    with pytest.raises(BindFailure):
        db.sql("SELECT SQRT(1, 2)")


def test_failing_changes(db):
    """A change that fails changes nothing."""
    db.sql("CREATE OR REPLACE TABLE k (id INTEGER PRIMARY KEY, name VARCHAR(3))")
    db.sql("INSERT INTO k VALUES (1, 'a'); INSERT INTO k VALUES (2, 'b')")
    for bad, kind in (("UPDATE k SET nope = 1", BindFailure), ("UPDATE k SET id = 7", ConstraintFailure), ("UPDATE k SET id = 2 WHERE id = 1", ConstraintFailure), ("UPDATE k SET name = 'long'", ConstraintFailure), ("INSERT INTO k (id, nope) VALUES (3, 'c')", BindFailure), ("INSERT INTO k VALUES (3, 'c'), (3, 'd')", ConstraintFailure), ("ALTER TABLE k DROP COLUMN nope", BindFailure)):
        with pytest.raises(kind):
            db.sql(bad)
        assert rows(db, "SELECT * FROM k ORDER BY id") == [(1, "a"), (2, "b")], bad
    parts = list(db.catalog.get("k").parts)
    assert rows(db, "UPDATE k SET name = 'z' WHERE id = 2") == [(1,)] and db.catalog.get("k").parts[0] == parts[0]
    assert rows(db, "DELETE FROM k WHERE id = 9") == [(0,)] and rows(db, "SELECT name FROM k ORDER BY id") == [("a",), ("z",)]
    assert db.catalog.vacuum() > 0 and rows(db, "SELECT COUNT(*) AS n FROM k") == [(2,)]


def test_merge_of_repeated_rows(db):
    db.sql("CREATE OR REPLACE TABLE target (id INTEGER, val VARCHAR); INSERT INTO target VALUES (1, 'a'), (1, 'a'), (2, 'b')")
    db.sql("CREATE OR REPLACE TABLE source (sid INTEGER, val VARCHAR); INSERT INTO source VALUES (1, 'new'), (3, 'c'), (3, 'c')")
    assert rows(db, "MERGE INTO target USING source ON source.sid = target.id WHEN MATCHED THEN UPDATE SET val = source.val WHEN NOT MATCHED THEN INSERT (id, val) VALUES (source.sid, source.val)") == [(4,)]
    assert rows(db, "SELECT * FROM target ORDER BY id, val") == [(1, "new"), (1, "new"), (2, "b"), (3, "c"), (3, "c")]
    db.sql("INSERT INTO source VALUES (1, 'twice')")
    with pytest.raises(ConstraintFailure):
        db.sql("MERGE INTO target USING source ON target.id = source.sid WHEN MATCHED THEN UPDATE SET val = source.val")


def test_dml(db):
    db.sql("CREATE OR REPLACE TABLE users (id INTEGER PRIMARY KEY, name VARCHAR(5) NOT NULL, score DOUBLE)")
    assert rows(db, "INSERT INTO users VALUES (1, 'a', 1.5), (2, 'b', NULL)") == [(2,)]
    for bad in ("(1, 'again', 0)", "(NULL, 'x', 0)", "(3, NULL, 0)", "(3, 'toolong', 0)"):
        with pytest.raises(ConstraintFailure):
            db.sql(f"INSERT INTO users VALUES {bad}")
    assert rows(db, "INSERT INTO users (name, id) VALUES ('c', 3)") == [(1,)]
    assert rows(db, "UPDATE users SET score = id * 2, name = upper(name) WHERE score IS NULL") == [(2,)]
    assert rows(db, "SELECT * FROM users ORDER BY id") == [(1, "a", 1.5), (2, "B", 4.0), (3, "C", 6.0)]
    assert rows(db, "DELETE FROM users WHERE id = 2") == [(1,)]
    db.sql("BEGIN; DELETE FROM users; CREATE TABLE other (x INTEGER)")
    assert rows(db, "SELECT COUNT(*) AS n FROM users") == [(0,)]
    with pytest.raises(CatalogFailure):
        db.sql("BEGIN")
    db.sql("ROLLBACK")
    assert rows(db, "SELECT COUNT(*) AS n FROM users") == [(2,)] and rows(db, "SHOW TABLES LIKE 'oth%'") == []
    db.sql("ALTER TABLE users ADD COLUMN extra VARCHAR; ALTER TABLE users RENAME COLUMN score TO points; ALTER TABLE users DROP COLUMN name")
    assert db.sql("SELECT * FROM users").column_names == ["id", "points", "extra"]
    assert rows(db, "DESCRIBE users")[0] == ("id", "INTEGER", "NO", "PRI", None, None)
    assert rows(db, "PRAGMA table_info('users')")[0][:4] == (0, "id", "INTEGER", True)
    db.sql("TRUNCATE TABLE users")
    assert rows(db, "SELECT COUNT(*) AS n FROM users") == [(0,)]
    db.sql("DROP TABLE users; DROP TABLE IF EXISTS users")
    with pytest.raises(CatalogFailure):
        db.sql("SELECT * FROM users")


def test_merge(db):
    db.sql("CREATE OR REPLACE TABLE target (id INTEGER, val VARCHAR); INSERT INTO target VALUES (1, 'old_a'), (2, 'old_b')")
    db.sql("CREATE OR REPLACE TABLE source (id INTEGER, val VARCHAR); INSERT INTO source VALUES (2, 'new_b'), (3, 'new_c')")
    assert rows(db, "MERGE INTO target USING source ON target.id = source.id WHEN MATCHED THEN UPDATE SET val = source.val WHEN NOT MATCHED THEN INSERT (id, val) VALUES (source.id, source.val)") == [(2,)]
    assert rows(db, "SELECT * FROM target ORDER BY id") == [(1, "old_a"), (2, "new_b"), (3, "new_c")]


def test_files(db, tmp_path):
    csv = tmp_path / "employees.csv"
    csv.write_text('name,dept,salary,at,day\n"A, ""x""",eng,10,2024-01-01 00:00:00,2024-01-01\nB,,2.5,,\n')
    assert rows(db, f"DESCRIBE '{csv}'")[2:4] == [("salary", "DOUBLE", "YES", None, None, None), ("at", "TIMESTAMP", "YES", None, None, None)]
    assert rows(db, f"SELECT name, dept, salary FROM '{csv}' ORDER BY salary") == [("B", None, 2.5), ('A, "x"', "eng", 10.0)]
    for ext in ("csv", "json", "parquet", "arrow", "tsv"):
        out = tmp_path / f"copy.{ext}"
        assert rows(db, f"COPY (SELECT name, salary FROM '{csv}') TO '{out}'") == [(2,)]
        assert out.is_file()
        assert rows(db, f"SELECT name, salary FROM '{out}' ORDER BY salary") == [("B", 2.5), ('A, "x"', 10.0)]
    assert len(json.loads((tmp_path / "copy.json").read_text())) == 2
    (tmp_path / "n.ndjson").write_text('{"a": 1, "b": {"c": 2}}\n{"a": 2.5, "b": null}\n')
    assert rows(db, f"SELECT a, b FROM read_json('{tmp_path}/n.ndjson') ORDER BY a") == [(1.0, '{"c":2}'), (2.5, None)]
    db.sql("CREATE OR REPLACE TABLE back (name VARCHAR, salary DOUBLE)")
    assert rows(db, f"COPY back FROM '{tmp_path}/copy.csv'") == [(2,)]
    assert rows(db, f"SELECT COUNT(*) AS n FROM read_parquet('{tmp_path}/*.parquet') p JOIN '{csv}' c ON p.name = c.name") == [(2,)]


def test_sqlite_arrow_xlsx_avro(db, tmp_path):
    con = sqlite3.connect(tmp_path / "x.sqlite")
    con.execute("CREATE TABLE t (id INTEGER, v REAL, s TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, i / 2, None if i % 3 else f"s{i}") for i in range(100)])
    con.commit()
    assert rows(db, f"SELECT COUNT(*) AS n, SUM(id) AS i, SUM(v) AS v, COUNT(s) AS s FROM sqlite_scan('{tmp_path}/x.sqlite', 't')") == [(100, 4950, 2475.0, 34)]
    feather.write_feather(pa.table({"k": range(5000), "s": ["x"] * 5000}), tmp_path / "f.arrow", chunksize=100, compression="uncompressed")
    assert rows(db, f"SELECT COUNT(*) AS n, MAX(k) AS m FROM '{tmp_path}/f.arrow'") == [(5000, 4999)]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5</v></c></row><row r="3"><c r="B3"><v>6</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>who</t></si><si><t>me</t></si></sst>')
    assert rows(db, f"SELECT who, n FROM read_xlsx('{tmp_path}/b.xlsx') ORDER BY n") == [("me", 5), (None, 6)]
    zig = lambda n: bytes([((n << 1) ^ (n >> 63)) & 127])
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "i", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "x", "type": "double"}]}).encode()
    body = zig(5) + zig(1) + zig(2) + b"hi" + zig(10) + struct.pack("<d", 1.5) + zig(-3) + zig(0) + zig(1) + struct.pack("<d", 2.5)
    long = lambda n: bytes([n * 2 & 127 | 128, n * 2 >> 7]) if n > 63 else zig(n)
    (tmp_path / "a.avro").write_bytes(b"Obj\1" + zig(1) + zig(11) + b"avro.schema" + long(len(schema)) + schema + zig(0) + b"M" * 16 + zig(2) + zig(len(body)) + body + b"M" * 16)
    got = rows(db, f"SELECT i, s, CAST(d AS VARCHAR) AS d, x FROM read_avro('{tmp_path}/a.avro') ORDER BY i")
    assert got == [(-3, None, "1970-01-02", 2.5), (5, "hi", "1970-01-11", 1.5)]


def test_views(db, tmp_path):
    f = tmp_path / "live.csv"
    f.write_text("a,b\n1,x\n2,y\n")
    db.sql(f"CREATE LIVE VIEW lv AS SELECT * FROM '{f}'")
    assert rows(db, "SELECT SUM(a) AS s FROM lv") == [(3,)] and db.live["lv"].refreshes == (1, 0)
    assert rows(db, "SELECT SUM(a) AS s FROM lv") == [(3,)] and db.live["lv"].refreshes == (1, 0)
    with open(f, "a") as h:
        h.write("3,z\n4,")
    assert rows(db, "SELECT SUM(a) AS s FROM lv") == [(6,)] and db.live["lv"].refreshes == (1, 1)
    with open(f, "a") as h:
        h.write("w\n")
    assert rows(db, "SELECT SUM(a) AS s, MAX(b) AS m FROM lv") == [(10, "z")]
    f.write_text("a,b\n9,q\n")
    assert rows(db, "SELECT SUM(a) AS s FROM lv") == [(9,)] and db.live["lv"].refreshes[0] == 2
    with pytest.raises(BindFailure):
        db.sql("CREATE LIVE VIEW bad AS SELECT 1 AS x")
    db.sql(f"CREATE VIEW v AS SELECT COUNT(*) AS n FROM '{f}'")
    assert rows(db, "SELECT n FROM v") == [(1,)]
    f.write_text("a,b\n9,q\n8,r\n")
    assert rows(db, "SELECT n FROM v") == [(2,)]
    db.sql("DROP VIEW v; DROP VIEW lv")


def test_persistence_udf_and_errors(spark, tmp_path):
    with connect(str(tmp_path / "db"), spark) as e:
        e.sql("CREATE TABLE kept AS SELECT 1 AS x UNION ALL SELECT 2")
    with connect(str(tmp_path / "db"), spark) as e:
        assert e.sql("SELECT SUM(x) AS s FROM kept").fetchone() == (3,)
        e.register_function("twice", lambda s: s * 2, "long")
        assert e.sql("SELECT twice(x) AS t FROM kept ORDER BY t").fetchdf().t.tolist() == [2, 4]
        assert "Physical Plan" in e.sql("EXPLAIN SELECT * FROM kept").fetchone()[0]
        for bad, kind in (("SELEC 1", SyntaxFailure), ("SELECT nope FROM kept", BindFailure), ("SELECT 'open", SyntaxFailure)):
            with pytest.raises(kind):
                e.sql(bad)
    assert split_statements("a; 'x;y'; -- c;\n b") == ["a", "'x;y'", "-- c;\n b"]


def test_extensions(db, monkeypatch):
    import sys
    import types

    seen = []
    monkeypatch.setitem(sys.modules, "some_extension", types.SimpleNamespace(register=lambda e: seen.append("on"), unregister=lambda e: seen.append("off")))
    db.load_extension("some_extension")
    assert list(db.extensions) == ["some_extension"]
    db.unload_extension("some_extension")
    assert seen == ["on", "off"] and not db.extensions
    for bad in ("some_extension", "../x"):
        with pytest.raises(CatalogFailure):
            (db.unload_extension if bad == "some_extension" else db.load_extension)(bad)


def test_copy_to_parts(db, tmp_path):
    db.sql("CREATE OR REPLACE TABLE many AS SELECT generate_series AS k, 'a,\"b' AS s FROM generate_series(1, 1000)")
    for ext in ("csv", "json", "parquet"):
        assert rows(db, f"COPY many TO '{tmp_path}/out.{ext}/'") == [(1000,)]
        assert rows(db, f"SELECT COUNT(*) AS n, SUM(k) AS k, MIN(s) AS s FROM '{tmp_path}/out.{ext}/*.{ext}'") == [(1000, 500500, 'a,"b')]


def test_ranges_of_lines(spark, tmp_path):
    """Every line is in one range, whatever the cuts; only line feeds end lines."""
    from fathom.streaming.tail import last_line_end, lines_between, ranges

    f = tmp_path / "x"
    text = ["a", "", "long" * 50, "cut\u2028here\x0c and \x85 there", "z"]
    f.write_text("\n".join(text) + "\r\nhalf", newline="")
    end = last_line_end(str(f))
    for size in (1, 3, 7, 1000):
        assert [x for a, b in ranges(0, end, size) for x in lines_between(str(f), a, b, 0)] == text
    assert last_line_end(str(tmp_path / "none")) == 0


def test_tail(spark, tmp_path):
    from fathom.streaming.tail import tail_csv

    f = tmp_path / "t.csv"
    f.write_text("k,v\na,1\nb,2\nc")
    q = tail_csv(spark, str(f), "k string, v int").writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("tailed").collect())) == [("a", 1), ("b", 2)]
        with open(f, "a") as h:
            h.write(",3\n")
        q.processAllAvailable()
        assert spark.table("tailed").count() == 3
    finally:
        q.stop()
