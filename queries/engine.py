"""The SQL engine on the driver's tables: formats, COPY, DDL and DML, views, functions, introspection, streams."""

from __future__ import annotations

import json
import sqlite3
import struct
import zipfile

import pyarrow.feather as feather
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fathom.session import connect
from fathom.sources import custom, files, sinks
from fathom.storage import fresh_path, make_dir
from queries.relational import C, Tables

QUERIES = {}
ORACLE = {}


def query(sql):
    """Registers ``f(tables, folder)``; ``folder`` is a new one in the shared folder."""

    def add(f):
        def run(spark, sf_dir):
            folder = fresh_path(spark, f.__name__)
            make_dir(spark, folder)
            return f(Tables(spark, sf_dir), folder)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def opened(t, **tables):
    """An engine with these tables of the folder as views."""
    e = connect(spark=t.spark)
    for name in tables:
        e.catalog.views[name] = f"SELECT * FROM '{t.sf_dir}/{tables[name]}.parquet'"
    return e


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority FROM orders")
def io_csv(t, d):
    t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).write.option("header", "true").csv(f"{d}/orders")
    return files.read_csv(t.spark, f"{d}/orders/*.csv")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events")
def io_json(t, d):
    t.events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).write.json(f"{d}/events")
    return files.read_json(t.spark, f"{d}/events/*.json").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def io_parquet_glob(t, d):
    t.orders.select("o_orderkey", "o_orderstatus").repartition(4).write.parquet(f"{d}/orders")
    return connect(spark=t.spark).query(f"SELECT o_orderstatus, COUNT(*) AS n FROM '{d}/orders/part-*.parquet' GROUP BY ALL")


@query("SELECT n_regionkey AS region, COUNT(*) AS n FROM nation GROUP BY 1")
def io_hive_partitions(t, d):
    t.nation.withColumnRenamed("n_regionkey", "region").write.partitionBy("region").parquet(f"{d}/nation")
    return t.spark.read.parquet(f"{d}/nation").groupBy("region").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def io_sqlite(t, d):
    """The fixture is written here by the driver; the read is partitioned."""
    path = f"{d.removeprefix('file://')}/c.sqlite"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL)")
        con.executemany("INSERT INTO customer VALUES (?, ?, ?)", (tuple(r) for r in t.customer.select("c_custkey", "c_name", "c_acctbal").toLocalIterator()))
    return custom.read(t.spark, "sqlite", path, "customer")


@query("SELECT * FROM supplier")
def io_arrow(t, d):
    path = f"{d.removeprefix('file://')}/s.arrow"
    feather.write_feather(pq.read_table(f"{t.sf_dir}/supplier.parquet"), path, compression="uncompressed", chunksize=64)
    return custom.read(t.spark, "arrow", path)


@query("SELECT n_name, CAST(n_regionkey AS BIGINT) AS r FROM nation")
def copy_csv_roundtrip(t, d):
    e = connect(spark=t.spark)
    e.sql(f"COPY (SELECT n_name, n_regionkey AS r FROM '{t.sf_dir}/nation.parquet') TO '{d}/n.csv' WITH (FORMAT CSV, HEADER TRUE)")
    return e.query(f"SELECT * FROM '{d}/n.csv'")


@query("SELECT r_name, CAST(r_regionkey AS BIGINT) AS k FROM region")
def copy_json_roundtrip(t, d):
    sinks.write_json(t.region.select("r_name", C("r_regionkey").alias("k")), f"{d}/r.json")
    return files.read_json(t.spark, f"{d}/r.json")


@query("SELECT generate_series FROM generate_series(-5, 100, 7) AS g(generate_series)")
def generate_series(t, d):
    return files.generate_series(t.spark, -5, 100, 7)


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def sql_qualify(t, d):
    return opened(t, part="part").query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")


@query("SELECT o_orderkey, o_orderkey // 3 AS q, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 2) END AS z FROM orders")
def sql_int_division(t, d):
    return opened(t, orders="orders").query("SELECT o_orderkey, o_orderkey / 3 AS q, o_orderkey / (o_custkey % 2) AS z FROM orders")


@query("SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS n, string_agg(DISTINCT CAST(user_id % 5 AS VARCHAR), ',' ORDER BY CAST(user_id % 5 AS VARCHAR)) AS u FROM events GROUP BY ALL")
def sql_group_all(t, d):
    return opened(t, events="events").query("SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS n, array_join(array_sort(collect_set(CAST(user_id % 5 AS VARCHAR))), ',') AS u FROM events GROUP BY ALL")


@query("SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def sql_file_join(t, d):
    return connect(spark=t.spark).query(f"SELECT c_mktsegment, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM '{t.sf_dir}/customer.parquet' c JOIN '{t.sf_dir}/orders.parquet' o ON c_custkey = o_custkey GROUP BY c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100, 'ATLANTIS'")
def dml_insert(t, d):
    e = opened(t, nation="nation")
    e.sql("CREATE TABLE n2 (n_nationkey INTEGER PRIMARY KEY, n_name VARCHAR NOT NULL); INSERT INTO n2 SELECT n_nationkey, n_name FROM nation; INSERT INTO n2 (n_name, n_nationkey) VALUES ('ATLANTIS', 100)")
    return e.table("n2")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
def dml_update(t, d):
    e = opened(t, part="part")
    e.sql("CREATE TABLE p2 AS SELECT p_partkey, p_size, p_retailprice FROM part; UPDATE p2 SET p_retailprice = p_retailprice * 2 WHERE p_size > 25; ALTER TABLE p2 DROP COLUMN p_size")
    return e.table("p2")


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT s_acctbal > 0")
def dml_delete(t, d):
    e = opened(t, supplier="supplier")
    e.sql("CREATE TABLE s2 AS SELECT s_suppkey, s_acctbal FROM supplier; DELETE FROM s2 WHERE s_acctbal > 0")
    return e.table("s2")


@query("SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'merged' ELSE c_name END AS name FROM customer UNION ALL SELECT -1 - s_suppkey, 'merged' FROM supplier")
def dml_merge(t, d):
    e = opened(t, customer="customer", supplier="supplier")
    e.sql("CREATE TABLE tgt AS SELECT c_custkey AS k, c_name AS name FROM customer; CREATE TABLE src AS SELECT c_custkey AS k, 'merged' AS v FROM customer WHERE c_acctbal > 0 UNION ALL SELECT -1 - s_suppkey, 'merged' FROM supplier")
    e.sql("MERGE INTO tgt USING src ON tgt.k = src.k WHEN MATCHED THEN UPDATE SET name = src.v WHEN NOT MATCHED THEN INSERT (k, name) VALUES (src.k, src.v)")
    return e.table("tgt")


@query("SELECT r_regionkey, r_name FROM region")
def txn_rollback(t, d):
    e = opened(t, region="region")
    e.sql("CREATE TABLE r2 AS SELECT r_regionkey, r_name FROM region; BEGIN; DELETE FROM r2 WHERE r_regionkey > 1; ROLLBACK")
    return e.table("r2")


@query("SELECT n_nationkey, n_name AS name, CAST(NULL AS INTEGER) AS extra FROM nation")
def alter_table(t, d):
    e = opened(t, nation="nation")
    e.sql("CREATE TABLE a AS SELECT n_nationkey, n_name, n_regionkey FROM nation; ALTER TABLE a RENAME COLUMN n_name TO name; ALTER TABLE a DROP COLUMN n_regionkey; ALTER TABLE a ADD COLUMN extra INT")
    return e.table("a")


@query("SELECT COUNT(*) AS n, CAST(SUM(n_nationkey) AS BIGINT) AS s FROM nation")
def view_file(t, d):
    e = connect(spark=t.spark)
    e.sql(f"CREATE VIEW v AS SELECT * FROM '{t.sf_dir}/nation.parquet'")
    return e.query("SELECT COUNT(*) AS n, SUM(n_nationkey) AS s FROM v")


@query("SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
def live_view_append(t, d):
    rows = [f"{r.r_regionkey},{r.r_name}\n" for r in t.region.orderBy("r_regionkey").toLocalIterator()]
    path = f"{d.removeprefix('file://')}/live.csv"
    with open(path, "w") as f:
        f.write("k,name\n" + "".join(rows[:2]))
    e = connect(spark=t.spark)
    e.sql(f"CREATE LIVE VIEW lv AS SELECT * FROM '{path}'")
    e.sql("SELECT * FROM lv")
    with open(path, "a") as f:
        f.write("".join(rows[2:]))
    return e.query("SELECT * FROM lv")


@query("SELECT p_partkey, p_size * 2 + 1 AS x FROM part")
def udf_scalar(t, d):
    e = opened(t, part="part")
    e.register_function("twice_and_one", lambda s: s * 2 + 1, "int")
    return e.query("SELECT p_partkey, twice_and_one(p_size) AS x FROM part")


@query("""SELECT * FROM (VALUES ('r_regionkey', 'INTEGER', 'YES', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)), ('r_name', 'VARCHAR', 'YES', NULL, NULL, NULL)) AS v(column_name, column_type, "null", key, "default", extra)""")
def describe(t, d):
    return connect(spark=t.spark).sql(f"DESCRIBE '{t.sf_dir}/region.parquet'").df


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events GROUP BY 1, 2")
def stream_tumbling(t, d):
    """A stream over the files of the table, in append mode to Parquet: state older than the watermark goes, results never meet the driver.

    A mark long after the last event, in a stream of its own, closes the last windows.
    """
    end = t.events.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts"))
    end.select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("props")).write.parquet(f"{d}/mark")
    read = t.spark.readStream.schema(t.events.schema)
    src = read.parquet(f"{t.sf_dir}/events.parquet*").unionByName(read.parquet(f"{d}/mark"))
    win = src.withColumn("ts", C("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))
    out = win.select(C("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "s")
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/cp").start()
    q.processAllAvailable()
    q.stop()
    return t.spark.read.schema(out.schema).parquet(f"{d}/out").filter("event_type IS NOT NULL")


@query("SELECT true AS aggregates, true AS scans")
def explain(t, d):
    df = connect(spark=t.spark).sql(f"EXPLAIN SELECT COUNT(*) AS n FROM '{t.sf_dir}/region.parquet'").df
    return df.selectExpr("plan LIKE '%Aggregate%' AS aggregates", "plan LIKE '%region.parquet%' AS scans")


def _zig(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_avro(t, d):
    """The fixture is written here by the driver."""
    path, text = f"{d.removeprefix('file://')}/n.avro", lambda s: _zig(len(s.encode())) + s.encode()
    spec = json.dumps({"type": "record", "name": "n", "fields": [{"name": "n_nationkey", "type": "int"}, {"name": "n_name", "type": ["null", "string"]}, {"name": "n_regionkey", "type": "int"}]})
    rows = [_zig(r.n_nationkey) + _zig(1) + text(r.n_name) + _zig(r.n_regionkey) for r in t.nation.toLocalIterator()]
    with open(path, "wb") as f:
        f.write(b"Obj\1" + _zig(1) + text("avro.schema") + text(spec) + _zig(0) + b"M" * 16 + _zig(len(rows)) + _zig(sum(map(len, rows))) + b"".join(rows) + b"M" * 16)
    return connect(spark=t.spark).query(f"SELECT * FROM read_avro('{path}')")


@query("SELECT s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier")
def io_xlsx(t, d):
    path, ns = f"{d.removeprefix('file://')}/s.xlsx", 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v!r}</v></c>"
    rows = [("s_name", "s_nationkey", "s_acctbal"), *map(tuple, t.supplier.select("s_name", "s_nationkey", "s_acctbal").toLocalIterator())]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join('<row>' + ''.join(map(cell, r)) + '</row>' for r in rows)}</sheetData></worksheet>")
    return connect(spark=t.spark).query(f"SELECT * FROM '{path}'")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def copy_from(t, d):
    """COPY to a folder of CSV parts, then COPY FROM it into a table."""
    e = opened(t, customer="customer")
    e.sql(f"COPY (SELECT c_custkey, c_name, c_acctbal FROM customer) TO '{d}/c.csv/'; CREATE TABLE back (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR, c_acctbal DOUBLE); COPY back FROM '{d}/c.csv/*.csv'")
    return e.table("back")


@query("SELECT * FROM part")
def copy_parquet_roundtrip(t, d):
    e = opened(t, part="part")
    e.sql(f"COPY part TO '{d}/p.parquet'")
    return e.query(f"SELECT * FROM '{d}/p.parquet'")


@query("SELECT * FROM supplier")
def copy_arrow_roundtrip(t, d):
    e = opened(t, supplier="supplier")
    e.sql(f"COPY supplier TO '{d}/s.arrow'")
    return e.query(f"SELECT * FROM '{d}/s.arrow'")


@query("SELECT * FROM (VALUES ('t1'), ('t2'), ('v')) AS v(name)")
def show_tables(t, d):
    e = connect(spark=t.spark)
    e.sql("CREATE TABLE t1 (x INTEGER); CREATE TABLE t2 AS SELECT 1 AS x; CREATE TABLE t3 (y INTEGER); DROP TABLE t3; CREATE VIEW v AS SELECT 1 AS x")
    return e.sql("SHOW TABLES").df


@query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'id', 'INTEGER', true, CAST(NULL AS VARCHAR), true), (1, 'name', 'VARCHAR(9)', true, NULL, false), (2, 'at', 'TIMESTAMP', false, NULL, false)) AS v(cid, name, type, \"notnull\", dflt_value, pk)")
def pragma_table_info(t, d):
    e = connect(spark=t.spark)
    e.sql("CREATE TABLE p (id INTEGER PRIMARY KEY, name VARCHAR(9) NOT NULL, at TIMESTAMP)")
    return e.sql("PRAGMA table_info('p')").df


@query("SELECT r_regionkey, r_name FROM region")
def truncate_table(t, d):
    e = opened(t, region="region", nation="nation")
    e.sql("CREATE TABLE u AS SELECT n_nationkey AS k, n_name AS name FROM nation; TRUNCATE TABLE u; INSERT INTO u SELECT r_regionkey, r_name FROM region")
    return e.table("u").toDF("r_regionkey", "r_name")


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 0, 'new'")
def persistence(t, d):
    """A database closed and opened again, and again after a change."""
    path = f"{d}/db"
    with connect(path, t.spark) as e:
        e.sql(f"CREATE TABLE s AS SELECT s_suppkey, s_name FROM '{t.sf_dir}/supplier.parquet'")
    with connect(path, t.spark) as e:
        e.sql("INSERT INTO s VALUES (0, 'new')")
    return connect(path, t.spark).table("s")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS bal FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END FROM customer")
def dml_merge_equal_rows(t, d):
    """Every row of the target twice; both are updated by the one match."""
    e = opened(t, customer="customer")
    e.sql("CREATE TABLE tgt AS SELECT c_custkey AS k, c_acctbal AS bal FROM customer; INSERT INTO tgt SELECT c_custkey, c_acctbal FROM customer; CREATE TABLE src AS SELECT c_custkey AS k, 0.0 AS b FROM customer WHERE c_acctbal < 0")
    e.sql("MERGE INTO tgt USING src ON tgt.k = src.k WHEN MATCHED THEN UPDATE SET bal = src.b")
    return e.table("tgt").toDF("c_custkey", "bal")
