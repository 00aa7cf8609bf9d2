"""Ranks over all rows: as Spark's own window gives them, in many tasks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom.operators import windows as W
from fathom.session import connect
from queries import registry
from tests.helpers import SF, same_as_oracle


@pytest.fixture(autouse=True)
def ranges(monkeypatch):
    monkeypatch.setattr(W, "SMALL", 0)  # as many ranges as shuffle partitions


@pytest.fixture
def db(spark):
    data = [(i, None if i % 3 == 0 else float("nan") if i % 7 == 0 else (-1) ** i * 0.0 if i % 5 == 0 else float(i * 37 % 101), f"s{i * 11 % 40:02d}" if i % 4 else None) for i in range(1, 2000)]
    spark.createDataFrame(data, "k bigint, v double, s string").repartition(5).createOrReplaceTempView("w_rows")
    with connect(spark=spark) as e:
        yield e


def single(plan) -> bool:
    return plan.getClass().getSimpleName() == "Window" and not plan.partitionSpec().size() or any(single(plan.children().apply(i)) for i in range(plan.children().size()))


def one_task(df) -> bool:
    return single(df._jdf.queryExecution().optimizedPlan())


def largest(df) -> float:
    """The share of the rows in the largest partition."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


@pytest.mark.parametrize("name", ["sql_null_order", "sort_nulls"])
def test_queries_number_in_many_tasks(spark, name):
    df = registry.queries()[name](spark, SF)
    assert not one_task(df)
    assert largest(df) < 0.5  # of 4 partitions
    same_as_oracle(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT *, ROW_NUMBER() OVER (ORDER BY v, k) AS n FROM w_rows",
        "SELECT *, ROW_NUMBER() OVER (ORDER BY v DESC, s, k) AS n FROM w_rows",
        "SELECT k, RANK() OVER (ORDER BY v) AS r, DENSE_RANK() OVER (ORDER BY v) AS d FROM w_rows",
        "SELECT k, RANK() OVER (ORDER BY s DESC, v) AS r, ROW_NUMBER() OVER (ORDER BY s DESC, v, k) AS n FROM w_rows",
        "SELECT k, 2 * DENSE_RANK() OVER (ORDER BY k % 10 DESC, s) - k AS x FROM w_rows",
        "SELECT a.k, b.k AS other, a.s, ROW_NUMBER() OVER (ORDER BY b.v, a.k, b.k) AS n FROM w_rows a JOIN w_rows b ON a.k = b.k + 1",
        "WITH t AS (SELECT s, COUNT(*) AS c FROM w_rows GROUP BY s) SELECT s, RANK() OVER (ORDER BY c DESC) AS r FROM t WHERE c < (SELECT MAX(c) FROM t)",
        "SELECT s, COUNT(*) AS c, ROW_NUMBER() OVER (ORDER BY COUNT(*), s) AS n FROM w_rows GROUP BY s",
        "SELECT n % 2 AS odd, SUM(k) AS t FROM (SELECT k, ROW_NUMBER() OVER (ORDER BY v, k) AS n FROM w_rows) AS x GROUP BY n % 2",
        "SELECT k, v FROM w_rows QUALIFY RANK() OVER (ORDER BY v) > 1000",
        "SELECT k, ROW_NUMBER() OVER (ORDER BY v, k) AS n FROM w_rows UNION ALL SELECT k, DENSE_RANK() OVER (ORDER BY s) FROM w_rows",
        "SELECT k, ROW_NUMBER() OVER (ORDER BY k) AS n FROM w_rows WHERE k < 0",
        "SELECT a.n, b.k FROM (SELECT k, ROW_NUMBER() OVER (ORDER BY v, k) AS n FROM w_rows) a JOIN (SELECT k, ROW_NUMBER() OVER (ORDER BY v DESC, k) AS n FROM w_rows) b ON a.n = b.n",
    ],
)
def test_as_one_window(db, sql):
    was = db._planned(sql)
    now = db.query(sql)
    assert one_task(was) and not one_task(now)
    assert now.columns == was.columns and now.dtypes == was.dtypes
    assert sorted(map(str, now.collect())) == sorted(map(str, was.collect()))


def test_alike_rows_are_spread(spark):
    """Half of the order's keys are NULL: no task gets them all."""
    df = spark.range(20000, numPartitions=4).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    got = W.distributed(df.select("*", W.row_number(W.over([], [F.asc_nulls_last("v")])).alias("n")))
    assert largest(got) < 0.4
    places = got.collect()
    assert sorted(r.n for r in places) == list(range(1, 20001))
    assert all((r.n == r.v // 2 + 1) if r.v is not None else r.n > 10000 for r in places)


def test_what_stays(db):
    """Ranks that Spark cuts to the first rows, other functions, windows with PARTITION BY."""
    spark = db.spark
    top = db.query("SELECT k FROM w_rows QUALIFY ROW_NUMBER() OVER (ORDER BY v, k) <= 3")
    assert one_task(top) and "GlobalLimit 3" in top._jdf.queryExecution().optimizedPlan().toString() and top.count() == 3
    assert one_task(db.query("SELECT RANK() OVER (ORDER BY k) AS r FROM (SELECT k FROM w_rows LIMIT 100000) AS x"))
    assert not one_task(db.query("SELECT RANK() OVER (ORDER BY k) AS r FROM (SELECT k FROM w_rows LIMIT 100001) AS x"))
    rows = spark.table("w_rows")
    for df in (rows.select(F.sum("k").over(Window.orderBy("k")).alias("x")), rows.select(F.row_number().over(Window.partitionBy("s").orderBy("k")).alias("x")), rows.select("k")):
        assert W.distributed(df) is df


def test_description_runs_nothing(db):
    seen = []
    db.query = lambda sql: seen.append(sql)
    assert db.sql("DESCRIBE SELECT ROW_NUMBER() OVER (ORDER BY k) AS n FROM w_rows").fetchall()[0][:2] == ("n", "INTEGER")
    assert "Window" in db.sql("EXPLAIN SELECT ROW_NUMBER() OVER (ORDER BY k) AS n FROM w_rows").fetchall()[0][0]
    assert not seen
