import pytest

from fathom.ask import to_sql
from fathom.errors import BindFailure
from fathom.session import connect
from fathom.shell import command

COLS = {"region": "string", "product": "string", "year": "int", "qty": "int", "revenue": "bigint"}


@pytest.mark.parametrize(
    ("question", "sql"),
    [
        ("How many rows?", "SELECT COUNT(*) AS n FROM t"),
        ("total revenue per region", "SELECT region, SUM(revenue) AS sum_revenue FROM t GROUP BY region ORDER BY sum_revenue DESC, region"),
        ("average qty in 2021", "SELECT AVG(qty) AS avg_qty FROM t WHERE year = 2021"),
        ("top 3 revenues", "SELECT * FROM t ORDER BY revenue DESC LIMIT 3"),
        ("top 2 revenue by product", "SELECT product, SUM(revenue) AS sum_revenue FROM t GROUP BY product ORDER BY sum_revenue DESC, product LIMIT 2"),
        ("highest qty where region is west", "SELECT MAX(qty) AS max_qty FROM t WHERE LOWER(region) = 'west'"),
        ("describe it", "DESCRIBE t"),
    ],
)
def test_rules(question, sql):
    assert to_sql(question, "t", COLS) == sql


def test_refusals():
    for q in ("running total of revenue", "what is love", "total revenue per planet", "sum of names"):
        with pytest.raises(BindFailure):
            to_sql(q, "t", COLS)


def test_shell(spark):
    db = connect(spark=spark)
    db.sql("CREATE OR REPLACE TABLE shop AS SELECT 'a' AS region, 5 AS qty UNION ALL SELECT 'b', 7")
    assert command(db, ".tables") == "shop" and "qty INTEGER" in command(db, ".schema shop")
    assert command(db, ".ask shop total qty per region").endswith("('b', 7)\n('a', 5)")
    assert command(db, ".quit") is None and ".help" in command(db, ".nope")
