"""Relational core: scans, predicates, joins, aggregates, windows, sorting, set operations, CTEs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions import conditional, maths, regex
from fathom.operators import aggregates as A
from fathom.operators import joins as J
from fathom.operators import setops as S
from fathom.operators import sorting as O
from fathom.operators import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C = F.col


class Tables:
    """Tables of a directory by attribute; each is read with the columns that the plan needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None):
    """Registers ``f(tables)`` with its oracle SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r2(x):
    return F.round(x, 2)


@query("""SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue,
ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2 LIMIT 10""")
def pricing_summary(t):
    price = C("l_extendedprice") * (1 - C("l_discount"))
    li = t.lineitem.filter(C("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    aggs = [r2(F.sum("l_quantity")).alias("sum_qty"), r2(F.sum(price)).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")]
    return li.groupBy("l_returnflag", "l_linestatus").agg(*aggs).orderBy("l_returnflag", "l_linestatus").limit(10)


@query("SELECT o_orderkey, o_custkey AS cust, o_totalprice * 2 AS twice FROM orders")
def scan_project(t):
    return t.orders.select("o_orderkey", C("o_custkey").alias("cust"), (C("o_totalprice") * 2).alias("twice"))


@query("SELECT 1 AS one, 'x' AS s")
def dummy_scan(t):
    return t.spark.range(1).select(F.lit(1).alias("one"), F.lit("x").alias("s"))


@query("SELECT * FROM part WHERE p_size > 10 AND p_retailprice < 1500 OR NOT (p_brand <> 'Brand#11') AND p_size <> 5")
def filter_predicates(t):
    return t.part.filter((C("p_size") > 10) & (C("p_retailprice") < 1500) | ~(C("p_brand") != "Brand#11") & (C("p_size") != 5))


@query("""SELECT event_id, (v > 50) IS TRUE AS is_true, (v > 50) IS NOT TRUE AS not_true, (v > 50) IS FALSE AS is_false, (v > 50) IS NULL AS unknown, v IS DISTINCT FROM 7 AS differs,
(v > 50 OR NULL) AS kleene_or, (v > 50 AND NULL) AS kleene_and FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)""")
def filter_null_logic(t):
    e = t.events.select("event_id", F.when(C("event_id") % 3 != 0, C("value")).alias("v"))
    p, yes, no, none = C("v") > 50, F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    return e.select("event_id", p.eqNullSafe(yes).alias("is_true"), (~p.eqNullSafe(yes)).alias("not_true"), p.eqNullSafe(no).alias("is_false"), p.isNull().alias("unknown"), conditional.distinct_from(C("v"), F.lit(7.0)).alias("differs"), (p | none).alias("kleene_or"), (p & none).alias("kleene_and"))


@query(r"""SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND NOT p_name ILIKE 'B%' AND p_type NOT LIKE '%X!_Y%' ESCAPE '!'""")
def filter_like_ilike_escape(t):
    return t.part.filter(C("p_name").like("%a%") & ~C("p_name").ilike("B%") & ~F.like(C("p_type"), F.lit("%X!_Y%"), F.lit("!"))).select("p_partkey", "p_name")


@query("""SELECT o_orderkey, o_orderstatus IN ('F', NULL) AS in_null, o_totalprice BETWEEN 1000 AND 50000 AS mid, o_orderstatus NOT IN ('F', 'P') AS other FROM orders WHERE o_custkey NOT BETWEEN 5 AND 10""")
def filter_in_between(t):
    s = C("o_orderstatus")
    return t.orders.filter(~C("o_custkey").between(5, 10)).select("o_orderkey", conditional.in_list(s, ["F", None]).alias("in_null"), C("o_totalprice").between(1000, 50000).alias("mid"), (~s.isin("F", "P")).alias("other"))


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS kind, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS simple,
CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS flag FROM part""")
def case_if(t):
    z = C("p_size")
    return t.part.select("p_partkey", F.when(z < 10, "small").when(z < 30, "mid").otherwise("large").alias("kind"), F.when(z % 3 == 0, "a").when(z % 3 == 1, "b").alias("simple"), conditional.if_(z > 25, F.lit(1), F.lit(0)).alias("flag"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey / 2.0 AS BIGINT) AS half_even, TRY_CAST(o_orderpriority AS INTEGER) AS bad, TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS good,
CAST(o_orderdate AS DATE) AS d, TRY_CAST('yes' AS BOOLEAN) AS b FROM (SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders)""")
def cast_trycast(t):
    k = C("o_orderkey")
    return t.orders.select("o_orderkey", k.cast("string").alias("s"), conditional.cast_int(k / 2.0, "bigint").alias("half_even"), C("o_orderpriority").try_cast("int").alias("bad"), F.left("o_orderpriority", F.lit(1)).try_cast("int").alias("good"), C("o_orderdate").cast("date").alias("d"), F.lit("yes").try_cast("boolean").alias("b"))


@query("""SELECT o_orderkey, o_orderkey // 7 AS q, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 5) END AS q0, (0 - o_orderkey) // 7 AS neg, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey % (o_custkey % 5) END AS m FROM orders""")
def arithmetic_int_div(t):
    k, d = C("o_orderkey"), C("o_custkey") % 5
    return t.orders.select("o_orderkey", maths.int_div(k, F.lit(7)).alias("q"), maths.int_div(k, d).alias("q0"), maths.int_div(-k, F.lit(7)).alias("neg"), maths.mod(k, d).alias("m"))


@query("""SELECT k, CASE WHEN k + 2147483600 > 2147483647 THEN NULL ELSE CAST(k + 2147483600 AS INTEGER) END AS a, CASE WHEN k * 100000000 > 2147483647 THEN NULL ELSE CAST(k * 100000000 AS INTEGER) END AS m,
CASE WHEN -2147483600 - k < -2147483648 THEN NULL ELSE CAST(-2147483600 - k AS INTEGER) END AS s FROM (SELECT CAST(n_nationkey * 3 AS BIGINT) AS k FROM nation)""")
def arithmetic_overflow_null(t):
    k, big = (C("n_nationkey") * 3).cast("int"), F.lit(2147483600)
    return t.nation.select(k.cast("bigint").alias("k"), maths.add(k, big).alias("a"), maths.mul(k, F.lit(100000000)).alias("m"), maths.sub(-big, k).alias("s"))


@query("""SELECT k, k & 6 AS a, k | 8 AS o, xor(k, 5) AS x, k << 3 AS l, k >> 1 AS r, CASE WHEN k < 64 THEN k >> CAST(k AS INTEGER) END AS g FROM (SELECT CAST(p_size * 2 AS BIGINT) AS k FROM part)""")
def bitwise_ops(t):
    k = C("k")
    f = lambda n: F.lit(n).cast("bigint")
    return t.part.select((C("p_size") * 2).cast("bigint").alias("k")).select("k", k.bitwiseAND(f(6)).alias("a"), k.bitwiseOR(f(8)).alias("o"), k.bitwiseXOR(f(5)).alias("x"), maths.shift_left(k, f(3)).alias("l"), maths.shift_right(k, f(1)).alias("r"), maths.shift_right(k, k).alias("g"))


# -- joins ---------------------------------------------------------------------


def _joined(t, how):
    return J.join(t.customer, t.orders, (C("c_custkey") == C("o_custkey")) & (C("c_acctbal") > 0) & (C("o_totalprice") > 1000), how).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


for _how in J.KINDS:  # all rows of both tables; customers in debt and their orders have no match
    QUERIES[f"join_{_how}"] = lambda spark, sf_dir, how=_how: _joined(Tables(spark, sf_dir), how)
    ORACLE[f"join_{_how}"] = f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer {_how.upper()} JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0 AND o_totalprice > 1000"


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (C("a.n_regionkey") < C("b.n_regionkey")) & (C("a.n_nationkey") != C("b.n_nationkey"))).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("""SELECT r_name, n_name, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def join_chain(t):
    li = t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey"))
    return li.join(t.nation, C("c_nationkey") == C("n_nationkey")).join(t.region, C("n_regionkey") == C("r_regionkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("n"), r2(F.sum("l_extendedprice")).alias("total"))


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)")
def join_using(t):
    return J.using(t.nation.select(C("n_regionkey").alias("k"), "n_name"), t.region.select(C("r_regionkey").alias("k"), "r_name"), "k")


@query("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)")
def join_natural(t):
    return J.natural(t.nation.select(C("n_regionkey").alias("k"), "n_name"), t.region.select(C("r_regionkey").alias("k"), "r_name"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def semi_in_subquery(t):
    return J.semi(t.customer, t.orders.filter("o_totalprice > 100000"), C("c_custkey") == C("o_custkey")).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def anti_not_in(t):
    t.customer.createOrReplaceTempView("f_customer"), t.orders.createOrReplaceTempView("f_orders")
    return t.spark.sql("SELECT c_custkey FROM f_customer WHERE c_custkey NOT IN (SELECT o_custkey FROM f_orders WHERE o_totalprice > 250000)")


@query("SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 3) AND EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20)")
def exists(t):
    t.region.createOrReplaceTempView("f_region"), t.nation.createOrReplaceTempView("f_nation")
    return t.spark.sql("SELECT r_name FROM f_region WHERE EXISTS (SELECT 1 FROM f_nation WHERE n_regionkey = 3) AND EXISTS (SELECT 1 FROM f_nation WHERE n_regionkey = r_regionkey AND n_nationkey > 20)")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def not_exists(t):
    return J.anti(t.customer, t.orders.filter("o_totalprice > 250000"), C("c_custkey") == C("o_custkey")).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(t):
    mean = t.orders.agg((F.avg("o_totalprice") * 1.5).alias("m"))
    return t.orders.join(F.broadcast(mean), C("o_totalprice") > C("m")).select("o_orderkey", "o_totalprice")  # one row by construction


# -- aggregates ------------------------------------------------------------------


@query("SELECT COUNT(*) AS n, COUNT(v) AS nv, CAST(SUM(event_id) AS BIGINT) AS s, ROUND(AVG(v), 6) AS a, MIN(event_type) AS lo, MAX(ts) AS hi FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS v FROM events)")
def agg_global(t):
    e = t.events.withColumn("v", F.when(C("event_id") % 2 == 0, C("value")))
    return e.agg(F.count("*").alias("n"), F.count("v").alias("nv"), F.sum("event_id").alias("s"), F.round(F.avg("v"), 6).alias("a"), F.min("event_type").alias("lo"), F.max("ts").alias("hi"))


@query("SELECT COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, MIN(ts) AS m FROM events WHERE event_id < 0")
def agg_empty(t):
    return t.events.filter("event_id < 0").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.avg("value").alias("a"), F.min("ts").alias("m"))


@query("SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS s FROM events GROUP BY event_type")
def agg_group(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), r2(F.sum("value")).alias("s"))


@query("SELECT user_id % 10 AS b, upper(event_type) AS e, COUNT(*) AS n FROM events GROUP BY user_id % 10, upper(event_type)")
def agg_group_expr(t):
    return t.events.groupBy((C("user_id") % 10).alias("b"), F.upper("event_type").alias("e")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def agg_group_all(t):
    return A.group_all(t.lineitem, [C("l_returnflag"), C("l_linestatus"), C("l_linenumber")], [F.count("*").alias("n")])


@query("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 10")
def agg_having(t):
    return A.group_all(t.orders, [C("o_custkey")], [F.count("*").alias("n")], C("n") > 10)


@query("SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS p, COUNT(DISTINCT l_suppkey) AS s, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem GROUP BY 1")
def agg_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("p"), F.countDistinct("l_suppkey").alias("s"), F.sum_distinct("l_linenumber").alias("d"))


@query("SELECT event_type, COUNT(*) FILTER (WHERE value > 50) AS n, ROUND(SUM(value) FILTER (WHERE user_id % 2 = 0), 2) AS s FROM events GROUP BY event_type")
def agg_filter(t):
    return t.events.groupBy("event_type").agg(A.count_if(C("value") > 50).alias("n"), r2(A.filtered(F.sum, C("value"), C("user_id") % 2 == 0)).alias("s"))


@query("SELECT event_type, ROUND(STDDEV(value), 4) AS sd, ROUND(STDDEV_POP(value), 4) AS sp, ROUND(VARIANCE(value), 3) AS v, ROUND(VAR_POP(value), 3) AS vp, STDDEV(value) FILTER (WHERE event_id = 1) AS one FROM events GROUP BY 1")
def agg_stats(t):
    v = C("value")
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp(v), 4).alias("sd"), F.round(F.stddev_pop(v), 4).alias("sp"), F.round(F.var_samp(v), 3).alias("v"), F.round(F.var_pop(v), 3).alias("vp"), F.stddev_samp(F.when(C("event_id") == 1, v)).alias("one"))


@query("SELECT event_type, MEDIAN(value) AS m FROM events GROUP BY event_type")
def agg_median(t):
    return t.events.groupBy("event_type").agg(F.median("value").alias("m"))


@query("SELECT n_regionkey, STRING_AGG(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string(t):
    return t.nation.groupBy("n_regionkey").agg(A.string_agg(C("n_name"), "|").alias("names"))


@query("SELECT o_orderpriority, BOOL_AND(o_totalprice > 1000) AS b_all, BOOL_OR(o_totalprice > 400000) AS b_any FROM orders GROUP BY 1")
def agg_bool(t):
    return t.orders.groupBy("o_orderpriority").agg(F.bool_and(C("o_totalprice") > 1000).alias("b_all"), F.bool_or(C("o_totalprice") > 400000).alias("b_any"))


@query("SELECT o_orderstatus, ROUND(SUM(o_totalprice) / COUNT(*) + MAX(o_custkey) * 2, 2) AS x FROM orders GROUP BY 1")
def agg_nested_expr(t):
    return t.orders.groupBy("o_orderstatus").agg(r2(F.sum("o_totalprice") / F.count("*") + F.max("o_custkey") * 2).alias("x"))


# -- windows ----------------------------------------------------------------------

def _by_cust():
    return ["o_custkey"], [O.desc("o_totalprice"), O.asc("o_orderkey")]


@query("SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def win_row_number(t):
    return t.orders.select("o_orderkey", W.row_number(W.over(*_by_cust())).alias("rn"))


@query("SELECT p_partkey, RANK() OVER w AS r, DENSE_RANK() OVER w AS d FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
def win_rank(t):
    w = W.over(["p_brand"], [O.asc("p_size")])
    return t.part.select("p_partkey", W.rank(w).alias("r"), W.dense_rank(w).alias("d"))


@query("SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
def win_ntile(t):
    return t.orders.select("o_orderkey", W.ntile(4, W.over(["o_orderstatus"], [O.asc("o_totalprice"), O.asc("o_orderkey")])).alias("q"))


@query("SELECT event_id, LAG(value) OVER w AS prev, LEAD(value, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_lead_lag(t):
    w = W.over(["user_id"], [O.asc("ts"), O.asc("event_id")])
    return t.events.select("event_id", F.lag("value").over(w).alias("prev"), F.lead("value", 2).over(w).alias("next2"))


@query("SELECT event_id, FIRST_VALUE(value) OVER w AS f, LAST_VALUE(value) OVER w AS l, NTH_VALUE(value, 2) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def win_first_last_nth(t):
    w = W.over(["user_id"], [O.asc("ts"), O.asc("event_id")])
    return t.events.select("event_id", F.first("value").over(w).alias("f"), F.last("value").over(w).alias("l"), F.nth_value("value", 2).over(w).alias("n"))


@query("SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS s, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS m, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey), 5) AS a FROM orders")
def win_agg_partition(t):
    w = W.over(["o_custkey"])
    return t.orders.select("o_orderkey", F.count("*").over(w).alias("n"), r2(F.sum("o_totalprice").over(w)).alias("s"), F.max("o_totalprice").over(w).alias("m"), F.round(F.avg("o_totalprice").over(w), 5).alias("a"))


@query("SELECT event_id, ROUND(SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 2) AS run, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events")
def win_running(t):
    w = W.over(["user_id"], [O.asc("ts"), O.asc("event_id")])
    return t.events.select("event_id", r2(F.sum("value").over(w)).alias("run"), F.count("*").over(w).alias("n"))


@query("SELECT event_id, COUNT(*) FILTER (WHERE value > 50) OVER (PARTITION BY event_type) AS n FROM events")
def win_filter(t):
    return t.events.select("event_id", W.filtered(F.count, F.lit(1), C("value") > 50, W.over(["event_type"])).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def qualify_topn(t):
    return W.top_per_group(t.orders, *_by_cust(), 2).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_brand FROM part QUALIFY RANK() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) = 1 AND COUNT(*) OVER (PARTITION BY p_brand) > 2")
def qualify_rank(t):
    return W.qualify(t.part, (F.rank().over(W.over(["p_brand"], [O.desc("p_retailprice")])) == 1) & (F.count("*").over(W.over(["p_brand"])) > 2)).select("p_partkey", "p_brand")


# -- sorting, set operations, CTEs ----------------------------------------------------


@query("SELECT k, v, ROW_NUMBER() OVER (ORDER BY v ASC NULLS LAST, k) AS place FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)")
def sort_nulls(t):
    rows = t.orders.select(C("o_orderkey").alias("k"), F.when(C("o_orderkey") % 3 != 0, C("o_totalprice")).alias("v"))
    return W.distributed(rows.select("k", "v", W.row_number(W.over([], [O.asc("v"), O.asc("k")])).alias("place")))


@query("SELECT p_name, p_size FROM part ORDER BY p_size % 7 DESC, 1, p_partkey")
def sort_expr_ordinal(t):
    return t.part.orderBy(O.desc(C("p_size") % 7), O.asc("p_name"), O.asc("p_partkey")).select("p_name", "p_size")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def limit_offset(t):
    return O.limit(t.orders.select("o_orderkey").orderBy("o_orderkey"), 10, 25)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def topk(t):
    return O.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), 100, O.desc("l_extendedprice"), O.asc("l_orderkey"), O.asc("l_linenumber"))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


for _name, _word, _f in (("union", "UNION", S.union), ("union_all", "UNION ALL", S.union_all), ("intersect", "INTERSECT", S.intersect), ("except", "EXCEPT", S.except_), ("intersect_all", "INTERSECT ALL", S.intersect_all), ("except_all", "EXCEPT ALL", S.except_all)):

    def _setop(spark, sf_dir, f=_f):
        t = Tables(spark, sf_dir)
        return f(t.orders.select(C("o_custkey").alias("k")), t.customer.filter("c_acctbal > 2000").select(C("c_custkey").alias("k")))

    QUERIES[_name], ORACLE[_name] = _setop, f"SELECT o_custkey AS k FROM orders {_word} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 2000"


@query("SELECT CAST(n_nationkey AS DOUBLE) AS x FROM nation UNION ALL SELECT c_acctbal FROM customer ORDER BY 1 DESC LIMIT 40")
def setop_order_limit(t):
    return O.order_by(S.union_all(t.nation.select(C("n_nationkey").alias("x")), t.customer.select("c_acctbal")), 1, descending=(0,)).limit(40)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), n AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY 1) SELECT n, COUNT(*) AS customers FROM n GROUP BY n")
def cte_multi(t):
    n = t.orders.filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("customers"))


@query("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
def cte_recursive(t):
    return t.spark.sql("WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) AS v(column0, column1)")
def values(t):
    return t.spark.createDataFrame([(1, "a"), (2, None)], "column0 int, column1 string")


@query("SELECT b, COUNT(*) AS n FROM (SELECT user_id % 7 AS b, value FROM events WHERE value > 10) AS d GROUP BY b")
def derived_table(t):
    return t.events.filter("value > 10").select((C("user_id") % 7).alias("b"), "value").groupBy("b").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, COUNT(*) AS c FROM events WHERE event_type <> '' GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10")
def hits_top_pairs(t):
    return O.top_k(t.events.filter("event_type <> ''").groupBy("event_type", "user_id").agg(F.count("*").alias("c")), 10, O.desc("c"), O.asc("event_type"), O.asc("user_id"))


@query("SELECT regexp_extract(url, '//([^/]*)', 1) AS host, COUNT(*) AS c, MIN(url) AS first, CAST(ROUND(AVG(length(url)), 6) AS DOUBLE) AS l FROM pages GROUP BY 1 HAVING c > 2")
def hits_hosts(t):
    host = regex.extract(C("url"), "//([^/]*)")
    return t.pages.groupBy(host.alias("host")).agg(F.count("*").alias("c"), F.min("url").alias("first"), F.round(F.avg(F.length("url")), 6).alias("l")).filter("c > 2")
