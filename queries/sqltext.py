
from __future__ import annotations

from fathom.session import connect
from queries import relational, scalars
from queries.relational import Tables

QUERIES = {}
ORACLE = {}
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def add(name: str, sql: str, oracle: str | None = None) -> None:
    """``sql`` over views of the tables; ``oracle`` is the name of a query with that oracle, or SQL, or (None) the text itself."""

    def run(spark, sf_dir):
        e = connect(spark=spark)
        for t in TABLES:
            e.catalog.views[t] = f"SELECT * FROM '{sf_dir}/{t}.parquet'"
        return e.query(sql.replace("{sf}", sf_dir))

    QUERIES[f"sql_{name}"] = run
    ORACLE[f"sql_{name}"] = {**relational.ORACLE, **scalars.ORACLE}.get(oracle, oracle) if oracle else sql


# -- names, places of tables, literals

add("identifiers", "SELECT doc_id, text, lang AS char, n_chars AS timestamp FROM '{sf}/documents.parquet'", 'SELECT doc_id, text, lang AS "char", n_chars AS "timestamp" FROM documents')
add("values", "SELECT * FROM (VALUES (1, 'a'), (2, NULL))", "values")
add("values_alias", "SELECT k, name, column1 FROM (VALUES (1, 'a'), (2, 'b')) AS v(k, name) JOIN (VALUES (1, 'x'), (2, 'y')) w ON k = w.column0", "SELECT * FROM (VALUES (1, 'a', 'x'), (2, 'b', 'y')) AS v(k, name, column1)")
add("alias_list", "SELECT k, name FROM region AS r(k, name)")
add("string_after_comma", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, 'x.csv' AS tag, o_orderkey FROM orders", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, 'x.csv' AS tag, o_orderkey FROM orders")
add("files_comma", "SELECT r_name, n_name FROM '{sf}/region.parquet' r, '{sf}/nation.parquet' n WHERE r_regionkey = n_regionkey", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
add("distinct_from", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' AND o_custkey IS NOT NULL")

# -- arithmetic

add("arithmetic", "SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey / (o_custkey % 5) AS q0, (0 - o_orderkey) / 7 AS neg, o_orderkey % (o_custkey % 5) AS m FROM orders", "arithmetic_int_div")
add("division_derived", "SELECT o_orderkey, q, q / 2 AS h, r / 2 AS f FROM (SELECT o_orderkey, o_orderkey / 7 AS q, o_totalprice / 7 AS r FROM orders) AS d", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey // 7 // 2 AS h, o_totalprice / 7 / 2 AS f FROM orders")
add("division_cte", "WITH a AS (SELECT o_custkey, o_orderkey / 100 AS q FROM orders), b AS (SELECT o_custkey, q / 3 AS t FROM a) SELECT t / 2 AS t, COUNT(*) AS n, SUM(o_custkey) / COUNT(*) AS mean FROM b GROUP BY t / 2", "SELECT o_orderkey // 100 // 3 // 2 AS t, COUNT(*) AS n, CAST(SUM(o_custkey) // COUNT(*) AS BIGINT) AS mean FROM orders GROUP BY 1")
add("overflow_null", "SELECT CAST(k AS BIGINT) AS k, k + 2147483600 AS a, k * 100000000 AS m, -2147483600 - k AS s FROM (SELECT n_nationkey * 3 AS k FROM nation) AS d", "arithmetic_overflow_null")
add("precedence", "SELECT p_partkey, p_size + 3 * p_size - 7 % p_size AS a, -p_size * 2 + (p_size - 1) * -1 AS b, p_retailprice * 2 - p_size / 2.0 AS c FROM part")
add("bitwise", "SELECT k, k & 6 AS a, k | 8 AS o, k ^ 5 AS x FROM (SELECT CAST(p_size * 2 AS BIGINT) AS k FROM part) AS d", "SELECT k, k & 6 AS a, k | 8 AS o, xor(k, 5) AS x FROM (SELECT CAST(p_size * 2 AS BIGINT) AS k FROM part)")
add("cast", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey / 2.0 AS BIGINT) AS half_even, TRY_CAST(o_orderpriority AS INTEGER) AS bad, TRY_CAST(LEFT(o_orderpriority, 1) AS INTEGER) AS good, o_orderdate::DATE AS d, TRY_CAST('yes' AS BOOLEAN) AS b FROM orders", "cast_trycast")
add("cast_boolean", "SELECT p_partkey, CAST(p_size > 20 AS INTEGER) AS f, CAST(p_retailprice / 8 AS INTEGER) AS r, p_retailprice::BIGINT AS l FROM part")

# -- subqueries and CTEs

add("in_subquery", relational.ORACLE["semi_in_subquery"])
add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
add("not_in_null", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN r_regionkey END FROM region) OR n_nationkey NOT IN (SELECT r_regionkey FROM region)")
add("exists", relational.ORACLE["exists"])
add("not_exists", relational.ORACLE["not_exists"])
add("scalar_subquery", relational.ORACLE["scalar_subquery"])
add("correlated_scalar", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
add("cte_multi", relational.ORACLE["cte_multi"])
add("cte_recursive", relational.ORACLE["cte_recursive"])
add("derived_table", relational.ORACLE["derived_table"])

# -- aggregates, windows, order

add("agg_all", "SELECT o_orderstatus, COUNT(ALL o_custkey) AS n, ROUND(SUM(ALL o_totalprice), 2) AS s, COUNT(DISTINCT o_custkey) AS d, ROUND(AVG(o_totalprice), 6) AS a FROM orders GROUP BY ALL")
add("agg_filter", relational.ORACLE["agg_filter"])
add("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) / 2 > 1000")
add("string_agg", "SELECT n_regionkey, STRING_AGG(n_name, '-' ORDER BY n_name DESC) AS names, LISTAGG(n_name, ',' ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, STRING_AGG(n_name, '-' ORDER BY n_name DESC) AS names, STRING_AGG(n_name, ',' ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey")
add("window_filter", "SELECT o_orderkey, COUNT(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n, ROUND(SUM(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS s FROM orders")
add("windows", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER w AS BIGINT) AS rn, LAG(o_totalprice, 1, 0.0) OVER w AS before, o_totalprice - FIRST_VALUE(o_totalprice) OVER w AS above FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
add("qualify_expression", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 2 DESC, o_orderkey) <= 2")
add("order_limit_constant", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice / 2 DESC, 1 LIMIT 5 * 4 OFFSET 2 + 1")
add("null_order", "SELECT k, v, CAST(ROW_NUMBER() OVER (ORDER BY v, k) AS BIGINT) AS up, CAST(ROW_NUMBER() OVER (ORDER BY v DESC, k) AS BIGINT) AS down FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders) AS d", "SELECT k, v, ROW_NUMBER() OVER (ORDER BY v NULLS LAST, k) AS up, ROW_NUMBER() OVER (ORDER BY v DESC NULLS FIRST, k) AS down FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v FROM orders) AS d")
add("union_types", "SELECT n_nationkey AS x FROM nation UNION ALL SELECT c_acctbal FROM customer EXCEPT SELECT 3", "SELECT CAST(n_nationkey AS DOUBLE) AS x FROM nation UNION ALL SELECT c_acctbal FROM customer EXCEPT SELECT 3")

# -- scalar functions, as text

add("fn_string_1", """SELECT p_partkey, LENGTH(p_name) AS n, OCTET_LENGTH(p_name) AS octets, BIT_LENGTH(p_name) AS bits, ASCII(p_name) AS a, CHR(128175) || CHR(p_size + 60) AS c, UPPER(p_name) AS u, LOWER(p_type) AS l,
SUBSTRING(p_name, 0, 3) AS s0, SUBSTR(p_name, -2, 5) AS s1, SUBSTRING(p_name FROM 3) AS s2, REPLACE(p_name, 'a', 'XX') AS r, CONCAT(p_name, NULL, '-', p_brand) AS c1, CONCAT_WS('/', p_name, NULL, p_brand) AS c2 FROM part""", "fn_string_1")
add("fn_string_2", """SELECT p_partkey, TRIM('  ' || p_name || ' ') AS t, LTRIM(p_brand, 'Ba') AS lt, RTRIM(p_brand, '123') AS rt, POSITION('a' IN p_name) AS p, LEFT(p_name, 3) AS l3, LEFT(p_name, -2) AS lm, RIGHT(p_name, 3) AS r3, RIGHT(p_name, -2) AS rm,
LPAD(p_brand, 12, '*') AS lp, RPAD(p_brand, 12, '-+') AS rp, REVERSE(p_name) AS rv, REPEAT(p_brand, 3) AS rep, STARTS_WITH(p_name, 'b') AS sw, SUFFIX(p_name, 'e') AS ew, CONTAINS(p_type, 'A') AS ct FROM part""", "fn_string_2")
add("trim_from", "SELECT p_partkey, TRIM(LEADING 'B' FROM p_brand) AS a, TRIM(TRAILING '1234' FROM p_brand) AS b, TRIM(BOTH 'B5' FROM p_brand) AS c, TRIM(FROM '  ' || p_name) AS d FROM part", "SELECT p_partkey, ltrim(p_brand, 'B') AS a, rtrim(p_brand, '1234') AS b, trim(p_brand, 'B5') AS c, trim('  ' || p_name) AS d FROM part")
add("fn_string_3", "SELECT page_id, SPLIT_PART(url, '/', 3) AS h, SPLIT_PART(url, '/', -1) AS last, SPLIT_PART(url, '/', 99) AS none, TRANSLATE(url, 'htp', 'HT') AS tr FROM pages", "fn_string_3")
add("split_part_edges", "SELECT p_partkey, SPLIT_PART(p_name, 'a', 0) AS z, SPLIT_PART(p_name, '', 2) AS c, SPLIT_PART(p_name, '', -1) AS e FROM part", "SELECT p_partkey, '' AS z, p_name[2] AS c, p_name[-1] AS e FROM part")
add("fn_initcap", "SELECT p_partkey, p_type, INITCAP(p_type || ' foo-bar2baz') AS i FROM part", "fn_string_initcap")
add("fn_hash_encode", "SELECT doc_id, MD5(text) AS m, SHA1(text) AS s1, SHA256(text) AS s2, TO_BASE64(text) AS b, FROM_BASE64(TO_BASE64(text)) AS back, HEX(text) AS h, UNHEX(HEX(text)) AS uh FROM documents", "fn_hash_encode")
add("hex_int", "SELECT n_nationkey, HEX(n_nationkey) AS h, HEX(CAST(n_nationkey * 100 AS BIGINT)) AS b, HEX(-1 - n_nationkey) AS m FROM nation", "SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN '0' ELSE ltrim(printf('%X', n_nationkey), '0') END AS h, CASE WHEN n_nationkey = 0 THEN '0' ELSE ltrim(printf('%X', n_nationkey * 100), '0') END AS b, printf('%X', 4294967295 - n_nationkey) AS m FROM nation")
add("fn_regex", r"SELECT page_id, REGEXP_MATCHES(url, 'e[a-m]+') AS m, REGEXP_REPLACE(url, '([a-z])([0-9])', '\2\1$') AS r, REGEXP_EXTRACT(url, '//([^/]+)') AS e, REGEXP_EXTRACT(url, '[0-9]+') AS d, REGEXP_EXTRACT(url, 'qqq') AS z FROM pages", "fn_regex")
add("fn_math_1", """SELECT event_id, ABS(v) AS a, CEIL(v) AS c, FLOOR(v) AS f, ROUND(v) AS r, ROUND(v, -1) AS r10, TRUNCATE(v) AS t, ROUND(SQRT(v), 9) AS q, ROUND(CBRT(v), 9) AS cb, ROUND(POWER(v / 10, 3), 6) AS p, ROUND(LN(v), 9) AS ln, ROUND(LOG(v), 9) AS lg,
ROUND(LOG2(v), 9) AS l2, SIGN(v) AS s, ROUND(EXP(v / 100), 9) AS e FROM (SELECT event_id, value - 50 AS v FROM events) AS d""", "fn_math_1")
add("fn_math_2", """SELECT p_partkey, MOD(p_retailprice, p_size % 4) AS fm, GCD(p_partkey, p_size) AS g, LCM(p_partkey, p_size) AS l, FACTORIAL(p_size % 15) AS f, PI() AS pi, LEAST(p_size, NULL, 20) AS lo, GREATEST(p_size, 20, NULL) AS hi, ISNAN(p_retailprice) AS nan, ISINF(p_retailprice) AS inf, ISFINITE(p_retailprice) AS fin FROM part""", "fn_math_2")
add("fn_trig", "SELECT event_id, " + ", ".join(f"ROUND({f}(x), 9) AS {f}" for f in "sin cos tan atan sinh cosh tanh asinh asin acos acosh atanh".split()) + ", ROUND(ATAN2(x, 2), 9) AS a2, ROUND(DEGREES(x), 9) AS dg, ROUND(RADIANS(x), 9) AS rd FROM (SELECT event_id, (value - 50) / 25 AS x FROM events) AS d", "fn_trig")
add("fn_date_extract", "SELECT event_id, " + ", ".join(f"EXTRACT({p} FROM ts) AS x_{p}" for p in [*scalars._PARTS, "epoch", "second"]) + " FROM events", "fn_date_extract")
add("fn_date_part", "SELECT event_id, " + ", ".join(f"DATE_PART('{p}', ts) AS x_{p}" for p in [*scalars._PARTS, "epoch", "second"]) + " FROM events", "fn_date_extract")
add("fn_date_trunc", "SELECT event_id, " + ", ".join(f"DATE_TRUNC('{p}', ts) AS t_{p}" for p in scalars._TRUNCS) + " FROM events", "fn_date_trunc")
add("fn_date_diff_add", """SELECT o_orderkey, DATE_DIFF('day', DATE '1995-01-15', o_orderdate::DATE) AS d, DATE_DIFF('month', DATE '1980-01-15', o_orderdate) AS m, DATE_ADD('month', 1, o_orderdate) AS plus_month,
DATE_SUB(o_orderdate::DATE, 10) AS minus_10, DATE_ADD('second', 90, o_orderdate) AS plus_90s, DATEDIFF(o_orderdate::DATE, DATE '1995-01-15') AS dd FROM orders""", "fn_date_diff_add")
add("fn_date_make_format", """SELECT event_id, STRFTIME(ts, '%Y-%m-%d %H:%M:%S') AS f, FORMAT_TIMESTAMP(ts, 'on %d/%m/%y') AS g, MONTHNAME(ts) AS mn, DAYNAME(ts) AS dn, MAKE_DATE(YEAR(ts), 2, 3) AS md, LAST_DAY(ts) AS ld, MAKE_TIMESTAMP(YEAR(ts), 5, 6, 7, 8, 9) AS mt,
EPOCH_MS(ts) AS em, TO_TIMESTAMP(event_id * 86400) AS fe FROM (SELECT event_id, DATE_TRUNC('second', ts) AS ts FROM events) AS d""", "fn_date_make_format")
add("fn_age", "SELECT o_orderkey, AGE(o_orderdate, TIMESTAMP '1995-01-01 00:00:00') AS a FROM orders", "SELECT o_orderkey, date_diff('microsecond', TIMESTAMP '1995-01-01 00:00:00', o_orderdate) AS a FROM orders")
add("date_arithmetic", "SELECT o_orderkey, o_orderdate::DATE - INTERVAL '10' DAY AS a, o_orderdate::DATE + 3 AS b, o_orderdate + INTERVAL '90' SECOND AS c, o_orderdate::DATE + INTERVAL 1 MONTH AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS a, CAST(o_orderdate AS DATE) + 3 AS b, o_orderdate + INTERVAL 90 SECOND AS c, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS d FROM orders")
add("now", "SELECT LOCALTIMESTAMP > TIMESTAMP '2020-01-01 00:00:00' AS a, NOW() >= TIMESTAMP '2020-01-01 00:00:00' AS b, LENGTH(CURTIME()) AS c, CURRENT_DATE > DATE '2020-01-01' AS d, CURRENT_TIME IS NULL AS e", "SELECT true AS a, true AS b, CAST(8 AS INTEGER) AS c, true AS d, false AS e")
add("fn_conditional", "SELECT event_id, COALESCE(v, value, 0) AS c, NULLIF(event_type, 'click') AS n, NVL(v, -1) AS i FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS v FROM events) AS d", "fn_conditional")
add("case_if", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS kind, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS simple, IF(p_size > 25, 1, 0) AS flag FROM part", "case_if")
add("predicates", "SELECT event_id, (v > 50) IS TRUE AS is_true, (v > 50) IS NOT TRUE AS not_true, (v > 50) IS FALSE AS is_false, (v > 50) IS UNKNOWN AS unknown, v IS DISTINCT FROM 7 AS differs, (v > 50 OR NULL) AS kleene_or, (v > 50 AND NULL) AS kleene_and FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events) AS d", "filter_null_logic")
add("like", relational.ORACLE["filter_like_ilike_escape"])
add("in_between", relational.ORACLE["filter_in_between"])
