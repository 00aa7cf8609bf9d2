"""Scalar functions, by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import conditional as N
from fathom.functions import dates as D
from fathom.functions import maths as M
from fathom.functions import regex as R
from fathom.functions import strings as S
from queries.relational import C, Tables

QUERIES = {}
ORACLE = {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(r"""SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, CAST(strlen(p_name) AS INTEGER) AS octets, CAST(8 * strlen(p_name) AS INTEGER) AS bits, CAST(ascii(p_name) AS INTEGER) AS a, chr(128175) || chr(p_size + 60) AS c, upper(p_name) AS u, lower(p_type) AS l,
substring(p_name, 0, 3) AS s0, left(p_name, 2) AS s1, substring(p_name, 3) AS s2, replace(p_name, 'a', 'XX') AS r, concat(p_name, NULL, '-', p_brand) AS c1, concat_ws('/', p_name, NULL, p_brand) AS c2 FROM (SELECT *, CAST(p_size AS INTEGER) FROM part)""")
def fn_string_1(t):
    s = C("p_name")
    null = F.lit(None).cast("string")
    return t.part.select("p_partkey", F.length(s).alias("n"), F.octet_length(s).alias("octets"), F.bit_length(s).alias("bits"), F.ascii(s).alias("a"), F.concat(S.chr_(F.lit(128175)), S.chr_(C("p_size") + 60)).alias("c"), F.upper(s).alias("u"), F.lower("p_type").alias("l"),
        S.substring(s, 0, 3).alias("s0"), S.substring(s, -2, 5).alias("s1"), S.substring(s, 3).alias("s2"), F.replace(s, F.lit("a"), F.lit("XX")).alias("r"), S.concat(s, null, F.lit("-"), C("p_brand")).alias("c1"), S.concat_ws("/", s, null, C("p_brand")).alias("c2"))


@query(r"""SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim(p_brand, 'Ba') AS lt, rtrim(p_brand, '123') AS rt, CAST(strpos(p_name, 'a') AS INTEGER) AS p, p_name[:3] AS l3, left(p_name, -2) AS lm, right(p_name, 3) AS r3, right(p_name, -2) AS rm,
lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '-+') AS rp, reverse(p_name) AS rv, repeat(p_brand, 3) AS rep, starts_with(p_name, 'b') AS sw, suffix(p_name, 'e') AS ew, contains(p_type, 'A') AS ct FROM part""")
def fn_string_2(t):
    s, b = C("p_name"), C("p_brand")
    return t.part.select("p_partkey", S.trim(F.concat(F.lit("  "), s, F.lit(" "))).alias("t"), S.ltrim(b, "Ba").alias("lt"), S.rtrim(b, "123").alias("rt"), S.position(s, "a").alias("p"), S.left(s, 3).alias("l3"), S.left(s, -2).alias("lm"), S.right(s, 3).alias("r3"), S.right(s, -2).alias("rm"),
        F.lpad(b, 12, "*").alias("lp"), F.rpad(b, 12, "-+").alias("rp"), F.reverse(s).alias("rv"), S.repeat(b, 3).alias("rep"), F.startswith(s, F.lit("b")).alias("sw"), F.endswith(s, F.lit("e")).alias("ew"), F.contains(C("p_type"), F.lit("A")).alias("ct"))


@query(r"""SELECT page_id, split_part(url, '/', 3) AS h, split_part(url, '/', -1) AS last, split_part(url, '/', 99) AS none, translate(url, 'htp', 'HT') AS tr FROM pages""")
def fn_string_3(t):
    u = C("url")
    return t.pages.select("page_id", S.split_part(u, "/", 3).alias("h"), S.split_part(u, "/", -1).alias("last"), S.split_part(u, "/", 99).alias("none"), F.translate(u, "htp", "HT").alias("tr"))


@query(r"""SELECT p_partkey, p_type, array_to_string(list_transform(regexp_extract_all(p_type || ' foo-bar2baz', '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '') AS i FROM part""")
def fn_string_initcap(t):
    return t.part.select("p_partkey", "p_type", S.initcap(F.concat(C("p_type"), F.lit(" foo-bar2baz"))).alias("i"))


@query(r"""SELECT doc_id, md5(text) AS m, sha1(text) AS s1, sha256(text) AS s2, base64(encode(text)) AS b, text AS back, hex(encode(text)) AS h, text AS uh FROM documents""")
def fn_hash_encode(t):
    x = C("text")
    return t.documents.select("doc_id", S.md5(x).alias("m"), S.sha1(x).alias("s1"), S.sha256(x).alias("s2"), S.base64_encode(x).alias("b"), S.base64_decode(S.base64_encode(x)).alias("back"), S.hex_(x).alias("h"), S.unhex(S.hex_(x)).alias("uh"))


@query(r"""SELECT page_id, regexp_matches(url, 'e[a-m]+') AS m, regexp_replace(url, '([a-z])([0-9])', '\2\1$', 'g') AS r, NULLIF(regexp_extract(url, '//([^/]+)', 1), '') AS e, NULLIF(regexp_extract(url, '[0-9]+'), '') AS d, NULLIF(regexp_extract(url, 'qqq'), '') AS z FROM pages""")
def fn_regex(t):
    u = C("url")
    return t.pages.select("page_id", R.matches(u, "e[a-m]+").alias("m"), R.replace(u, "([a-z])([0-9])", r"\2\1$").alias("r"), R.extract(u, "//([^/]+)").alias("e"), R.extract(u, "[0-9]+").alias("d"), R.extract(u, "qqq").alias("z"))


@query(r"""SELECT event_id, abs(v) AS a, ceil(v) AS c, floor(v) AS f, round(v) AS r, round(v, -1) AS r10, trunc(v) AS t, CASE WHEN v >= 0 THEN round(sqrt(v), 9) END AS q, round(cbrt(v), 9) AS cb, round(power(v / 10, 3), 6) AS p, CASE WHEN v > 0 THEN round(ln(v), 9) END AS ln, CASE WHEN v > 0 THEN round(log10(v), 9) END AS lg,
CASE WHEN v > 0 THEN round(log2(v), 9) END AS l2, CAST(sign(v) AS INTEGER) AS s, round(exp(v / 100), 9) AS e FROM (SELECT event_id, value - 50 AS v FROM events)""")
def fn_math_1(t):
    v = C("v")
    r9 = lambda x: F.round(x, 9)
    e = t.events.select("event_id", (C("value") - 50).alias("v"))
    return e.select("event_id", F.abs(v).alias("a"), M.ceil(v).alias("c"), M.floor(v).alias("f"), M.round_(v).alias("r"), M.round_(v, -1).alias("r10"), M.trunc(v).alias("t"), r9(M.sqrt(v)).alias("q"), r9(M.cbrt(v)).alias("cb"), F.round(M.power(v / 10, F.lit(3.0)), 6).alias("p"), r9(M.ln(v)).alias("ln"), r9(M.log(v)).alias("lg"), r9(M.log2(v)).alias("l2"), M.sign(v).alias("s"), r9(M.exp(v / 100)).alias("e"))


@query(r"""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE fmod(p_retailprice, p_size % 4) END AS fm, CAST(gcd(p_partkey, p_size) AS BIGINT) AS g, CAST(lcm(p_partkey, p_size) AS BIGINT) AS l, CAST(factorial(CAST(p_size % 15 AS INTEGER)) AS BIGINT) AS f, pi() AS pi,
least(p_size, NULL, 20) AS lo, greatest(p_size, 20, NULL) AS hi, isnan(p_retailprice) AS nan, isinf(p_retailprice) AS inf, isfinite(p_retailprice) AS fin FROM part""")
def fn_math_2(t):
    z, p = C("p_size"), C("p_retailprice")
    none = F.lit(None).cast("int")
    return t.part.select("p_partkey", M.fmod(p, z % 4).alias("fm"), M.gcd(C("p_partkey"), z).alias("g"), M.lcm(C("p_partkey"), z).alias("l"), M.factorial(z % 15).alias("f"), F.pi().alias("pi"), N.least(z, none, F.lit(20)).alias("lo"), N.greatest(z, F.lit(20), none).alias("hi"), F.isnan(p).alias("nan"), M.isinf(p).alias("inf"), M.isfinite(p).alias("fin"))


@query("SELECT event_id, " + ", ".join(f"round({f}(x), 9) AS {f}" for f in "sin cos tan atan sinh cosh tanh asinh".split()) + ", CASE WHEN abs(x) <= 1 THEN round(asin(x), 9) END AS asin, CASE WHEN abs(x) <= 1 THEN round(acos(x), 9) END AS acos, CASE WHEN x >= 1 THEN round(acosh(x), 9) END AS acosh, CASE WHEN abs(x) < 1 THEN round(atanh(x), 9) END AS atanh, round(atan2(x, 2), 9) AS a2, round(degrees(x), 9) AS dg, round(radians(x), 9) AS rd FROM (SELECT event_id, (value - 50) / 25 AS x FROM events)")
def fn_trig(t):
    x = C("x")
    e = t.events.select("event_id", ((C("value") - 50) / 25).alias("x"))
    plain = [F.round(getattr(M, f)(x), 9).alias(f) for f in "sin cos tan atan sinh cosh tanh asinh asin acos acosh atanh".split()]
    return e.select("event_id", *plain, F.round(M.atan2(x, F.lit(2.0)), 9).alias("a2"), F.round(F.degrees(x), 9).alias("dg"), F.round(F.radians(x), 9).alias("rd"))


_PARTS = "year month day quarter week dow isodow doy hour minute isoyear decade century millennium".split()


@query("SELECT event_id, " + ", ".join(f"extract({p} FROM ts) AS x_{p}" for p in _PARTS) + ", CAST(floor(extract(epoch FROM ts)) AS BIGINT) AS x_epoch, extract(second FROM ts) AS x_second FROM events")
def fn_date_extract(t):
    return t.events.select("event_id", *[D.part(p, C("ts")).alias(f"x_{p}") for p in [*_PARTS, "epoch", "second"]])


_TRUNCS = "second minute hour day week month quarter year decade century millennium".split()


@query("SELECT event_id, " + ", ".join(f"CAST(date_trunc('{p}', ts) AS TIMESTAMP) AS t_{p}" for p in _TRUNCS) + " FROM events")
def fn_date_trunc(t):
    return t.events.select("event_id", *[D.trunc(p, C("ts")).alias(f"t_{p}") for p in _TRUNCS])


@query("""SELECT o_orderkey, date_diff('day', DATE '1995-01-15', CAST(o_orderdate AS DATE)) AS d, (year(o_orderdate) - 1980) * 12 + month(o_orderdate) - 1 - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END AS m,
o_orderdate + INTERVAL 1 MONTH AS plus_month, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS minus_10, o_orderdate + INTERVAL 90 SECOND AS plus_90s, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-15' AS INTEGER) AS dd FROM orders""")
def fn_date_diff_add(t):
    o, day = C("o_orderdate"), C("o_orderdate").cast("date")
    start = F.lit("1995-01-15").cast("date")
    return t.orders.select("o_orderkey", D.diff("day", start, day).alias("d"), D.diff("month", F.lit("1980-01-15").cast("date"), o).alias("m"), D.add("month", F.lit(1), o).alias("plus_month"), D.add("day", F.lit(-10), day, True).alias("minus_10"), D.plus_seconds(o, F.lit(90)).alias("plus_90s"), D.days_between(day, start).alias("dd"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, strftime(ts, 'on %d/%m/%y') AS g, monthname(ts) AS mn, dayname(ts) AS dn, make_date(year(ts), 2, 3) AS md, last_day(ts) AS ld, make_timestamp(year(ts), 5, 6, 7, 8, 9.0) AS mt,
CAST(epoch_ms(ts) AS DOUBLE) AS em, CAST(make_timestamp(CAST(event_id * 86400 * 1000000 AS BIGINT)) AS TIMESTAMP) AS fe FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def fn_date_make_format(t):
    ts, i = C("ts"), F.lit
    e = t.events.select("event_id", D.trunc("second", C("ts")).alias("ts"))
    return e.select("event_id", D.strftime(ts, "%Y-%m-%d %H:%M:%S").alias("f"), D.strftime(ts, "on %d/%m/%y").alias("g"), D.month_name(ts).alias("mn"), D.day_name(ts).alias("dn"), D.make_date(F.year(ts), i(2), i(3)).alias("md"), D.last_day(ts).alias("ld"), D.make_timestamp(F.year(ts), i(5), i(6), i(7), i(8), i(9)).alias("mt"), D.epoch_ms(ts).alias("em"), D.from_epoch(C("event_id") * 86400).alias("fe"))


@query("SELECT event_id, COALESCE(v, value, 0) AS c, NULLIF(event_type, 'click') AS n, IFNULL(v, -1) AS i FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value END AS v FROM events)")
def fn_conditional(t):
    e = t.events.withColumn("v", F.when(C("event_id") % 2 == 0, C("value")))
    return e.select("event_id", N.coalesce(C("v"), C("value"), F.lit(0.0)).alias("c"), N.nullif(C("event_type"), F.lit("click")).alias("n"), N.ifnull(C("v"), F.lit(-1.0)).alias("i"))
