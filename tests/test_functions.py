import re

from pyspark.sql import functions as F

from fathom.functions import conditional, dates, maths, strings
from fathom.operators import setops
from queries.scalars import QUERIES

SF = "/root/testdata/sf0.01"


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_initcap(spark):
    for r in QUERIES["fn_string_initcap"](spark, SF).collect():
        assert r.i == re.sub(r"[A-Za-z]+", lambda m: m[0][0].upper() + m[0][1:].lower(), r.p_type + " foo-bar2baz")


def test_strings(spark):
    h = F.lit("hello")
    assert one(spark, strings.substring(h, -2, 5), strings.substring(h, 4, 9), strings.substring(h, 1, -1), strings.left(F.lit("hi"), -5), strings.right(h, -2)) == ("he", "lo", "", "", "llo")
    assert one(spark, strings.split_part(F.lit("a,b"), ",", 0), strings.split_part(F.lit("ab"), "", 2), strings.split_part(F.lit("ab"), "", -1), strings.split_part(F.lit("a,b"), ",", -3)) == ("", "b", "b", "")
    assert one(spark, strings.unhex(F.lit("zz")), strings.hex_(F.lit(-1), 32), strings.base64_decode(F.lit("?")), strings.chr_(F.lit(65))) == (None, "FFFFFFFF", None, "A")


def test_maths(spark):
    big = F.lit(2**31 - 1)
    assert one(spark, maths.add(big, F.lit(1)), maths.int_div(F.lit(-7), F.lit(2)), maths.mod(F.lit(5), F.lit(0)), maths.shift_left(F.lit(1), F.lit(64)), maths.abs_(F.lit(-(2**31)), 32)) == (None, -3, None, None, None)
    assert one(spark, maths.sqrt(F.lit(-1.0)), maths.exp(F.lit(1000.0)), maths.log(F.lit(0.0)), maths.acos(F.lit(2.0)), maths.factorial(F.lit(-3)), maths.gcd(F.lit(48), F.lit(18))) == (None, None, None, None, 1, 6)
    assert one(spark, maths.trunc(F.lit(-2.349), 2), conditional.cast_int(F.lit(2.5)), conditional.cast_int(F.lit(1.5))) == (-2.34, 2, 2)


def test_dates(spark):
    t = F.lit("2024-01-31").cast("date")
    assert one(spark, dates.diff("month", t, F.lit("2024-02-29").cast("date")), dates.part("dow", F.lit("2024-01-07").cast("date"))) == (0, 0)
    assert str(one(spark, dates.add("month", F.lit(1), t, True))[0]) == "2024-02-29"
    assert str(one(spark, dates.from_raw(F.lit(86400)))[0]) == "1970-01-02 00:00:00"
    assert str(one(spark, dates.from_raw(F.lit(10**15)))[0]) == "2001-09-09 01:46:40"


def test_common_types(spark):
    a, b = spark.sql("SELECT 1 AS x, 'a' AS y"), spark.sql("SELECT 2.5D AS p, 3 AS q")
    assert [tuple(r) for r in setops.union_all(a, b).collect()] == [(1.0, "a"), (2.5, "3")]
