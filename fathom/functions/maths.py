"""Arithmetic and mathematical functions: outside the domain or range the result is NULL, never NaN or infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def guard(x: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _wide(x: Column) -> Column:
    return x.cast("double")


def int_div(a: Column, b: Column) -> Column:
    """Truncating division of integers; NULL for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b))


def div(a: Column, b: Column) -> Column:
    return F.try_divide(_wide(a), _wide(b))


def add(a: Column, b: Column) -> Column:
    """NULL on overflow, as the next two."""
    return F.try_add(a, b)


def sub(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b)


def mul(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def shift_left(a: Column, n: Column) -> Column:
    """NULL for shifts below 0 or above 63."""
    return F.when((n >= 0) & (n < 64), F.call_function("shiftleft", a.cast("long"), n.cast("int")))


def shift_right(a: Column, n: Column) -> Column:
    return F.when((n >= 0) & (n < 64), F.call_function("shiftright", a.cast("long"), n.cast("int")))


def abs_(x: Column, bits: int = 64) -> Column:
    """NULL for the least integer."""
    return F.when(x != -(2 ** (bits - 1)), F.abs(x))


def ceil(x: Column) -> Column:
    return F.ceil(_wide(x)).cast("double")


def floor(x: Column) -> Column:
    return F.floor(_wide(x)).cast("double")


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero."""
    return F.round(_wide(x), digits)


def trunc(x: Column, digits: int = 0) -> Column:
    p = F.lit(float(10**digits))
    return F.signum(_wide(x)) * F.floor(F.abs(_wide(x)) * p).cast("double") / p


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def cbrt(x: Column) -> Column:
    return F.cbrt(_wide(x))


def power(x: Column, y: Column) -> Column:
    return guard(F.pow(_wide(x), _wide(y)))


def exp(x: Column) -> Column:
    return guard(F.exp(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def log(x: Column, base: Column | None = None) -> Column:
    """Base 10, or any base: log(x, base=b)."""
    return log10(x) if base is None else guard(F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base)))


def fmod(x: Column, y: Column) -> Column:
    return F.try_mod(_wide(x), _wide(y))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def _guarded(name: str):
    def f(x: Column) -> Column:
        return guard(getattr(F, name)(_wide(x)))

    f.__name__ = name
    return f


sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, asinh, acosh, atanh = (_guarded(n) for n in "sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh".split())
atan2, degrees, radians, pi = F.atan2, F.degrees, F.radians, F.pi


def isinf(x: Column) -> Column:
    return F.abs(x) == float("inf")


def isfinite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 92 are enough for 64 bits."""
    zero = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), zero, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.try_multiply(int_div(F.abs(a.cast("long")), gcd(a, b)), F.abs(b.cast("long"))))


def factorial(n: Column) -> Column:
    """1 for negative numbers, NULL above 20."""
    return F.when(n < 0, F.lit(1).cast("long")).otherwise(F.factorial(n.cast("int")))
