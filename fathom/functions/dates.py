"""Dates and times: timestamps have no zone; parts are BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = {
    "year": lambda t: F.year(t), "month": lambda t: F.month(t), "day": lambda t: F.dayofmonth(t), "quarter": lambda t: F.quarter(t), "week": lambda t: F.weekofyear(t),
    "dow": lambda t: F.dayofweek(t) - 1, "isodow": lambda t: F.weekday(t) + 1, "doy": lambda t: F.dayofyear(t), "hour": lambda t: F.hour(t), "minute": lambda t: F.minute(t), "second": lambda t: F.second(t),
    "isoyear": lambda t: F.extract(F.lit("yearofweek"), t), "decade": lambda t: F.floor(F.year(t) / 10), "century": lambda t: F.floor((F.year(t) - 1) / 100) + 1, "millennium": lambda t: F.floor((F.year(t) - 1) / 1000) + 1,
    "epoch": lambda t: F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t.cast("timestamp_ntz")),
    "millisecond": lambda t: F.floor((F.extract(F.lit("second"), t) % 1) * 1000), "microsecond": lambda t: F.floor((F.extract(F.lit("second"), t) % 1) * 1000000),
}
_ALIASES = {"dayofmonth": "day", "dayofweek": "dow", "dayofyear": "doy", "years": "year", "months": "month", "days": "day", "weeks": "week", "hours": "hour", "minutes": "minute", "seconds": "second", "quarters": "quarter", "ms": "millisecond", "us": "microsecond", "decades": "decade", "centuries": "century", "millennia": "millennium"}


def unit(name: str) -> str:
    return _ALIASES.get(name.lower(), name.lower())


def part(name: str, t: Column) -> Column:
    """Sunday is dow 0, weeks are ISO weeks, milli- and microseconds are those of the second."""
    f = _PARTS.get(unit(name))
    if f is None:
        raise ValueError(f"unknown date part {name!r}")
    return f(t).cast("bigint")


def trunc(name: str, t: Column) -> Column:
    """Weeks start on Monday."""
    name = unit(name)
    span = {"decade": 10, "century": 100, "millennium": 1000}.get(name)
    if span:
        first = (F.floor(F.year(t) / span) * span).cast("int")
        one, zero = F.lit(1), F.lit(0)
        return F.make_timestamp_ntz(first, one, one, zero, zero, zero)
    return F.date_trunc(name, t).cast("timestamp_ntz")


def diff(name: str, a: Column, b: Column) -> Column:
    """Complete units from a to b."""
    return F.timestamp_diff(unit(name).upper(), a.cast("timestamp_ntz"), b.cast("timestamp_ntz")).cast("bigint")


def days_between(a: Column, b: Column) -> Column:
    """a - b in days."""
    return F.datediff(a, b)


def add(name: str, n: Column, t: Column, is_date: bool = False) -> Column:
    """The end of a month is kept within the month; dates stay dates for days and more."""
    out = F.timestamp_add(unit(name).upper(), n, t.cast("timestamp_ntz"))
    return out.cast("date") if is_date and unit(name) in ("day", "week", "month", "quarter", "year") else out


def plus_seconds(t: Column, n: Column) -> Column:
    return F.timestamp_add("SECOND", n, t.cast("timestamp_ntz"))


def age(a: Column, b: Column) -> Column:
    """Microseconds a - b."""
    return F.timestamp_diff("MICROSECOND", b.cast("timestamp_ntz"), a.cast("timestamp_ntz"))


_FORMAT = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "p": "a", "I": "hh", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def strftime(t: Column, pattern: str) -> Column:
    out, plain, i = "", "", 0
    while i < len(pattern):
        c, code = pattern[i], pattern[i + 1 : i + 2]
        if c == "%" and code and code != "%":
            out += (f"'{plain}'" if plain else "") + _FORMAT[code]
            plain, i = "", i + 2
        else:
            plain += "''" if c == "'" else c
            i += 2 if c == code == "%" else 1
    out += f"'{plain}'" if plain else ""
    return F.date_format(t, out)


def month_name(t: Column) -> Column:
    return F.date_format(t, "MMMM")


def day_name(t: Column) -> Column:
    return F.date_format(t, "EEEE")


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01").cast("timestamp_ntz"))


def epoch_ms(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t.cast("timestamp_ntz")) / 1000


def from_raw(v: Column) -> Column:
    """A BIGINT as a time: from 1e13 on microseconds, below seconds."""
    zero = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.when(F.abs(v) >= 10**13, F.timestamp_add("MICROSECOND", v, zero)).otherwise(F.timestamp_add("SECOND", v, zero))


make_date, last_day = F.make_date, F.last_day


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp_ntz(y, mo, d, h, mi, s)
