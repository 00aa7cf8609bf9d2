"""String functions: positions are 1-based code points, NULL in gives NULL out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def substring(s: Column, start, length=None) -> Column:
    """A start below 1 uses up length; a negative length gives ''."""
    start = col(start)
    begin = F.greatest(start, F.lit(1))
    if length is None:
        return F.substring(s, begin, F.length(s))
    return F.substring(s, begin, F.greatest(F.lit(0), start + col(length) - begin))


def left(s: Column, n) -> Column:
    """A negative n drops from the end."""
    n = col(n)
    return F.when(n < 0, F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))).otherwise(F.left(s, n))


def right(s: Column, n) -> Column:
    """A negative n drops from the start."""
    n = col(n)
    return F.when(n < 0, F.substring(s, 1 - n, F.length(s))).otherwise(F.right(s, n))


def concat(*parts: Column) -> Column:
    """Skips NULLs; all NULL gives ''."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def concat_ws(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def trim(s: Column, chars: str = BLANK) -> Column:
    return F.btrim(s, F.lit(chars))


def ltrim(s: Column, chars: str = BLANK) -> Column:
    return F.ltrim(s, F.lit(chars))


def rtrim(s: Column, chars: str = BLANK) -> Column:
    return F.rtrim(s, F.lit(chars))


def position(s: Column, needle) -> Column:
    """0 where absent."""
    return F.locate(needle, s) if isinstance(needle, str) else F.instr(s, needle)


def chr_(n: Column) -> Column:
    """The character of a Unicode code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def split_part(s: Column, sep: str, n: int) -> Column:
    """A negative n counts from the end, out of range (0 too) gives ''; an empty separator splits into characters."""
    if n == 0:
        return F.when(s.isNotNull(), F.lit(""))
    if not sep:
        at = F.lit(n) if n > 0 else F.length(s) + n + 1
        return F.when((at >= 1) & (at <= F.length(s)), F.substring(s, at, F.lit(1))).when(s.isNotNull(), F.lit(""))
    return F.split_part(s, F.lit(sep), F.lit(n))


def initcap(s: Column) -> Column:
    """Any character that isn't a letter starts a word."""
    parts = F.regexp_extract_all(s, F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def hex_(x: Column, bits: int = 64) -> Column:
    """Upper-case; negative numbers in the width of their type."""
    return F.right(F.hex(x), F.lit(bits // 4)) if bits < 64 else F.hex(x)


def unhex(s: Column) -> Column:
    """NULL where it isn't hexadecimal text."""
    return F.when(s.rlike("^([0-9A-Fa-f]{2})*$"), F.decode(F.unhex(s), "UTF-8"))


def base64_encode(s: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(s, "UTF-8")), "[\r\n]", "")


def base64_decode(s: Column) -> Column:
    return F.decode(F.try_to_binary(s, F.lit("base64")), "UTF-8")


def repeat(s: Column, n: int) -> Column:
    """Up to 65536 times; a negative count gives ''."""
    if n > 65536:
        raise ValueError("REPEAT takes a count up to 65536")
    return F.repeat(s, F.lit(max(n, 0)))


md5, sha1 = F.md5, F.sha1


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


def sha512(s: Column) -> Column:
    return F.sha2(s, 512)
