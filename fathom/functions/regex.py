"""Regular expressions: matching searches, replacing replaces all, extracting gives NULL without a match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(s: Column, pattern: str) -> Column:
    return s.rlike(pattern)


def replace(s: Column, pattern: str, to: str) -> Column:
    r"""``\1`` are groups, ``$`` is literal."""
    return F.regexp_replace(s, pattern, re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$")))


def has_group(pattern: str) -> bool:
    return re.search(r"(?<!\\)\((?!\?)", pattern) is not None


def extract(s: Column, pattern: str) -> Column:
    """The first group if there is one, else the whole match."""
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, 1 if has_group(pattern) else 0))
