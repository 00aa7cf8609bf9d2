"""Questions in plain English to SQL, by rules: counts, totals, averages, extremes, per group, top N, a year, filters.

Anything the rules don't cover raises, rather than guessing.
"""

from __future__ import annotations

import re

from fathom.errors import BindFailure

_AGGS = ((r"\b(?:how many|count|number of)\b", "COUNT"), (r"\b(?:total|sum)\b", "SUM"), (r"\b(?:average|mean|avg)\b", "AVG"), (r"\b(?:smallest|lowest|least|minimum|min)\b", "MIN"), (r"\b(?:largest|highest|most|greatest|maximum|max)\b", "MAX"))
_REFUSED = r"\b(?:running|cumulative|forecast|predict|correlat\w+)\b"


def _column(word: str, columns: dict[str, str]) -> str | None:
    """The column a word means: its name, without plural s or underscores."""
    bare = lambda s: s.lower().replace("_", "").removesuffix("s")
    return next((c for c in columns if bare(c) == bare(word)), None)


def to_sql(question: str, source: str, columns: dict[str, str]) -> str:
    """``source``: what goes after FROM; ``columns``: names and simple Spark types."""
    q = question.lower().strip().rstrip("?.")
    if re.search(_REFUSED, q):
        raise BindFailure("running totals and predictions can't be asked for")
    if re.match(r"(describe|what columns|which columns)", q):
        return f"DESCRIBE {source}"
    numeric = [c for c, t in columns.items() if t in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    named = [c for w in re.findall(r"\w+", q) if (c := _column(w, columns))]
    group = re.search(r"\b(?:per|by|for each|in each)\s+(\w+)", q)
    key = _column(group[1], columns) if group else None
    if group and key is None:
        raise BindFailure(f"there is no column {group[1]!r}")
    where = []
    if (y := re.search(r"\b(?:in|during|for)\s+((?:19|20)\d\d)\b", q)) and (c := next((c for c, t in columns.items() if c.lower() == "year" or t in ("date", "timestamp_ntz", "timestamp")), None)):
        where.append(f"{c} = {y[1]}" if columns[c] in ("int", "bigint") else f"YEAR({c}) = {y[1]}")
    for word, op, value in re.findall(r"(\w+)\s+(over|above|more than|greater than|under|below|less than|is|equals|=)\s+'?([\w.]+)'?", q):
        if c := _column(word, columns):
            sign = ">" if op in ("over", "above", "more than", "greater than") else "<" if op in ("under", "below", "less than") else "="
            where.append(f"{c} {sign} {value}" if c in numeric else f"LOWER({c}) {sign} '{value}'")
    tail = f" WHERE {' AND '.join(where)}" if where else ""
    agg = next((a for p, a in _AGGS if re.search(p, q)), None)
    measure = next((c for c in named if c in numeric and c != key and not any(w.startswith(c + " ") for w in where)), None)
    top = re.search(r"\btop\s+(\d+)\b", q)
    if top and not key:
        by = measure or next(iter(numeric), None)
        if by is None:
            raise BindFailure("there is no number to rank by")
        return f"SELECT * FROM {source}{tail} ORDER BY {by} DESC LIMIT {top[1]}"
    if agg is None and top:
        agg = "SUM" if measure else "COUNT"
    if agg is None:
        if re.match(r"(show|list|give)", q):
            return f"SELECT * FROM {source}{tail} LIMIT 20"
        raise BindFailure("the question isn't understood")
    if agg != "COUNT" and measure is None:
        raise BindFailure(f"there is no number for {agg}")
    value = "COUNT(*) AS n" if agg == "COUNT" else f"{agg}({measure}) AS {agg.lower()}_{measure}"
    if not key:
        return f"SELECT {value} FROM {source}{tail}"
    name = value.rsplit(" ", 1)[-1]
    return f"SELECT {key}, {value} FROM {source}{tail} GROUP BY {key} ORDER BY {name} DESC, {key}" + (f" LIMIT {top[1]}" if top else "")
