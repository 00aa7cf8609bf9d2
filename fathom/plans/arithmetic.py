"""Arithmetic of the dialect: overflow gives NULL, integers divide to integers, casts round half to even.

``+ - * %`` become the ``try_`` functions. Division and casts to integers depend on
the operands' types, which only the analysed query tells. They are therefore marked,
and ``decide`` analyses the query with literals of known numbers beside the operands:
the type to which Spark casts such a literal is the operand's. Every pass may find
more integers, as results of divisions are operands of others; mostly one is enough.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from fathom.plans.lexer import Token, closing, text
from fathom.plans.names import INTEGERS, type_name

#: Begin, before the left side, between the sides, end.
BEGIN, LEFT, RIGHT, END = "", "", "", ""
_MARK = re.compile(f"{BEGIN}([dc])(\\d+){LEFT}([^{BEGIN}-{END}]*){RIGHT}([^{BEGIN}-{END}]*){END}")
_BASE = 1_900_000_000
_TRY = {"+": "try_add", "-": "try_subtract", "*": "try_multiply", "%": "try_mod"}
_POWER = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}
KEYWORDS = frozenset("""SELECT DISTINCT ALL FROM WHERE GROUP BY HAVING QUALIFY ORDER LIMIT OFFSET UNION INTERSECT EXCEPT AND OR NOT IN IS LIKE ILIKE RLIKE SIMILAR BETWEEN WHEN THEN ELSE END AS ON USING
JOIN VALUES WITH ESCAPE ASC DESC NULLS ROWS RANGE GROUPS PRECEDING FOLLOWING CURRENT UNBOUNDED OVER PARTITION WINDOW FILTER EXISTS ANY SOME DIV SET LATERAL NATURAL CROSS INNER OUTER FULL SEMI ANTI RECURSIVE
FOR LEADING TRAILING BOTH INTO TABLESAMPLE""".split())
_UNITS = frozenset("YEAR YEARS MONTH MONTHS WEEK WEEKS DAY DAYS HOUR HOURS MINUTE MINUTES SECOND SECONDS MILLISECOND MILLISECONDS MICROSECOND MICROSECONDS TO".split())


class Arithmetic:
    """Rewrites tokens; equal expressions get equal marks, so that GROUP BY still meets SELECT."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}

    def __call__(self, toks: list[Token]) -> list[Token]:
        out, i = [], 0
        while i < len(toks):
            if toks[i].kind == "word" and toks[i].up in ("LIMIT", "OFFSET"):
                made, i = _constant(toks, i)
                out += made
            elif self._starts(toks, i):
                made, i = self._expression(toks, i, 0)
                out += made
            else:
                out.append(toks[i])
                i += 1
        return out

    @staticmethod
    def _next(toks: list[Token], i: int) -> int:
        while i < len(toks) and toks[i].kind == "space":
            i += 1
        return i

    def _starts(self, toks: list[Token], i: int) -> bool:
        if i >= len(toks):
            return False
        t = toks[i]
        if t.kind == "word":
            if t.up in ("LEFT", "RIGHT"):
                j = self._next(toks, i + 1)
                return j < len(toks) and toks[j].text == "("
            return t.up not in KEYWORDS
        return t.kind in ("number", "string", "raw", "quoted") or t.text == "(" or t.text in ("+", "-") and self._starts(toks, self._next(toks, i + 1))

    def _expression(self, toks: list[Token], i: int, power: int) -> tuple[list[Token], int]:
        left, j = self._prefix(toks, i)
        while True:
            k = self._next(toks, j)
            if k >= len(toks) or toks[k].kind != "op" or _POWER.get(toks[k].text, 0) <= power:
                return left, j
            r = self._next(toks, k + 1)
            if not self._starts(toks, r):
                return left, j
            right, j = self._expression(toks, r, _POWER[toks[k].text])
            if toks[k].text == "/":
                left = self._mark("d", left, right)
            else:
                left = [Token("word", _TRY[toks[k].text]), Token("op", "("), *left, Token("op", ","), Token("space", " "), *right, Token("op", ")")]

    def _mark(self, kind: str, left: list[Token], right: list[Token]) -> list[Token]:
        key = (kind, text(left).lower(), text(right).lower())
        n = self.numbers.setdefault(key, len(self.numbers))
        return [Token("mark", f"{BEGIN}{kind}{n}{LEFT}"), *left, Token("mark", RIGHT), *right, Token("mark", END)]

    def _cast(self, operand: list[Token], kind: list[Token], word: str = "CAST") -> list[Token]:
        name = type_name(text(kind).strip())
        if word == "CAST" and name in INTEGERS:
            return self._mark("c", operand, [Token("raw", name)])
        return [Token("word", word), Token("op", "("), *operand, Token("space", " "), Token("word", "AS"), Token("space", " "), Token("raw", name), Token("op", ")")]

    def _prefix(self, toks: list[Token], i: int) -> tuple[list[Token], int]:
        t = toks[i]
        if t.text in ("+", "-") and t.kind == "op":
            made, j = self._prefix(toks, self._next(toks, i + 1))
            return [t, *made], j
        j = i + 1
        if t.text == "(" and t.kind == "op":
            end = closing(toks, i)
            node, j = [t, *self(toks[i + 1 : end]), toks[end]], end + 1
        elif t.up == "CASE" and t.kind == "word":
            depth = 0
            for end in range(i, len(toks)):
                depth += (toks[end].kind == "word") * ((toks[end].up == "CASE") - (toks[end].up == "END"))
                if not depth:
                    break
            node, j = [t, *self(toks[i + 1 : end]), toks[end]], end + 1
        else:
            node = [t]
            k = self._next(toks, j)
            after = toks[k] if k < len(toks) else None
            if t.up in ("DATE", "TIMESTAMP", "TIME") and after is not None and after.kind == "string":
                node, j = toks[i : k + 1], k + 1
            elif t.up == "INTERVAL" and after is not None and (after.kind in ("number", "string") or after.text == "-"):
                j = k + 1 + (after.text == "-")
                while (k := self._next(toks, j)) < len(toks) and toks[k].kind == "word" and toks[k].up in _UNITS:
                    j = k + 1
                node = toks[i:j]
            elif t.kind in ("word", "quoted"):
                while j + 1 < len(toks) and toks[j].text == ".":
                    node, j = [*node, toks[j], toks[j + 1]], j + 2
                k = self._next(toks, j)
                if k < len(toks) and toks[k].text == "(" and node[-1].text != "*":
                    end = closing(toks, k)
                    inner = toks[k + 1 : end]
                    at = _last_as(inner) if t.up in ("CAST", "TRY_CAST") else None
                    if at is not None:
                        node = self._cast(_trimmed(self(inner[:at])), inner[at + 1 :], t.up)
                    else:
                        node = [*node, toks[k], *self(inner), toks[end]]
                    j = end + 1
        while True:  # what follows an operand
            k = self._next(toks, j)
            if k >= len(toks):
                return node, j
            if toks[k].text == "::":
                a = self._next(toks, k + 1)
                b = a + 1
                c = self._next(toks, b)
                if c < len(toks) and toks[c].text == "(":
                    b = closing(toks, c) + 1
                node, j = self._cast(node, toks[a:b]), b
            elif toks[k].text == "[":
                end = next(e for e in range(k, len(toks)) if toks[e].text == "]")
                node, j = [*node, toks[k], *self(toks[k + 1 : end]), toks[end]], end + 1
            elif toks[k].up in ("OVER", "FILTER") and (p := self._next(toks, k + 1)) < len(toks) and toks[p].text == "(":
                end = closing(toks, p)
                node, j = [*node, *toks[j : p + 1], *self(toks[p + 1 : end]), toks[end]], end + 1
            elif toks[k].up == "OVER" and (p := self._next(toks, k + 1)) < len(toks) and toks[p].kind in ("word", "quoted"):
                node, j = [*node, *toks[j : p + 1]], p + 1
            elif toks[k].up in ("IGNORE", "RESPECT") and (p := self._next(toks, k + 1)) < len(toks) and toks[p].up == "NULLS":
                node, j = [*node, *toks[j : p + 1]], p + 1
            elif toks[k].up == "WITHIN" and (p := self._next(toks, self._next(toks, k + 1) + 1)) < len(toks) and toks[p].text == "(":
                end = closing(toks, p)
                node, j = [*node, *toks[j : p + 1], *self(toks[p + 1 : end]), toks[end]], end + 1
            else:
                return node, j


def _constant(toks: list[Token], at: int) -> tuple[list[Token], int]:
    """LIMIT or OFFSET with its expression, worked out if it is of whole numbers."""
    end = at + 1
    while end < len(toks) and (toks[end].kind in ("space", "number") or toks[end].text in ("+", "-", "*", "/", "%")):
        end += 1
    said = text(toks[at + 1 : end])
    if re.fullmatch(r"\s*\d+\s*(?:[-+*/%]\s*\d+\s*)+", said):
        return [toks[at], Token("number", f" {eval(said.replace('/', '//'), {'__builtins__': {}})} ")], end  # noqa: S307 - digits and operators only
    return [toks[at]], at + 1


def _trimmed(toks: list[Token]) -> list[Token]:
    while toks and toks[-1].kind == "space":
        toks = toks[:-1]
    while toks and toks[0].kind == "space":
        toks = toks[1:]
    return toks


def _last_as(toks: list[Token]) -> int | None:
    depth, at = 0, None
    for i, t in enumerate(toks):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.kind == "word" and t.up == "AS":
            at = i
    return at


def resolve(sql: str, whole: set[int], real: set[int], probe: str = "") -> str:
    """The SQL without marks: divisions in ``whole`` truncate, casts in ``real`` round; ``probe`` names the marks that get literals beside their operands: ``d``, ``c``, ``cd``, or one as ``c3``."""

    def one(m: re.Match) -> str:
        kind, n, a, b = m[1], int(m[2]), m[3], m[4]
        if kind in probe and probe in (kind, "cd", f"{kind}{n}"):
            a = f"if(true, {a}, {_BASE + 2 * n})"
            b = f"if(true, {b}, {_BASE + 2 * n + 1})" if kind == "d" else b
        if kind == "c":
            return f"CAST({f'bround(CAST({a} AS double))' if n in real else a} AS {b})"
        if n in whole:
            return f"CASE WHEN ({b}) = 0 THEN NULL WHEN ({b}) = -1 THEN try_subtract(0L, {a}) ELSE ({a}) div ({b}) END"
        return f"try_divide({a}, {b})"

    while BEGIN in sql:
        sql = _MARK.sub(one, sql)
    return sql


def decide(marked: str, analysed: Callable[[str], str]) -> str:
    """Resolves the marks; ``analysed`` gives the text of the analysed plan of a query, or raises."""
    if BEGIN not in marked:
        return marked
    numbers = {(m[0], int(m[1])) for m in re.findall(f"{BEGIN}([dc])(\\d+){LEFT}", marked)}
    kinds = "".join(sorted({k for k, _ in numbers}))
    whole: set[int] = set()
    real: set[int] = set()
    while True:
        plan = ""
        for probe in (kinds, "d", *(f"c{n}" for k, n in sorted(numbers) if k == "c")):
            # where some operand is no number: the divisions, then every cast by itself
            try:
                if probe[0] in kinds:
                    plan += analysed(resolve(marked, whole, real, probe))
            except Exception:  # noqa: BLE001
                continue
            if probe == kinds:
                break
        cast_to = {int(m[1]) - _BASE: m[2] for m in re.finditer(r"else (?:cast\()?(19\d{8})(?: as (\w+))?", plan)}
        is_int = lambda n: n in cast_to and cast_to[n] in (None, "int", "bigint")
        found = {n for k, n in numbers if k == "d" and is_int(2 * n) and is_int(2 * n + 1)}
        rounds = {n for k, n in numbers if k == "c" and cast_to.get(2 * n) in ("double", "float", "decimal")}
        if found <= whole and rounds <= real:
            return resolve(marked, whole, real)
        whole, real = whole | found, real | rounds
        if len(numbers) == 1:
            return resolve(marked, whole, real)
