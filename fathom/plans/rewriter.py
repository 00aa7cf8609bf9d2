"""From the dialect to Spark SQL, token by token.

Sources (file literals, read functions, series) become temporary views; QUALIFY a
filter around the query; FILTER of a window aggregate a CASE in its argument;
functions whose names or rules differ get Spark expressions with the dialect's rules;
ORDER BY puts NULLs last (first if descending). Arithmetic is in ``arithmetic``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from fathom.errors import BindFailure
from fathom.functions.dates import _FORMAT, unit
from fathom.plans.arithmetic import KEYWORDS
from fathom.plans.lexer import Token, closing, split_args, text, tokens

_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT")
_RENAMES = {"STRLEN": "length", "BOOL_AND": "bool_and", "PREFIX": "startswith", "STARTS_WITH": "startswith", "SUFFIX": "endswith", "ENDS_WITH": "endswith", "GETDATE": "localtimestamp", "NOW": "localtimestamp", "SHA_1": "sha1", "POW": "power", "RANDOM": "rand", "GEN_RANDOM_UUID": "uuid", "IIF": "if", "DAYNAME": "dayname", "STRPOS": "instr"}


def _pattern(p: str) -> str:
    out, plain = "", ""
    body = p[1:-1].replace("''", "'")
    i = 0
    while i < len(body):
        if body[i] == "%" and i + 1 < len(body) and body[i + 1] in _FORMAT:
            out += (f"'{plain}'" if plain else "") + _FORMAT[body[i + 1]]
            plain, i = "", i + 2
        else:
            plain += body[i]
            i += 1
    out += f"'{plain}'" if plain else ""
    return "'" + out.replace("'", "\\'") + "'"


def _part(p: str, t: str) -> str:
    name = unit(p.strip().strip("'"))
    simple = {"year": "year", "month": "month", "day": "dayofmonth", "quarter": "quarter", "week": "weekofyear", "doy": "dayofyear", "hour": "hour", "minute": "minute", "second": "second"}
    if name in simple:
        return f"cast({simple[name]}({t}) AS bigint)"
    special = {"dow": f"dayofweek({t}) - 1", "isodow": f"weekday({t}) + 1", "isoyear": f"extract(yearofweek FROM {t})", "decade": f"floor(year({t}) / 10)", "century": f"floor((year({t}) - 1) / 100) + 1", "millennium": f"floor((year({t}) - 1) / 1000) + 1", "epoch": f"timestampdiff(SECOND, timestamp_ntz'1970-01-01', cast({t} AS timestamp_ntz))", "millisecond": f"floor((extract(SECOND FROM {t}) % 1) * 1000)", "microsecond": f"floor((extract(SECOND FROM {t}) % 1) * 1000000)"}
    return f"cast({special[name]} AS bigint)"


def _trunc(p: str, t: str) -> str:
    name = unit(p.strip().strip("'"))
    span = {"decade": 10, "century": 100, "millennium": 1000}.get(name)
    return f"make_timestamp_ntz(cast(floor(year({t}) / {span}) * {span} AS int), 1, 1, 0, 0, 0)" if span else f"cast(date_trunc('{name}', {t}) AS timestamp_ntz)"


def _guard(e: str) -> str:
    return f"nullif(nullif(nullif({e}, double('NaN')), double('inf')), double('-inf'))"


def _replace(s: str, p: str, to: str) -> str:
    return f"regexp_replace({s}, {p}, {re.sub(r'\\(\d)', r'$\1', to.replace('$', r'\\$'))})"


def _extract(s: str, p: str) -> str:
    return f"if({s} rlike {p}, regexp_extract({s}, {p}, {1 if re.search(r'(?<!\\)\((?!\?)', p) else 0}), null)"


def _substr(s: str, a: str, n: str | None = None) -> str:
    return f"substring({s}, greatest({a}, 1))" if n is None else f"substring({s}, greatest({a}, 1), greatest(0, ({a}) + ({n}) - greatest({a}, 1)))"


_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
_SPANS = {"day": (1, "DAY"), "week": (7, "DAY"), "month": (1, "MONTH"), "quarter": (3, "MONTH"), "year": (1, "YEAR")}


def _shift(sign: str) -> Callable[..., str]:
    def f(*a: str) -> str:
        """(unit, n, t), (t, n, unit), or (t, n) in days; a date stays one for days and more."""
        if len(a) == 2 and re.match(r"interval\b", a[1].strip(), re.I):
            return f"({a[0]} {sign or '+'} {a[1]})"
        if len(a) == 2:
            name, n, t = "day", a[1], a[0]
        else:
            name = unit(a[0].strip().strip("'"))
            name, n, t = (name, a[1], a[2]) if name in _UNITS else (unit(a[2].strip().strip("'")), a[1], a[0])
        if t.strip().startswith("'"):
            t = f"cast({t} AS {'date' if re.fullmatch(r"'[0-9-]+'", t.strip()) else 'timestamp_ntz'})"
        if name not in _SPANS:
            return f"timestampadd({name}, {sign}({n}), cast({t} AS timestamp_ntz))"
        times, span = _SPANS[name]
        return f"({t} {sign or '+'} cast({times} * ({n}) AS interval {span}))"

    return f


def _diff(*a: str) -> str:
    """(unit, a, b): complete units from a to b; (a, b): days a - b."""
    return f"datediff({a[0]}, {a[1]})" if len(a) == 2 else f"timestampdiff({unit(a[0].strip().strip(chr(39)))}, {a[1]}, {a[2]})"


def _gcd(a: str, b: str) -> str:
    return f"aggregate(sequence(1, 92), struct(abs(cast({a} AS bigint)) AS a, abs(cast({b} AS bigint)) AS b), (s, i) -> if(s.b = 0, s, struct(s.b AS a, try_mod(s.a, s.b) AS b)), s -> s.a)"


def _split_part(s: str, sep: str, n: str) -> str:
    at = f"if({n} > 0, {n}, length({s}) + {n} + 1)"
    return f"CASE WHEN {s} IS NULL OR {sep} IS NULL THEN NULL WHEN {n} = 0 THEN '' WHEN {sep} = '' THEN if({at} BETWEEN 1 AND length({s}), substring({s}, {at}, 1), '') ELSE split_part({s}, {sep}, nullif({n}, 0)) END"


def _initcap(s: str) -> str:
    return f"array_join(transform(regexp_extract_all({s}, '([A-Za-z]+|[^A-Za-z]+)', 1), w -> concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), '')"


def _strftime(a: str, b: str) -> str:
    return f"date_format({b}, {_pattern(a.strip())})" if a.strip().startswith("'") and "%" in a else f"date_format({a}, {_pattern(b.strip())})"


#: Words that are calls without parentheses.
BARE = {"LOCALTIMESTAMP": "localtimestamp()", "CURRENT_TIMESTAMP": "localtimestamp()", "CURRENT_TIME": "date_format(localtimestamp(), 'HH:mm:ss')", "LOCALTIME": "date_format(localtimestamp(), 'HH:mm:ss')"}

#: Name -> function of the argument texts.
FUNCTIONS: dict[str, Callable[..., str]] = {
    "LOG": lambda *a: f"if({a[0]} > 0, log10({a[0]}), null)" if len(a) == 1 else _guard(f"log({a[0]}, {a[1]})"),
    **{f: (lambda x, f=f.lower(): f"if({x} > 0, {f}({x}), null)") for f in ("LN", "LOG10", "LOG2")},
    "SQRT": lambda x: f"if({x} >= 0, sqrt({x}), null)",
    **{f: (lambda *a, f=f.lower(): _guard(f"{f}({', '.join(a)})")) for f in ("EXP", "POWER", "POW", "ASIN", "ACOS", "ACOSH", "ATANH")},
    "SIGN": lambda x: f"cast(signum({x}) AS int)", "CEIL": lambda x: f"cast(ceil(cast({x} AS double)) AS double)", "CEILING": lambda x: f"cast(ceil(cast({x} AS double)) AS double)", "FLOOR": lambda x: f"cast(floor(cast({x} AS double)) AS double)",
    "ROUND": lambda x, d="0": f"round(cast({x} AS double), {d})", "MOD": lambda a, b: f"try_mod(cast({a} AS double), cast({b} AS double))",
    **{f: (lambda x, d="0": f"(signum({x}) * floor(abs({x}) * power(10, {d})) / power(10, {d}))") for f in ("TRUNC", "TRUNCATE")},
    "ABS": lambda x: f"if({x} >= 0, {x}, try_subtract(0, {x}))", "ISINF": lambda x: f"(abs(cast({x} AS double)) = double('inf'))", "ISFINITE": lambda x: f"(NOT isnan(cast({x} AS double)) AND abs(cast({x} AS double)) < double('inf'))",
    "SPLIT_PART": _split_part, "INITCAP": _initcap, **{f: (lambda x: f"if(typeof({x}) = 'int', right(hex({x}), 8), hex({x}))") for f in ("HEX", "TO_HEX")},
    **{f: (lambda: "date_format(localtimestamp(), 'HH:mm:ss')") for f in ("CURTIME", "CURRENT_TIME")}, **{f: (lambda: "localtimestamp()") for f in ("CURRENT_TIMESTAMP", "LOCALTIMESTAMP")},
    "SUBSTRING": _substr, "SUBSTR": _substr,
    "LEFT": lambda s, n: f"if({n} < 0, substring({s}, 1, greatest(length({s}) + {n}, 0)), left({s}, {n}))", "RIGHT": lambda s, n: f"if({n} < 0, substring({s}, 1 - ({n})), right({s}, {n}))",
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(f'cast({x} AS string)' for x in a)})",
    "TRIM": lambda s, c=r"' \t\r\n'": f"btrim({s}, {c})", "LTRIM": lambda s, c=r"' \t\r\n'": f"ltrim({c}, {s})", "RTRIM": lambda s, c=r"' \t\r\n'": f"rtrim({c}, {s})",
    "CHR": lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')",
        **{f: (lambda s, p: f"({s} rlike {p})") for f in ("REGEXP_MATCHES", "REGEXP_MATCH", "REGEXP", "REGEXP_LIKE")}, "REGEXP_REPLACE": _replace, "REGEXP_EXTRACT": _extract,
    "SHA256": lambda s: f"sha2({s}, 256)", "SHA512": lambda s: f"sha2({s}, 512)", "SHA2_256": lambda s: f"sha2({s}, 256)", "SHA2_512": lambda s: f"sha2({s}, 512)",
    "TO_BASE64": lambda s: f"regexp_replace(base64(encode({s}, 'UTF-8')), '[\\r\\n]', '')", "BASE64_ENCODE": lambda s: f"regexp_replace(base64(encode({s}, 'UTF-8')), '[\\r\\n]', '')", "FROM_BASE64": lambda s: f"decode(try_to_binary({s}, 'base64'), 'UTF-8')", "BASE64_DECODE": lambda s: f"decode(try_to_binary({s}, 'base64'), 'UTF-8')",
    "DATE_PART": _part, "DATEPART": _part, "DATE_TRUNC": _trunc, **{f: _diff for f in ("DATE_DIFF", "DATEDIFF", "TIMESTAMPDIFF")}, **{f: _shift("") for f in ("DATE_ADD", "DATEADD", "TIMESTAMPADD")}, **{f: _shift("-") for f in ("DATE_SUB", "SUBDATE")},
    "GCD": _gcd, "LCM": lambda a, b: f"if({a} = 0 OR {b} = 0, 0L, abs(cast({a} AS bigint)) div {_gcd(a, b)} * abs(cast({b} AS bigint)))", "FACTORIAL": lambda n: f"if({n} < 0, 1L, factorial({n}))",
    "MONTHNAME": lambda t: f"date_format({t}, 'MMMM')", "DAYNAME": lambda t: f"date_format({t}, 'EEEE')",
    **{p.upper(): (lambda t, p=p: _part(p, t)) for p in ("year", "month", "day", "dayofmonth", "dayofweek", "dayofyear", "hour", "minute", "second", "week", "quarter", "decade", "century", "millennium", "epoch", "isodow", "isoyear", "millisecond", "microsecond")},
    **{f: _strftime for f in ("STRFTIME", "FORMAT_TIMESTAMP", "DATE_FORMAT")},
    "AGE": lambda a, b: f"timestampdiff(MICROSECOND, {b}, {a})", "IIF": lambda c, a, b: f"if({c}, {a}, {b})", "EPOCH_MS": lambda t: f"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', cast({t} AS timestamp_ntz)) / 1000)",
    "MAKE_TIMESTAMP": lambda *a: f"make_timestamp_ntz({', '.join(a)})", "TO_TIMESTAMP": lambda x: f"timestampadd(SECOND, {x}, timestamp_ntz'1970-01-01')", "UNHEX": lambda s: f"decode(unhex({s}), 'UTF-8')", "VERSION": lambda: "'1'", "CURRENT_DATABASE": lambda: "'main'",
}
TABLE_FUNCTIONS = ("READ_CSV", "READ_CSV_AUTO", "READ_PARQUET", "READ_JSON", "READ_JSON_AUTO", "READ_ARROW", "READ_AVRO", "READ_XLSX", "SQLITE_SCAN", "GENERATE_SERIES")


def _found(toks: list[Token], *names: str) -> int | None:
    """Position of the first of these words outside parentheses."""
    depth = 0
    for i, t in enumerate(toks):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.kind == "word" and t.up in names:
            return i
    return None


def _spoken(name: str, inner: list[Token]) -> list[list[Token]] | None:
    """Arguments of TRIM([kind] [characters] FROM x), SUBSTRING(x FROM a FOR n), POSITION(a IN x), in the order of a plain call, or None."""
    at = _found(inner, "FROM", "IN") if name in ("TRIM", "SUBSTRING", "POSITION") else None
    if at is None:
        return None
    head, tail = inner[:at], inner[at + 1 :]
    if name == "TRIM":
        head = [t for t in head if t.up not in ("LEADING", "TRAILING", "BOTH")]
        return [tail, head] if text(head).strip() else [tail]
    if name == "POSITION":
        return [head, tail]
    n = _found(tail, "FOR")
    return [head, tail] if n is None else [head, tail[:n], tail[n + 1 :]]


def names_and_functions(toks: list[Token]) -> list[Token]:
    """Quoted names to backticks, decimal literals to doubles, functions by FUNCTIONS and _RENAMES."""
    out: list[Token] = []
    i = 0
    while i < len(toks):
        t = toks[i]
        if t.kind == "quoted" and t.text[0] == '"':
            out.append(Token("quoted", "`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`"))
        elif t.kind == "string":
            out.append(Token("string", "'" + t.text[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"))
        elif t.kind == "number" and re.search(r"[.eE]", t.text):
            out.append(Token("number", t.text + "D"))
        elif t.kind == "word":
            nxt = next((j for j in range(i + 1, len(toks)) if toks[j].kind != "space"), None)
            call = nxt is not None and toks[nxt].text == "("
            dotted = i > 0 and toks[i - 1].text == "." or nxt is not None and toks[nxt].text == "."
            before = next((x.up for x in reversed(toks[:i]) if x.kind != "space"), "")
            end = closing(toks, nxt) if call else i
            inner = toks[nxt + 1 : end] if call else []
            said = _spoken(t.up, inner) if call else None
            if t.up == "TIMESTAMP" and nxt is not None and toks[nxt].kind == "string":
                out.append(Token("word", "timestamp_ntz"))
            elif t.up in BARE and not call and not dotted and before != "AS":
                out.append(Token("raw", BARE[t.up]))
            elif call and t.up == "EXTRACT":
                at = _found(inner, "FROM")
                out.append(Token("raw", _part(text(inner[:at]), text(names_and_functions(inner[at + 1 :])))))
                i = end
            elif said is not None:
                name = t.up
                if name == "TRIM":
                    name = {"LEADING": "LTRIM", "TRAILING": "RTRIM"}.get(next((x.up for x in inner if x.kind == "word" and x.up in ("LEADING", "TRAILING", "BOTH")), ""), "TRIM")
                args = [text(names_and_functions(a)).strip() for a in said]
                out.append(Token("raw", f"locate({args[0]}, {args[1]})" if name == "POSITION" else FUNCTIONS[name](*args)))
                i = end
            elif call and t.up in ("STRING_AGG", "GROUP_CONCAT", "LISTAGG"):
                at = _found(inner, "ORDER")
                args = split_args(inner if at is None else inner[:at])
                sep = names_and_functions(args[1]) if len(args) > 1 else [Token("string", "','")]
                out += [Token("word", "listagg"), Token("op", "("), *names_and_functions(args[0]), Token("op", ","), Token("space", " "), *sep, Token("op", ")")]
                if at is not None:
                    out += [*tokens(" WITHIN GROUP ("), *names_and_functions(inner[at:]), Token("op", ")")]
                i = end
            elif call and t.up in FUNCTIONS and not any(x.up in ("DISTINCT", "ORDER") for x in inner if x.kind == "word"):
                args = [text(names_and_functions(a)).strip() for a in split_args(inner)]
                try:
                    out.append(Token("raw", FUNCTIONS[t.up](*args)))
                except TypeError:
                    raise BindFailure(f"{t.text} doesn't take {len(args)} arguments") from None
                i = end
            elif call and t.up in _RENAMES:
                out.append(Token("word", _RENAMES[t.up]))
            else:
                out.append(t)
        else:
            out.append(t)
        i += 1
    return out


def filter_over(toks: list[Token]) -> list[Token]:
    """f(x) FILTER (WHERE p) OVER w: x becomes a CASE of p."""
    toks = list(toks)
    i = 0
    while i < len(toks):
        if toks[i].kind == "word" and toks[i].up == "FILTER":
            solid = [j for j in range(i + 1, len(toks)) if toks[j].kind != "space"]
            close = next((j for j in range(i - 1, -1, -1) if toks[j].kind != "space"), None)
            if solid and toks[solid[0]].text == "(" and close is not None and toks[close].text == ")":
                end = closing(toks, solid[0])
                after = next((t.up for t in toks[end + 1 :] if t.kind != "space"), "")
                if after == "OVER":
                    depth, start = 0, close
                    while True:
                        depth += (toks[start].text == ")") - (toks[start].text == "(")
                        if not depth:
                            break
                        start -= 1
                    where = _found(toks[solid[0] + 1 : end], "WHERE")
                    cond = toks[solid[0] + 1 : end][where + 1 :]
                    args = split_args(toks[start + 1 : close])
                    first = [Token("number", "1")] if text(args[0]).strip() == "*" else args[0]
                    rest = [x for a in args[1:] for x in (Token("op", ","), *a)]
                    toks[start + 1 : end + 1] = [*tokens("CASE WHEN "), *cond, *tokens(" THEN "), *first, *tokens(" END"), *rest, Token("op", ")")]
                    i = start
        i += 1
    return toks


def values_names(toks: list[Token]) -> list[Token]:
    """(VALUES ...) in a table's place has columns column0, column1, ... unless its alias names them."""
    toks = list(toks)
    i = 0
    while i < len(toks):
        solid = next((j for j in range(i + 1, len(toks)) if toks[j].kind != "space"), None)
        before = next((x for x in reversed(toks[:i]) if x.kind != "space"), None)
        if toks[i].text == "(" and solid is not None and toks[solid].up == "VALUES" and before is not None and before.up in ("FROM", "JOIN", ","):
            end = closing(toks, i)
            first = next(j for j in range(solid, end) if toks[j].text == "(")
            width = len(split_args(toks[first + 1 : closing(toks, first)]))
            names = f"({', '.join(f'column{k}' for k in range(width))})"
            at = [j for j in range(end + 1, len(toks)) if toks[j].kind != "space"]
            if at and toks[at[0]].up == "AS":
                at = at[1:]
            named = bool(at) and (toks[at[0]].kind == "quoted" or toks[at[0]].kind == "word" and toks[at[0]].up not in KEYWORDS and toks[at[0]].up not in ("LEFT", "RIGHT"))
            if not named:
                toks[end + 1 : end + 1] = tokens(f" AS __values{names}")
            elif not (len(at) > 1 and toks[at[1]].text == "("):
                toks[at[0] + 1 : at[0] + 1] = tokens(names)
        i += 1
    return toks


def null_order(toks: list[Token]) -> list[Token]:
    """Every ORDER BY key says where its NULLs go."""
    out = list(toks)
    i = 0
    while i < len(out):
        if out[i].up == "ORDER" and any(t.up == "BY" for t in out[i + 1 : i + 3]):
            depth, j = 0, next(k for k in range(i, len(out)) if out[k].up == "BY") + 1
            start, ends = j, []
            while j < len(out):
                t = out[j]
                depth += (t.text == "(") - (t.text == ")")
                if depth < 0 or depth == 0 and t.up in ("LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ROWS", "RANGE"):
                    break
                if t.text == "," and depth == 0:
                    ends.append(j)
                j += 1
            for e in reversed([*ends, j]):
                begin = max([k + 1 for k in ends if k < e], default=start)
                item = [t.up for t in out[begin:e] if t.kind != "space"]
                if item and "NULLS" not in item:
                    tail = e
                    while out[tail - 1].kind == "space":
                        tail -= 1
                    out.insert(tail, Token("raw", " NULLS FIRST" if item[-1] == "DESC" else " NULLS LAST"))
        i += 1
    return out


def _top(toks: list[Token], names) -> dict[str, int]:
    """First positions of the clauses outside parentheses."""
    found, depth = {}, 0
    for i, t in enumerate(toks):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.up in names and t.kind == "word":
            found.setdefault(t.up, i)
    return found


def qualify(toks: list[Token]) -> list[Token]:
    """SELECT ... QUALIFY p [ORDER BY ...]: p becomes a hidden column, the filter goes around."""
    out, i = [], 0
    while i < len(toks):  # inner queries first
        if toks[i].text == "(":
            end = closing(toks, i)
            out += [toks[i], *qualify(toks[i + 1 : end]), toks[end]]
            i = end
        else:
            out.append(toks[i])
        i += 1
    at = _top(out, _CLAUSES)
    if "QUALIFY" not in at:
        return out
    q = at["QUALIFY"]
    tail = min([v for k, v in at.items() if v > q], default=len(out))
    depth, select = 0, None
    for i in range(q):
        depth += (out[i].text == "(") - (out[i].text == ")")
        if depth == 0 and out[i].up == "SELECT":
            select = i
    frm = next(i for i in range(select, q) if i == at["FROM"] or out[i].up == "FROM")
    body = f"SELECT * EXCEPT (__qualify) FROM ({text(out[select:frm])}, ({text(out[q + 1 : tail]).strip()}) AS __qualify {text(out[frm:q])}) WHERE __qualify {text(out[tail:])}"
    return tokens(text(out[:select]) + body)
