"""Line-first cleaning: rules for lines, then one rule for what is left of the document.

Each line is judged by itself for punctuation, navigation and boilerplate; the
failing lines go. A document that lost too much of its text is rejected. All of
it is built-in string expressions: one pass, no shuffle, no Python.

Line rules, in the order in which the reason is named (blank lines are kept as
paragraph marks and don't count):

* ``navigation``: two or more separators (``|``, ``·``, ``•``, and ``»`` where the line has no ``«``), or one at either end of the line; or nothing but a menu word (``Home``, ``Next``);
* ``boilerplate``: cookie, copyright, licence and subscription phrases;
* ``symbols``: more than a tenth of the words carry marks such as ``###`` or ``!!``;
* ``repetition``: four times the same word in a row (blanks are no words, so indented lines don't repeat any);
* ``punctuation``: a line of two or more words that doesn't end in a sentence mark, a colon, a closing quote or bracket.

Defined results: a null text stays null and is rejected (``null``); an empty or
blank text is rejected (``empty``); repeated rows are judged alike; very long
texts and lines are judged whole; a line of one word that is no menu word is kept;
columns of ``docs`` named as those of RESULT are replaced, all others stay, whatever
their names; an empty table gives an empty one.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import others, quoted, unused

#: Share of the non-blank characters a document may lose.
MAX_LOST = 0.5

#: Lines that are nothing but one of these are navigation.
MENU = ("menu", "home", "next", "previous", "prev", "back", "top", "search", "share", "print", "login", "register", "contact", "about", "sitemap", "help", "more")
#: What a line of several words ends with.
MARKS = ".!?…。？！;:\"”»)]'’"

#: (reason, pattern); written in what Java and RE2 share. A line fails at the first that is found in it.
LINE_RULES = (
    ("navigation", rf"[|·•][^|·•]*[|·•]|^ *[|·•]|[|·•] *$|^[^«]*»[^«»]*»[^«]*$|^ *»|^[^«]*» *$|^ *(?i:{'|'.join(MENU)}) *$"),
    ("boilerplate", r"(?i)all rights reserved|licensed under|is licensed|creative commons|general public license|(?:accept|use|uses) cookies|cookie policy|privacy policy|terms of (?:use|service)|javascript|sign up|\blog ?in\b|subscribe to|click here|copyright (?:\(c\)|©|[0-9]{4})"),
    ("symbols", None),
    ("repetition", None),
    ("punctuation", None),
)


#: Runs of marks, as in "word###" or "WORD!!".
SYMBOLS = r"[#$%&*!~^=+<>_]{2,}"


#: Four equal words in a row, anywhere in a (lower-case) text.
REPEATED = r"(?:^|[ \n])([^ \n]+) \1 \1 \1(?:[ \n]|$)"
_PHRASES = ("all rights reserved", "licensed under", "is licensed", "creative commons", "general public license", "cookie", "privacy policy", "terms of ", "javascript", "sign up", "login", "log in", "subscribe to", "click here", "copyright ")


def _suspects(text: Column) -> dict[str, Column]:
    """By rule: can any line of the text fail it? Cheap and never wrong when false, so that most lines needn't be tried."""
    low = F.lower(text)
    anywhere = lambda hay, needles: functools.reduce(lambda a, b: a | b, [F.contains(hay, F.lit(n)) for n in needles])
    return {
        "navigation": anywhere(text, "|»·•") | F.regexp(low, F.lit(rf"(?m)^ *(?:{'|'.join(MENU)}) *$")),
        "boilerplate": anywhere(low, _PHRASES),
        "symbols": F.regexp(text, F.lit(SYMBOLS)),
        "repetition": F.regexp(low, F.lit(REPEATED)),
    }


def _fails(reason: str, pattern: str | None, line: Column) -> Column:
    if pattern is not None:
        return F.regexp(line, F.lit(pattern))
    if reason == "symbols":
        marks = F.regexp_count(line, F.lit(SYMBOLS))
        return (marks >= 2) & (marks * 10 > F.size(F.split(line, " ")))
    if reason == "punctuation":
        return ~F.contains(F.lit(MARKS), F.substring(F.rtrim(line), -1, 1)) & F.contains(F.trim(line), F.lit(" "))
    return F.regexp(F.lower(line), F.lit(REPEATED))


def line_verdict(line: Column, suspects: dict[str, Column]) -> Column:
    """The name of the rule that the line fails, null for a good or blank line."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(LINE_RULES):
        fails = _fails(reason, pattern, line)
        out = F.when(suspects[reason] & fails if reason in suspects else fails, F.lit(reason)).otherwise(out)
    return F.when(F.trim(line) == "", F.lit(None).cast("string")).otherwise(out)


RESULT = ("clean_text", "n_lines", "n_dropped", "lost", "kept", "reason")


def clean_lines(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """All rows and columns of ``docs`` with the columns RESULT (they replace columns of those names).

    ``clean_text``: the lines that passed; ``n_lines`` counts non-blank lines,
    ``n_dropped`` those dropped, ``lost`` is the share of characters in them;
    ``kept`` is the verdict and ``reason`` names the cause of a rejection.
    """
    text = F.col(quoted(text_col))
    flag = unused(docs.columns, "__may_fail")
    marked = docs.withColumn(flag, F.struct(*[c.alias(r) for r, c in _suspects(text).items()]))
    flags = {r: F.col(flag)[r] for r in _suspects(text)}
    verdicts = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), line_verdict(x, flags).alias("bad")))
    # a generator of one row keeps the optimizer from copying the verdicts into everything that uses them
    at = unused(docs.columns, "__lines")
    judged = marked.withColumn(at, F.explode(F.array(verdicts)))
    lines = F.col(at)
    good = F.filter(lines, lambda x: x["bad"].isNull())

    def chars(a):
        return F.aggregate(a, F.lit(0), lambda n, x: n + F.when(F.trim(x["line"]) == "", 0).otherwise(F.length(x["line"])))

    full = F.size(F.filter(lines, lambda x: F.trim(x["line"]) != ""))
    sums = unused(docs.columns, "__sums")
    out = judged.select(
        *[F.col(quoted(c)) for c in others(docs.columns, RESULT)],
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
        F.when(text.isNotNull(), full).alias("n_lines"),
        F.when(text.isNotNull(), F.size(lines) - F.size(good)).alias("n_dropped"),
        F.struct(chars(lines).alias("all"), chars(good).alias("good"), text.isNull().alias("null")).alias(sums),
    )
    n = F.col(sums)
    lost = F.when(n["all"] > 0, 1 - n["good"] / n["all"]).otherwise(F.lit(1.0))
    reason = F.when(n["null"], "null").when(n["all"] == 0, "empty").when(lost > max_lost, "lost_too_much")
    return out.withColumns({"lost": F.when(~n["null"], F.round(lost, 6)), "reason": reason}).withColumn("kept", F.col("reason").isNull()).drop(sums)


def oracle(max_lost: float = MAX_LOST) -> str:
    """DuckDB SQL for the verdicts on documents; the rules are put in words and lists, not in the patterns above."""
    sep = lambda c: f"(len(line) - len(replace(line, '{c}', '')))"
    text = "trim(line, ' ')"
    edge = " OR ".join(f"starts_with({text}, '{c}') OR ends_with({text}, '{c}')" for c in "|·•")
    quotes = f"(strpos(line, '«') = 0 AND ({sep('»')} >= 2 OR ends_with({text}, '»'))) OR starts_with({text}, '»')"
    menu = f"lower({text}) IN ({', '.join(repr(m) for m in MENU)})"
    phrases = [*_PHRASES[:5], "accept cookies", "use cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "javascript", "sign up", "subscribe to", "click here", "copyright (c)", "copyright ©"]
    said = " OR ".join(f"strpos(low, '{p}') > 0" for p in phrases)
    sym = f"len(regexp_extract_all(line, '{SYMBOLS}'))"
    bad = f"""{sep('|')} + {sep('·')} + {sep('•')} >= 2 OR {edge} OR {quotes} OR {menu} OR {said} OR regexp_matches(low, 'copyright [0-9]{{4}}|\\blog ?in\\b')
   OR ({sym} >= 2 AND {sym} * 10 > len(w)) OR (strpos({text}, ' ') > 0 AND strpos('{MARKS.replace("'", "''")}', right(rtrim(line, ' '), 1)) = 0)
   OR len(list_filter(range(1, len(w) - 2), lambda i: w[i] <> '' AND w[i] = w[i+1] AND w[i] = w[i+2] AND w[i] = w[i+3])) > 0"""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
j AS (SELECT doc_id, line, k, trim(line, ' ') = '' AS blank, ({bad}) AND trim(line, ' ') <> '' AS bad FROM (SELECT *, lower(line) AS low, string_split(lower(line), ' ') AS w FROM l)),
d AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad), '') AS clean_text, CAST(count(*) FILTER (NOT blank) AS INTEGER) AS n_lines,
  CAST(count(*) FILTER (bad) AS INTEGER) AS n_dropped, coalesce(sum(length(line)) FILTER (NOT blank), 0) AS a, coalesce(sum(length(line)) FILTER (NOT blank AND NOT bad), 0) AS g FROM j GROUP BY doc_id)
SELECT doc_id, clean_text, n_lines, n_dropped, round(CASE WHEN a > 0 THEN 1 - g / a ELSE 1.0 END, 6) AS lost,
  CASE WHEN a = 0 THEN 'empty' WHEN 1 - g / a > {max_lost} THEN 'lost_too_much' END AS reason, a > 0 AND 1 - g / a <= {max_lost} AS kept FROM d"""
