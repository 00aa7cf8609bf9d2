import re

import pandas as pd

from fathom.llm.quality import clean_lines
from fathom.llm.queries import QUERIES
from tests.llm.helpers import SF

GOOD = "This is a good sentence about the sea."


def test_rules(spark):
    rows = [
        (1, GOOD + "\nHome | About | Contact\n\nAnother fine line here.", None, "q"), (2, "Home | About | Contact", 1, None), (3, None, 1, "q"), (4, "", 1, "q"), (5, " \n ", 1, "q"),
        (6, "buy&&& now&&& here*** this### that$$$.", 1, "q"), (7, "go go go go go.", 1, "q"), (8, "no end of sentence here", 1, "q"),
        (9, (GOOD + "\n") * 20000, 1, "q"), (10, GOOD + "\nAll rights reserved.", 1, "q"), (11, GOOD, 1, "q"), (11, GOOD, 1, "q"), (12, "One.", 1, "q"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, reason string")
    out = clean_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and {k for k, r in got.items() if r.kept} == {1, 9, 10, 11, 12}
    assert got[1].clean_text == GOOD + "\n\nAnother fine line here." and got[1].n_dropped == 1 and got[1].n_lines == 3
    assert (got[3].reason, got[4].reason, got[5].reason, got[2].reason) == ("null", "empty", "empty", "lost_too_much")
    assert got[3].clean_text is None and got[3].lost is None and got[4].clean_text == ""
    assert got[10].clean_text == GOOD and got[9].n_lines == 20000
    assert clean_lines(df.limit(0)).count() == 0


def test_indented(spark):
    """Blanks are not words, so an indented line does not repeat one; a repeated word behind blanks still does."""
    text = "\n".join("    " * k + GOOD for k in range(1, 5))
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame([(1, text), (2, text + "\n        go go go go.\n    go go go go now.")], "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].clean_text == text and got[1].n_dropped == 0
    assert got[2].kept and got[2].n_dropped == 1


def test_lines(spark):
    """Where a line ends, menus of one word a line, quotes that are no separators, code, and columns of any name."""
    said = "Il dit «oui» et puis «non» et s'en va."
    rows = [
        (1, "Menu\nHome\nNext\n" + GOOD, True), (2, "Well. This has no end\n" + GOOD * 3, True), (3, said, True), (4, "Home » News » Today\nnews »", False),
        (5, "def f(x):\n    return x + 1.\n    y = f(2).", True), (6, "Menu\nHome\nNext", False), (7, "Please log in\nor login.", False), (8, "He said \"so.\"\nIt is (so)\nSo [1]", True), (9, "Word", True),
    ]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, want boolean, __lines int, __sums int")
    out = clean_lines(df)
    got = {r.doc_id: r for r in out.collect()}
    assert {i: r.kept for i, r in got.items()} == {i: w for i, _, w in rows}
    assert got[1].clean_text == GOOD and got[2].clean_text == GOOD * 3 and got[3].clean_text == said and got[5].n_dropped == 0 and got[8].n_dropped == 0
    assert all(r["__lines"] == 7 and r["__sums"] == 8 for r in got.values())


def plain(line):
    """The line rules in plain Python."""
    t = line.strip(" ")
    if not t:
        return True
    low, words = t.lower(), line.split(" ")
    if sum(t.count(c) for c in "|·•") > 1 or t[0] in "|·•»" or t[-1] in "|·•" or "«" not in t and (t.count("»") > 1 or t[-1] == "»"):
        return False
    if low in "menu home next previous prev back top search share print login register contact about sitemap help more".split():
        return False
    if re.search(r"all rights reserved|licensed under|is licensed|creative commons|general public license|(accept|uses?) cookies|(cookie|privacy) policy|terms of (use|service)|javascript|sign up|\blog ?in\b|subscribe to|click here|copyright (\(c\)|©|\d{4})", low):
        return False
    marks = len(re.findall(r"[#$%&*!~^=+<>_]{2,}", line))
    if marks > 1 and marks * 10 > len(words):
        return False
    low_words = line.lower().split(" ")
    if any(low_words[i] and len(set(low_words[i : i + 4])) == 1 for i in range(len(words) - 3)):
        return False
    return " " not in t or t[-1] in ".!?…。？！;:\"”»)]'’"


def test_query(spark):
    got = {r.doc_id: (r.clean_text, r.n_lines, r.n_dropped, r.lost, r.kept) for r in QUERIES["op10_quality_lines"](spark, SF).collect()}
    d = pd.read_parquet(f"{SF}/documents.parquet")
    for i, text in zip(d.doc_id, d.text):
        lines = text.split("\n")
        good, full = [x for x in lines if plain(x)], [x for x in lines if x.strip(" ")]
        size = lambda xs: sum(len(x) for x in xs if x.strip(" "))
        lost = 1 - size(good) / size(lines)
        text, n, dropped, share, kept = got[i]
        assert (text, n, dropped, kept) == ("\n".join(good), len(full), len(lines) - len(good), lost <= 0.5) and abs(share - lost) < 1e-6, i
