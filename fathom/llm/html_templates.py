"""HTML text extraction with removal of site templates.

Every element subtree of a page is hashed (tag, text and the hashes of its
children, so attributes don't matter). Spark counts on how many pages of its host
each hash occurs; template subtrees are deleted from the pages, the largest first
as their parts go with them. What is left becomes text: block elements end lines,
scripts, styles and the like never count.

A block with text outside the page's content (``article``, ``main``, ``head``) is
template on ``MIN_PAGES`` pages of its host, however many the host has: sections of
a site have navigation, footers and ads of their own. Everything else (single links,
list items and paragraphs, which differing menus share, and what stands in the content) is
template on ``MIN_PAGES`` pages that are also ``MIN_SHARE`` of the host's, but only
if it has ``LEAST_TEXT`` characters or is, outside the content, made of links alone:
a short cell or heading that many pages have, such as "No", is part of what they say.
For the same reason an inline element in a run of text is never one ("is <b>not</b> safe").

Only hashes are shuffled for the counts. The template hashes of all hosts go to
the tasks as sets by host while there are at most ``BROADCAST_HASHES`` of them;
beyond that they meet the pages' hashes by (host, hash), salted as a template may be
on a large part of all pages, and every page gets the list of its own.

The scanner reads the page once, forwards. The parser is lenient, as browsers are:
unclosed elements end with their parent, stray end tags are ignored, void elements
have no content, and ``<p>``, ``<li>``, table parts and options end open ones of
their kind. After a tag that never ends quotes no longer hide a ``>``.

Defined results: null HTML gives null text, empty HTML ''; a page without a host
(null, broken or relative URL) belongs to the host ''; pages repeat as often as
their (url, html) rows are distinct, so repeated rows alone make no template, nor does
one page under several URLs of a large host; subtrees without text go uncounted;
very deep or long pages are parsed whole, without recursion, in time that grows with
their length; columns named as those of RESULT are replaced, others stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm.shared import arrow_map, others, quoted, unused, written
from fathom.llm.urls import url_host

#: A subtree is template on this many pages of a host and, unless it is a block outside the content, this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.3
BROADCAST_HASHES = 1_000_000

#: Characters that a subtree has at least which is template by its share of the host's pages.
LEAST_TEXT = 25
_SALTS = 16

#: The rest of a tag after its name; nothing is tried twice.
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>").match
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+").match
_RAW = {t: re.compile(rf"</{t}\b[^>]*+>", re.I).search for t in ("script", "style", "noscript", "template", "svg", "textarea")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CONTENT = frozenset("article main head title".split())
#: Tags whose subtrees aren't counted: the page itself and what carries nothing.
_WHOLE = frozenset(("html", "body", "br", "hr"))
_NONE, _P = frozenset(), frozenset(("p",))
_ITEMS = frozenset("li dt dd tr td th option p h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())
_SPACE = re.compile(r"\s+")


def scan(source: str) -> Iterator[tuple[str, str]]:
    """(text, ''), and ('', name) or ('', /name) of the tags, in order; scripts and the like leave nothing."""
    at, mark, quotes = 0, 0, True
    last = source.rfind(">")
    while True:
        i = source.find("<", mark)
        if i < 0 or i > last:
            break
        if source.startswith("<!--", i):
            end = source.find("-->", i + 4)
            end, name = (len(source) if end < 0 else end + 3), None
        elif source.startswith(("<!", "<?"), i):
            end, name = source.find(">", i) + 1, None
        else:
            m = _NAME(source, i + 1)
            if m is None:
                mark = i + 1
                continue
            name = m[0].lower()
            rest = _QUOTED(source, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if quotes else source.find(">", m.end()) + 1
            if name in _RAW:
                close = _RAW[name](source, end)
                end, name = (close.end() if close else len(source)), None
        if i > at:
            yield source[at:i], ""
        if name:
            yield "", name
        at = mark = end
        if at > last:
            break
    if at < len(source):
        yield source[at:], ""


class Page:
    """Parsed page: elements in document order with their subtrees' ends, hashes and the pieces of text between."""

    def __init__(self, source: str) -> None:
        self.tags: list[str] = []
        self.end: list[int] = []  # number of the first event after the element
        self.events: list[tuple[int, str | int]] = []  # (0, text), (1, element opens), (2, element closes)
        self.hash: list[int] = []
        self.size: list[int] = []  # characters of text
        self.linked: list[int] = []  # those of them in links
        self.own: list[bool] = []  # has text of its own
        self.parent: list[int] = []
        self.content: list[bool] = []  # is or stands in an element of _CONTENT
        self._parts: list[list[bytes]] = []
        self._open_now: Counter[str] = Counter()
        stack: list[int] = []
        for text, name in scan(source):
            if text:
                self._text(text, stack)
            elif name[0] == "/":
                name = name[1:]
                if name not in _VOID and self._open_now[name]:
                    while self.tags[stack[-1]] != name:
                        self._close(stack)
                    self._close(stack)
            else:
                closes = _CLOSES.get(name, _NONE) | (_P if name in _ENDS_P else _NONE)
                while stack and self.tags[stack[-1]] in closes:
                    self._close(stack)
                self._open(name, stack)
                if name in _VOID:
                    self._close(stack)
        while stack:
            self._close(stack)

    def _text(self, raw: str, stack: list[int]) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self.events.append((0, text))
        if stack and (short := " ".join(text.split())):
            e = stack[-1]
            self._parts[e].append(b"\1" + short.encode("utf-8", "surrogatepass"))
            self.size[e] += len(short)
            self.own[e] = True

    def _open(self, name: str, stack: list[int]) -> None:
        self.events.append((1, len(self.tags)))
        self.size.append(0)
        self.linked.append(0)
        self.own.append(False)
        self.parent.append(stack[-1] if stack else -1)
        self.content.append(name in _CONTENT or bool(stack) and self.content[stack[-1]])
        stack.append(len(self.tags))
        self.tags.append(name)
        self._open_now[name] += 1
        self._parts.append([name.encode("utf-8", "surrogatepass")])
        self.end.append(0)
        self.hash.append(0)

    def _close(self, stack: list[int]) -> None:
        e = stack.pop()
        self._open_now[self.tags[e]] -= 1
        raw = hashlib.blake2b(b"\0".join(self._parts[e]), digest_size=8).digest()
        self.hash[e] = int.from_bytes(raw, "big", signed=True)
        self.events.append((2, e))
        self.end[e] = len(self.events)
        if self.tags[e] == "a":
            self.linked[e] = self.size[e]
        if stack:
            self._parts[stack[-1]].append(b"\2" + raw)
            self.size[stack[-1]] += self.size[e]
            self.linked[stack[-1]] += self.linked[e]
        self._parts[e] = []

    def kind(self, e: int) -> int:
        """Of an element as a template: 2 a block outside the content, 1 one by share, 0 none."""
        tag, size = self.tags[e], self.size[e]
        if not size or tag in _WHOLE:
            return 0
        if tag in _BLOCK:
            if not self.content[e] and tag not in _ITEMS:
                return 2
        elif self.parent[e] >= 0 and self.own[self.parent[e]]:
            return 0  # in a run of text
        return int(size >= LEAST_TEXT or not self.content[e] and self.linked[e] == size)

    def hashes(self) -> tuple[list[int], list[bool]]:
        """Distinct hashes of what may be a template, and of each whether it is (anywhere) a block outside the content."""
        found: dict[int, bool] = {}
        for e, h in enumerate(self.hash):
            if k := self.kind(e):
                found[h] = found.get(h, False) or k == 2
        return list(found), list(found.values())

    def text(self, template: Callable[[int], bool]) -> tuple[str, int]:
        """Text without the subtrees that may be a template and whose hash is one, and how many went."""
        out, i, gone = [], 0, 0
        while i < len(self.events):
            kind, x = self.events[i]
            i += 1
            if kind == 0:
                out.append(_SPACE.sub(" ", x))
            elif kind == 1 and template(self.hash[x]) and self.kind(x):
                i, gone = self.end[x], gone + 1
                if self.tags[x] in _BLOCK:
                    out.append("\n")
            elif self.tags[x] in _BLOCK:
                out.append("\n")
        lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line), gone


RESULT = ("text", "n_removed")


def _hashed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, page, source, hash, block): a row a page and subtree; ``page`` is a hash of URL and HTML, ``source`` of the HTML."""
    url, source = F.col(quoted(url_col)), F.col(quoted(html_col))
    src = pages.select(_host(url).alias("host"), F.xxhash64(url, source).alias("page"), F.xxhash64(source).alias("source"), source.alias("html"))
    fields = [T.StructField("hash", T.ArrayType(T.LongType())), T.StructField("block", T.ArrayType(T.BooleanType()))]

    def marked(b: pa.RecordBatch) -> list[pa.Array]:
        made = [Page(x).hashes() if x else ([], []) for x in b.column(0).to_pylist()]
        return [pa.array([h for h, _ in made], pa.list_(pa.int64())), pa.array([k for _, k in made], pa.list_(pa.bool_()))]

    hashed = arrow_map(src, ["html"], ["host", "page", "source"], fields, lambda: marked)
    return hashed.select("host", "page", "source", F.explode(F.arrays_zip("hash", "block")).alias("x")).select("host", "page", "source", "x.*")


def _host(url: Column) -> Column:
    return F.coalesce(url_host(url), F.lit(""))


def template_hashes(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of every template subtree. Shuffles hashes, a row a subtree and page; every page is parsed once."""
    url, source = F.col(quoted(url_col)), F.col(quoted(html_col))
    rows = _hashed(pages, url_col, html_col).distinct()
    block = F.when(F.col("block"), F.col("source"))
    count = rows.groupBy("host", "hash").agg(F.count("*").alias("n"), F.count(block).alias("blocks"), (F.min(block) < F.max(block)).alias("differ")).filter(f"n >= {int(min_pages)}")
    total = pages.select(_host(url).alias("host"), F.xxhash64(url, source).alias("page")).distinct().groupBy("host").agg(F.count("*").alias("pages"))
    recurs = (F.col("blocks") >= int(min_pages)) & F.col("differ") | (F.col("n") >= F.col("pages") * min_share)
    return count.join(total, "host").filter(recurs).select("host", "hash")


def _mix(host: pa.Array) -> np.ndarray:
    made = {h: int.from_bytes(hashlib.blake2b(h.encode(), digest_size=8).digest(), "big", signed=True) for h in host.unique().to_pylist()}
    return np.fromiter((made[h] for h in host.to_pylist()), np.int64, len(host))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_removed`` (subtrees deleted); they replace columns of these names."""
    spark = pages.sparkSession
    found = written(template_hashes(pages, url_col, html_col, min_pages, min_share), "templates")
    keep = others([c for c in pages.columns if c != html_col], RESULT)
    url, source = F.col(quoted(url_col)), F.col(quoted(html_col))
    fields = [T.StructField("text", T.StringType()), T.StructField("n_removed", T.IntegerType())]

    def result(rows: list[tuple[str | None, Callable[[int], bool]]]) -> list[pa.Array]:
        made = [(None, None) if h is None else Page(h).text(t) for h, t in rows]
        return [pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int32())]

    if found.count() <= broadcast_hashes:
        host, text = (unused(keep, c) for c in ("__host", "__html"))
        src = pages.select(*[F.col(quoted(c)) for c in keep], _host(url).alias(host), source.alias(text))
        parts = [(_mix(b.column(0)), np.asarray(b.column(1))) for b in found.select("host", "hash").toArrow().to_batches() if b.num_rows]
        by_host: dict[int, set[int]] = {}
        for hosts, hashes in parts:
            for h, x in zip(hosts.tolist(), hashes.tolist()):
                by_host.setdefault(h, set()).add(x)
        held = spark.sparkContext.broadcast(by_host)

        def make():
            known = held.value
            return lambda b: result([(h, known.get(k, frozenset()).__contains__) for k, h in zip(_mix(b.column(0)).tolist(), b.column(1).to_pylist())])

        return arrow_map(src, [host, text], keep, fields, make)

    # every page's own templates, then the pages by their hash: no host or template gathers rows in one task
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    mine = _hashed(pages, url_col, html_col).withColumn("salt", F.pmod("page", F.lit(_SALTS)).cast("int")).join(salted, ["host", "hash", "salt"])
    page, known, text = (unused(keep, c) for c in ("__page", "__known", "__html"))
    mine = mine.groupBy(F.col("page").alias(page)).agg(F.collect_set("hash").alias(known))
    src = pages.select(*[F.col(quoted(c)) for c in keep], F.xxhash64(url, source).alias(page), source.alias(text))
    return arrow_map(src.join(mine, page, "left"), [text, known], keep, fields, lambda: lambda b: result([(h, frozenset(k or ()).__contains__) for h, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]))
