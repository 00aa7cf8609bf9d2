import time
from collections import Counter
from html.parser import HTMLParser

import pandas as pd

from fathom.llm.html_templates import Page, extract, scan
from fathom.llm.queries import QUERIES
from tests.llm.helpers import SF

NAV = "<nav><ul><li><a href='/a'>Home</a></li><li>About us</li></ul></nav>"


def page(i, foot="Footer of the site"):
    return f"<html><head><title>T{i}</title><script>if (a<b) x('</p>')</script></head><body>{NAV}<p>Own text {i} &amp; more<p>second<br>line {i}<div class=x{i}>{foot}</div></body></html>"


def test_text():
    never = lambda h: False
    assert Page(page(1)).text(never)[0] == "T1\nHome\nAbout us\nOwn text 1 & more\nsecond\nline 1\nFooter of the site"
    assert Page("").text(never) == ("", 0) and Page("just text < 5").text(never)[0] == "just text < 5"
    assert Page("</div><p>a<b>b</p>c<!-- no --><style>x").text(never)[0] == "ab\nc"
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert Page(deep).text(never)[0] == "x" and len(Page(deep).hashes()[0]) == 20000
    assert Page("<p id=1>a</p>").hash == Page("<p class='z>'>a</p>").hash != Page("<p>b</p>").hash
    assert "".join(t for t, _ in scan("a<b x='>c<i>d</i>")) == "acd" and [n for _, n in scan("a<b x='>c<i>d</i>") if n] == ["b", "i", "/i"]


def test_broken_pages_take_no_longer():
    """Time grows with the length whatever is unclosed."""
    n = 100_000
    for source in ("<a x='" * n, "<div>" * n + "</b>" * n, "<a '>'" * n, "<script" * n, "<!" * n, "<!--" * n, "<p" * n, "<b>" * n + "</i>" * n + "</b>" * n, "</script   " * n):
        began = time.process_time()
        Page(source).text(lambda h: False)
        assert time.process_time() - began < 4


def test_words_agree_with_stdlib_parser():
    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    for source in pd.read_parquet(f"{SF}/pages.parquet").html.head(60):
        p = Words()
        p.feed(source)
        p.close()
        assert "".join("".join(p.out).split()) == "".join(Page(source).text(lambda h: False)[0].split())


def test_templates(spark):
    rows = [(i, f"http://www.a.example/{i}", page(i), "k") for i in range(5)] + [(10, "http://b.example/", page(1), "k"), (11, None, page(2), "k"), (12, "http://c.example/1", None, None), (13, "http://c.example/2", "", None)]
    rows += [(20, "http://d.example/1", page(7), "k")] * 4 + [(30, "http://e.example", "<p>" + "long " * 100000, "k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")
    for most in (1000, 0):
        out = extract(df, broadcast_hashes=most)
        got = {r.page_id: r for r in out.collect()}
        assert out.count() == len(rows) and [c.lower() for c in out.columns] == ["page_id", "url", "text", "n_removed"]
        for i in range(5):
            assert got[i].text == f"T{i}\nOwn text {i} & more\nsecond\nline {i}" and got[i].n_removed == 2
        assert "Home" in got[10].text and "Home" in got[11].text and "Home" in got[20].text and got[20].n_removed == 0
        assert got[12].text is None and got[12].n_removed is None and got[13].text == "" and len(got[30].text) > 400000
    assert extract(df.limit(0)).count() == 0


def test_templates_of_a_large_host(spark):
    """Blocks of a section go however large the host is; article text, also where it recurs, and copies of a page stay."""
    plain = "<!DOCTYPE html><html><head><meta charset=utf-8><title>T{0}</title></head><body>{1}<article><h1>Title {2}</h1>{4}<p>Own text {0}</p></article>{3}</body></html>"
    rows = []
    for i in range(320):
        k = i // 10
        nav = f"<nav><ul><li><a href=/>Section {k}</a></li><li>Home</li></ul></nav><div class=ad>Buy {k}</div>" if k < 2 else f"<nav><ul><li>Only {i}</li><li>Shop {i // 4}</li></ul></nav>"
        rows.append((i, f"http://a.example/{i}", plain.format(i, nav, i // 4, f"<footer>Footer {k}</footer>" if k < 2 else "", "<p>Often said.</p>" * (i % 8 == 0))))
    rows += [(400 + i, f"http://a.example/copy{i}", "<div>A page under many names</div>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1000, 0):
        got = {r.page_id: (r.text, r.n_removed) for r in extract(df, broadcast_hashes=most).collect()}
        for i in range(320):
            nav, often = "" if i < 20 else f"Only {i}\nShop {i // 4}\n", "Often said.\n" * (i % 8 == 0)
            assert got[i] == (f"T{i}\n{nav}Title {i // 4}\n{often}Own text {i}", 3 if i < 20 else 0)
        assert all(got[400 + i] == ("A page under many names", 0) for i in range(5))


def test_words_in_a_sentence_stay(spark):
    """What is part of what a page says is no template, though all pages have it; menus of links are."""
    body = "<div class=bar><a href=/>Home</a><a href=/{0}>Topic {0}</a></div><p>It is <b>not</b> safe {0}.</p><table><tr><td>Safe</td><td>No</td><td>{0}</td></tr></table><p><i>Note</i></p>"
    df = spark.createDataFrame([(i, f"http://a.example/{i}", body.format(i)) for i in range(6)], "page_id long, url string, html string")
    for most in (1000, 0):
        assert {r.page_id: (r.text, r.n_removed) for r in extract(df, broadcast_hashes=most).collect()} == {i: (f"Topic {i}\nIt is not safe {i}.\nSafe\nNo\n{i}\nNote", 1) for i in range(6)}


class Tree(HTMLParser):
    """The page as nested lists by the stdlib's parser, for pages whose elements are all closed."""

    def __init__(self, source):
        super().__init__()
        self.root = ["", []]
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        if tag not in ("meta", "link", "br", "img", "hr", "input"):
            self.stack.append(node)

    def handle_endtag(self, tag):
        if tag in [n[0] for n in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def key(node):
    return (node[0], *(" ".join(c.split()) if isinstance(c, str) else key(c) for c in node[1] if not isinstance(c, str) or c.strip()))


def words(node):
    return " ".join(w for c in node[1] for w in (c.split() if isinstance(c, str) else [words(c)] if c[0] not in ("script", "style") else []) if w)


def test_query(spark):
    """Against nested lists of another parser and counts in plain Python: the blocks that go, and the text that stays."""
    inline = "a b i em strong span code small sup sub u mark abbr time label title".split()
    d = pd.read_parquet(f"{SF}/pages.parquet")
    d["host"] = d.url.str.lower().str.extract(r"//(?:www\.)?([^/?#:]*)")[0]
    trees = [Tree(s) for s in d.html]

    def walk(node, content=False, said=False):
        for c in node[1]:
            if not isinstance(c, str) and c[0] not in ("script", "style"):
                inside = content or c[0] in ("article", "main", "head", "title")
                yield c, inside, any(isinstance(x, str) and x.strip() for x in node[1])
                yield from walk(c, inside)

    def links(node):
        return sum(len(c) for c in flat(node, True))

    def flat(node, only_links, inside=False):
        inside = inside or node[0] == "a"
        for c in node[1]:
            if isinstance(c, str):
                if c.strip() and (inside or not only_links):
                    yield " ".join(c.split())
            elif c[0] not in ("script", "style"):
                yield from flat(c, only_links, inside)

    def kind(c, content, said):
        size = sum(map(len, flat(c, False)))
        if not size or c[0] in ("html", "body"):
            return 0
        if c[0] not in inline:
            if not content and c[0] not in "li dt dd tr td th option p h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split():
                return 2
        elif said:
            return 0
        return int(size >= 25 or not content and links(c) == size)

    seen, blocks, pages = Counter(), {}, Counter()
    once = d.drop_duplicates(["url", "html"])
    for k in once.index:
        host, found = d.host[k], {}
        pages[host] += 1
        for c, content, said in walk(trees[k].root):
            if v := kind(c, content, said):
                found[key(c)] = max(found.get(key(c), 0), v)
        for x, v in found.items():
            seen[host, x] += 1
            if v == 2:
                blocks.setdefault((host, x), []).append(d.html[k])
    known = {hx for hx, n in seen.items() if n >= 3 and (n >= 0.3 * pages[hx[0]] or len(blocks.get(hx, [])) >= 3 and len(set(blocks[hx])) > 1)}

    def left(node, host, content=False):
        out, gone = [], 0
        said = any(isinstance(x, str) and x.strip() for x in node[1])
        for c in node[1]:
            if isinstance(c, str):
                out += c.split()
            elif c[0] not in ("script", "style"):
                inside = content or c[0] in ("article", "main", "head", "title")
                if (host, key(c)) in known and kind(c, inside, said):
                    gone += 1
                else:
                    more, n = left(c, host, inside)
                    out, gone = out + more, gone + n
        return out, gone

    got = {r.page_id: r for r in QUERIES["op7_html_templates"](spark, SF).collect()}
    assert len(got) == len(d)
    for k in d.index:
        want, gone = left(trees[k].root, d.host[k])
        r = got[d.page_id[k]]
        assert ("".join(r.text.split()), r.n_removed) == ("".join(want), gone), d.page_id[k]
