import random
import time
from collections import Counter, defaultdict
from html import unescape
from html.parser import HTMLParser

import duckdb

from tempoloom.llm import html_extract as H
from tempoloom.llm import url_reputation as R

SCHEMA = "page_id long, url string, html string, host string, mean double"


def page(nav, body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{nav}<!-- c --><article><h1>Head {body}</h1><p>One {body} &amp; two<p>Three<br>four</article><footer><p>Rights <b>all</b></footer></body></html>"


class Tree(HTMLParser):
    """Subtrees of well-formed pages, for counting by brute force."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.all = [["", []]], []

    def handle_starttag(self, tag, attrs):
        self.stack.append([str((tag, attrs)), []])

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][1].append(data.strip())

    def handle_endtag(self, tag):
        t = self.stack.pop()
        self.all.append(str(t))
        self.stack[-1][1].append(str(t))


def test_templates_are_those_that_brute_force_counts(spark):
    nav = lambda h: f'<nav class="x"><ul><li><a href="/{h}">Home {h}</a></li><li>About</li></ul></nav>'
    rows, count, seen = [], Counter(), defaultdict(set)
    for h, n in (("a.example.com", 12), ("b.example.com", 4), ("c.example.org", 7)):
        for i in range(n):
            html = f"<html><body>{nav(h)}<div><p>text {h} {i}</p><p>note {i % 2}</p></div></body></html>"
            rows.append((len(rows), f"https://{h}/p/{i}", html, None, None))
            t = Tree()
            t.feed(html)
            count[h] += 1
            for s in set(t.all):
                seen[h, s].add(i)
    want = Counter(h for (h, s), p in seen.items() if len(p) >= H.MIN_PAGES and len(p) >= H.MIN_SHARE * count[h])
    pages = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r.host for r in H.templates(pages).collect())
    assert got == want
    text = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert text[0] == "text a.example.com 0" and text[12] == "Home b.example.com\nAbout\ntext b.example.com 0\nnote 0"


def test_text_of_untidy_and_odd_pages(spark):
    assert H.parse(page("<nav>menu</nav>", "x"))[0] == "menu\nHead x\nOne x & two\nThree\nfour\nRights all"
    assert H.parse("a < b <i>c</i></u><p>d<script>var s='</p>'</script>e <img src='>'> f")[0] == "a < b c\nde f"
    assert H.parse('<div title="never closed')[0].startswith("<div")
    rows = [(1, None, None, "h", 1.0), (2, "x", "", "h", 1.0), (None, "http://a/", "<p>hi", None, None), (3, None, "<b>" * 3000 + "deep", "h", 1.0), (4, "http://a/", "<p>hi", None, None), (4, "http://a/", "<p>hi", None, None), (5, "http://z/", "w " * 300000, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {(r.page_id, r.text[:9] if r.text is not None else None) for r in H.extract(pages).collect()}
    assert got == {(1, None), (2, ""), (None, "hi"), (3, "deep"), (4, "hi"), (5, "w w w w w")}
    assert H.extract(pages.limit(0)).count() == 0


def test_shuffled_lists_give_the_same(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "http://a.org/", page("<nav>menu</nav>", str(i)), None, None) for i in range(9)], SCHEMA)
    want = sorted(map(tuple, H.extract(pages).collect()))
    monkeypatch.setattr(H, "LIST_ROWS", 0)
    assert sorted(map(tuple, H.extract(pages).collect())) == want and want[0][1] == "Head 0\nOne 0 & two"


def test_templates_of_a_small_share_go_and_a_page_given_again_stays(spark):
    rows = [(i, f"https://big.example.com/{i}", page(f"<nav><ul><li>item {i // 5}</li></ul></nav>", str(i)), None, None) for i in range(100)]
    rows += [(200, "https://big.example.com/200", page("<nav>own menu</nav>", "again"), None, None)] * 6
    pages = spark.createDataFrame(rows, SCHEMA)
    text = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert text == {i: f"Head {i}\nOne {i} & two" for i in range(100)} | {200: "own menu\nHead again\nOne again & two"}
    kept = {r.page_id: r.text for r in H.extract(pages, min_pages=6).collect()}
    assert all(kept[i] == f"item {i // 5}\nHead {i}\nOne {i} & two" for i in range(100))


def test_reputation_against_sql(spark):
    hosts = ["a.example.com", "WWW.b.co.uk", "10.0.0.1", "spam.example.com", "localhost", "x.y.z.org."]
    rows = [(i, f"https://u@{hosts[i % 6]}:80/p?{i}" if i % 7 else f"http://{hosts[i % 6]}", "h", "q", 0.5) for i in range(120)]
    rows += [(None, None, None, None, None), (500, "", None, None, None), (501, "nothing", None, None, None), (3, "http://a.example.com/", None, None, None), (3, "http://a.example.com/", None, None, None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    lab = [(i, int(i % 6 != 3), 0) for i in range(0, 110)] + [(4, 0, 0), (None, 1, 1), (8, None, 1)]
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    for name, df in (("pages", pages), ("labels", labels)):
        con.register(name, df.toArrow())
    for part in (labels, labels.limit(0)):
        con.register("labels", part.toArrow())
        want = con.execute(R.SQL).fetchall()
        got = [tuple(r) for r in R.judged(pages, part).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    rep = {r.host: r for r in R.reputations(pages, labels).collect()}
    assert rep["www.b.co.uk"].domain == "b.co.uk" and rep["x.y.z.org"].domain == "z.org" and rep["10.0.0.1"].suffix == "10.0.0.1"
    assert rep["spam.example.com"].upper < 0.5 < rep["a.example.com"].upper
    assert R.judged(pages.limit(0), labels).count() == 0


def plain_parse(html, drop):
    """The same text by the rules alone: characters one by one, a tree, and walks over all open elements."""
    low, loose, stack, at = html.lower(), False, [("", "", [])], 0

    def end_of_tag(i, loose):
        quote = ""
        while i < len(html):
            c = html[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and not loose:
                quote = c
            elif c == ">":
                return i
            i += 1
        return -1

    def put(x):
        stack[-1][2].append(x)

    def close():
        x = stack.pop()
        put(x)

    while at < len(html):
        c = html[at]
        if c != "<":
            e = at
            while e < len(html) and html[e] != "<":
                e += 1
            put(html[at:e])
            at = e
            continue
        if html.startswith("<!--", at):
            e = html.find("-->", at + 4)
            at = len(html) if e < 0 else e + 3
            continue
        slash = html[at + 1 : at + 2] == "/"
        i = at + 1 + slash
        named = html[i : i + 1].isascii() and html[i : i + 1].isalpha()
        if html[at + 1 : at + 2] in ("!", "?") and ">" in html[at:]:
            at = html.index(">", at) + 1
            continue
        j = i
        while named and j < len(html) and not html[j].isspace() and html[j] not in "/>":
            j += 1
        e = end_of_tag(j, loose) if named else -1
        if named and e < 0 and ">" in html[at:] and not loose:
            loose, e = True, end_of_tag(j, True)
        if not named or e < 0:
            put("<")
            at += 1
            continue
        tag, attrs, at = low[i:j], html[j:e], e + 1
        names = [x[0] for x in stack]
        if slash:
            if tag in names[1:]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in H.ENDS:
            k = len(stack) - 1
            while k > 0 and names[k] not in H.BOUNDS and names[k] != tag:
                k -= 1
            while k > 0 and names[k] == tag and len(stack) > k:
                close()
        stack.append((tag, attrs, []))
        if tag in H.RAW:
            m = H.RAW[tag].search(html, at)
            put(html[at : m.start() if m else len(html)])
            at = m.end() if m else len(html)
            close()
        elif tag in H.VOID or attrs.endswith("/"):
            close()
    while len(stack) > 1:
        close()

    def text(x):
        if isinstance(x, str):
            return x
        tag, _, inner = x
        edge = "\n" if tag in H.BLOCK else ""
        if tag == drop:
            return edge
        return "" if tag in H.HIDDEN or (tag in H.RAW and tag != "textarea") else edge + "".join(map(text, inner)) + edge

    lines = (" ".join(x.split()) for x in unescape("".join(map(text, stack[0][2]))).split("\n"))
    return "\n".join(x for x in lines if x)


def test_malformed_pages_have_the_text_that_the_plain_rules_give():
    g = random.Random(5)
    parts = ["<p>", "</p>", "<b>", "</b>", "<div class='a'>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<table>", "</table>", "x", " y\n", "<", ">", '"', "'", "<a href=\"u>v\">", "</a>", "<br/>", "<!-- c -->", "<!--", "<!d>", "&amp;", "<script>", "</script>", "<title>t</title>", "</", "<é", "<option>", "</x>", "<i a='", "<textarea>q"]
    for _ in range(4000):
        html = "".join(g.choices(parts, k=g.randint(1, 25)))
        assert H.parse(html)[0] == plain_parse(html, None), html
        hashes = set()
        assert H.parse(html, hashes=hashes)[0] == plain_parse(html, None), html  # hashing changes no text


def test_hard_pages_of_a_megabyte_take_linear_time():
    n = 1 << 20
    deep = "<b>x" * (n // 8)
    pages = ['<a "' * (n // 4), "<a " * (n // 3), "<b>" * (n // 8) + "</i>" * (n // 8), "<p><div>" + "<b>" * (n // 8) + "<p></p>" * (n // 14), deep, "<a \">\" " * (n // 8) + "'", "<" * n, "<!" * (n // 2), "<ul><li>" * (n // 16) + "<li>" * (n // 8), "<script" * (n // 7), "<!--" * (n // 4)]
    for html in pages:
        for hashes in (None, set()):
            began = time.process_time()
            H.parse(html, hashes=hashes)
            assert time.process_time() - began < 4, html[:40]
