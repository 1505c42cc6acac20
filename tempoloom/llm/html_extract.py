"""HTML text extraction with removal of site templates.

Every element's subtree is hashed (tag, attributes, text and the hashes of its children). Spark counts, for each host,
the distinct pages that hold each hash. Subtrees found on MIN_PAGES pages or more are its template and are deleted,
whatever share of the host's pages that is; the rest of the page becomes text, a line for each block.

A page gets only those template hashes that it holds itself, so its list is no longer than its elements: (host, hash) is
joined to the hashes of the pages, and what is left of them to the pages by a shuffle, in which every page travels
deflated. The first join broadcasts the templates only if they are LIST_ROWS at most.

Defined results: a null page has null text, an empty one has empty text; pages with a null url or one without a host
share the host ''; html, head and body themselves are never deleted; scripts, styles, comments and the head aren't text;
unclosed elements end with their parent, stray end tags are skipped; a tag whose quotes never close ends at its first
'>', and from there on quotes don't count; a '<' that no '>' follows is text; rows of one host with equal page_id and
html count as one page, and a subtree that recurs within one page counts once. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoloom.llm.common import checkpoint
from tempoloom.llm.url_reputation import host

MIN_PAGES = 5
MIN_SHARE = 0.0  # of the host's pages: none is asked for
LIST_ROWS = 1_000_000
ATTRS = r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+"""
TOKEN, LOOSE = (re.compile(rf"([^<]++)|<(/?)([a-zA-Z][^\s/>]*+)({attrs})>|<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<", re.S) for attrs in (ATTRS, "[^>]*+"))
NAMED = re.compile("</?[a-zA-Z]")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "template", "noscript", "textarea", "title")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = frozenset("p li dt dd tr td th option".split())  # each ends an open one of its kind
BOUNDS = frozenset("ul ol dl table div section article main body html nav select header footer aside".split())
BLOCK = BOUNDS | frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 pre blockquote form fieldset figure figcaption address hr br option".split())
HIDDEN = frozenset(("head", "script", "style", "template", "noscript"))
FIXED = frozenset(("html", "head", "body"))


def parse(html: str, drop: frozenset[int] | set[int] = frozenset(), hashes: set[int] | None = None) -> tuple[str, int]:
    """(text, deleted subtrees); hashes gets the hash of every element but html, head and body. Time grows linearly with the page."""
    hashing = hashes is not None or bool(drop)
    stack: list[tuple[str, list[str], int]] = [("", [], 0)]  # tag, what is hashed, where its text begins
    out: list[str] = []
    opened: dict[str, int] = {}
    scopes: list[dict[str, int]] = [{}]  # open elements of ENDS since each element of BOUNDS
    removed = 0

    def start(tag: str, attrs: str) -> None:
        opened[tag] = opened.get(tag, 0) + 1
        if tag in BOUNDS:
            scopes.append({})
        elif tag in ENDS:
            scopes[-1][tag] = scopes[-1].get(tag, 0) + 1
        stack.append((tag, [tag, attrs.strip()] if hashing else [], len(out)))
        if tag in BLOCK:
            out.append("\n")

    def close() -> None:
        nonlocal removed
        tag, seen, begin = stack.pop()
        opened[tag] -= 1
        if tag in BOUNDS:
            scopes.pop()
        elif tag in ENDS:
            scopes[-1][tag] -= 1
        dropped = tag in HIDDEN
        if hashing:
            h = xxhash.xxh64_intdigest("\x00".join(seen)) - (1 << 63)
            stack[-1][1].append(f"\x01{h}")
            if tag not in FIXED:
                if hashes is not None:
                    hashes.add(h)
                if h in drop:
                    removed += 1
                    dropped = True
        if dropped:
            del out[begin + (tag in BLOCK) :]
        elif tag in BLOCK:
            out.append("\n")

    def close_through(tag: str) -> None:
        while stack[-1][0] != tag:
            close()
        close()

    at, n, last = 0, len(html), html.rfind(">")
    token = TOKEN
    while at < n:
        if at > last:  # no tag ends any more
            e = html.find("<!--", at)
            rest = html[at : e if e >= 0 else n]
            if hashing and rest.strip():
                stack[-1][1].append(rest.strip())
            out.append(rest)
            break
        m = token.match(html, at)
        if token is TOKEN and m.end() == at + 1 and html[at] == "<":
            if NAMED.match(html, at):  # a quote that never closes
                token = LOOSE
                continue
        at = m.end()
        text, end, tag, attrs = m.groups()
        if text is not None:
            if hashing and (t := text.strip()):
                stack[-1][1].append(t)
            out.append(text)
        elif tag is None:
            if m.group() == "<":
                out.append("<")
        elif end:
            tag = tag.lower()
            if opened.get(tag):
                close_through(tag)
        else:
            tag = tag.lower()
            if tag in ENDS and scopes[-1].get(tag):
                close_through(tag)
            start(tag, attrs)
            if tag in RAW:
                e = RAW[tag].search(html, at)
                body = html[at : e.start() if e else n]
                if hashing:
                    stack[-1][1].append(body)
                if tag == "textarea":
                    out.append(body)
                at = e.end() if e else n
                close()
            elif tag in VOID or attrs.endswith("/"):
                close()
    while len(stack) > 1:
        close()
    lines = (" ".join(x.split()) for x in unescape("".join(out)).split("\n"))
    return "\n".join(x for x in lines if x), removed


def _with_keys(pages: DataFrame, *columns: str) -> DataFrame:
    """The columns, the host, and a hash that is equal for rows that are one page."""
    return pages.select(*columns, host(F.col("url")).alias("host"), F.xxhash64("page_id", "html").alias("page"))


def held(pages: DataFrame) -> DataFrame:
    """(host, page, hash): the subtrees of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = [], [0]
            for x in batch.column(0).to_pylist():
                seen: set[int] = set()
                if x is not None:
                    parse(x, hashes=seen)
                found.append(np.fromiter(seen, np.int64, len(seen)))
                ends.append(ends[-1] + len(seen))
            rows = pa.array(np.repeat(np.arange(len(found)), np.diff(ends)))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], names=["host", "page", "hash"])

    return _with_keys(pages, "html").mapInArrow(run, "host string, page long, hash long")


def _packed(pages: DataFrame) -> DataFrame:
    """(page_id, host, page, packed): the pages with their html deflated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if x is None else zlib.compress(x, 3) for x in batch.column(3).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["page_id", "host", "page", "packed"])

    own = _with_keys(pages, "page_id", "html").select("page_id", "host", "page", "html")
    return own.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, page long, packed binary")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, hash, on): the template subtrees of each host, and the number of pages they are on."""
    return held(pages).groupBy("host", "hash").agg(F.count_distinct("page").alias("on")).filter(F.col("on") >= min_pages)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, text, removed (deleted subtrees) of every page."""
    found = checkpoint(templates(pages, min_pages).select("host", "hash"))
    if found.limit(LIST_ROWS + 1).count() <= LIST_ROWS:
        found = F.broadcast(found)
    lists = held(pages).join(found, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("_tpl_drop"))
    given = _packed(pages).join(lists, ["host", "page"], "left").select("page_id", "packed", "_tpl_drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, drops = [], [], batch.column(2)
            for i, x in enumerate(batch.column(1).to_pylist()):
                d = drops[i]
                text, n = (None, 0) if x is None else parse(zlib.decompress(x).decode(), frozenset(d.values.to_numpy().tolist()) if d.is_valid else frozenset())
                texts.append(text)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "text", "removed"])

    return given.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, removed long")
