"""Cards of listing pages and lines of detail pages, by declared selectors, in Arrow batches.

A selector is tag.class.class or .class, with [attr] or [attr=value]; a space
means a descendant.  Only the standard library's parser is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, times, urls

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEAF = ("p", "li", "h2", "h3", "h4", "h5", "dd", "dt", "td", "div")
STEP = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)$")


class Node:
    def __init__(self, tag: str, attrs: dict, up: "Node | None"):
        self.tag, self.attrs, self.up, self.down = tag, attrs, up, []

    def all(self) -> Iterator["Node"]:
        stack = [x for x in reversed(self.down) if isinstance(x, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [x for x in reversed(n.down) if isinstance(x, Node)]

    def text(self, line: str = " ") -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "br":
                out.append(line)
            elif n.tag not in ("script", "style"):
                stack += reversed(n.down)
                if n is not self:
                    out.append(" ")
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#root", {}, None)
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "p", "dt", "dd", "tr", "td") and self.now.tag == tag:
            self.now = self.now.up
        n = Node(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.down.append(n)
        if tag not in VOID:
            self.now = n

    def handle_startendtag(self, tag, attrs):
        self.now.down.append(Node(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        n = self.now
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:
            self.now = n.up

    def handle_data(self, data):
        self.now.down.append(data)


def _step(s: str):
    m = STEP.match(s)
    if not m:
        raise ValueError(f"selector not understood: {s}")
    want = re.findall(r"\.([\w-]+)|#([\w-]+)|\[([\w-]+)(~?=)?[\"']?([^\]\"']*)[\"']?\]", m[2])

    def fits(n: Node) -> bool:
        if m[1] and m[1] != "*" and n.tag != m[1].lower():
            return False
        for cls, id_, attr, op, value in want:
            have = n.attrs.get("class", "").split()
            if cls and cls not in have or id_ and n.attrs.get("id") != id_:
                return False
            if attr and (attr not in n.attrs or op == "=" and n.attrs[attr] != value or op == "~=" and value not in n.attrs[attr].split()):
                return False
        return True

    return fits


def select(node: Node, selector: str) -> list[Node]:
    """Descendants that fit, in the page's order."""
    steps = [_step(s) for s in selector.split()]

    def up(n: Node, left: list) -> bool:
        if not left:
            return True
        n = n.up
        while n is not None:
            if left[-1](n) and up(n, left[:-1]):
                return True
            n = n.up
        return False

    return [n for n in node.all() if steps[-1](n) and up(n, steps[:-1])]


def flat(s: str) -> str:
    return " ".join(s.split())


@dataclass(frozen=True)
class Cards:
    """Where an item, and in it the link, title, date and category are."""

    item: str
    link: str = "a[href]"
    title: str | None = None
    date: str | None = None
    date_attr: str = "datetime"
    category: str | None = None
    utc_offset: str | None = None
    next_page: str | None = None


def cards(html: str, spec: Cards) -> list[dict]:
    """href, title, date_raw and category of each item that has a link."""
    out = []
    for item in select(Tree(html).root, spec.item):
        link = next(iter(select(item, spec.link)), None)
        if link is None or not link.attrs.get("href"):
            continue
        one = lambda s: next(iter(select(item, s)), None) if s else None
        title, date, cat = one(spec.title), one(spec.date), one(spec.category)
        raw = (date.attrs.get(spec.date_attr) or flat(date.text())) if date is not None else None
        out.append({"href": link.attrs["href"], "title": flat((title or link).text()), "date_raw": raw or None, "category": flat(cat.text()) or None if cat is not None else None})
    return out


def listing(pages: DataFrame, spec: Cards) -> DataFrame:
    """pages: source_name, page_url, html, fetched_at.  Cards as discoveries; links that are no web links are left out."""

    @F.pandas_udf("array<struct<href:string,title:string,date_raw:string,category:string>>")
    def read(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda h: cards(h, spec))

    c = pages.select("source_name", "page_url", "fetched_at", F.posexplode(read("html")).alias("seq", "c"))
    out = c.select("source_name", urls.canonical(F.col("c.href"), F.col("page_url")).alias("url"), F.lit("html").alias("method"), F.col("c.title").alias("title"), times.utc(F.col("c.date_raw"), spec.utc_offset).alias("source_timestamp"), F.col("c.date_raw").alias("source_timestamp_raw"), F.col("fetched_at").alias("discovered_at"), "page_url", F.col("c.category").alias("category"), F.col("seq").cast("long").alias("seq"))
    return out.where("url <> ''")


def next_page(pages: DataFrame, selector: str) -> DataFrame:
    """page_url and next_url: the first fitting link that is neither a fragment nor a script."""

    @F.pandas_udf("string")
    def find(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda h: next((h2 for n in select(Tree(h).root, selector) if (h2 := n.attrs.get("href", "").strip()) and not h2.startswith("#") and not h2.lower().startswith("javascript:")), None))

    n = pages.select("page_url", find("html").alias("href"))
    u = urls.canonical(F.col("href"), F.col("page_url"))
    return n.select("page_url", F.when(u != "", u).alias("next_url"))


def block_lines(html: str) -> list[str]:
    """Visible text of each innermost block, line breaks kept."""
    out = []
    for n in Tree(html).root.all():
        if n.tag not in LEAF or any(x.tag in ("p", "li", "div", "td") for x in n.all()):
            continue
        lines = [flat(x) for x in n.text("\n").split("\n")]
        if s := "\n".join(x for x in lines if x):
            out.append(s)
    return out


def lines(pages: DataFrame) -> DataFrame:
    """pages: item_url, html.  item_url, seq, line of each innermost block."""

    @F.pandas_udf("array<string>")
    def read(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(block_lines)

    return pages.select("item_url", F.posexplode(read("html")).alias("seq", "line"))


def fields(pages: DataFrame, selectors: dict[str, str], attributes: dict[str, str] | None = None) -> DataFrame:
    """pages: item_url, html.  A column for each selector: the text of the first that fits, or the attribute named for it; * for its tag, where only its being there counts."""
    attributes = attributes or {}
    schema = "struct<" + ",".join(f"{k}:string" for k in selectors) + ">"

    @F.pandas_udf(schema)
    def read(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            rows = []
            for h in s:
                root, row = Tree(h).root, {}
                for k, sel in selectors.items():
                    n = next(iter(select(root, sel)), None)
                    row[k] = None if n is None else (n.tag if attributes.get(k) == "*" else n.attrs.get(attributes[k]) if k in attributes else flat(n.text())) or None
                rows.append(row)
            yield pd.DataFrame(rows, columns=list(selectors))

    return pages.select("item_url", read("html").alias("f")).select("item_url", "f.*")


def calendar(pages: DataFrame, script: str, array_path: str, keywords: list[str], now: str, title: str = "title", url: str = "url", start: str = "start") -> DataFrame:
    """pages: source_name, page_url, html, fetched_at.  Events of a calendar's JSON in a script, whose text is JSON again at array_path.

    script: a regular expression with the JSON as its group.  Titles with any of the
    keywords; upcoming first in order of time, then past ones, latest first; the
    first place of a URL counts.
    """
    from pyspark.sql import Window

    body = F.get_json_object(F.regexp_extract("html", script, 1), array_path)
    events = F.from_json(body, f"array<struct<{title}:string,{url}:string,{start}:string>>")
    e = pages.select("source_name", "page_url", "fetched_at", F.posexplode(events).alias("pos", "e"))
    name = text.collapse(F.regexp_replace(F.col(f"e.{title}"), "&amp;", "&"))
    e = e.withColumn("title", name).withColumn("url", urls.canonical(F.col(f"e.{url}"), F.col("page_url"))).withColumn("ts", times.utc(F.col(f"e.{start}")))
    if keywords:
        e = e.where(F.exists(F.array(*(F.lit(k.lower()) for k in keywords)), lambda k: F.contains(F.lower("title"), k)))
    past = F.coalesce(F.col("ts") < now, F.lit(True))
    order = (past, F.when(~past, F.col("ts")).asc(), F.when(past, F.col("ts")).desc_nulls_last(), F.col("pos"))
    first = e.where("url <> ''").withColumn("seq", F.row_number().over(Window.partitionBy("page_url").orderBy(*order)))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("page_url", "url").orderBy("seq"))).where("k = 1")
    return first.select("source_name", "url", F.lit("html").alias("method"), "title", F.col("ts").alias("source_timestamp"), F.col(f"e.{start}").alias("source_timestamp_raw"), F.col("fetched_at").alias("discovered_at"), "page_url", F.col("seq").cast("long").alias("seq"))
