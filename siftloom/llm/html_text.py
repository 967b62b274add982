"""Main text of web pages: site templates are found by what recurs on a host.

A page is cut into elements in one pass, tolerant of missing end tags.  Every
element subtree outside running prose is hashed.  Spark counts, per host, on how
many different pages (pages of equal main text count once) each hash occurs; a
subtree that recurs on many is a template and is deleted with all its content.
Besides, what HTML itself names as no article goes: menus, headers, footers,
asides, forms, scripts, and elements whose class or id says advert, comments and
the like.  What is left of the article (or of main, or of the body) is the text.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|svg|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Start tags before which an open element ends, and where the search for it stops.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPE = frozenset("article aside body div fieldset figure footer form header html li main nav section table td th blockquote dd button".split())
#: Elements that are no part of an article, by name, by role, and by a word of their class or id.
NO_ARTICLE = frozenset("nav header footer aside form fieldset button select datalist dialog menu search head object audio video canvas map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside rail footer masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies disqus widget widgets pagination pager skip copyright legal disclaimer toolbar search".split()
)
#: Elements of running prose: inside the main text they are never templates.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption figcaption blockquote pre br hr a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SPACE = re.compile(r"\s+")
HEADINGS = re.compile(r"<h[1-6]\b", re.I)


class Page:
    """The elements of a page: tag, whether it is no article by name, parent, and its range of tokens."""

    def __init__(self, html: str):
        self.tags, self.bad, self.parent, self.first, self.last = ["#root"], [False], [-1], [0], [0]
        #: (element, text or None for a block border, place in the page); texts are still encoded
        self.bits: list[tuple[int, str | None]] = []
        self.spans: list[list[int]] = [[0, len(html)]]
        self.html = html
        stack, at = [0], 0
        for m in TOKEN.finditer(html):
            if m.start() > at:
                self.bits.append((stack[-1], html[at : m.start()]))
            at = m.end()
            tag = m[3] or m[6]
            if not tag:
                continue
            tag = tag.lower()
            if m[2] or m[5]:
                self._close(stack, tag, m)
            else:
                self._open(stack, tag, m[4] if m[3] else m[7], m)
        if at < len(html):
            self.bits.append((stack[-1], html[at:]))
        self._pop(stack, 1, len(html))
        self.last[0] = len(self.bits)

    def _pop(self, stack: list[int], depth: int, at: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            self.last[e], self.spans[e][1] = len(self.bits), at
            if self.tags[e] in BLOCK:
                self.bits.append((stack[-1], None))

    def _close(self, stack: list[int], tag: str, m: re.Match) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            open_tag = self.tags[stack[depth]]
            if open_tag == tag:
                self._pop(stack, depth + 1, m.start())
                return self._pop(stack, depth, m.end())
            if tag not in BLOCK and open_tag in BLOCK:
                return

    def _open(self, stack: list[int], tag: str, attributes: str, m: re.Match) -> None:
        if tag in VOID:
            self.bits.append((stack[-1], None if tag == "hr" else " " if tag == "br" else ""))
            return
        if tag in ENDS:
            ends, stops = ENDS[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if self.tags[stack[depth]] in ends:
                    self._pop(stack, depth, m.start())
                    break
                if self.tags[stack[depth]] in stops:
                    break
        elif tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):
                if self.tags[stack[depth]] == "p":
                    self._pop(stack, depth, m.start())
                    break
                if self.tags[stack[depth]] in SCOPE:
                    break
        e = len(self.tags)
        self.tags.append(tag)
        self.parent.append(stack[-1])
        if tag in BLOCK:
            self.bits.append((stack[-1], None))
        self.first.append(len(self.bits))
        self.last.append(len(self.bits))
        self.spans.append([m.start(), m.end()])
        self.bad.append(self._named(tag, attributes))
        stack.append(e)

    @staticmethod
    def _named(tag: str, attributes: str) -> bool:
        if tag in NO_ARTICLE:
            return True
        if "=" not in attributes and "hidden" not in attributes.lower() or tag in ("html", "body", "main"):
            return False
        for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            name = name.lower()
            if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True
            if name == "role" and value in ROLES:
                return True
            if name in ("class", "id") and not NAMES.isdisjoint(re.split(r"[\s_-]+", value)):
                return True
        return False

    def dropped(self, templates: frozenset = frozenset()) -> list[bool]:
        """Whether each element goes: by its own name, as a template, or with its parent.  A header inside an article that holds a heading stays."""
        out = [False]
        inside = [False]
        for e in range(1, len(self.tags)):
            up = self.parent[e]
            gone = self.bad[e]
            if gone and self.tags[e] == "header" and inside[up] and HEADINGS.search(self.html, *self.spans[e]):
                gone = False
            out.append(out[up] or gone)
            inside.append(inside[up] or self.tags[e] in ("article", "main"))
        if templates:
            for e, h in self.subtrees(out):
                if h in templates:
                    out[e] = True
            for e in range(1, len(out)):
                out[e] = out[e] or out[self.parent[e]]
        return out

    def roots(self, out: list[bool]) -> list[int]:
        """The outermost articles, else mains, else the body or all."""
        for tag in ("article", "main", "body"):
            found: list[int] = []
            covered = set()
            for e in range(1, len(self.tags)):
                if self.parent[e] in covered:
                    covered.add(e)
                elif self.tags[e] == tag and not out[e]:
                    covered.add(e)
                    found.append(e)
            if found:
                return found
        return [0]

    def blocks(self, out: list[bool], roots: list[int]) -> list[str]:
        got: list[str] = []
        for root in roots:
            now: list[str] = []
            for e, text in [*self.bits[self.first[root] : self.last[root]], (root, None)]:
                if out[e]:
                    continue
                if text is not None:
                    now.append(text)
                elif now:
                    raw = "".join(now)
                    if line := " ".join((entities.unescape(raw) if "&" in raw else raw).split()):
                        got.append(line)
                    now = []
        return got

    def subtrees(self, out: list[bool]) -> list[tuple[int, int]]:
        """(element, hash) of what can be a template: not prose of the main text, not around the main text, and with content."""
        roots = self.roots(out)
        around, inside = {0}, set(roots)
        for r in roots:
            while r > 0:
                around.add(r)
                r = self.parent[r]
        found = []
        for e in range(1, len(self.tags)):
            if self.parent[e] in inside:
                inside.add(e)
            if e in around or self.tags[e] in ("html", "head", "body") or e in inside and self.tags[e] in PROSE:
                continue
            if self.last[e] > self.first[e]:
                found.append(e)
        hashes = self.hashes() if found else []
        return [(e, hashes[e]) for e in found]

    def hashes(self) -> list[int]:
        """Of each element, a hash of its source with runs of white space as one space and its children as their hashes: linear in the page, however long or deep an element is."""
        children: list[list[int]] = [[] for _ in self.tags]
        for e in range(1, len(self.tags)):
            children[self.parent[e]].append(e)
        got = [0] * len(self.tags)
        for e in range(len(self.tags) - 1, 0, -1):
            at, parts = self.spans[e][0], []
            for c in children[e]:
                parts += [SPACE.sub(" ", self.html[at : self.spans[c][0]]), f"\0{got[c]:x}\0"]
                at = self.spans[c][1]
            parts.append(SPACE.sub(" ", self.html[at : self.spans[e][1]]).rstrip())
            got[e] = xxhash.xxh64_intdigest("".join(parts), 1) - (1 << 63)
        return got


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _text(b: bytes | None) -> str:
    return (b or b"").decode("utf-8", "replace")


def template_counts(pages: DataFrame) -> DataFrame:
    """pages: url, html.  host, pages (of different main texts), and for each recurring subtree hash on how many of them it is."""

    def run(c):
        seen = set()
        for url, h in zip(c["url"], c["html"]):
            page, host = Page(_text(h)), host_of(_text(url))
            out = page.dropped()
            body = xxhash.xxh64_intdigest("\n".join(page.blocks(out, page.roots(out)))) - (1 << 63)
            seen.add((host, None, body))
            seen.update((host, s, body) for _, s in page.subtrees(out))
        seen = list(seen)
        return {"host": [x[0] for x in seen], "subtree": [x[1] for x in seen], "body": [x[2] for x in seen]}

    rows = common.arrow_map(pages.select("url", "html"), run, "host string, subtree long, body long")
    return rows.distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages"))


def templates(pages: DataFrame, least_pages: int = 4) -> DataFrame:
    """host, subtree: hashes of subtrees on least_pages different pages of a host or more, however many pages the host has."""
    n = template_counts(pages).where(F.col("subtree").isNotNull() & (F.col("pages") >= least_pages))
    return common.kept(n.select("host", "subtree"), "templates")


#: Hashes of all hosts that are broadcast at most (8 bytes each); with more, the subtrees of pages are joined to templates by shuffle.
MOST_HASHES = 1_000_000


def templates_of_pages(pages: DataFrame, t: DataFrame) -> DataFrame:
    """page_id, url, html, templates: those of the host that are on the page, so a row grows with its page and not with its host."""

    def place(url, h):
        d = xxhash.xxh3_128_digest(h or b"")
        return host_of(_text(url)), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)

    def subtrees(c):
        seen = set()
        for url, h in zip(c["url"], c["html"]):
            page, at = Page(_text(h)), place(url, h)
            seen.update((*at, s) for _, s in page.subtrees(page.dropped()))
        return dict(zip(("host", "k1", "k2", "subtree"), zip(*seen))) if seen else {"host": [], "k1": [], "k2": [], "subtree": []}

    def keyed(c):
        at = [place(u, h) for u, h in zip(c["url"], c["html"])]
        return c | {"host": [x[0] for x in at], "k1": [x[1] for x in at], "k2": [x[2] for x in at]}

    found = common.arrow_map(pages.select("url", "html"), subtrees, "host string, k1 long, k2 long, subtree long").distinct()
    found = found.join(t, ["host", "subtree"]).groupBy(F.col("host").alias("of_host"), F.col("k1").alias("of_k1"), F.col("k2").alias("of_k2")).agg(F.collect_list("subtree").alias("templates"))
    rows = common.arrow_map(pages.select("page_id", "url", "html"), keyed, "page_id long, url string, html string, host string, k1 long, k2 long")
    return rows.join(found, (F.col("host") == F.col("of_host")) & (F.col("k1") == F.col("of_k1")) & (F.col("k2") == F.col("of_k2")), "left").select("page_id", "url", "html", "templates")


def main_text(pages: DataFrame, least_pages: int = 4) -> DataFrame:
    """pages: page_id, url, html; other columns are ignored.

    One row for each row of pages: page_id, url, text, n_chars.  A null or empty
    html has empty text; a null or unreadable url belongs to the host ''; equal
    rows give equal results; broken markup is read as far as it goes; an empty
    table gives no rows.
    """
    t = templates(pages, least_pages)
    if t.count() <= MOST_HASHES:
        known: dict[str, set] = {}
        for host, subtree in t.collect():
            known.setdefault(host, set()).add(subtree)
        held = pages.sparkSession.sparkContext.broadcast({k: frozenset(v) for k, v in known.items()})
        j = pages.select("page_id", "url", "html")
    else:
        held = None
        j = templates_of_pages(pages, t)

    def run(c):
        texts = []
        for i, (url, h) in enumerate(zip(c["url"], c["html"])):
            page = Page(_text(h))
            known = held.value.get(host_of(_text(url)), frozenset()) if held else frozenset(c["templates"][i] or ())
            out = page.dropped(known)
            texts.append("\n".join(page.blocks(out, page.roots(out))))
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": list(map(len, texts))}

    return common.arrow_map(j, run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
