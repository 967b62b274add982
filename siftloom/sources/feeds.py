"""RSS, Atom and sitemaps from their text, natively; documents that declare a type or entities, or are no well-formed XML, are refused first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, times, urls

FEED_ROOTS, SITEMAP_ROOTS = ("rss", "RDF", "feed"), ("urlset", "sitemapindex")


def root(xml: Column) -> Column:
    """The name of the outermost element, without its prefix."""
    return F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1)


def refused(xml: Column, roots: tuple = ()) -> Column:
    """Why a document is not parsed, or null.  Spark's XML parser says whether it is well-formed; it only sees documents without a type and entities of their own."""
    x = F.coalesce(xml, F.lit(""))
    why = F.when(~x.rlike(r"^\s*<"), "not a document").when(x.rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"), "declares a document type or entities")
    if roots:
        why = why.when(~root(x).isin(*roots), F.concat(F.lit("its root is "), root(x)))
    safe = F.when(x.rlike(r"^\s*<") & ~x.rlike(r"(?i)<!(?:DOCTYPE|ENTITY)"), x)
    parsed = F.from_xml(safe, "_corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return why.when(parsed.isNull() | parsed.getField("_corrupt_record").isNotNull(), "not well-formed")


def rejects(documents: DataFrame, roots: tuple = (*FEED_ROOTS, *SITEMAP_ROOTS)) -> DataFrame:
    """page_url and parse_error of the documents that feed() and sitemap() leave out."""
    return documents.select("page_url", refused(F.col("xml"), roots).alias("parse_error")).where("parse_error is not null")


def _elements(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>.*?</(?:\w+:)?{tag}\s*>"), F.lit(0))


def _value(element: Column, tag: str) -> Column:
    """The text of the first child of this name, or null."""
    raw = F.regexp_extract(element, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[(.*?)\]\]>|(.*?))\s*</(?:\w+:)?{tag}\s*>", 1)
    plain = F.regexp_extract(element, rf"(?s)<(?:\w+:)?{tag}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[(.*?)\]\]>|(.*?))\s*</(?:\w+:)?{tag}\s*>", 2)
    v = F.when(raw != "", raw).otherwise(unescape(plain))
    return F.when(v != "", v)


def unescape(c: Column) -> Column:
    """Character references, numbered ones first, &amp; last."""
    c = F.coalesce(c, F.lit(""))
    one = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def numbered(t: Column, rule: str, base: int) -> Column:
        codes = F.array_distinct(F.regexp_extract_all(t, F.lit(rule), F.lit(1)))
        number = lambda x: F.conv(x, base, 10).cast("long")
        valid = lambda n: n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        sign = lambda x: F.concat(F.lit("&#" if base == 10 else "&#x"), x, F.lit(";"))
        return F.aggregate(codes, t, lambda acc, x: F.when(valid(number(x)), F.replace(acc, sign(x), one(number(x)))).otherwise(acc))

    c = F.when(c.contains("&#"), numbered(numbered(F.replace(c, F.lit("&#X"), F.lit("&#x")), "&#x([0-9A-Fa-f]{1,6});", 16), "&#([0-9]{1,7});", 10)).otherwise(c)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def feed(documents: DataFrame) -> DataFrame:
    """documents: source_name, page_url, xml, fetched_at.  Entries of RSS and Atom feeds, relative links resolved, others than web links left out.

    The published time counts, else the updated one; both forms go together.
    """
    d = documents.where(refused(F.col("xml"), FEED_ROOTS).isNull())
    atom = root(F.col("xml")) == "feed"
    kind = F.when(atom, "atom").otherwise("rss")
    e = d.withColumn("method", kind).select("source_name", "page_url", "fetched_at", "method", F.posexplode(F.when(atom, _elements(F.col("xml"), "entry")).otherwise(_elements(F.col("xml"), "item"))).alias("seq", "e"))
    link = F.when(F.col("method") == "atom", unescape(F.regexp_extract("e", r"""(?s)<(?:\w+:)?link\b(?:(?!rel=)[^>])*?(?:rel=["']alternate["'][^>]*?)?href=["']([^"']*)["']""", 1))).otherwise(_value(F.col("e"), "link"))
    published = F.coalesce(_value(F.col("e"), "pubDate"), _value(F.col("e"), "published"))
    updated = F.coalesce(_value(F.col("e"), "updated"), _value(F.col("e"), "date"))
    raw = F.coalesce(published, updated)
    out = e.select("source_name", urls.canonical(link, F.col("page_url")).alias("url"), "method", text.collapse(_value(F.col("e"), "title")).alias("title"), F.coalesce(times.utc(published), times.utc(updated)).alias("source_timestamp"), raw.alias("source_timestamp_raw"), F.col("fetched_at").alias("discovered_at"), "page_url", F.col("seq").cast("long").alias("seq"))
    return out.where("url <> ''")


def sitemap(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents: as for feed.  URLs of url sets as discoveries, and of indexes as children (source_name, page_url, child, seq)."""
    d = documents.where(refused(F.col("xml"), SITEMAP_ROOTS).isNull())
    u = d.select("source_name", "page_url", "fetched_at", F.posexplode(_elements(F.col("xml"), "url")).alias("seq", "e"))
    raw = _value(F.col("e"), "lastmod")
    items = u.select("source_name", urls.canonical(_value(F.col("e"), "loc"), F.col("page_url")).alias("url"), F.lit("sitemap").alias("method"), F.lit(None).cast("string").alias("title"), times.utc(raw).alias("source_timestamp"), raw.alias("source_timestamp_raw"), F.col("fetched_at").alias("discovered_at"), "page_url", F.col("seq").cast("long").alias("seq"))
    c = d.select("source_name", "page_url", F.posexplode(_elements(F.col("xml"), "sitemap")).alias("seq", "e"))
    children = c.select("source_name", "page_url", urls.canonical(_value(F.col("e"), "loc"), F.col("page_url")).alias("child"), F.col("seq").cast("long").alias("seq"))
    return items.where("url <> ''"), children.where("child <> ''")


def followed(children: DataFrame, most: int = 2) -> DataFrame:
    """children with follow: the first most of each index."""
    return children.withColumn("follow", F.row_number().over(Window.partitionBy("page_url").orderBy("seq")) <= most)


def walk(start: DataFrame, documents: DataFrame, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """start and documents: as for feed.  URLs of the start documents and of the first most children of each index among them, and all children with follow.

    An index's children are read, their own children are not.
    """
    items, children = sitemap(start)
    children = followed(children, most)
    next_ = documents.join(children.where("follow").select(F.col("child").alias("page_url"), "source_name").distinct(), ["page_url", "source_name"], "left_semi")
    return items.unionByName(sitemap(next_)[0]), children
