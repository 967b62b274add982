"""Discovery: candidates of several methods as one row for each URL; listing joined with detail; pages in a chain."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import adapters, feeds
from . import decisions

#: Methods by priority.
METHODS = ("html", "rss", "atom", "sitemap")


def priority(method: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, METHODS)), method)


def union(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def merge_methods(found: DataFrame) -> DataFrame:
    """found: url, method, title, source_timestamp, source_timestamp_raw, discovered_at, page_url, category, seq.

    One row for each url: title, and time stamp with its raw form, each from the
    first method that has it; the earliest discovery; methods by priority; pages
    and category as first seen.  One aggregation with partial sums.
    """
    rank = F.struct(priority(F.col("method")), F.col("seq"))
    stamp = F.struct("source_timestamp", "source_timestamp_raw")
    best = lambda v, have: F.min_by(v, F.when(have, rank))
    pages = F.array_sort(F.collect_set(F.when(F.col("page_url").isNotNull(), F.struct("seq", "page_url"))))
    out = found.where(F.col("url") != "").groupBy("url").agg(
        best(F.col("title"), F.coalesce(F.col("title"), F.lit("")) != "").alias("title"),
        best(stamp, F.col("source_timestamp").isNotNull() | F.col("source_timestamp_raw").isNotNull()).alias("_t"),
        F.min("discovered_at").alias("discovered_at"),
        F.array_sort(F.collect_set(priority(F.col("method")))).alias("_m"),
        F.min_by("category", F.when(F.coalesce(F.col("category"), F.lit("")) != "", F.col("seq"))).alias("category"),
        F.array_distinct(F.transform(pages, lambda p: p.getField("page_url"))).alias("found_on"),
        F.min("seq").alias("seq"),
    )
    methods = F.transform("_m", lambda i: F.element_at(F.array(*map(F.lit, METHODS)), i.cast("int")))
    stamp = lambda f: F.when(F.col("_t").isNotNull(), F.col(f"_t.{f}")).alias(f)
    return out.select("url", "title", stamp("source_timestamp"), stamp("source_timestamp_raw"), "discovered_at", methods.alias("methods"), "category", "found_on", "seq")


def enrich(listing: DataFrame, detail: DataFrame, key: str, most: int, keep: tuple = (), seq: str = "seq") -> DataFrame:
    """listing left-joined with detail pages of its first most rows; a value of the detail wins unless blank, but for the columns of keep.

    detail: key, ok, error and fields.  Adds detail_fetch_status and detail_error;
    a page that failed leaves its row as the listing gave it.
    """
    fields = [c for c in detail.columns if c not in (key, "ok", "error")]
    # the first rows by a top-k, not by a sort of the whole listing in one task
    first = listing.orderBy(seq, key).limit(most).select(F.struct(F.col(seq), F.col(key)).alias("_first"), F.lit(True).alias("_try"))
    tried = listing.join(F.broadcast(first) if most <= 100_000 else first, F.struct(F.col(seq), F.col(key)).eqNullSafe(F.col("_first")), "left")
    d = detail.select(F.col(key).alias("_k"), F.struct(*detail.columns).alias("_d"))
    j = tried.join(d, (F.col(key) == F.col("_k")) & F.col("_try"), "left")
    ok = F.coalesce(F.col("_d.ok"), F.lit(False))
    status = F.when(F.col("_try").isNull(), "not_attempted").when(ok, "ok").otherwise("failed")

    def value(c: str) -> Column:
        a = F.col(c) if c in listing.columns else F.lit(None)
        if c not in fields or c in keep:
            return a.alias(c)
        b = F.col(f"_d.{c}")
        return F.when(ok & b.isNotNull() & (b.cast("string") != ""), b).otherwise(a).alias(c)

    names = [*listing.columns, *(c for c in fields if c not in listing.columns)]
    return j.select(*(value(c) for c in names), status.alias("detail_fetch_status"), F.when(status == "failed", F.coalesce(F.col("_d.error"), F.lit("no page"))).alias("detail_error"))


def page_chain(pages: DataFrame, start: str, most: int = 5) -> DataFrame:
    """pages: url, next_url, items (array of item URLs), ok.  The pages walked from start, in order, and why the walk stopped there.

    A walk is short and each step depends on the one before it, so it is a
    recursive query over pages; a page's row is read by its URL alone.
    """
    pages.createOrReplaceTempView("_siftloom_pages")
    spark = pages.sparkSession
    walked = spark.sql(
        """WITH RECURSIVE walk(n, url, seen, items_seen, known) AS (
             SELECT 1, :start, array(:start), CAST(array() AS array<string>), false
             UNION ALL
             SELECT w.n + 1, p.next_url, concat(w.seen, array(p.next_url)), array_union(w.items_seen, p.items), false
             FROM walk w JOIN _siftloom_pages p ON p.url = w.url
             WHERE w.n < :most AND p.ok AND size(p.items) > 0 AND size(array_except(p.items, w.items_seen)) > 0
               AND p.next_url IS NOT NULL AND NOT array_contains(w.seen, p.next_url)
               AND parse_url(p.next_url, 'HOST') = parse_url(:start, 'HOST'))
           SELECT w.n, w.url, w.seen, w.items_seen, p.next_url, p.items, coalesce(p.ok, false) AS ok
           FROM walk w LEFT JOIN _siftloom_pages p ON p.url = w.url""",
        args={"start": start, "most": most},
    )
    host = lambda c: F.lower(F.regexp_extract(c, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    reason = (
        F.when(~F.col("ok"), "fetch_failed")
        .when(F.size("items") == 0, "empty_listing")
        .when(F.size(F.array_except("items", "items_seen")) == 0, "repeated_items")
        .when(F.coalesce(F.col("next_url"), F.lit("")) == "", "no_next_page")
        .when(F.array_contains("seen", F.col("next_url")), "cycle_detected")
        .when(host(F.col("next_url")) != host(F.lit(start)), "domain_mismatch")
        .when(F.col("n") >= most, "max_pages_reached")
    )
    return walked.select(F.col("n").alias("page"), "url", reason.alias("stop_reason"))


class DiscoveryError(RuntimeError):
    """Every page of a discovery failed."""


class EmptyListingError(RuntimeError):
    """Pages were read and no item was found: the layout may have changed."""


@dataclass(frozen=True)
class Source:
    """What a source's configuration says.  urls: pages by method; without a scope, the listing's own host is in scope."""

    source_id: str
    listing_url: str
    adapter: str
    methods: tuple = ("html",)
    urls: dict = field(default_factory=dict)
    listing_options: dict = field(default_factory=dict)
    scope: decisions.Scope | None = None
    routes: dict = field(default_factory=dict)
    institution: str = ""
    item_type: str = "event"
    organizer: str = ""
    supports_detail: bool = True
    detail_limit: int = 100
    allow_empty_listing: bool = False
    enabled: bool = True
    interval_minutes: float | None = None
    retry_minutes: float = 60.0
    lock_max_age_minutes: float = 120.0
    pipeline: str = "aggregator"

    def __post_init__(self):
        unknown = [m for m in self.methods if m not in METHODS]
        if unknown:
            raise ValueError(f"{self.source_id}: unknown discovery methods {unknown}")

    @classmethod
    def of(cls, settings: dict) -> "Source":
        """From a mapping; unknown keys are refused."""
        unknown = sorted(set(settings) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"{settings.get('source_id')}: unknown keys {unknown}")
        scope = settings.get("scope")
        return cls(**{**settings, "methods": tuple(settings.get("methods", ("html",))), "scope": decisions.Scope.of(scope) if isinstance(scope, dict) else scope})

    def scoped(self) -> decisions.Scope:
        from urllib.parse import urlsplit

        return self.scope or decisions.Scope(hosts=(urlsplit(self.listing_url).hostname or "",))

    def routed(self) -> decisions.Routes:
        return decisions.Routes(**{"hosts": self.scoped().hosts, **self.routes})


def method_urls(source: Source) -> list[tuple[str, str]]:
    """(method, URL) to read, methods by priority; html reads the listing where no URL is given for it."""
    known = {**({"html": [source.listing_url]} if "html" in source.methods else {}), **{k: v for k, v in source.urls.items() if v}}
    lacking = [m for m in source.methods if m not in known]
    if lacking:
        raise ValueError(f"{source.source_id}: no URLs for {', '.join(lacking)}")
    return [(m, u) for m in METHODS if m in source.methods for u in known[m]]


def _html(pages: DataFrame, source: Source) -> DataFrame:
    adapter = adapters.load(source.adapter)
    return adapters.from_hook(pages, adapter, source.listing_options) if source.listing_options else adapter.listing(pages)


def _feed(pages: DataFrame, source: Source) -> DataFrame:
    return feeds.feed(pages.withColumnRenamed("html", "xml"))


#: Of each method, what reads its pages (source_name, page_url, html, fetched_at) but for sitemaps, which lead to more pages.
PARSERS = {"html": _html, "rss": _feed, "atom": _feed}


@dataclass
class Found:
    """candidates: one row for each URL; pages: one for each page read or missed, with found; found: all records before they are merged."""

    candidates: DataFrame
    pages: DataFrame
    found: DataFrame


def discover(landed: DataFrame, source: Source, now: str, most_children: int = 2, keep=None) -> Found:
    """landed: page_url, final_url, http_status, content_type, fetched_at, body, as fetched for this run.

    All methods are read from what has landed, in the order of their priority; of a
    sitemap index the first most_children children are read too.  URLs are merged,
    scoped and capped.  Candidates are numbered as first seen.  keep(name, df), if
    given, writes a table and reads it again, so that plans stay short.
    """
    spark = landed.sparkSession
    keep = keep or (lambda name, df: df)
    asked = spark.createDataFrame([(source.source_id, m, u, i) for i, (m, u) in enumerate(method_urls(source))], "source_name string, method string, page_url string, turn long")

    def read(asked: DataFrame) -> DataFrame:
        ok = F.coalesce(F.col("http_status") < 400, F.lit(False)) & F.col("body").isNotNull()
        return asked.join(landed, "page_url", "left").withColumn("ok", ok)

    def usable(pages: DataFrame, method: str) -> DataFrame:
        return pages.where(F.col("ok") & (F.col("method") == method)).select("source_name", F.coalesce("final_url", "page_url").alias("page_url"), F.col("page_url").alias("asked"), "turn", F.col("body").alias("html"), F.lit(now).alias("fetched_at"))

    pages = keep("pages", read(asked))
    found = []
    for method in METHODS:
        if method not in source.methods:
            continue
        p = usable(pages, method)
        if method == "sitemap":
            documents = p.withColumnRenamed("html", "xml")
            items, children = feeds.sitemap(documents)
            turns = documents.select("page_url", "turn").dropDuplicates(["page_url"])
            next_ = children.join(turns, "page_url").orderBy("turn", "seq").limit(most_children)
            more = read(next_.select("source_name", F.lit("sitemap").alias("method"), F.col("child").alias("page_url"), (F.col("turn") * 1000 + F.col("seq") + 1_000_000).alias("turn")))
            pages = pages.unionByName(more)
            p = p.unionByName(usable(more, method))
            records = items.unionByName(feeds.sitemap(usable(more, method).withColumnRenamed("html", "xml"))[0])
        else:
            records = PARSERS[method](p, source).withColumn("method", F.lit(method))
        at = p.select("page_url", "asked", "turn").dropDuplicates(["page_url"])
        records = records.join(F.broadcast(at) if method != "sitemap" else at, "page_url")
        found.append(records.withColumn("page_url", F.col("asked")).withColumn("seq", (F.col("turn") * F.lit(1 << 40) + F.col("seq")).cast("long")).drop("asked", "turn"))
    found = keep("found", union(*found))
    counted = found.groupBy("page_url", "method").agg(F.count("*").alias("found"))
    pages = pages.join(counted, ["page_url", "method"], "left").select("page_url", "method", "turn", "http_status", "ok", F.coalesce("found", F.lit(0)).alias("found"))
    merged = merge_methods(found).withColumn("source_name", F.lit(source.source_id))
    return Found(keep("candidates", decisions.capped(keep("merged", merged), source.scoped())), pages, found)


def counters(found: Found) -> dict:
    """pages_fetched, http_status of the first page even if it failed, raw_count, failures."""
    p = found.pages.agg(F.count_if("ok").alias("pages_fetched"), F.min_by(F.struct("http_status"), "turn").alias("s"), F.coalesce(F.sum("found"), F.lit(0)).alias("raw_count"), F.count_if(~F.col("ok")).alias("failures"))
    return p.select("pages_fetched", "s.http_status", "raw_count", "failures").first().asDict()


def checked(found: Found, source: Source, counted: dict | None = None) -> int:
    """How many candidates there are.  Raises if every page failed, or if pages were read and nothing was found, unless the source allows that."""
    c = counted or counters(found)
    if not c["pages_fetched"]:
        raise DiscoveryError(f"{source.source_id}: every page of the discovery failed (first status {c['http_status']})")
    if not c["raw_count"] and not source.allow_empty_listing:
        raise EmptyListingError(f"{source.source_id}: pages were read and no item was found; has the layout changed?")
    return found.candidates.count()


def empty_pages(pages: DataFrame) -> DataFrame:
    """Pages that were read and gave nothing: a selector that misses, or really an empty page."""
    return pages.where(F.col("ok") & (F.col("found") == 0)).select("page_url", "method", "http_status")


def routed(candidates: DataFrame, source: Source, types: DataFrame | None = None) -> DataFrame:
    """candidates with label and label_reason.  types: url and content_type, once pages were read; they decide over the name."""
    candidates = candidates.drop("label", "label_reason")
    if types is None:
        c, kind = candidates, None
    else:
        c, kind = candidates.join(types.select("url", F.col("content_type").alias("_type")), "url", "left"), F.col("_type")
    r = decisions.route(F.col("url"), source.routed(), kind, F.col("category"))
    return c.withColumn("_r", r).select(*candidates.columns, F.col("_r.label").alias("label"), F.col("_r.reason").alias("label_reason"))


def discovered_rows(routed_candidates: DataFrame) -> DataFrame:
    """Rows of the table of discovered items: every candidate, in scope or not, with what was decided."""
    c = routed_candidates
    return c.select(F.col("url").alias("discovered_url"), "source_name", F.col("methods").alias("discovery_methods"), F.col("title").alias("discovered_title"), "source_timestamp", "source_timestamp_raw", F.col("discovered_at").alias("first_discovered_at"), F.col("discovered_at").alias("last_discovered_at"), "in_scope", F.col("reason").alias("scope_reason"), F.col("label").alias("content_class"), F.col("label_reason").alias("class_reason"))


def upsert_discovered(old: DataFrame, rows: DataFrame) -> DataFrame:
    """The next state of discovered items: a URL keeps when it was first discovered, all else is this run's; one full join on the URL."""
    o = old.select(F.col("discovered_url").alias("_u"), F.struct(*(c for c in old.columns if c != "discovered_url")).alias("_o"))
    n = rows.withColumn("_new", F.lit(True))
    j = n.join(o, n["discovered_url"] == o["_u"], "full_outer")
    value = lambda c: F.when(F.col("_new"), F.coalesce(F.col(f"_o.{c}"), F.col(c)) if c == "first_discovered_at" else F.col(c)).otherwise(F.col(f"_o.{c}")).alias(c)
    return j.select(F.coalesce("discovered_url", "_u").alias("discovered_url"), *(value(c) for c in rows.columns if c != "discovered_url"))


def detail_counts(records: DataFrame, *by: str) -> DataFrame:
    """Rows of each detail_fetch_status."""
    return records.groupBy(*by).agg(*(F.count_if(F.col("detail_fetch_status") == s).alias(s) for s in ("ok", "failed", "not_attempted")))
