"""The registered queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times, urls
from ..operators import decisions, discovery, matching, records, runlog, runs
from ..sources import feeds, fetched, html
from ..sources.snapshots import query
from ..streaming.upserts import windowed_counts

Q: dict = {}
SQL: dict[str, str] = {}


def registered(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict:
    from . import lifecycle  # noqa: F401  registers its own

    return dict(Q)


def oracle_sql() -> dict[str, str]:
    from . import lifecycle  # noqa: F401

    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- URLs, scope, routes ------------------------------------------------------

_TRACK = "(lower(split_part(p, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\' OR lower(split_part(p, '=', 1)) IN (" + ", ".join(f"'{k}'" for k in urls.TRACKING) + "))"
_CANON = f"""canon AS (SELECT page_id, url, html, scheme || '://' || host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(list_sort(query), '&') ELSE '' END AS canonical, host, path FROM (
  SELECT page_id, url, html, lower(regexp_extract(url, '^([^:/?#]+):', 1)) AS scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
    CASE WHEN regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END AS path,
    list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT {_TRACK}) AS query FROM pages))"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", urls.canonical(F.col("url")).alias("canonical"))


@registered(f"WITH {_CANON} SELECT page_id, canonical FROM canon")
def canonical_urls(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", "canonical")


@registered(f"WITH {_CANON} SELECT canonical, count(*) AS n_pages, min(page_id) AS first_page FROM canon GROUP BY canonical")
def url_dedup(spark, sf_dir):
    return _canonical(spark, sf_dir).groupBy("canonical").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@registered(f"WITH {_CANON} SELECT page_id, scheme_host || '#/item/' || substr(sha256(page_id || chr(31) || 'x y'), 1, 16) AS item_url FROM (SELECT page_id, split_part(canonical, '?', 1) AS scheme_host FROM canon)")
def synthetic_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.synthetic(F.col("url"), F.col("page_id"), F.lit(" X  y ")).alias("item_url"))


SCOPE = decisions.Scope(domains=("example.com", "example.org"), prefixes=("/en/", "/fr/", "/de"), excluded=("/de/1",), query_keys=("page",))
_SCOPE_SQL = f"""WITH {_CANON}, d AS (SELECT page_id, canonical, host, CASE
   WHEN NOT (host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org') THEN 'external host: ' || host
   WHEN path LIKE '/de/1/%' OR path = '/de/1' THEN 'excluded prefix: /de/1/'
   WHEN len(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: lower(split_part(p, '=', 1)) = 'page')) > 0 THEN 'excluded query key (calendar/search/filter explosion): page'
   WHEN path LIKE '/en/%' THEN 'in scope: ' || host || ' /en/' WHEN path LIKE '/fr/%' THEN 'in scope: ' || host || ' /fr/' WHEN path LIKE '/de/%' THEN 'in scope: ' || host || ' /de/'
   ELSE 'outside allowed prefixes: ' || path END AS reason FROM canon)"""


@registered(_SCOPE_SQL + " SELECT page_id, reason LIKE 'in scope%' AS in_scope, reason FROM d")
def scope_filter(spark, sf_dir):
    return _canonical(spark, sf_dir).withColumn("d", decisions.scope(F.col("canonical"), SCOPE)).select("page_id", "d.in_scope", "d.reason")


@registered(
    _SCOPE_SQL
    + """, r AS (SELECT page_id, reason, reason LIKE 'in scope%' AS ok, sum((reason LIKE 'in scope%')::INT) OVER (PARTITION BY host ORDER BY page_id) AS k FROM d)
   SELECT page_id, ok AND k <= 3 AS in_scope, CASE WHEN ok AND k > 3 THEN 'over max_discovered_items (3)' ELSE reason END AS reason FROM r"""
)
def capped_discovery(spark, sf_dir):
    df = _canonical(spark, sf_dir).withColumn("host", urls.host(F.col("canonical")))
    s = decisions.Scope(domains=SCOPE.domains, prefixes=SCOPE.prefixes, excluded=SCOPE.excluded, query_keys=SCOPE.query_keys, most_items=3)
    return decisions.capped(df, s, "canonical", "page_id", ("host",)).select("page_id", "in_scope", "reason")


@registered(
    f"""WITH {_CANON}, r AS (SELECT host, CASE WHEN host LIKE '%.net' THEN 'external_link' WHEN path LIKE '/en/%' THEN 'event' WHEN path LIKE '/fr/%' THEN 'announcement' WHEN path LIKE '/es/%' THEN 'faculty' ELSE 'unknown' END AS label FROM canon)
   SELECT label, host, count(*) AS n FROM r GROUP BY ALL"""
)
def router_classes(spark, sf_dir):
    df = _canonical(spark, sf_dir).withColumn("host", urls.host(F.col("canonical")))
    routes = decisions.Routes(patterns={"event": ["/en/"], "announcement": ["/fr/"], "faculty": ["/es/"]})
    label = F.when(F.col("host").endswith(".net"), "external_link").otherwise(decisions.route(F.col("canonical"), routes).getField("label"))
    return df.select(label.alias("label"), "host").groupBy("label", "host").agg(F.count("*").alias("n"))


@registered("SELECT * FROM (VALUES ('http://a.b/x.pdf', NULL, NULL, 'pdf_document'), ('http://a.b/x.pdf', 'text/html; charset=x', NULL, 'unknown'), ('http://a.b/x', 'application/pdf', NULL, 'pdf_document'), ('http://a.b/events/1', NULL, NULL, 'event'), ('http://a.b/events/1', NULL, ' News ', 'announcement'), ('http://c.d/events/1', NULL, 'News', 'external_link'), ('http://a.b/y', NULL, 'Other', 'unknown')) t(url, content_type, category, label)")
def route_rules(spark, sf_dir):
    rows = [("http://a.b/x.pdf", None, None), ("http://a.b/x.pdf", "text/html; charset=x", None), ("http://a.b/x", "application/pdf", None), ("http://a.b/events/1", None, None), ("http://a.b/events/1", None, " News "), ("http://c.d/events/1", None, "News"), ("http://a.b/y", None, "Other")]
    r = decisions.Routes(hosts=("a.b",), categories={"news": "announcement"}, patterns={"event": ["/events/"]})
    df = spark.createDataFrame(rows, "url string, content_type string, category string")
    return df.select("*", decisions.route(F.col("url"), r, F.col("content_type"), F.col("category")).getField("label").alias("label"))


@registered("SELECT * FROM (VALUES ('../b?x=1#top', 'http://h.com/a/c/d', 'http://h.com/a/b?x=1'), ('//H2.com:443/p/', 'https://h.com/', 'https://h2.com/p/'), ('?page=2', 'http://h.com/l?page=1', 'http://h.com/l?page=2'), ('mailto:a@b.c', 'http://h.com/', ''), ('#/item/4', 'http://h.com/x', 'http://h.com/x#/item/4'), ('http://h.com:80', '', 'http://h.com/'), ('/a;jsessionid=9?b=2&a=1&sid=3', 'http://h.com', 'http://h.com/a?a=1&b=2'), ('  ', 'http://h.com', ''), ('e f', 'http://h.com/d/', 'http://h.com/d/e f'), ('x', '', '')) t(href, page, url)")
def resolved_urls(spark, sf_dir):
    rows = [("../b?x=1#top", "http://h.com/a/c/d"), ("//H2.com:443/p/", "https://h.com/"), ("?page=2", "http://h.com/l?page=1"), ("mailto:a@b.c", "http://h.com/"), ("#/item/4", "http://h.com/x"), ("http://h.com:80", ""), ("/a;jsessionid=9?b=2&a=1&sid=3", "http://h.com"), ("  ", "http://h.com"), ("e f", "http://h.com/d/"), ("x", "")]
    return spark.createDataFrame(rows, "href string, page string").select("*", urls.canonical(F.col("href"), F.col("page")).alias("url"))


# -- discovery ----------------------------------------------------------------


@registered(
    f"""WITH {_CANON}, f AS (
   SELECT canonical AS url, 1 AS prio, page_id AS seq, NULL AS title, NULL AS ts FROM canon WHERE page_id % 3 <> 0
   UNION ALL SELECT canonical, 2, page_id, 'rss ' || page_id, '2024-01-01T00:00:00Z' FROM canon WHERE page_id % 2 = 0
   UNION ALL SELECT canonical, 4, page_id, 'map ' || page_id, '2023-01-01T00:00:00Z' FROM canon)
   SELECT url, arg_min(title, prio * 100000000 + seq) FILTER (WHERE title IS NOT NULL) AS title, arg_min(ts, prio * 100000000 + seq) FILTER (WHERE ts IS NOT NULL) AS source_timestamp,
     array_to_string(list_transform(list_sort(list(DISTINCT prio)), lambda p: CASE p WHEN 1 THEN 'html' WHEN 2 THEN 'rss' WHEN 4 THEN 'sitemap' END), ',') AS methods, min(seq) AS seq FROM f GROUP BY url"""
)
def priority_merge(spark, sf_dir):
    c = _canonical(spark, sf_dir)
    null = F.lit(None).cast("string")

    def one(df, method, title, ts):
        return df.select(F.col("canonical").alias("url"), F.lit(method).alias("method"), title.alias("title"), ts.alias("source_timestamp"), ts.alias("source_timestamp_raw"), F.lit("2024-02-01T00:00:00Z").alias("discovered_at"), F.col("url").alias("page_url"), null.alias("category"), F.col("page_id").alias("seq"))

    tag = lambda t: F.concat(F.lit(f"{t} "), F.col("page_id").cast("string"))
    found = discovery.union(one(c.where("page_id % 3 <> 0"), "html", null, null), one(c.where("page_id % 2 = 0"), "rss", tag("rss"), F.lit("2024-01-01T00:00:00Z")), one(c, "sitemap", tag("map"), F.lit("2023-01-01T00:00:00Z")))
    return discovery.merge_methods(found).select("url", "title", "source_timestamp", F.array_join("methods", ",").alias("methods"), "seq")


@registered(
    """WITH n AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages),
   l AS (SELECT page_id, site, unnest(regexp_extract_all(nav, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(nav, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM n)
   SELECT page_id, site || href AS url, title FROM l"""
)
def anchor_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("source_name"), F.col("url").alias("page_url"), "html", F.lit(None).cast("string").alias("fetched_at"))
    return html.listing(p, html.Cards(item="nav li")).select(F.col("source_name").cast("long").alias("page_id"), "url", "title")


@registered("SELECT page_id, trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&amp;?', '&', 'g'), '&quot;', '\"'), '\\s+', ' ', 'g')) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("item_url"), "html")
    f = html.fields(p, {"title": "title", "lang": "html"}, {"lang": "lang"})
    return f.select(F.col("item_url").cast("long").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), "lang")


_RSS = """<?xml version="1.0"?><rss version="2.0"><channel><item><title>A &amp; B</title><link>/e/1?utm_source=x</link><pubDate>Tue, 05 Mar 2024 10:00:00 +0530</pubDate></item><item><title><![CDATA[C <d>]]></title><link>https://o.org/2</link></item><item><link>mailto:x@y.z</link></item></channel></rss>"""
_ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title><link href="https://o.org/3"/><updated>2024-03-01T00:00:00Z</updated></entry></feed>"""
_EVIL = """<!DOCTYPE x [<!ENTITY a "b">]><rss><channel><item><link>https://o.org/9</link></item></channel></rss>"""


@registered("SELECT * FROM (VALUES ('https://h.org/e/1', 'rss', 'A & B', '2024-03-05T04:30:00Z', 'Tue, 05 Mar 2024 10:00:00 +0530', 0), ('https://o.org/2', 'rss', 'C <d>', NULL, NULL, 1), ('https://o.org/3', 'atom', 'E', '2024-03-01T00:00:00Z', '2024-03-01T00:00:00Z', 0)) t(url, method, title, source_timestamp, source_timestamp_raw, seq)")
def feed_entries(spark, sf_dir):
    d = spark.createDataFrame([("s", "https://h.org/feed", x, None) for x in (_RSS, _ATOM, _EVIL, "not xml")], "source_name string, page_url string, xml string, fetched_at string")
    return feeds.feed(d).select("url", "method", "title", "source_timestamp", "source_timestamp_raw", "seq")


@registered("SELECT * FROM (VALUES ('url', 'https://h.org/a', '2024-01-02T00:00:00Z', false), ('url', 'https://h.org/b', NULL, false), ('child', 'https://h.org/s1.xml', NULL, true), ('child', 'https://h.org/s2.xml', NULL, true), ('child', 'https://h.org/s3.xml', NULL, false)) t(kind, url, source_timestamp, follow)")
def sitemap_walk(spark, sf_dir):
    one = "<urlset xmlns='x'><url><loc>https://h.org/a</loc><lastmod>2024-01-02T00:00:00+00:00</lastmod></url><url><loc> https://h.org/b#t </loc><lastmod>2024-01-03</lastmod></url></urlset>"
    two = "<sitemapindex>" + "".join(f"<sitemap><loc>/s{i}.xml</loc></sitemap>" for i in (1, 2, 3)) + "</sitemapindex>"
    d = spark.createDataFrame([("s", "https://h.org/sitemap.xml", x, None) for x in (one, two)], "source_name string, page_url string, xml string, fetched_at string")
    items, children = feeds.sitemap(d)
    return items.select(F.lit("url").alias("kind"), "url", "source_timestamp", F.lit(False).alias("follow")).unionByName(feeds.followed(children).select(F.lit("child").alias("kind"), F.col("child").alias("url"), F.lit(None).cast("string").alias("source_timestamp"), "follow"))


@registered("SELECT * FROM (VALUES (1, 'https://h.org/new', 'Next talk', '2024-06-01T04:30:00Z'), (2, 'https://h.org/old', 'A Talk', '2024-01-01T04:30:00Z'), (3, 'https://h.org/older', 'Talk 0', '2023-01-01T04:30:00Z')) t(seq, url, title, source_timestamp)")
def calendar_events(spark, sf_dir):
    import json

    inner = json.dumps([{"title": "A Talk", "url": "/old", "start": "2024-01-01T10:00:00+05:30"}, {"title": "Talk 0", "url": "/older", "start": "2023-01-01T10:00:00+05:30"}, {"title": "Holiday", "url": "/h", "start": "2024-07-01"}, {"title": "Next  talk", "url": "/new", "start": "2024-06-01T10:00:00+05:30"}, {"title": "A Talk", "url": "/old#x", "start": "2022-01-01T10:00:00+05:30"}])
    page = f"<script data-x='settings'>{json.dumps({'cal': {'options': json.dumps({'events': json.loads(inner)})}})}</script>"
    d = spark.createDataFrame([("s", "https://h.org/c", page, None)], "source_name string, page_url string, html string, fetched_at string")
    nested = d.withColumn("html", F.concat(F.lit("<script data-x='settings'>"), F.get_json_object(F.regexp_extract("html", r"(?s)<script data-x='settings'>(.*?)</script>", 1), "$.cal.options"), F.lit("</script>")))
    return html.calendar(nested, r"(?s)<script data-x='settings'>(.*?)</script>", "$.events", ["talk"], "2024-03-01T00:00:00Z").select(F.col("seq").cast("int").alias("seq"), "url", "title", "source_timestamp")


@registered("SELECT * FROM (VALUES (1, 'http://h.org/l', NULL), (2, 'http://h.org/l?page=1', NULL), (3, 'http://h.org/l?page=2', 'repeated_items')) t(page, url, stop_reason)")
def page_chain(spark, sf_dir):
    rows = [("http://h.org/l", "http://h.org/l?page=1", ["a", "b"], True), ("http://h.org/l?page=1", "http://h.org/l?page=2", ["c"], True), ("http://h.org/l?page=2", "http://h.org/l", ["b", "c"], True)]
    return discovery.page_chain(spark.createDataFrame(rows, "url string, next_url string, items array<string>, ok boolean"), "http://h.org/l")


@registered(
    """SELECT page_id, CASE WHEN d.doc_id IS NOT NULL AND rn <= 100 AND d.doc_id % 3 <> 0 THEN d.lang ELSE 'unknown' END AS lang, CASE WHEN rn > 100 THEN 'not_attempted' WHEN d.doc_id % 3 <> 0 THEN 'ok' ELSE 'failed' END AS detail_fetch_status
   FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS rn FROM pages) p LEFT JOIN documents d ON d.doc_id = p.page_id"""
)
def listing_with_detail(spark, sf_dir):
    listing = table(spark, sf_dir, "pages").select("page_id", F.lit("unknown").alias("lang"))
    detail = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "lang", (F.col("doc_id") % 3 != 0).alias("ok"), F.lit("timeout").alias("error"))
    return discovery.enrich(listing, detail, "page_id", 100, seq="page_id").select("page_id", "lang", "detail_fetch_status")


# -- records ------------------------------------------------------------------


@registered("SELECT doc_id, sha256(concat_ws('|', doc_id, coalesce(lang, ''), coalesce(source, ''), n_chars, coalesce(text, ''))) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", records.legacy_hash(*(F.col(c) for c in ("doc_id", "lang", "source", "n_chars", "text"))).alias("content_hash"))


@registered("""SELECT doc_id, sha256('{"description":null,"is_online":true,"organizations":["a","' || source || '"],"speakers":[{"affiliation":null,"name":"A B"},{"affiliation":"x","name":"' || lang || '"}],"title":"t/' || doc_id || '"}') AS record_hash FROM documents""")
def record_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    sp = F.array(F.struct(F.lit("x").alias("affiliation"), F.col("lang").alias("name")), F.struct(F.lit(None).cast("string").alias("affiliation"), F.lit("A B").alias("name")))
    r = d.select("doc_id", F.lit(None).cast("string").alias("description"), F.lit(True).alias("is_online"), F.array("source", F.lit("a")).alias("organizations"), sp.alias("speakers"), F.concat(F.lit("t/"), F.col("doc_id").cast("string")).alias("title"))
    return r.select("doc_id", records.content_hash(r).alias("record_hash"))


_OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS s, CAST(round(o_totalprice * 100) AS BIGINT) AS v, '2024-01-01T00:00:00Z' AS f, CASE WHEN o_orderkey % 4 = 0 THEN '2024-01-02T00:00:00Z' ELSE '2024-01-05T00:00:00Z' END AS l FROM orders WHERE o_orderkey % 10 <> 0)"
_NEW = "new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS s, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS v, CASE WHEN o_orderkey % 5 = 0 THEN 'ok' ELSE 'failed' END AS detail_fetch_status FROM orders WHERE o_orderkey % 11 <> 0)"
_MERGED = f"""WITH {_OLD}, {_NEW}, j AS (SELECT coalesce(n.k, o.k) AS k, n.k IS NOT NULL AS fresh, o.k IS NOT NULL AS known, CASE WHEN n.k IS NULL THEN o.s WHEN n.s IS NULL AND o.k IS NOT NULL AND n.detail_fetch_status <> 'ok' THEN o.s ELSE n.s END AS s,
    coalesce(n.v, o.v) AS v, sha256(concat_ws('|', coalesce(o.s, ''), o.v)) AS oh, o.f, o.l FROM old o FULL JOIN new n ON o.k = n.k),
   m AS (SELECT k, s, CASE WHEN NOT fresh THEN 'not_seen' WHEN NOT known THEN 'new' WHEN oh = sha256(concat_ws('|', coalesce(s, ''), v)) THEN 'unchanged' ELSE 'changed' END AS state, fresh AND known AND l < '2024-01-03T00:00:00Z' AS rediscovered,
    coalesce(f, '2024-01-09T00:00:00Z') AS first_seen_at, CASE WHEN fresh THEN '2024-01-09T00:00:00Z' ELSE l END AS last_seen_at FROM j)"""


def _merged(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    digest = lambda df: records.legacy_hash(F.col("s"), F.col("v"))
    v = F.round(F.col("o_totalprice") * 100).cast("long")
    old = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), v.alias("v"), F.lit("ok").alias("detail_fetch_status"), F.lit("2024-01-01T00:00:00Z").alias("first_seen_at"), F.when(F.col("o_orderkey") % 4 == 0, "2024-01-02T00:00:00Z").otherwise("2024-01-05T00:00:00Z").alias("last_seen_at"))
    old = old.withColumn("content_hash", digest(old))
    new = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus")).alias("s"), (v + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("v"), F.when(F.col("o_orderkey") % 5 == 0, "ok").otherwise("failed").alias("detail_fetch_status"))
    return records.merge(old, new, "k", ("s", "v"), "2024-01-09T00:00:00Z", digest, records.carry_rule(), "2024-01-03T00:00:00Z")


@registered(_MERGED + " SELECT k, s, state, rediscovered, first_seen_at, last_seen_at FROM m")
def merged_records(spark, sf_dir):
    return _merged(spark, sf_dir).select("k", "s", "state", "rediscovered", "first_seen_at", "last_seen_at")


@registered(_MERGED + ' SELECT count(*) FILTER (state = \'new\') AS "new", count(*) FILTER (state = \'changed\') AS changed, count(*) FILTER (state = \'unchanged\') AS unchanged, count(*) FILTER (state = \'not_seen\') AS not_seen, count(*) FILTER (rediscovered) AS rediscovered FROM m')
def change_counts(spark, sf_dir):
    return records.counts(_merged(spark, sf_dir))


@registered("SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN lag(event_type) OVER w = event_type THEN 'unchanged' ELSE 'changed' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def batch_duplicates(spark, sf_dir):
    return records.fold_in_order(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "state")


@registered("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_of_each_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return records.last_of_each(e.withColumn("at", F.col("event_id")), ["user_id"], "at").select("user_id", "event_type", "event_id")


@registered(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN source IS NULL OR source = '' THEN 'title: required' END, CASE WHEN doc_id % 4 = 1 THEN 'event_start: expected ISO 8601 UTC ''YYYY-MM-DDTHH:MM:SSZ'' or date-only ''YYYY-MM-DD'', got ''2024-02-30''' END,
     CASE WHEN doc_id % 4 = 2 THEN 'timezone: required when event_start is date-only (it is a local calendar date)' END, CASE WHEN doc_id % 4 = 3 THEN 'event_end: earlier than event_start' END, CASE WHEN doc_id % 5 = 0 THEN 'organizations[0]: expected non-empty str' END, CASE WHEN doc_id % 7 = 0 THEN 'detail_fetch_status: expected one of ok, failed, not_attempted' END], lambda x: x IS NOT NULL), '; ') AS errors FROM documents"""
)
def record_errors(spark, sf_dir):
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    start = F.when(i % 4 == 1, "2024-02-30").when(i % 4 == 2, "2024-02-28").otherwise("2024-02-28T10:00:00Z")
    end = F.when(i % 4 == 3, "2024-02-28T09:00:00Z")
    r = d.select("doc_id", F.col("source").alias("title"), start.alias("event_start"), end.alias("event_end"), F.lit(None).cast("string").alias("timezone"), F.when(i % 5 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("o"))).alias("organizations"), F.when(i % 7 == 0, "lost").otherwise("ok").alias("detail_fetch_status"))
    return r.select("doc_id", F.array_join(records.errors(r), "; ").alias("errors"))


@registered("SELECT doc_id, coalesce(source, 'none') AS source_name, 'I-' || coalesce(source, 'none') AS institution, 'event' AS item_type, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Office' END AS organization, 'http://l/' AS source_url FROM documents")
def assembled_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source_name", F.coalesce("source", F.lit("none")))
    s = d.select("source_name").distinct().select("source_name", F.concat(F.lit("I-"), F.col("source_name")).alias("institution"), F.lit("event").alias("item_type"), F.lit("Office").alias("organizer"), F.lit("http://l/").alias("listing_url"))
    m = d.select("source_name", F.col("doc_id").cast("string").alias("item_url"), F.when(F.col("doc_id") % 2 == 0, F.array("lang")).alias("organizations"))
    return records.assemble(m, s).select(F.col("item_url").cast("long").alias("doc_id"), "source_name", "institution", "item_type", F.col("organizations")[0].alias("organization"), "source_url")


@registered("SELECT text AS text_copy, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    return records.repeated_keys(table(spark, sf_dir, "documents"), "text").withColumnRenamed("text", "text_copy")


@registered("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def inventory(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


# -- entities -----------------------------------------------------------------


@registered("SELECT c_custkey, n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'FRANCE' OR c_custkey % 50 = 0")
def person_lookup(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "nation")}
    return query(spark, t, "SELECT c_custkey, n_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = :nation OR c_custkey % :step = 0", nation="FRANCE", step=50)


@registered("SELECT n_name, o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('O', 'F') GROUP BY ALL")
def organizer_rank(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    c, n = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"))


@registered(
    """WITH kept AS (SELECT o_orderkey AS item, o_custkey AS person FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0), new AS (SELECT DISTINCT o_orderkey AS item, o_custkey + o_orderkey % 3 AS person FROM orders WHERE o_orderkey % 6 IN (0, 3, 4))
   SELECT * FROM kept UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.item = n.item AND k.person = n.person)"""
)
def entity_links(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("person"))
    new = o.where("o_orderkey % 6 in (0, 3, 4)").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("person"))
    return records.upsert_links(old, new, ["item", "person"], old.where("item % 6 = 0"), "item")


@registered("SELECT s_nationkey AS id, s_name AS link FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def orphan_links(spark, sf_dir):
    links = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("link"))
    return records.orphans(links, table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id")), "id")


@registered(
    """WITH d AS (SELECT n_nationkey::BIGINT AS id, n_name AS normalized_name, n_name AS display_name FROM nation WHERE n_nationkey < 10), m AS (SELECT n_name AS k, n_name || ' (' || c_custkey || ')' AS display, c_custkey AS seq FROM customer JOIN nation ON c_nationkey = n_nationkey),
   f AS (SELECT k, arg_min(display, seq) AS display, min(seq) AS s FROM m WHERE k NOT IN (SELECT normalized_name FROM d) GROUP BY k) SELECT * FROM d UNION ALL SELECT 9 + row_number() OVER (ORDER BY s, k), k, display FROM f"""
)
def entity_dimension(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    d = n.where("n_nationkey < 10").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("normalized_name"), F.col("n_name").alias("display_name"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.select(F.col("n_name").alias("normalized_name"), F.concat("n_name", F.lit(" ("), F.col("c_custkey").cast("string"), F.lit(")")).alias("display_name"), F.col("c_custkey").alias("seq"))
    return records.first_forms(d, m)


_NAMES = [(1, "Dr. Mira Lund"), (2, "M. Lund"), (3, "Mira L."), (4, "mira lund"), (5, "Mira Tove Lund"), (6, "Prof. M. T. Lund"), (7, "B. Lund"), (8, "Bodil Lund"), (9, "M. L.")]


@registered("SELECT * FROM (VALUES (1, 2), (1, 3), (2, 4), (3, 4), (5, 6), (7, 8)) t(a_id, b_id)")
def person_review_pairs(spark, sf_dir):
    return matching.person_pairs(spark.createDataFrame(_NAMES, "id int, name string")).select("a_id", "b_id")


_PART_NAMES = """n AS (SELECT name, min(p_partkey) AS id FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 1) || ' ' || left(split_part(p_name, ' ', 2), 1) ELSE p_name END AS name FROM part) GROUP BY name),
   p AS (SELECT id, name, split_part(name, ' ', 1) AS a, split_part(name, ' ', 2) AS b FROM n)"""
_PART_PAIRS = "SELECT least(x.id, y.id) AS a_id, greatest(x.id, y.id) AS b_id FROM p x JOIN p y ON x.a = y.a AND length(x.b) = 1 AND length(y.b) > 1 AND left(y.b, 1) = x.b"


def _part_names(spark, sf_dir):
    """id and name: every name of a part, every fifth part with an initial for its second word; the least id of a name."""
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", first, F.substring(second, 1, 1))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("id"))


@registered(f"WITH {_PART_NAMES} {_PART_PAIRS}")
def part_review_pairs(spark, sf_dir):
    return matching.person_pairs(_part_names(spark, sf_dir), text.ascii_key).select("a_id", "b_id")


@registered("SELECT * FROM (VALUES (1, 2)) t(a_id, b_id)")
def organisation_review_pairs(spark, sf_dir):
    rows = [(1, "Center for Tidal Studies"), (2, "Centre for Tidal Studies (CTS)"), (3, "CTS"), (4, "Centre for tidal studies."), (5, "School of Tides")]
    return matching.organisation_pairs(spark.createDataFrame(rows, "id int, name string").where("id <> 4")).select("a_id", "b_id")


@registered("SELECT * FROM (VALUES ('Dr. M. Lund and Prof B. Holt', 0, 'Dr. M. Lund'), ('Dr. M. Lund and Prof B. Holt', 1, 'Prof B. Holt'), ('Dr. M. Lund, Centre for X and Y', 0, 'Dr. M. Lund, Centre for X and Y'), ('Dr. M. Lund, X; Prof. C', 0, 'Dr. M. Lund, X'), ('Dr. M. Lund, X; Prof. C', 1, 'Prof. C'), ('A & B', 0, 'A'), ('A & B', 1, 'B')) t(value, pos, one)")
def split_people(spark, sf_dir):
    rows = [(x,) for x in ("Dr. M. Lund and Prof B. Holt", "Dr. M. Lund, Centre for X and Y", "Dr. M. Lund, X; Prof. C", "A & B")]
    return spark.createDataFrame(rows, "value string").select("value", F.posexplode(text.people(F.col("value"))).alias("pos", "one"))


@registered("SELECT * FROM (VALUES ('Prof. Dr. Tomas Vik, Bergen (mail a@b.de)', 'Tomas Vik', 'Prof. Dr.', 'Bergen (mail )'), ('Katharine (Kat) Moor, Head', 'Katharine (Kat) Moor', NULL, 'Head'), ('Elin P. Strand FRS Harbour Professor', 'Elin P. Strand', NULL, 'FRS Harbour Professor'), ('M. Lund - NTX', 'M. Lund', NULL, 'NTX'), ('123', NULL, NULL, NULL), ('Shriver Rao', 'Shriver Rao', NULL, NULL)) t(one, name, honorific, affiliation)")
def parse_person(spark, sf_dir):
    rows = [(x,) for x in ("Prof. Dr. Tomas Vik, Bergen (mail a@b.de)", "Katharine (Kat) Moor, Head", "Elin P. Strand FRS Harbour Professor", "M. Lund - NTX", "123", "Shriver Rao")]
    df = spark.createDataFrame(rows, "one string").withColumn("p", text.person(F.col("one")))
    return df.select("one", "p.name", "p.honorific", "p.affiliation")


@registered("SELECT * FROM (VALUES ('Department of Ports and Harbours', 0, 'Department of Ports and Harbours', NULL, NULL, 'department'), ('Centre for Tidal Studies (CTS), Oslo and School of Law', 0, 'Centre for Tidal Studies', 'Oslo', 'CTS', 'centre'), ('Centre for Tidal Studies (CTS), Oslo and School of Law', 1, 'School of Law', NULL, NULL, 'school'), ('NTX', 0, 'NTX', NULL, NULL, NULL)) t(value, pos, name, parent, acronym, org_type)")
def parse_organisations(spark, sf_dir):
    rows = [(x,) for x in ("Department of Ports and Harbours", "Centre for Tidal Studies (CTS), Oslo and School of Law", "NTX")]
    o = spark.createDataFrame(rows, "value string").select("value", F.posexplode(text.organisations(F.col("value"))).alias("pos", "one")).withColumn("o", text.organisation(F.col("one")))
    return o.select("value", "pos", "o.name", "o.parent", "o.acronym", "o.org_type")


@registered("SELECT * FROM (VALUES ('person', 'u', 'mira lund', 'speaker', 'Speaker: Dr. Mira Lund, X'), ('person', 'u', 'c d', 'organizer', 'Organized by: Prof. C. D.'), ('organisation', 'u', 'centre for tidal studies', 'organizer', 'Organized by: Centre for Tidal Studies (CTS)'), ('organisation', 'v', 'cts', 'organizer', 'Organized by: CTS')) t(kind, item_url, normalized_name, role, source_text)")
def extracted_mentions(spark, sf_dir):
    page = "<div><p>Speaker: Dr. Mira Lund, X</p><p>About the Speaker: Dr. Q Q</p><ul><li>Speakers: Mira  Lund</ul><p>Organized by: Centre for Tidal Studies (CTS)</p><p>Organized by: CTS</p><p>Organized by: Prof. C. D.</p></div>"
    pages = spark.createDataFrame([("u", page), ("v", "<p>Organized by: CTS</p>")], "item_url string, html string")
    hits = matching.labelled(html.lines(pages), {"speaker": ["Speaker", "Speakers"], "organizer": ["Organized by"]})
    p, o = matching.mentions(hits)
    cols = ["item_url", "normalized_name", "role", "source_text"]
    return p.select(F.lit("person").alias("kind"), *cols).unionByName(o.select(F.lit("organisation").alias("kind"), *cols))


@registered("SELECT DISTINCT n_name AS name, trim(regexp_replace(replace(lower(n_name), '.', ' '), '\\s+', ' ', 'g')) AS key FROM nation")
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), text.name_key("n_name").alias("key")).distinct()


# -- times --------------------------------------------------------------------


@registered("SELECT * FROM (VALUES ('2024-03-05T10:00:00+05:30', '2024-03-05T04:30:00Z'), ('2024-03-05T10:00:00Z', '2024-03-05T10:00:00Z'), ('2024-03-05', NULL), ('2024-03-05 10:00', '2024-03-05T04:30:00Z'), ('Tue, 05 Mar 2024 10:00:00 GMT', '2024-03-05T10:00:00Z'), ('5 Mar 2024 10:00 -0100', '2024-03-05T11:00:00Z'), ('2024-02-30T10:00:00Z', NULL), ('soon', NULL), ('', NULL)) t(raw, utc)")
def time_stamps(spark, sf_dir):
    rows = [(x,) for x in ("2024-03-05T10:00:00+05:30", "2024-03-05T10:00:00Z", "2024-03-05", "2024-03-05 10:00", "Tue, 05 Mar 2024 10:00:00 GMT", "5 Mar 2024 10:00 -0100", "2024-02-30T10:00:00Z", "soon", "")]
    return spark.createDataFrame(rows, "raw string").select("raw", times.utc(F.col("raw"), "+05:30").alias("utc"))


@registered("SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def event_times(spark, sf_dir):
    local = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", times.utc(local, "+05:30").alias("utc"))


# -- runs ---------------------------------------------------------------------

_RUNS = """runs AS (SELECT event_type || '-' || strftime(ts, '%Y-%m-%d') AS run_id, event_type AS source_id, strftime(ts, '%Y-%m-%d') AS started_at, CASE WHEN sum(event_id) % 4 = 0 THEN 'failed' WHEN sum(event_id) % 4 = 1 THEN 'skipped' ELSE 'success' END AS status,
   count(*) AS items_discovered, count(DISTINCT user_id) AS items_parsed, round_even(100.0 * count(*) FILTER (user_id % 3 = 0) / count(*), 1) AS pct_with_date FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d'))"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("started_at", F.date_format("ts", "yyyy-MM-dd"))
    n = F.sum("event_id") % 4
    pct = runs.pct(F.count_if(F.col("user_id") % 3 == 0), F.count("*"))
    r = e.groupBy(F.col("event_type").alias("source_id"), "started_at").agg(F.when(n == 0, "failed").when(n == 1, "skipped").otherwise("success").alias("status"), F.count("*").alias("items_discovered"), F.countDistinct("user_id").alias("items_parsed"), pct.alias("pct_with_date"), pct.alias("pct_with_speaker"), F.lit(None).cast("double").alias("pct_with_org"))
    return r.withColumn("run_id", F.concat_ws("-", "source_id", "started_at"))


@registered(
    f"""WITH {_RUNS}, g AS (SELECT source_id, max(started_at) FILTER (status = 'success') AS good, max(started_at) FILTER (status <> 'skipped') AS last_started_at FROM runs GROUP BY source_id)
   SELECT g.source_id, last_started_at, (SELECT status FROM runs r WHERE r.source_id = g.source_id AND r.started_at = last_started_at) AS last_status, (SELECT count(*) FROM runs r WHERE r.source_id = g.source_id AND status <> 'skipped' AND (good IS NULL OR r.started_at > good)) AS consecutive_failures FROM g WHERE last_started_at IS NOT NULL"""
)
def run_history(spark, sf_dir):
    return runs.history(_runs(spark, sf_dir))


_WEAK = _RUNS + """, weak AS (SELECT run_id, source_id, started_at, status, items_parsed, CASE WHEN right(started_at, 2)::INT % 5 = 0 THEN items_discovered // 3 ELSE items_discovered END AS items_discovered,
   CASE WHEN right(started_at, 2)::INT % 5 = 0 THEN 10.0 ELSE 60.0 END AS pct_with_date FROM runs)"""


def _weak_runs(spark, sf_dir):
    weak = F.substring("started_at", -2, 2).cast("int") % 5 == 0
    pct = F.when(weak, 10.0).otherwise(60.0)
    return _runs(spark, sf_dir).withColumn("items_discovered", F.when(weak, F.expr("items_discovered div 3")).otherwise(F.col("items_discovered"))).withColumn("pct_with_date", pct).withColumn("pct_with_speaker", pct)


@registered(
    f"""WITH {_WEAK}, s AS (SELECT *, lag(pct_with_date) OVER w AS p, lag(items_parsed) OVER w AS pp FROM weak WHERE status = 'success' WINDOW w AS (PARTITION BY source_id ORDER BY started_at))
   SELECT run_id, source_id, m AS metric, p AS previous, pct_with_date AS now FROM s, (VALUES ('pct_with_date'), ('pct_with_speaker')) t(m) WHERE items_parsed > 0 AND pp > 0 AND p - pct_with_date >= 30"""
)
def coverage_drops(spark, sf_dir):
    return runs.coverage_drops(_weak_runs(spark, sf_dir))


@registered(f"WITH {_WEAK}, s AS (SELECT *, lag(items_discovered) OVER (PARTITION BY source_id ORDER BY started_at) AS p FROM weak WHERE status = 'success') SELECT run_id, source_id, p AS previous, items_discovered AS now FROM s WHERE p >= 10 AND items_discovered <= p * 0.5")
def discovery_drops(spark, sf_dir):
    return runs.discovery_drops(_weak_runs(spark, sf_dir))


@registered("SELECT * FROM (VALUES (0, 1440.0), (1, 60.0), (2, 120.0), (3, 240.0), (4, 480.0), (5, 960.0), (6, 1440.0), (7, 1440.0)) t(failures, wait)")
def retry_waits(spark, sf_dir):
    return spark.range(8).select(F.col("id").cast("int").alias("failures")).select("failures", runs.wait_minutes(F.lit(1440.0), F.lit(60.0), F.col("failures")).alias("wait"))


@registered("SELECT * FROM (VALUES ('a', true, 'never_run', NULL), ('b', false, 'interval_after_success', '2024-01-01T12:00:00Z'), ('c', true, 'retry_after_failure', '2024-01-01T10:00:00Z'), ('d', true, 'interval_after_success', '2024-01-01T11:01:00Z')) t(source_id, due, due_reason, next_due_at)")
def due_sources(spark, sf_dir):
    h = spark.createDataFrame([("a", None, None, 0), ("b", "2024-01-01T10:00:00Z", "success", 0), ("c", "2024-01-01T09:00:00Z", "failed", 1), ("d", "2024-01-01T09:01:00Z", "success", 0)], "source_id string, last_started_at string, last_status string, consecutive_failures int")
    return runs.due(h, "2024-01-01T11:00:00Z", 120.0).select("source_id", "due", "due_reason", "next_due_at")


@registered("SELECT lang, count(*) AS items_parsed, round_even(100.0 * count(*) FILTER (doc_id % 3 <> 0) / count(*), 1) AS pct_with_date, round_even(100.0 * count(*) FILTER (doc_id % 2 = 0) / count(*), 1) AS pct_with_speaker, 100.0::DOUBLE AS pct_with_org FROM documents GROUP BY lang")
def coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = d.select("lang", F.when(F.col("doc_id") % 3 != 0, "2024-01-01").otherwise("").alias("event_start"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("speakers"), F.array(F.lit("o")).alias("organizations"))
    return runs.coverage(p, "lang")


@registered("WITH d AS (SELECT DISTINCT o_orderpriority AS p, o_custkey % 50 AS c, CAST(o_orderdate AS DATE) AS d FROM orders), g AS (SELECT p || c AS k, date_diff('day', lag(d) OVER (PARTITION BY p, c ORDER BY d), d) AS gap FROM d) SELECT k, count(*) AS n, min(gap) AS least, median(gap) AS median, round(avg(gap), 6) AS mean, max(gap) AS greatest FROM g WHERE gap IS NOT NULL GROUP BY k")
def gap_stats(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("k"), "o_orderdate")
    return runs.gaps(o, "k", "o_orderdate")


@registered("WITH c AS (SELECT unnest(generate_series(date_trunc('month', (SELECT min(o_orderdate) FROM orders)), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH)) AS m) SELECT strftime(m, '%Y-%m') AS month, count(o_orderkey) AS n FROM c LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m")
def monthly_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    span = o.agg(F.min(F.trunc("o_orderdate", "month")).alias("a"), F.max(F.trunc("o_orderdate", "month")).alias("b"))
    months = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    n = o.groupBy(F.trunc("o_orderdate", "month").alias("k")).agg(F.count("*").alias("n"))
    return months.join(n, F.col("m") == F.col("k"), "left").select(F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


@registered("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'click' ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@registered("SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def current_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("event_seq"), F.col("event_type").alias("status"), "value")
    return runs.latest(e).withColumnRenamed("run_id", "user_id")


@registered("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@registered("SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL")
def union_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"))).groupBy("kind", "nation").agg(F.count("*").alias("n"))


@registered("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    """An extension: the batch form of the streaming window."""
    return windowed_counts(table(spark, sf_dir, "events"), "ts", "6 hours", "1 hour", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# -- landed responses, logs, written times ------------------------------------


@registered("SELECT * FROM (VALUES ('25th Sep 2025', '15:30 PM', '2025-09-25T10:00:00Z'), ('1st January 2025', '9:05 am', '2025-01-01T03:35:00Z'), ('3 Feb 2025', '12:10 AM', '2025-02-02T18:40:00Z'), ('soon', '9:00', NULL), ('3 Feb 2025', 'noon', NULL)) t(day, clock, utc)")
def written_times(spark, sf_dir):
    rows = [("25th Sep 2025", "15:30 PM"), ("1st January 2025", "9:05 am"), ("3 Feb 2025", "12:10 AM"), ("soon", "9:00"), ("3 Feb 2025", "noon")]
    return spark.createDataFrame(rows, "day string, clock string").select("*", times.written(F.col("day"), F.col("clock"), "+05:30").alias("utc"))


@registered("SELECT * FROM (VALUES ('28-09-26', 'Tea | 11.00 a.m to 12.45 p.m.', '2026-09-28T05:30:00Z'), ('28-09-26', '2.00 - 3.00 p.m.', '2026-09-28T08:30:00Z'), ('28-09-2026', NULL, '2026-09-28'), ('31-02-26', '2.00', NULL), ('x', '2.00', NULL)) t(header, schedule, start)")
def scheduled_times(spark, sf_dir):
    rows = [("28-09-26", "Tea | 11.00 a.m to 12.45 p.m."), ("28-09-26", "2.00 - 3.00 p.m."), ("28-09-2026", None), ("31-02-26", "2.00"), ("x", "2.00")]
    return spark.createDataFrame(rows, "header string, schedule string").select("*", times.scheduled(F.col("header"), F.col("schedule"), "+05:30").alias("start"))


@registered("SELECT * FROM (VALUES ('2025-03-04', '2025-03-04'), ('4 Mar 2025', '2025-03-04'), ('14 March 2025', '2025-03-14'), ('4/3/2025', '2025-03-04'), ('2025-13-01', NULL), ('', NULL)) t(raw, day)")
def first_dates(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ("2025-03-04", "4 Mar 2025", "14 March 2025", "4/3/2025", "2025-13-01", "")], "raw string").select("raw", times.first_date(F.col("raw")).alias("day"))


@registered("SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM events")
def relabelled_times(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", times.relabelled(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "+05:30").alias("utc"))


@registered("SELECT * FROM (VALUES (1, 'On a long title'), (2, 'Two lines'), (3, NULL)) t(id, title)")
def joined_titles(spark, sf_dir):
    return spark.createDataFrame([(1, ["On a long ti\\", "tle"]), (2, ["Two", "lines"]), (3, [])], "id int, lines array<string>").select("id", text.joined_lines(F.col("lines")).alias("title"))


@registered(
    f"""WITH {_CANON}, r AS (SELECT page_id, host, path, CASE WHEN host LIKE '%.net' THEN 404 WHEN host LIKE '%.org' THEN 503 ELSE 200 END AS s FROM canon)
   SELECT page_id, CASE WHEN s = 404 THEN true WHEN s = 503 THEN false ELSE NOT (path LIKE '/en/%' AND path NOT LIKE '/en/1%') END AS allowed FROM r"""
)
def robots_gate(spark, sf_dir):
    c = _canonical(spark, sf_dir).withColumn("u", F.col("canonical"))
    origin = F.regexp_extract("u", r"^([a-z]+://[^/]+)", 1)
    rules = c.select(origin.alias("origin")).distinct()
    status = F.when(F.col("origin").endswith(".net"), 404).when(F.col("origin").endswith(".org"), 503).otherwise(200)
    rules = rules.select("origin", status.alias("http_status"), F.array(F.lit("/en/")).alias("disallow"), F.array(F.lit("/en/1")).alias("allow"))
    return fetched.allowed(c.select("page_id", F.col("u").alias("url")), rules).select("page_id", "allowed")


@registered("WITH e AS (SELECT event_id, epoch(date_trunc('second', ts)) - epoch(date_trunc('second', lag(ts) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts), 'http://h' || user_id || '.org/' || event_id))) AS g FROM events) SELECT event_id, CAST(coalesce(g, -1) AS BIGINT) AS pause_s, coalesce(g < 3600, false) AS too_soon FROM e")
def request_pauses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.concat(F.lit("http://h"), F.col("user_id").cast("string"), F.lit(".org/"), F.col("event_id").cast("string"))
    p = fetched.pauses(e.select(u.alias("url"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("fetched_at")), 3600.0)
    return p.select(F.regexp_extract("url", r"/(\d+)$", 1).cast("long").alias("event_id"), F.coalesce("pause_s", F.lit(-1)).alias("pause_s"), "too_soon")


@registered("SELECT event_type AS run_id, count(*) AS events, count(*) FILTER (value < 10) AS failures, 0 AS ended FROM events GROUP BY event_type")
def run_log_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return runlog.stage_counts(e.select(F.col("event_type").alias("run_id"), F.when(F.col("value") < 10, "FETCH_ERROR").otherwise("FETCH").alias("stage")))


@registered("SELECT event_id, 'FETCH event=' || event_type || ' user=' || user_id AS line FROM events")
def run_log_lines(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", runlog.line(F.lit("FETCH"), F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("event"), F.col("event_type"))).alias("line"))


@registered("SELECT * FROM (VALUES ('a', 'unknown key: colour'), ('b', 'repeated id')) t(source_id, fault)")
def configuration_faults(spark, sf_dir):
    rows = [("a", {"delay": "1", "colour": "x"}), ("b", {"delay": "1"}), ("b", {})]
    return fetched.configurations(spark.createDataFrame(rows, "source_id string, settings map<string,string>"), ("delay", "timeout"))
