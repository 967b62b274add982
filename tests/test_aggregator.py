"""A small site, run several times: discovery, details, records, entities, review, runs."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from siftloom import schema
from siftloom.operators import aggregator, discovery, records, review, runs, scheduler, summary
from siftloom.sources import adapters, feeds, fetched
from siftloom.sources.snapshots import Store, broken, like, lookup, migrated, shifted

LANDED = "page_url string, final_url string, http_status int, content_type string, fetched_at string, body string"
T1, T2, T3 = "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z"


def card(n, title, day="2026-09-03"):
    return f"<div class='views-row'><div class='views-field-title'><a href='/event/{n}?utm_source=x'>{title}</a></div><div class='views-field-field-event-date'><time datetime='{day}T10:00:00Z'>d</time></div></div>"


def detail(title, speaker, body="", start="2026-09-03T17:15:00Z"):
    return f"<html><body><article class='node--type-event'><h1 class='field--name-title'>{title}</h1><div class='field--name-field-event-date'><time datetime='{start}'>x</time></div><div class='field--name-field-vanue'>Venue Hall 1</div><div class='field--name-body'><p>Speaker: {speaker}</p><p>Organized by: Centre for Tides (CT)</p><p>{body}</p></div></article></body></html>"


FEED = "<rss version='2.0'><channel><item><title>Tea &#38; talk</title><link>http://s.example/event/9</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item><item><title>again</title><link>http://s.example/event/1</link></item></channel></rss>"
INDEX = "<sitemapindex><sitemap><loc>http://s.example/a.xml</loc></sitemap><sitemap><loc>http://s.example/b.xml</loc></sitemap><sitemap><loc>http://s.example/c.xml</loc></sitemap></sitemapindex>"
URLS = "<urlset><url><loc>http://s.example/event/{}</loc><lastmod>2026-01-01</lastmod></url></urlset>"


def site(changed=False, without=()):
    rows = {
        "http://s.example/": "<div class='homepage-events'>" + card(1, "One") + ("" if changed else card(2, "Two")) + card(3, "Three, news") + (card(4, "Four") if changed else "") + "<div class='views-row'><div class='views-field-title'><a href='http://other.example/event/7'>Away</a></div></div></div>",
        "http://s.example/feed": FEED,
        "http://s.example/sitemap.xml": INDEX,
        "http://s.example/a.xml": URLS.format(21),
        "http://s.example/b.xml": URLS.format(22),
        "http://s.example/c.xml": URLS.format(23),
        "http://s.example/event/1": detail("One", "Dr. Mira Lund, Fjord University"),
        "http://s.example/event/2": detail("Two", "M. Lund"),
        "http://s.example/event/3": "<p>no article</p>",
        "http://s.example/event/4": detail("Four", "Olu Adeyemi; Dr. Mira Lund"),
        "http://s.example/event/9": detail("Tea", "Kim Ito", start="soon"),
    }
    if changed:
        rows["http://s.example/event/1"] = detail("One, moved", "Dr. Mira Lund, Fjord University")
    return [(u, u, 200, "text/html", T1, b) for u, b in rows.items() if u not in without]


def source(**more):
    return discovery.Source.of({"source_id": "s", "listing_url": "http://s.example/", "adapter": "events", "institution": "S", "routes": {"patterns": {"event": ["/event/"]}}, **more})


ALL = {"methods": ["sitemap", "html", "rss"], "urls": {"rss": ["http://s.example/feed"], "sitemap": ["http://s.example/sitemap.xml"]}}


def test_discovery_reads_all_methods(spark):
    f = discovery.discover(spark.createDataFrame(site(), LANDED), source(**ALL), T1)
    got = {r.url: r for r in f.candidates.collect()}
    assert set(got) == {f"http://s.example/event/{n}" for n in (1, 2, 3, 9, 21, 22)} | {"http://other.example/event/7"}
    assert got["http://s.example/event/1"].methods == ["html", "rss"] and got["http://s.example/event/1"].title == "One"
    assert got["http://s.example/event/9"].title == "Tea & talk" and not got["http://other.example/event/7"].in_scope
    assert [r.url for r in sorted(got.values(), key=lambda r: r.seq)][:3] == [f"http://s.example/event/{n}" for n in (1, 2, 3)]
    assert got["http://s.example/event/1"].found_on == ["http://s.example/", "http://s.example/feed"]
    stats = discovery.counters(f)
    assert stats["pages_fetched"] == 5 and discovery.checked(f, source(**ALL)) == 7 and stats["raw_count"] == 8 and stats["http_status"] == 200
    assert [r.page_url for r in discovery.empty_pages(f.pages).collect()] == ["http://s.example/sitemap.xml"]


def test_caps_and_order(spark):
    s = source(scope={"hosts": ["s.example"], "most_items": 2})
    got = {r.url[-1]: r for r in discovery.discover(spark.createDataFrame(site(), LANDED), s, T1).candidates.collect()}
    assert [got[k].in_scope for k in "123"] == [True, True, False] and got["3"].reason.startswith("over max_discovered_items")
    none = source(scope={"hosts": ["s.example"], "most_items": 0})
    assert not any(r.in_scope for r in discovery.discover(spark.createDataFrame(site(), LANDED), none, T1).candidates.collect())


def test_guards(spark):
    failing = [(u, u, 500, None, T1, None) for u in ("http://s.example/",)]
    with pytest.raises(discovery.DiscoveryError):
        discovery.checked(discovery.discover(spark.createDataFrame(failing, LANDED), source(), T1), source())
    blank = spark.createDataFrame([("http://s.example/", None, 200, "text/html", T1, "<p>new design</p>")], LANDED)
    with pytest.raises(discovery.EmptyListingError):
        discovery.checked(discovery.discover(blank, source(), T1), source())
    assert discovery.checked(discovery.discover(blank, source(allow_empty_listing=True), T1), source(allow_empty_listing=True)) == 0
    with pytest.raises(ValueError):
        source(colour="red")
    with pytest.raises(ValueError):
        discovery.method_urls(source(methods=["rss"]))
    with pytest.raises(ValueError):
        source(methods=["telnet"])
    with pytest.raises(ValueError):
        source(scope={"hosts": ["a"], "depth": 3})


def test_runs_of_a_site(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    log = runs.RunLog(spark, f"file://{tmp_path}/runs")
    s = source(methods=["html", "rss"], urls={"rss": ["http://s.example/feed"]}, interval_minutes=60)
    now = {"site": site()}

    def pipeline(src, run_id, started, cutoff, previous):
        return aggregator.run(spark.createDataFrame(now["site"], LANDED), src, store, run_id, started, cutoff, previous)

    cycle = lambda: scheduler.run_once(lambda: [s], log, str(tmp_path / "locks"), force=True, pipelines={"aggregator": pipeline})[0]
    first = cycle()
    assert first["status"] == "success", first
    assert {k: first["counts"][k] for k in ("new", "changed", "unchanged", "not_seen")} == {"new": 4, "changed": 0, "unchanged": 0, "not_seen": 0}
    rows = {r.item_url[-1]: r for r in store.read("records").collect()}
    one = rows["1"]
    assert one.title == "One" and one.event_start == "2026-09-03T11:45:00Z" and one.location == "Hall 1" and one.institution == "S"
    assert [x.name for x in one.speakers] == ["Mira Lund"] and one.organizations == ["Centre for Tides"] and one.extras["discovery_methods"] == "html,rss"
    assert rows["3"].detail_fetch_status == "failed" and rows["3"].title == "Three, news" and rows["3"].event_start == "2026-09-03T10:00:00Z"
    assert rows["9"].event_start == "2024-03-05T10:00:00Z"  # the page's own was unreadable, the feed's counts
    assert {r.discovered_url: r.in_scope for r in store.read("discovered_items").collect()}["http://other.example/event/7"] is False
    people = {r.display_name: r.id for r in store.read("people").collect()}
    assert set(people) == {"Mira Lund", "M. Lund", "Kim Ito"} and sorted(people.values()) == [1, 2, 3]
    queue = store.read("entity_alias_candidates")
    assert [(r.kind, r.status) for r in queue.collect()] == [("person", "open")]
    named = review.named(queue, store.read("people"), store.read("organizations")).collect()
    assert {named[0].a_name, named[0].b_name} == {"Mira Lund", "M. Lund"} and named[0].reason

    now["site"] = site(changed=True)
    second = cycle()
    assert {k: second["counts"][k] for k in ("new", "changed", "unchanged", "not_seen")} == {"new": 1, "changed": 1, "unchanged": 2, "not_seen": 1}
    assert sorted(r.id for r in store.read("people").collect()) == [1, 2, 3, 4]

    now["site"] = [(u, u, 503, None, T3, None) for u in ("http://s.example/", "http://s.example/feed")]
    before = store.current()
    failed = cycle()
    assert failed["status"] == "failed" and store.current() == before
    table = {r.run_id: r for r in log.runs().collect()}
    assert [table[x["run_id"]].status for x in (first, second, failed)] == ["success"] * 2 + ["failed"]
    assert table[first["run_id"]].items_discovered == 5 and table[failed["run_id"]].http_status == 503 and table[first["run_id"]].people_extracted == 3
    h = log.history("s")
    assert h["last_status"] == "failed" and h["consecutive_failures"] == 1
    assert scheduler.run_once(lambda: [s], log, str(tmp_path / "locks"), pipelines={"aggregator": pipeline}) == []  # not due yet
    assert [r.status for r in runs.list_runs(log.runs(), "s").collect()].count("success") == 2
    assert runs.last_runs(log.runs(), 1, "s", "success").first().run_id == second["run_id"]


def test_a_locked_source_is_skipped_and_a_dead_one_taken_over(spark, tmp_path):
    log = runs.RunLog(spark, f"file://{tmp_path}/runs")
    s = source(interval_minutes=60)
    lock = scheduler.Lock(str(tmp_path / "s.lock"))
    assert lock.acquire() and not scheduler.Lock(str(tmp_path / "s.lock")).acquire()
    assert scheduler.run_scheduled(s, log, str(tmp_path))["status"] == "skipped"
    lock.release()
    assert not os.path.exists(tmp_path / "s.lock")
    log.add(runs.started("left", "s", T1))
    (tmp_path / "s.lock").write_text(json.dumps({"pid": 2**22 + 5, "host": __import__("socket").gethostname(), "started_at": scheduler.now()}))

    def broken_pipeline(*a):
        raise RuntimeError("no pages")

    got = scheduler.run_scheduled(s, log, str(tmp_path), {"aggregator": broken_pipeline})
    assert got["status"] == "failed" and "no pages" in got["error"]
    status = {r.run_id: (r.status, r.error) for r in log.runs().collect()}
    assert status["left"][0] == "failed" and "is gone" in status["left"][1] and status[got["run_id"]] == ("failed", "RuntimeError: no pages")
    old = scheduler.Lock(str(tmp_path / "t.lock"), stale_s=5)
    (tmp_path / "t.lock").write_text("{half")
    os.utime(tmp_path / "t.lock", (time.time() - 60, time.time() - 60))
    assert old.acquire() and "old" in old.taken_over
    (tmp_path / "t.lock").write_text(json.dumps({"pid": 1, "host": "elsewhere"}))
    old.release()
    assert (tmp_path / "t.lock").exists()  # not its own
    assert scheduler.alive(os.getpid()) and not scheduler.alive(2**22 + 5)
    ticks = []
    assert scheduler.run_loop(lambda: ticks.append(1), 5.0, 3, lambda s: ticks.append(s)) == 3 and ticks == [1, 5.0, 1, 5.0, 1]


def test_publication_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    df = lambda n: spark.createDataFrame([(n,)], "x int")
    store.publish("a", {"t": df(1), "u": df(10)})
    with monkeypatch.context() as m:
        m.setattr(Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            store.publish("b", {"t": df(2)})
    assert store.current() == "a" and store.read("t").first().x == 1
    # two at once: the later one fails, the earlier one's state stays
    numbers = store._pointers()
    store.publish("c", {"t": df(3)})
    with monkeypatch.context() as m:
        m.setattr(Store, "_pointers", lambda self: numbers)
        with pytest.raises(OSError):
            store.publish("d", {"t": df(4)})
    assert store.current() == "c" and store.read("t").first().x == 3 and store.read("u").first().x == 10
    store.publish("c", {"t": df(5)})  # the same run again: a reader's files stay
    assert store.read("t").first().x == 5
    store.clean(1)
    assert store.read("t").first().x == 5 and store.read("u").first().x == 10 and len(store._pointers()) == 1


def test_review_queue_keeps_what_a_reviewer_said(spark):
    q = spark.createDataFrame([("person", 1, 2, "old", "rejected")], schema.REVIEW)
    got = review.queued(q, "person", spark.createDataFrame([(2, 1, "x"), (4, 3, "y"), (4, 3, "y")], "a_id int, b_id int, reason string"))
    assert sorted(map(tuple, got.collect())) == [("person", 1, 2, "old", "rejected"), ("person", 3, 4, "y", "open")]
    said = review.decided(got, spark.createDataFrame([("person", 3, 4, "merged")], "kind string, a_id long, b_id long, status string"))
    assert {(r.a_id, r.status) for r in said.collect()} == {(1, "rejected"), (3, "merged")}


def test_refused_documents_are_rows(spark):
    docs = [("ok", FEED), ("bomb", '<!DOCTYPE lolz [<!ENTITY lol "lol">]><rss>&lol;</rss>'), ("torn", "<rss><channel><item></channel></rss>"), ("page", "<html><body/></html>"), ("path", "/etc/passwd"), ("none", None)]
    df = spark.createDataFrame([("s", u, x, T1) for u, x in docs], "source_name string, page_url string, xml string, fetched_at string")
    got = {r.page_url: r.parse_error for r in feeds.rejects(df).collect()}
    assert set(got) == {"bomb", "torn", "page", "path", "none"} and got["torn"] == "not well-formed" and "entities" in got["bomb"] and got["page"] == "its root is html"
    assert {r.page_url for r in feeds.feed(df).collect()} == {"ok"}
    text = spark.createDataFrame([("a &#233;&#x1F600;&amp;#65; &lt;b&gt;",)], "t string").select(feeds.unescape(F.col("t"))).first()[0]
    assert text == "a é😀&#65; <b>"


def test_charsets_and_headers(spark):
    rows = [("1", "é".encode("latin-1"), "text/html"), ("2", "é".encode(), None), ("3", "<meta charset='iso-8859-1'>é".encode("latin-1"), "text/html"), ("4", "é".encode("utf-16"), ""), ("5", "é".encode("latin-1"), "text/html; charset=ISO-8859-1")]
    df = spark.createDataFrame([(u, bytearray(b), c) for u, b, c in rows], "url string, body binary, content_type string")
    got = {r.url: r.t for r in df.select("url", fetched.body_text(F.col("body"), F.col("content_type")).alias("t")).collect()}
    assert all(t.endswith("é") for t in got.values()), got
    h = fetched.headers(df.withColumn("final_url", F.concat(F.lit("http://x.example/"), "url")).withColumn("http_status", F.lit(200))).collect()
    assert {r.url: r.charset for r in h}["3"] == "ISO-8859-1" and all(r.redirected for r in h)
    u = fetched.unpacked(spark.createDataFrame([("u", "b")], "url string, body string"), T1).first()
    assert (u.final_url, u.http_status, u.fetched_at) == ("u", None, T1)


def test_carry_forward(spark):
    fields = "item_url string, detail_fetch_status string, title string, description string, extras map<string,string>, parse_warnings map<string,string>"
    old = spark.createDataFrame([(u, "ok", "t", "d", {"a": "1", "b": "2"}, "h", T1, T1) for u in ("failed", "unread", "gone")], "item_url string, detail_fetch_status string, title string, description string, extras map<string,string>, content_hash string, first_seen_at string, last_seen_at string")
    new = spark.createDataFrame([("failed", "failed", "new", None, {"b": "3"}, {}), ("unread", "ok", None, None, {"b": "3"}, {"title": "raw"}), ("gone", "ok", None, None, {}, {})], fields)
    m = records.merge(old, new, "item_url", ["title", "description"], T2, lambda df: records.legacy_hash(F.col("title"), F.col("description")), records.carry_rule(), None, "parse_warnings", "extras")
    got = {r.item_url: r for r in m.collect()}
    assert "parse_warnings" not in m.columns
    assert (got["failed"].title, got["failed"].description, got["failed"].extras) == ("new", "d", {"a": "1", "b": "3"})
    assert (got["unread"].title, got["unread"].description, got["unread"].extras) == ("t", None, {"b": "3"})
    assert (got["gone"].title, got["gone"].description) == (None, None)


def test_errors_name_the_place(spark):
    row = {f: None for f in schema.RECORD.names} | {"item_url": "http://a.b/x", "source_name": "s", "institution": "i", "item_type": "event", "title": "t", "source_url": "http://a.b/", "fetched_at": T1, "http_status": 200, "detail_fetch_status": "lost", "speakers": [("x", "A"), (None, "")], "organizations": ["o", ""], "extras": {}}
    df = spark.createDataFrame([tuple(row[f] for f in schema.RECORD.names)], schema.RECORD)
    assert df.select(records.errors(df).alias("e")).first().e == ["speakers[1].name: required str", "organizations[1]: expected non-empty str", "detail_fetch_status: expected one of ok, failed, not_attempted"]


def test_adapters(spark):
    with pytest.raises(ValueError):
        adapters.register("half", object())
    with pytest.raises(ValueError):
        adapters.load("nowhere")
    talks = adapters.load("talks")
    assert isinstance(talks, adapters.Adapter)
    page = "<html><head><title>On tides | Humanities and Social Sciences</title><link rel=canonical href='http://s.example/e/1'></head><article class='node--type-events' data-history-node-id='77'><div class='field--name-field-event-speaker'><div class='field__item'>Prof Mira Lund, Fjord University</div></div><div class='field--name-field-event-date'><div class='field__item'><time datetime='2025-09-25T10:00:00Z'>x</time></div></div><div class='field--name-field-event-location'><div class='field__item'>Online, room 3</div></div><div class='field--name-body'>Abstract: About tides.</div></article></html>"
    pages = spark.createDataFrame([("u1", page), ("u2", "<p>nothing</p>")], "item_url string, html string")
    d = talks.detail(pages)
    got = {r.item_url: r for r in d.collect()}
    assert got["u1"].parse_error is None and got["u1"].node_id == "77" and "layout" in got["u2"].parse_error
    n = talks.normalize(d.where("item_url = 'u1'").withColumn("start_date", F.lit("25th Sep 2025")).withColumn("start_time", F.lit("15:30 PM"))).first()
    assert (n.title, n.event_start, n.is_online, n.description, n.parse_warnings) == ("On tides", "2025-09-25T10:00:00Z", True, "About tides.", {})
    assert [(s.name, s.affiliation) for s in n.speakers] == [("Mira Lund", "Fjord University")] and n.extras["node_id"] == "77"
    listed = spark.createDataFrame([("u", None, "25th Sep 2025", "15:30 PM", "t"), ("v", "whenever", "soon", None, "t")], "item_url string, event_start string, start_date string, start_time string, title string")
    got = {r.item_url: r for r in talks.normalize(listed).collect()}
    assert got["u"].event_start == "2025-09-25T10:00:00Z" and got["v"].event_start is None and got["v"].parse_warnings == {"event_start": "whenever"}
    lost = adapters.load("dated-cards").lost(spark.createDataFrame([("p", "<p>x</p>"), ("q", "<div class='view-events-listing'><div class='view-content'></div></div>")], "page_url string, html string"))
    assert [r.page_url for r in lost.collect()] == ["p"]


def test_list_pages_and_news_and_hooks(spark):
    lines = ["28-09-26", "Colloquium", "Speaker: Mira Lund", "Time:", "11.00 a.m to 12.45 p.m.", "Venue: Hall 1", "On long ti\\", "des", "Mira Lund", "Fjord University."]
    b = spark.createDataFrame([("http://s.example/list", 0, lines, "Mira Lund", "2026", "12")], "page_url string, seq int, lines array<string>, speaker string, year string, ref string")
    r = adapters.listing_rows(b)
    row = r.first()
    assert (row.title, row.schedule, row.location, row.affiliation, row.category) == ("On long tides", "11.00 a.m to 12.45 p.m.", "Hall 1", "Fjord University", "Colloquium")
    assert row.item_url.startswith("http://s.example/list#/item/")
    n = adapters.load("seminar-list").normalize(r).first()
    assert n.event_start == "2026-09-28T05:30:00Z" and n.extras["schedule"] and n.speakers[0].affiliation == "Fjord University"
    items = spark.createDataFrame([("  A  b ", " /n/1?utm_source=k#top", "3 Feb 2026", "../i.png", None, " t ")], "title string, item_url string, date_raw string, image_url string, image_alt string, raw_text string")
    got = adapters.news(items, "http://s.example/news/list").first()
    assert (got.title, got.item_url, got.published_at, got.image_url, got.raw_text) == ("A b", "http://s.example/n/1?utm_source=k#top", "2026-02-03", "http://s.example/i.png", "t")
    old = spark.createDataFrame([("k", "h")], "item_url string, content_hash string")
    states = records.stored(old, spark.createDataFrame([("k", "x"), (None, "x"), ("n", "y")], "item_url string, title string"), "item_url", ["title"], T1)
    assert sorted(r.state for r in states.collect()) == ["new", "skipped", "updated"]

    class Hooked(adapters.Spec):
        pass

    hook = lambda pages, options: pages.select("source_name", "page_url", "fetched_at", F.lit(0).alias("seq"), F.lit(options["href"]).alias("href"), F.lit(" T ").alias("title"), F.lit("2026-01-01 10:00").alias("timestamp_raw"))
    a = Hooked(cards=adapters.NEWS_CARDS.cards, hooks={"calendar": hook})
    pages = spark.createDataFrame([("s", "http://s.example/", "<p/>", T1)], "source_name string, page_url string, html string, fetched_at string")
    got = adapters.from_hook(pages, a, {"hook": "calendar", "href": "/e/1", "utc_offset": "+05:30"}).first()
    assert (got.url, got.title, got.source_timestamp, got.method) == ("http://s.example/e/1", "T", "2026-01-01T04:30:00Z", "html")
    with pytest.raises(ValueError):
        adapters.from_hook(pages, a, {"hook": "other"})


def test_summaries():
    said = summary.build("s", "success", "r", {"items_discovered": 4, "detail_failures": 1, "invalid": 2, "pages_fetched": 3}, {"new": 1}, {"pct_with_date": 10.0})
    assert said["failed"] == 3 and "NEW: 1" in summary.block(said) and summary.line(said).startswith("RUN_SUMMARY run_id=r source=s status=success")
    said["items_parsed"] = 5
    before = {"items_discovered": 20, "items_parsed": 5, "pct_with_date": 90.0}
    assert len(summary.warnings(said, before)) == 2 and summary.warnings(said, None) == []
    assert summary.runs_row(said)["not_seen_count"] is None and summary.runs_row(said)["new_count"] == 1


def test_small_helpers(spark):
    t = spark.createDataFrame([("http://a/x_y", T1), ("http://a/xzy", T1)], "url string, at string")
    assert like(t, "url", "x_y").count() == 1 and lookup(t, "url", "http://a/xzy").count() == 1
    assert t.select(shifted(F.col("at"), "-1 hour")).first()[0] == "2025-12-31T23:00:00Z"
    m = migrated(spark.createDataFrame([("r", 3)], "run_id string, existing_count long"), schema.RUNS, {"existing_count": "unchanged_count"})
    assert m.columns == schema.RUNS.names and m.first().unchanged_count == 3
    bad = broken({"p": spark.createDataFrame([(1,), (1,), (None,)], "id int"), "l": spark.createDataFrame([(1,), (7,)], "pid int")}, {"p": ("id",)}, (("l", "pid", "p", "id"),))
    assert {(r.table, r.rule, r.n) for r in bad.collect()} == {("p", "id: null", 1), ("p", "id: repeated", 1), ("l", "pid: not in p", 1)}
    n = records.numbered(spark.range(100).selectExpr("id * 7 % 100 AS v"), "v", first=5)
    assert sorted((r.v, r.id) for r in n.collect()) == [(i, i + 5) for i in range(100)]
    months = runs.months(spark.createDataFrame([("2025-01-05",), ("2025-03-01",), ("2025-03-02",)], "d string"), "d")
    assert [tuple(r) for r in months.orderBy("month").collect()] == [("2025-01", 1), ("2025-02", 0), ("2025-03", 2)]
