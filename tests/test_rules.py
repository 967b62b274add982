import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from siftloom.functions import urls
from siftloom.operators import decisions, runs
from siftloom.sources import html

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_scope(spark):
    s = decisions.Scope(hosts=("H.org",), domains=(".sub.org",), prefixes=("events",), excluded=("/events/search/",), query_keys=("Q",))
    cases = {"https://h.org/events/1": True, "https://h.org/events": False, "https://h.org/events/search": False, "https://h.org/events/search-tips": True, "https://h.org/events/1?q=x": False, "https://a.sub.org/events/2": True, "https://notsub.org/events/2": False, "ftp://h.org/events/1": False, "https://h.org/events/x.pdf": True, "": False}
    got = {r.u: (r.d.in_scope, r.d.reason) for r in spark.createDataFrame([(u,) for u in cases], "u string").select("u", decisions.scope(F.col("u"), s).alias("d")).collect()}
    assert {u: ok for u, (ok, _) in got.items()} == cases and "PDF" in got["https://h.org/events/x.pdf"][1]
    with pytest.raises(ValueError):
        decisions.Scope()


def test_external_needs_no_prefix_but_heeds_exclusions(spark):
    s = decisions.Scope(external=True, hosts=("h.org",), prefixes=("/e/",), excluded=("/x/",))
    got = [r.ok for r in spark.createDataFrame([("https://o.org/any",), ("https://o.org/x/1",), ("https://h.org/any",)], "u string").select(decisions.scope(F.col("u"), s)["in_scope"].alias("ok")).collect()]
    assert got == [True, False, False]


def test_routes_check_their_labels():
    with pytest.raises(ValueError):
        decisions.Routes(patterns={"news": ["/n/"]})


def test_drops_need_enough_to_compare(spark):
    rows = [("s", "1", "success", 20, 5, 80.0), ("s", "2", "success", 10, 5, 50.0), ("s", "3", "failed", 0, 0, None), ("s", "4", "success", 6, 5, 20.1), ("t", "1", "success", 9, 1, 90.0), ("t", "2", "success", 1, 0, 10.0)]
    df = spark.createDataFrame([(f"{a}{b}", a, b, c, d, e, f) for a, b, c, d, e, f in rows], "run_id string, source_id string, started_at string, status string, items_discovered long, items_parsed long, pct_with_date double")
    df = df.withColumn("pct_with_speaker", F.lit(None).cast("double")).withColumn("pct_with_org", F.lit(None).cast("double"))
    assert [(r.run_id, r.metric) for r in runs.coverage_drops(df).collect()] == [("s2", "pct_with_date")]
    assert [r.run_id for r in runs.discovery_drops(df).collect()] == ["s2"]


def test_percentages_round_half_to_even(spark):
    got = spark.createDataFrame([(1, 16), (1, 32), (0, 0), (1, 3)], "a int, b int").select(runs.pct(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [6.2, 3.1, None, 33.3]


def test_cards():
    page = "<div class='row item'><h3><a href='/a?x=1'>One <b>two</b></a></h3><time datetime='2024-01-01T00:00:00Z'>1 Jan</time><span class=cat> News </span></div><div class='row'><a href='/no'>no</a></div><div class='item'><p>no link</p></div>"
    got = html.cards(page, html.Cards(item="div.item", link="h3 a[href]", date="time", category=".cat"))
    assert got == [{"href": "/a?x=1", "title": "One two", "date_raw": "2024-01-01T00:00:00Z", "category": "News"}]
    assert html.block_lines("<div><p>a<br>b</p><ul><li>c<li>d <i>e</i></ul></div>") == ["a\nb", "c", "d e"]


def test_next_page(spark):
    pages = spark.createDataFrame([("http://h/l", "<a rel='nofollow next' href='?page=1'>n</a>"), ("http://h/m", "<a rel=next href='#'>n</a>")], "page_url string, html string")
    assert {r.page_url: r.next_url for r in html.next_page(pages, "a[rel~=next]").collect()} == {"http://h/l": "http://h/l?page=1", "http://h/m": None}


def test_urls_keep_what_names_an_item(spark):
    cases = [("HTTP://H.ORG:80/A//b/?b=2&a=1&b=1&a=&utm_x=1#!/k", "http://h.org/A//b/?a=1&a=&b=2&b=1#!/k"), ("https://h.org:8443/?q=a+b%20c~*", "https://h.org:8443/?q=a+b+c~%2A"), ("https://h.org:99999/", ""), ("tel:1", ""), (None, "")]
    got = spark.createDataFrame([(a,) for a, _ in cases], "h string").select(urls.canonical(F.col("h")).alias("u")).collect()
    assert [r.u for r in got] == [b for _, b in cases]


def test_entry_module_works_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "siftloom"):
        subprocess.run(["cp", "-r", f"{REPO}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/siftloom/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [x for x in q if x.startswith('op') and x[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_lock_is_held_once_and_taken_over_when_stale(tmp_path):
    from siftloom.operators import runlog

    path = str(tmp_path / "lock")
    with runlog.lock(path):
        with pytest.raises(FileExistsError):
            with runlog.lock(path):
                pass
    assert not os.path.exists(path)
    open(path, "w").close()
    os.utime(path, (1, 1))
    with runlog.lock(path):
        assert os.path.exists(path)


def test_responses_and_bodies(spark):
    from siftloom.sources import fetched

    r = spark.createDataFrame([("a", 200), ("b", 404), ("c", None)], "url string, http_status int")
    good, bad = fetched.usable(r)
    assert [x.url for x in good.collect()] == ["a"] and {(x.url, x.error_type) for x in bad.collect()} == {("b", "http_error"), ("c", "no_response")}
    b = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=iso-8859-1"), (bytearray("é".encode()), "text/html"), (bytearray(b"x"), None)], "body binary, content_type string")
    assert [x.t for x in b.select(fetched.body_text(F.col("body"), F.coalesce("content_type", F.lit(""))).alias("t")).collect()] == ["é", "é", "x"]


def test_json_items(spark, tmp_path):
    from siftloom.sources import fetched

    (tmp_path / "items.json").write_text('[{"title": "A", "item_url": "/a"}, {"title": "B", "item_url": null}]')
    assert [tuple(r) for r in fetched.json_items(spark, f"file://{tmp_path}/items.json", "title string, item_url string").collect()] == [("A", "/a"), ("B", None)]
