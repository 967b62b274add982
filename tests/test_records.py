import pytest
from pyspark.sql import functions as F

from siftloom import schema
from siftloom.operators import records
from siftloom.sources.snapshots import Store, query
from siftloom.streaming import upserts

CONTENT = ["title", "description"]
ROW = "item_url string, title string, description string, detail_fetch_status string"


def digest(df):
    return records.legacy_hash(*(F.col(c) for c in CONTENT))


def run(old, new, now, cutoff=None):
    return records.merge(old, new, "item_url", CONTENT, now, digest, records.carry_rule(), cutoff)


def stored(df):
    return df.drop("state", "rediscovered")


def test_runs_over_a_changing_site(spark):
    first = spark.createDataFrame([(f"u{i}", f"t{i}", f"d{i}", "ok") for i in range(22)], ROW)
    none = spark.createDataFrame([], ROW + ", content_hash string, first_seen_at string, last_seen_at string")
    one = run(none, first, "2024-01-01T00:00:00Z")
    assert records.counts(one).first().asDict() == {"new": 22, "changed": 0, "unchanged": 0, "not_seen": 0, "rediscovered": 0}
    two = run(stored(one), first, "2024-01-02T00:00:00Z")
    assert records.counts(two).first().asDict() == {"new": 0, "changed": 0, "unchanged": 22, "not_seen": 0, "rediscovered": 0}
    rows = [(f"u{i}", f"t{i}" + "!" * (i < 2), None if i == 5 else f"d{i}", "failed" if i == 5 else "ok") for i in range(20)] + [("new", "n", "n", "ok")]
    three = run(stored(two), spark.createDataFrame(rows, ROW), "2024-01-03T00:00:00Z")
    assert records.counts(three).first().asDict() == {"new": 1, "changed": 2, "unchanged": 18, "not_seen": 2, "rediscovered": 0}
    kept = three.where("item_url = 'u5'").first()
    assert kept.description == "d5" and kept.state == "unchanged" and kept.first_seen_at == "2024-01-01T00:00:00Z"
    assert three.where("item_url = 'u21'").first().last_seen_at == "2024-01-02T00:00:00Z"
    back = run(stored(three), first, "2024-01-04T00:00:00Z", "2024-01-03T00:00:00Z")
    assert records.counts(back).first().rediscovered == 2


def test_hash_ignores_the_order_of_lists_and_provenance(spark):
    def one(speakers, orgs, at):
        return (("u", "t", speakers, orgs, True, at),)

    s = "item_url string, title string, speakers array<struct<affiliation:string,name:string>>, organizations array<string>, is_online boolean, fetched_at string"
    a = spark.createDataFrame(one([(None, "B"), ("x", "A")], ["q", "p"], "1"), s)
    b = spark.createDataFrame(one([("x", "A"), (None, "B")], ["p", "q"], "2"), s)
    c = spark.createDataFrame(one([("x", "A"), ("y", "B")], ["p", "q"], "2"), s)
    h = [df.select(records.content_hash(df).alias("h")).first().h for df in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_publication_is_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None and store.read("records", schema.STORED).count() == 0
    links = spark.createDataFrame([("u", "p")], "item_url string, person string")
    good, bad = spark.createDataFrame([("u",)], "item_url string"), spark.createDataFrame([("v",)], "item_url string")
    store.publish("r1", {"records": good, "links": links}, [lambda: records.orphans(links, good)])
    with pytest.raises(ValueError):
        store.publish("r2", {"records": bad, "links": links}, [lambda: records.orphans(links, bad)])
    assert store.current() == "r1" and store.read("records").collect() == good.collect()
    assert query(spark, {"r": store.read("records")}, "SELECT count(*) AS n FROM r WHERE item_url = :u", u="u").first().n == 1


def test_stream_of_batches_is_merged_once(spark, tmp_path):
    for i, rows in enumerate([[(1, "u1", "a"), (2, "u2", "b"), (3, "u1", "c")], [(4, "u2", "b"), (5, "u3", "d")]]):
        spark.createDataFrame(rows, "seq long, item_url string, title string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        store = Store(spark, f"file://{tmp_path}/store")
        stream = spark.readStream.schema("seq long, item_url string, title string").parquet(f"{tmp_path}/in")
        empty = "seq long, item_url string, title string, content_hash string, first_seen_at string, last_seen_at string"
        for _ in range(2):
            upserts.merge_batches(stream, store, "records", "item_url", ["title"], "seq", lambda n: f"2024-01-0{n + 1}T00:00:00Z", f"{tmp_path}/ck", spark.createDataFrame([], empty).schema).awaitTermination(120)
    got = {r.item_url: (r.title, r.first_seen_at, r.last_seen_at) for r in store.read("records").collect()}
    assert got == {"u1": ("c", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z"), "u2": ("b", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"), "u3": ("d", "2024-01-02T00:00:00Z", "2024-01-02T00:00:00Z")}


def test_windows_of_a_stream_close(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:10:00", "a") for h in (1, 1, 2, 5)]
    spark.createDataFrame(rows, "ts string, kind string").write.parquet(f"{tmp_path}/ev")
    s = spark.readStream.schema("ts string, kind string").parquet(f"{tmp_path}/ev")
    out = upserts.windowed_counts(s, "ts", "1 hour", "1 hour", "kind")
    q = out.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(str(r.window_start), r.n) for r in spark.table("closed").collect()} == {("2024-01-01 01:00:00", 2), ("2024-01-01 02:00:00", 1)}
