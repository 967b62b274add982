"""The queries over whole tables, on rows that the ones over id subsets leave out."""

from datetime import datetime

from siftloom.plans import catalog


def test_parts_above_400_meet(spark, tmp_path):
    """Every fifth part is written with an initial; names count once, by their least id."""
    rows = [(401, "cold widget"), (405, "cold wagon"), (403, "cold widget"), (410, "warm bolt"), (7, "hot wedge"), (900, "hot widget")]
    spark.createDataFrame(rows, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, catalog.queries()["part_review_pairs"](spark, str(tmp_path)).collect()))
    assert got == [(7, 900), (401, 405)]


def test_all_orders_count(spark, tmp_path):
    rows = [(i, datetime(2024, 1 + 2 * (i % 2), 5)) for i in range(2, 9)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(map(tuple, catalog.queries()["monthly_counts"](spark, str(tmp_path)).collect()))
    assert got == [("2024-01", 4), ("2024-02", 0), ("2024-03", 3)]


def test_all_events_are_relabelled(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 12)) for i in range(1, 5)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalog.queries()["relabelled_times"](spark, str(tmp_path)).collect()))
    assert got == [(i, "2024-01-01T06:30:00Z") for i in range(1, 5)]
