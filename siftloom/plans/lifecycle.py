"""Queries over states that live on from run to run: discovered items, the review queue, runs and their events, constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, discovery, matching, records, review, runs, summary
from ..sources import snapshots
from ..functions import text
from .catalog import _PART_NAMES, _PART_PAIRS, _RUNS, _WEAK, SCOPE, _SCOPE_SQL, _canonical, _part_names, _runs, _weak_runs, registered, table


@registered(_SCOPE_SQL + """, r AS (SELECT page_id, reason, reason LIKE 'in scope%' AS ok, row_number() OVER (PARTITION BY reason LIKE 'in scope%' ORDER BY page_id) AS k FROM d)
   SELECT page_id, ok AND k <= 40 AS in_scope, CASE WHEN ok AND k > 40 THEN 'over max_discovered_items (40)' ELSE reason END AS reason FROM r""")
def capped_run(spark, sf_dir):
    """One run's cap, over all sources together."""
    return decisions.capped(_canonical(spark, sf_dir), SCOPE, "canonical", "page_id").select("page_id", "in_scope", "reason")


@registered("""WITH o AS (SELECT page_id AS u, page_id * 2 AS seen FROM pages WHERE page_id % 2 = 0), n AS (SELECT page_id AS u, page_id * 3 AS seen FROM pages WHERE page_id % 3 = 0)
   SELECT coalesce(o.u, n.u)::VARCHAR AS discovered_url, coalesce(o.seen, n.seen)::VARCHAR AS first_discovered_at, coalesce(n.seen, o.seen)::VARCHAR AS last_discovered_at, n.u IS NOT NULL AS in_scope FROM o FULL JOIN n ON o.u = n.u""")
def discovered_state(spark, sf_dir):
    p = table(spark, sf_dir, "pages")

    def rows(k: int, scoped: bool):
        seen = (F.col("page_id") * k).cast("string")
        return p.where(F.col("page_id") % k == 0).select(F.col("page_id").cast("string").alias("discovered_url"), seen.alias("first_discovered_at"), seen.alias("last_discovered_at"), F.lit(scoped).alias("in_scope"))

    return discovery.upsert_discovered(rows(2, False), rows(3, True))


@registered(f"""WITH {_PART_NAMES}, q AS ({_PART_PAIRS}) SELECT 'person' AS kind, a_id, b_id, CASE WHEN a_id % 2 = 0 THEN 'rejected' ELSE 'open' END AS status FROM q""")
def alias_queue(spark, sf_dir):
    """Pairs that a reviewer turned down stay so when they are found again."""
    pairs = matching.person_pairs(_part_names(spark, sf_dir), text.ascii_key)
    before = pairs.where(F.col("a_id") % 2 == 0).select(F.lit("person").alias("kind"), F.col("a_id").cast("long"), F.col("b_id").cast("long"), "reason", F.lit("rejected").alias("status"))
    return review.queued(before, "person", pairs).select("kind", "a_id", "b_id", "status")


@registered(f"""WITH {_PART_NAMES}, q AS ({_PART_PAIRS}) SELECT 'person' AS kind, a.name AS a_name, b.name AS b_name, 'open' AS status FROM q JOIN n a ON a.id = a_id JOIN n b ON b.id = b_id""")
def review_queue(spark, sf_dir):
    names = _part_names(spark, sf_dir)
    entities = names.select("id", F.col("name").alias("display_name"))
    queue = review.queued(spark.createDataFrame([], "kind string, a_id long, b_id long, reason string, status string"), "person", matching.person_pairs(names, text.ascii_key))
    return review.named(queue, entities, entities.limit(0)).select("kind", "a_name", "b_name", "status")


@registered(f"""WITH {_PART_NAMES} SELECT x.id AS a_id, y.id AS b_id, CASE WHEN x.name = y.name THEN 'safe match' WHEN x.a <> y.a AND NOT (length(x.a) = 1 AND left(y.a, 1) = x.a) AND NOT (length(y.a) = 1 AND left(x.a, 1) = y.a) THEN 'do not match automatically'
   WHEN x.b = y.b OR (length(x.b) = 1 AND left(y.b, 1) = x.b) OR (length(y.b) = 1 AND left(x.b, 1) = y.b) THEN 'possible match requiring review' ELSE 'do not match automatically' END AS decision FROM p x JOIN p y ON left(x.a, 1) = left(y.a, 1)""")
def person_decisions(spark, sf_dir):
    """Verdicts on names that start alike."""
    n = _part_names(spark, sf_dir).withColumn("k", F.substring("name", 1, 1))
    a, b = (n.select("k", F.col("id").alias(f"{x}_id"), F.col("name").alias(x)) for x in "ab")
    return a.join(b, "k").select("a_id", "b_id", matching.person_match(F.col("a"), F.col("b"), text.ascii_key).getField("decision").alias("decision"))


@registered("""WITH e AS (SELECT event_id // 10 AS run, event_id % 10 AS seq, event_type, CASE WHEN event_id % 7 < 3 THEN 'running' ELSE 'success' END AS status FROM events), l AS (SELECT run, max(seq) AS seq, arg_max(status, seq) AS status FROM e GROUP BY run)
   SELECT run::VARCHAR AS run_id, (seq + (status = 'running')::INT)::BIGINT AS event_seq, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'its process is gone' END AS error FROM l""")
def run_lifecycle(spark, sf_dir):
    """Runs from their events, those left running turned into failed ones."""
    e = table(spark, sf_dir, "events").select(F.expr("cast(event_id div 10 as string)").alias("run_id"), (F.col("event_id") % 10).alias("event_seq"), F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("finished_at"), F.when(F.col("event_id") % 7 < 3, "running").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error"))
    events = e.unionByName(runs.abandoned(e, "s", "2024-02-01T00:00:00Z", "its process is gone"))
    return runs.latest(events.withColumn("seq", F.col("event_seq"))).select("run_id", F.col("seq").alias("event_seq"), "status", "error")


@registered(f"WITH {_RUNS} SELECT run_id, source_id AS source, status, items_discovered, items_parsed FROM runs WHERE status NOT IN ('running', 'skipped') ORDER BY started_at DESC, run_id DESC LIMIT 10")
def run_summaries(spark, sf_dir):
    """The last ten finished runs, under the names of a summary."""
    return summary.from_runs(runs.last_runs(_runs(spark, sf_dir), 10)).select("run_id", "source", "status", "items_discovered", "items_parsed")


@registered(f"""WITH {_WEAK}, s AS (SELECT source_id, count(*) FILTER (status = 'success') AS ok, count(*) AS n, sum(items_discovered) AS found FROM weak GROUP BY source_id)
   SELECT source_id, CASE WHEN ok = 0 THEN 'all failed' WHEN found = 0 THEN 'empty' ELSE 'fine' END AS verdict, ok AS pages_fetched FROM s""")
def run_guards(spark, sf_dir):
    """Each type's days as pages of a discovery: whether all failed, or none gave anything."""
    r = _weak_runs(spark, sf_dir)
    kept = {k: r.where(F.col("source_id") == k) for k in ("signup", "error", "click", "view", "purchase")}
    out = []
    for k, pages in kept.items():
        p = pages.select(F.col("run_id").alias("page_url"), F.lit(200).alias("http_status"), F.monotonically_increasing_id().alias("turn"), (F.col("status") == "success").alias("ok"), F.col("items_discovered").alias("found"))
        c = discovery.counters(discovery.Found(p, p, p))
        out.append((k, "all failed" if not c["pages_fetched"] else "empty" if not c["raw_count"] else "fine", c["pages_fetched"]))
    return spark.createDataFrame([x for x in out if x[2] or x[1] != "all failed" or kept[x[0]].limit(1).count()], "source_id string, verdict string, pages_fetched long")


@registered("SELECT o_orderstatus AS status, strftime(m, '%Y-%m') AS month, count(o.o_orderkey) AS n FROM (SELECT o_orderstatus AS s, unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS m FROM orders GROUP BY o_orderstatus) c LEFT JOIN orders o ON o.o_orderstatus = c.s AND date_trunc('month', o.o_orderdate) = m GROUP BY s, m, o_orderstatus HAVING o_orderstatus IS NOT NULL")
def months_by_status(spark, sf_dir):
    return runs.months(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderstatus").where("n > 0").withColumnRenamed("o_orderstatus", "status")


@registered("SELECT strftime(ts, '%a') AS weekday, count(*) AS n FROM events GROUP BY 1")
def weekday_counts(spark, sf_dir):
    return runs.weekdays(table(spark, sf_dir, "events"), "ts")


@registered("WITH d AS (SELECT DISTINCT o_orderpriority AS p, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_custkey % 9 = 0), g AS (SELECT p, date_diff('day', lag(d) OVER (PARTITION BY p ORDER BY d), d) AS gap FROM d) SELECT p AS priority, count(*) FILTER (gap > 1) AS over_1, count(*) FILTER (gap > 7) AS over_7, count(*) FILTER (gap > 30) AS over_30 FROM g WHERE gap IS NOT NULL GROUP BY p")
def long_gaps(spark, sf_dir):
    """Gaps between days with orders of every ninth customer."""
    return runs.gap_thresholds(table(spark, sf_dir, "orders").where("o_custkey % 9 = 0"), "o_orderpriority", "o_orderdate").withColumnRenamed("o_orderpriority", "priority")


@registered("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, name LIMIT 6")
def most_common_names(spark, sf_dir):
    return runs.most_common(table(spark, sf_dir, "part"), "p_name", 6).withColumnRenamed("p_name", "name")


@registered("SELECT year(o_orderdate) AS year, count(*) AS n, count(DISTINCT o_orderpriority) AS titles, count(*) FILTER (lower(o_orderpriority) LIKE '%urgent%') AS with_urgent FROM orders GROUP BY 1")
def year_survey(spark, sf_dir):
    return runs.survey(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", ("urgent",))


@registered("SELECT user_id, count(*) FILTER (value < 10) AS ok, count(*) FILTER (value >= 10 AND value < 20) AS failed, count(*) FILTER (value >= 20) AS not_attempted FROM events GROUP BY user_id")
def detail_status(spark, sf_dir):
    v = F.col("value")
    return discovery.detail_counts(table(spark, sf_dir, "events").withColumn("detail_fetch_status", F.when(v < 10, "ok").when(v < 20, "failed").otherwise("not_attempted")), "user_id")


@registered("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) + 9 AS id FROM customer")
def numbered_rows(spark, sf_dir):
    return records.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", first=10).select("c_custkey", "id")


@registered("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'skipped' WHEN page_id % 2 = 1 THEN 'new' WHEN page_id % 4 = 0 THEN 'known' ELSE 'updated' END AS state FROM pages")
def item_states(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    title = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    old = p.where("page_id % 2 = 0").select("url", "page_id", records.legacy_hash(F.when(F.col("page_id") % 4 == 0, title).otherwise("old"), missing="None").alias("content_hash")).withColumn("key", F.concat_ws(" ", "url", "page_id"))
    new = p.select("page_id", F.when(F.col("page_id") % 5 != 0, F.concat_ws(" ", "url", "page_id")).alias("key"), title.alias("title"))
    return records.stored(old.select("key", "content_hash"), new, "key", ["title"], "").select("page_id", "state")


@registered("SELECT 'supplier' AS \"table\", 's_nationkey: not in nation' AS rule, count(*) AS n FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) UNION ALL SELECT 'lineitem', 'l_orderkey: repeated', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def broken_rules(spark, sf_dir):
    t = {n: table(spark, sf_dir, n) for n in ("supplier", "lineitem", "orders")} | {"nation": table(spark, sf_dir, "nation").where("n_regionkey < 3")}
    return snapshots.broken(t, {"lineitem": ("l_orderkey",), "orders": ("o_orderkey",)}, (("supplier", "s_nationkey", "nation", "n_nationkey"),))


@registered("SELECT page_id FROM pages WHERE contains(url, '/de/1')")
def url_like(spark, sf_dir):
    return snapshots.like(table(spark, sf_dir, "pages"), "url", "/de/1").select("page_id")


@registered("SELECT event_id, strftime(ts - INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def shifted_times(spark, sf_dir):
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "events").select("event_id", snapshots.shifted(at, "-1 hour").alias("at"))
