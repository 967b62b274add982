"""Runs of sources: coverage, drops against the run before, history, and when a source is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema

# Points of coverage lost, share of items left, and items before, at which a run is warned about.
COVERAGE_POINTS, DISCOVERY_RATIO, DISCOVERY_LEAST = 30.0, 0.5, 10
COVERAGE = ("pct_with_date", "pct_with_speaker", "pct_with_org")


def pct(part: Column, whole: Column) -> Column:
    """Per cent with one digit, half to even; null of nothing."""
    return F.bround(F.try_divide(100.0 * part, whole), 1)


def coverage(parsed: DataFrame, *by: str) -> DataFrame:
    """parsed: event_start, speakers, organizations.  Rows and coverage of each group."""
    n = F.count("*")
    some = lambda c: F.count_if(c)
    return parsed.groupBy(*by).agg(n.alias("items_parsed"), pct(some(F.coalesce(F.col("event_start"), F.lit("")) != ""), n).alias("pct_with_date"), pct(some(F.size("speakers") > 0), n).alias("pct_with_speaker"), pct(some(F.size("organizations") > 0), n).alias("pct_with_org"))


def _before(df: DataFrame, columns: list[str]) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy("started_at", "run_id")
    return df.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns))


def coverage_drops(runs: DataFrame) -> DataFrame:
    """run_id, source_id, metric, previous, now: coverage lost against the successful run before."""
    r = _before(runs.where("status = 'success'"), ["items_parsed", *COVERAGE])
    r = r.where("items_parsed > 0 and prev_items_parsed > 0")
    m = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"prev_{c}").alias("previous"), F.col(c).alias("now")) for c in COVERAGE)))
    return r.select("run_id", "source_id", m.alias("m")).select("run_id", "source_id", "m.*").where(F.col("previous") - F.col("now") >= COVERAGE_POINTS)


def discovery_drops(runs: DataFrame) -> DataFrame:
    """run_id, source_id, previous, now: items found fell to half or less."""
    r = _before(runs.where("status = 'success'"), ["items_discovered"])
    r = r.where((F.col("prev_items_discovered") >= DISCOVERY_LEAST) & (F.col("items_discovered") <= F.col("prev_items_discovered") * DISCOVERY_RATIO))
    return r.select("run_id", "source_id", F.col("prev_items_discovered").alias("previous"), F.col("items_discovered").alias("now"))


def history(runs: DataFrame) -> DataFrame:
    """source_id, last_started_at, last_status, consecutive_failures: runs since the last success, skipped ones aside."""
    r = runs.where("status <> 'skipped'")
    last = F.max_by(F.struct("started_at", "status"), F.struct("started_at", "run_id"))
    good = F.max(F.when(F.col("status") == "success", F.struct("started_at", "run_id")))
    h = r.groupBy("source_id").agg(last.alias("l"), good.alias("g"))
    later = r.join(h, "source_id").where(F.col("g").isNull() | (F.struct("started_at", "run_id") > F.col("g")))
    n = later.groupBy("source_id").agg(F.count("*").alias("consecutive_failures"))
    return h.join(n, "source_id", "left").select("source_id", F.col("l.started_at").alias("last_started_at"), F.col("l.status").alias("last_status"), F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"))


def wait_minutes(interval: Column, retry: Column, failures: Column) -> Column:
    """interval after a success; after failures retry, doubled for each but the first, and never more than interval."""
    return F.when(failures <= 0, interval).otherwise(F.least(retry * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(60))), interval))


def due(hist: DataFrame, now: str, interval: float, retry: float = 60.0) -> DataFrame:
    """hist with wait, next_due_at, due and due_reason at the time now; a run a little early (two minutes, a tenth of the wait at most) counts."""
    wait = wait_minutes(F.lit(interval), F.lit(retry), F.col("consecutive_failures"))
    grace = F.least(F.lit(120.0), wait * 6.0)
    start = F.unix_timestamp(F.to_timestamp("last_started_at"))
    at = start + wait * 60
    reason = F.when(F.col("last_started_at").isNull(), "never_run").when(F.col("consecutive_failures") == 0, "interval_after_success").when(F.col("last_status") == "running", "retry_after_unfinished_run").otherwise("retry_after_failure")
    t = F.unix_timestamp(F.to_timestamp(F.lit(now)))
    return hist.select("*", wait.alias("wait"), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("next_due_at"), F.coalesce(t + grace >= at, F.lit(True)).alias("due"), reason.alias("due_reason"))


def gaps(dates: DataFrame, by: str, date: str) -> DataFrame:
    """Days between following distinct dates of each group: n, least, median, mean and greatest."""
    d = dates.select(by, F.to_date(date).alias("d")).distinct()
    g = d.select(by, F.date_diff("d", F.lag("d").over(Window.partitionBy(by).orderBy("d"))).alias("gap")).where("gap is not null")
    return g.groupBy(by).agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.median("gap").alias("median"), F.round(F.avg("gap"), 6).alias("mean"), F.max("gap").alias("greatest"))


def months(dates: DataFrame, date: str, *by: str) -> DataFrame:
    """by, month (yyyy-MM) and n for every month from the first to the last of each group, months without rows too."""
    d = dates.select(*by, F.trunc(F.to_date(date), "month").alias("m")).where("m is not null")
    span = d.groupBy(*by).agg(F.min("m").alias("a"), F.max("m").alias("b")).select(*by, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("m"))
    n = d.groupBy(*by, "m").agg(F.count("*").alias("n"))
    return span.join(n, [*by, "m"], "left").select(*by, F.date_format("m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def weekdays(dates: DataFrame, date: str, *by: str) -> DataFrame:
    """by, weekday (Mon ...) and n."""
    return dates.where(F.to_date(date).isNotNull()).groupBy(*by, F.date_format(F.to_date(date), "E").alias("weekday")).agg(F.count("*").alias("n"))


def gap_thresholds(dates: DataFrame, by: str, date: str, days: tuple = (1, 7, 30)) -> DataFrame:
    """Of the gaps between following distinct dates, how many are longer than so many days."""
    d = dates.select(by, F.to_date(date).alias("d")).where("d is not null").distinct()
    g = d.select(by, F.date_diff("d", F.lag("d").over(Window.partitionBy(by).orderBy("d"))).alias("gap")).where("gap is not null")
    return g.groupBy(by).agg(*(F.count_if(F.col("gap") > n).alias(f"over_{n}") for n in days))


def survey(items: DataFrame, title: str, date: str, keywords: tuple = ()) -> DataFrame:
    """year, n, different titles, and titles with each keyword."""
    has = [F.count_if(F.contains(F.lower(F.col(title)), F.lit(k.lower()))).alias(f"with_{k.lower()}") for k in keywords]
    return items.groupBy(F.year(F.to_date(date)).alias("year")).agg(F.count("*").alias("n"), F.countDistinct(title).alias("titles"), *has)


def most_common(items: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values with their counts, ties by value."""
    return items.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def latest(run_events: DataFrame) -> DataFrame:
    """The current row of each run, from a log of events that is only added to: run_id, event_seq and others."""
    others = [c for c in run_events.columns if c not in ("run_id", "event_seq")]
    return run_events.groupBy("run_id").agg(F.max_by(F.struct(*others), "event_seq").alias("_r")).select("run_id", "_r.*")


def last_runs(runs: DataFrame, k: int = 1, source_id: str | None = None, status: str | None = None) -> DataFrame:
    """The k finished runs started last, of a source or with a status if these are given."""
    r = runs.where(~F.col("status").isin("running", "skipped"))
    if source_id is not None:
        r = r.where(F.col("source_id") == source_id)
    if status is not None:
        r = r.where(F.col("status") == status)
    return r.orderBy(F.desc("started_at"), F.desc("run_id")).limit(k)


def list_runs(runs: DataFrame, source_id: str | None = None) -> DataFrame:
    """All runs, of a source if it is given, in the order in which they started."""
    return (runs if source_id is None else runs.where(F.col("source_id") == source_id)).orderBy("started_at", "run_id")


def started(run_id: str, source_id: str, now: str, status: str = "running", error: str | None = None) -> dict:
    """The first event of a run; a skipped one is finished at once."""
    if status not in schema.RUN_STATUS:
        raise ValueError(f"no run is {status}")
    return {"run_id": run_id, "event_seq": 0, "source_id": source_id, "started_at": now, "finished_at": now if status == "skipped" else None, "status": status, "error": error}


def finished(start: dict, now: str, status: str, counts: dict | None = None, failed: int = 0, error: str | None = None, metrics: dict | None = None) -> dict:
    """The event that ends a run; metrics that a run has no column for are left out."""
    if status not in schema.RUN_STATUS:
        raise ValueError(f"no run is {status}")
    known = {k: v for k, v in (metrics or {}).items() if k in schema.RUN_METRICS.names}
    own = {f"{k}_count": (counts or {}).get(k) for k in ("new", "unchanged", "changed")}
    return {**start, **own, **known, "event_seq": start["event_seq"] + 1, "finished_at": now, "status": status, "failed_count": failed, "error": error}


def abandoned(run_events: DataFrame, source_id: str, now: str, reason: str) -> DataFrame:
    """Events that turn the running runs of a source into failed ones, whose process is gone."""
    top = run_events.where(F.col("source_id") == source_id).groupBy("run_id").agg(F.max_by(F.struct(*run_events.columns), "event_seq").alias("_r")).select("_r.*").where("status = 'running'")
    own = {"event_seq": F.col("event_seq") + 1, "finished_at": F.lit(now), "status": F.lit("failed"), "error": F.lit(reason)}
    return top.select(*(own.get(c, F.col(c)).cast(run_events.schema[c].dataType).alias(c) for c in run_events.columns))


class RunLog:
    """Events of runs as Parquet that is only added to; written outside the publication of data, so a run that failed is there too."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema.RUN_EVENTS)
        return self.spark.read.schema(schema.RUN_EVENTS).parquet(self.path)

    def runs(self) -> DataFrame:
        return latest(self.events())

    def add(self, *events: dict) -> None:
        rows = [tuple(e.get(f) for f in schema.RUN_EVENTS.names) for e in events]
        self.spark.createDataFrame(rows, schema.RUN_EVENTS).coalesce(1).write.mode("append").parquet(self.path)

    def abandon(self, source_id: str, now: str, reason: str) -> int:
        rows = abandoned(self.events(), source_id, now, reason).collect()  # the running runs of one source
        if rows:
            self.add(*(r.asDict() for r in rows))
        return len(rows)

    def history(self, source_id: str) -> dict:
        row = history(self.runs().where(F.col("source_id") == source_id)).first()
        return row.asDict() if row else {"source_id": source_id, "last_started_at": None, "last_status": None, "consecutive_failures": 0}
