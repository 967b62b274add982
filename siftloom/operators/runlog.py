"""The log of runs as a table: one row for each event of a stage, with its fields as a map."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("START", "FETCH", "FETCH_ERROR", "PARSE", "NORMALIZE", "PAGINATE", "DETAIL_FAILURE", "ENRICH", "PARSE_WARNING", "VALIDATION_FAILURE", "VALIDATE", "STORE", "REDISCOVERED", "END", "WARNING", "FAILURE", "SCHEDULE", "RUN_START", "RUN_END", "RUN_SKIPPED", "STALE_LOCK")


def line(stage: Column, fields: Column) -> Column:
    """stage key=value ..., keys in order; values with quotes and line ends made harmless."""
    clean = lambda v: F.replace(F.replace(F.coalesce(v, F.lit("none")), F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), clean(e["value"])))
    return F.concat_ws(" ", stage, F.array_join(pairs, " "))


def stage_counts(log: DataFrame) -> DataFrame:
    """log: run_id, stage, fields.  Events and failed ones of each run."""
    failed = F.col("stage").isin("FETCH_ERROR", "DETAIL_FAILURE", "VALIDATION_FAILURE", "FAILURE")
    return log.groupBy("run_id").agg(F.count("*").alias("events"), F.count_if(failed).alias("failures"), F.count_if(F.col("stage") == "END").alias("ended"))


def entries(run_id: str, *events: tuple[str, dict]) -> list[tuple]:
    """(run_id, seq, stage, fields) rows of a run's events, in order; a stage that isn't known is refused."""
    bad = sorted({s for s, _ in events} - set(STAGES))
    if bad:
        raise ValueError(f"unknown stages {bad}")
    return [(run_id, i, s, {k: None if v is None else str(v) for k, v in f.items()}) for i, (s, f) in enumerate(events)]


def set_up(level: int = logging.INFO, name: str = "siftloom", stream=None) -> logging.Logger:
    """The driver's logger: one handler however often this is called, 'time [LEVEL] logger=name message'."""
    logger = logging.getLogger(name)
    if not any(getattr(h, "siftloom", False) for h in logger.handlers):
        h = logging.StreamHandler(stream)
        h.siftloom = True
        f = logging.Formatter("%(asctime)s [%(levelname)s] logger=%(name)s %(message)s", "%Y-%m-%dT%H:%M:%SZ")
        f.converter = time.gmtime
        h.setFormatter(f)
        logger.addHandler(h)
        logger.propagate = False
    logger.setLevel(level)
    return logger


@contextmanager
def lock(path: str, stale_s: float = 7200.0):
    """One run of a source at a time: scheduler.Lock as a context; FileExistsError while another holds it."""
    from .scheduler import Lock

    held = Lock(path, stale_s)
    if not held.acquire():
        raise FileExistsError(path)
    try:
        yield
    finally:
        held.release()
