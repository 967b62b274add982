"""The summary of a run: one mapping of numbers, its row in the table of runs, and its text forms."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs

# The names of a summary in order, and those of a row of runs that differ.
FIELDS = ("run_id", "source", "status", "http_status", "pages_fetched", "items_discovered", "items_parsed", "new", "changed", "unchanged", "not_seen_this_run", "failed", "parse_failures", "detail_failures", "people_extracted", "organizations_extracted", "pct_with_date", "pct_with_speaker", "pct_with_org", "error")
ROW_NAMES = {"source": "source_id", "new": "new_count", "changed": "changed_count", "unchanged": "unchanged_count", "not_seen_this_run": "not_seen_count", "failed": "failed_count"}


def from_runs(rows: DataFrame) -> DataFrame:
    """Rows of runs under the names of a summary."""
    have = set(rows.columns)
    return rows.select(*((F.col(ROW_NAMES.get(f, f)) if ROW_NAMES.get(f, f) in have else F.lit(None)).alias(f) for f in FIELDS))


def runs_row(summary: dict) -> dict:
    """The metrics of a summary under their names in the table of runs."""
    return {ROW_NAMES.get(f, f): summary.get(f) for f in FIELDS if f not in ("run_id", "source", "status", "error")}


def build(source: str, status: str, run_id: str | None, stats: dict, counts: dict | None = None, coverage: dict | None = None, error: str | None = None) -> dict:
    """Missing numbers are 0 for counts of failures, else null."""
    zero = {k: 0 for k in ("parse_failures", "detail_failures", "people_extracted", "organizations_extracted", "items_parsed")}
    s = {**dict.fromkeys(FIELDS), **zero, **{k: v for k, v in stats.items() if k in FIELDS}, **(counts or {}), **(coverage or {})}
    failed = s["parse_failures"] + s["detail_failures"] + stats.get("invalid", 0)
    return {k: v for k, v in s.items() if k in FIELDS} | {"source": source, "status": status, "run_id": run_id, "error": error, "failed": failed}


def block(summary: dict) -> str:
    """A line for each number, as people read it."""
    return "\n".join(f"{f.upper()}: {summary.get(f)}" for f in FIELDS)


def line(summary: dict) -> str:
    """One line for the log."""
    shown = " ".join(f"{f}={'none' if summary.get(f) is None else summary[f]}" for f in FIELDS if f != "error")
    said = (summary.get("error") or "").replace('"', "'").replace("\n", " ")
    return f'RUN_SUMMARY {shown} error="{said}"'


def warnings(summary: dict, previous: dict | None) -> list[str]:
    """Coverage lost and items lost against the successful run before."""
    out = []
    if not previous or summary.get("status") != "success":
        return out
    if summary.get("items_parsed") and previous.get("items_parsed"):
        for f in runs.COVERAGE:
            before, now = previous.get(f), summary.get(f)
            if before is not None and now is not None and before - now >= runs.COVERAGE_POINTS:
                out.append(f"COVERAGE_DROP source={summary['source']} metric={f} previous={before} now={now}")
    before, now = previous.get("items_discovered"), summary.get("items_discovered")
    if before is not None and now is not None and before >= runs.DISCOVERY_LEAST and now <= before * runs.DISCOVERY_RATIO:
        out.append(f"DISCOVERY_DROP source={summary['source']} previous={before} now={now}")
    return out


def emit(summary: dict, logger: logging.Logger, previous: dict | None = None) -> list[str]:
    """Logs the line, as an error if the run failed, and its warnings, which are returned."""
    logger.log(logging.INFO if summary.get("status") == "success" else logging.ERROR, line(summary))
    said = warnings(summary, previous)
    for w in said:
        logger.warning(w)
    return said
