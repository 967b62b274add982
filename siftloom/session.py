"""Session settings that the library's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "siftloom", **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; anything else is the cluster's to set, or conf's."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
