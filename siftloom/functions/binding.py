"""Naming a value inside an expression, so that the plan holds it once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body of value, with value computed and written down once."""
    return F.transform(F.array(value), body)[0]
