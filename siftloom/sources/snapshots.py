"""Tables published together: all are written under one run id, then one pointer is put down.

Pointers are numbered files and never changed: the one of the greatest number
counts, so there is no moment without one, and a crash leaves the state before.  A
reader takes the pointer once and sees one run's tables; older runs stay until
``clean``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import times

POINTER = "_CURRENT"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[len(POINTER) + 1 :]) for n in names if n.startswith(f"{POINTER}.") and n[len(POINTER) + 1 :].isdigit())

    def _said(self, number: int) -> list[str]:
        stream = self._fs.open(self._path(f"{self.root}/{POINTER}.{number:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def current(self) -> str | None:
        """The run that was published last."""
        numbers = self._pointers()
        return self._said(numbers[-1])[0] if numbers else None

    def paths(self, table: str) -> list[str]:
        """Where the table is in the state published last: written by that run or by ones before it, whole or in parts (table-0000 and on)."""
        numbers = self._pointers()
        places = dict(line.split("\t") for line in (self._said(numbers[-1])[1:] if numbers else ()) if line)
        part = re.compile(re.escape(table) + r"(?:-\d{4})?")
        return [f"{self.root}/{where}" for name, where in sorted(places.items()) if part.fullmatch(name)]

    def read(self, table: str, schema=None) -> DataFrame:
        """The table as last published; empty, with schema, before that."""
        paths = self.paths(table)
        if not paths:
            if schema is None:
                raise ValueError(f"nothing is published of {table}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*paths)

    def write(self, run_id: str, name: str, df: DataFrame) -> str:
        """A table in a folder of its own that nobody reads yet."""
        where = f"snapshot={run_id}/{uuid.uuid4().hex[:8]}/{name}"
        df.write.parquet(f"{self.root}/{where}")
        return where

    def staged(self, run_id: str, name: str, df: DataFrame) -> DataFrame:
        """df written where nobody looks for it and read again: what follows starts from files, with a short plan, and survives lost executors.  clean removes it."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.write(f'{run_id}-work', name, df)}")

    def publish(self, run_id: str, tables: dict[str, DataFrame], checks: list[Callable[[], DataFrame]] = (), extra: Callable[[], dict[str, DataFrame]] | None = None) -> None:
        """Writes all tables and those that extra gives, runs checks (each must give no row), then puts the pointer down.  Before that nothing is visible.

        Tables that are not among these stay as they are.  Of two runs that publish
        at once one fails: the pointer of a number is created once.
        """
        numbers = self._pointers()
        places = dict(line.split("\t") for line in (self._said(numbers[-1])[1:] if numbers else ()) if line)
        for name, df in {**tables, **(extra() if extra else {})}.items():
            places[name] = self.write(run_id, name, df)
        for check in checks:
            if bad := check().limit(1).collect():
                raise ValueError(f"not published: {bad[0]}")
        self._point(run_id, places, (numbers[-1] if numbers else 0) + 1)

    def _point(self, run_id: str, places: dict[str, str], number: int) -> None:
        """The pointer is written whole under another name and renamed to a name that must be free."""
        own = self._path(f"{self.root}/{POINTER}-{uuid.uuid4().hex}.tmp")
        out = self._fs.create(own, True)
        out.write(bytearray("\n".join([run_id, *(f"{k}\t{v}" for k, v in sorted(places.items()))]).encode()))
        out.close()
        at = self._path(f"{self.root}/{POINTER}.{number:012d}")
        if self._fs.exists(at) or not self._fs.rename(own, at):
            self._fs.delete(own, False)
            raise OSError(f"another run was published meanwhile: {self.root}")

    def clean(self, keep: int = 2) -> None:
        """Removes pointers before the last keep ones, and folders that no pointer left names; for times when no run is under way."""
        numbers = self._pointers()
        used = {line.split("\t")[1] for n in numbers[-keep:] for line in self._said(n)[1:] if line}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{POINTER}.{n:012d}"), False)
        for run in self._fs.globStatus(self._path(f"{self.root}/snapshot=*/*/*")):
            if "/".join(str(run.getPath().toString()).rsplit("/", 3)[1:]) not in used:
                self._fs.delete(run.getPath(), True)


def lookup(df: DataFrame, column: str, *keys) -> DataFrame:
    """Rows by key; the comparison reaches the scan."""
    return df.where(F.col(column).isin(*keys)) if len(keys) != 1 else df.where(F.col(column) == keys[0])


def like(df: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column has the part in it, as SQL's LIKE with % at both ends; the part is taken as it is."""
    return df.where(F.contains(F.col(column), F.lit(part)))


def shifted(c: Column, interval: str) -> Column:
    """A UTC text moved by an interval like '-1 hour'."""
    return times.utc_text(F.to_timestamp(c) + F.expr(f"INTERVAL {interval}"))


def migrated(df: DataFrame, schema: T.StructType, renamed: dict[str, str] | None = None) -> DataFrame:
    """A table of an older form in the form of schema: columns renamed where the new name lacks, missing ones added as null."""
    for old, new in (renamed or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def broken(tables: dict[str, DataFrame], keys: dict[str, tuple], references: tuple = ()) -> DataFrame:
    """table, rule and n of broken constraints: keys (table -> columns that are not null and not repeated) and references ((table, column, other, its column))."""
    from functools import reduce

    found = []
    for name, columns in keys.items():
        df = tables[name]
        nulls = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
        found.append(df.agg(F.count_if(nulls).alias("n")).select(F.lit(name).alias("table"), F.lit(f"{', '.join(columns)}: null").alias("rule"), "n"))
        found.append(df.groupBy(*columns).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"{', '.join(columns)}: repeated").alias("rule"), "n"))
    for name, column, other, key in references:
        lost = tables[name].where(F.col(column).isNotNull()).join(tables[other].select(F.col(key).alias(column)).distinct(), column, "left_anti")
        found.append(lost.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(f"{column}: not in {other}").alias("rule"), "n"))
    return reduce(DataFrame.unionByName, found).where("n > 0")


def query(spark: SparkSession, tables: dict[str, DataFrame], sql: str, **args) -> DataFrame:
    """SQL with named parameters over tables by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=args)
