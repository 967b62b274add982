"""What the operators of this subpackage share.

A word is a maximal run of characters other than space, tab, line feed,
vertical tab, form feed and carriage return.  ``bytes.split()`` cuts at exactly
these six, so words are taken from UTF-8 bytes.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WHITE = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    The setting is read from the session.  A folder of this machine stands in
    only if it is unset and the master is a plain local one, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(shared_dir, "own", None) or "file://" + tempfile.mkdtemp(prefix="siftloom-")
        shared_dir.own = base
    path = f"{base.rstrip('/')}/siftloom-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append(path)
    return path


_made: list[str] = []


def _sweep() -> None:
    """Removes this driver's folders when it ends with its session still there; results are read lazily, so not before."""
    sc = SparkContext._active_spark_context
    if sc is None or sc._jsc is None:
        return
    try:
        conf = sc._jsc.hadoopConfiguration()
        for path in _made:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
    except (Py4JError, OSError):
        pass  # the session went meanwhile


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    This cuts the lineage: what follows survives the loss of any executor, and
    no Python stage runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


#: Spark removes the shuffle files of an execution when it ends; a table that is written needs them no more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def dropped(*tables: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more, not even a plan that has yet to run."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def arrow_schema(spark: SparkSession, schema) -> pa.Schema:
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema if isinstance(schema, str) else StructType(schema.fields))


def arrow_map(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema, size: int | None = None) -> DataFrame:
    """f over the columns of each Arrow batch, as lists, in slices of about size bytes; strings come as UTF-8 bytes."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for part in cut(b, size):
                yield pa.RecordBatch.from_pydict(f(columns(part)), schema=out)

    return df.mapInArrow(run, schema)


#: Bytes of an Arrow batch that are worked on at once.
PART_BYTES = 8 << 20


def cut(b: pa.RecordBatch, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes (PART_BYTES), so that long texts don't pile up as Python objects."""
    n = max(1, -(-b.nbytes // (size or PART_BYTES)))
    step = max(1, -(-b.num_rows // n))
    for i in range(0, b.num_rows, step):
        yield b.slice(i, step)


def columns(b: pa.RecordBatch) -> dict[str, list]:
    out = {}
    for name, col in zip(b.schema.names, b.columns):
        if pa.types.is_string(col.type):
            col = col.cast(pa.binary())
        elif pa.types.is_large_string(col.type):
            col = col.cast(pa.large_binary())
        out[name] = col.to_pylist()
    return out


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; counted first, else Spark's own choice of join holds."""
    return F.broadcast(df) if len(df.limit(most + 1).select(F.lit(1)).collect()) <= most else df
