"""Streams: batches of landed files merged into a published table, and windows over events with late data (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from ..sources.snapshots import Store


def merge_batches(stream: DataFrame, store: Store, table: str, key: str, content: list[str], seq: str, now: Callable[[int], str], checkpoint: str, schema, trigger: dict | None = None, parts: int = 64, keep: int = 4):
    """Merges each micro-batch by its content hash and publishes it as run <batch id>, so a batch that is run again changes nothing.

    The table is parts tables by a hash of the key; a batch rewrites those that its
    keys fall into and leaves the others where they are; Store.read reads all of them.
    """
    part = F.pmod(F.hash(key), F.lit(parts))

    def merge(batch: DataFrame, batch_id: int) -> None:
        run = f"batch-{batch_id:012d}"
        if store.current() == run:
            return
        new = records.last_of_each(batch, [key], seq).withColumn("_part", part).persist()
        try:
            touched = sorted(r[0] for r in new.select("_part").distinct().collect())  # parts of them at most
            digest = lambda df: records.legacy_hash(*(F.col(c) for c in content))
            out = {}
            for k in touched:
                name = f"{table}-{k:04d}"
                merged = records.merge(store.read(name, schema), new.where(F.col("_part") == k).drop("_part"), key, content, now(batch_id), digest)
                out[name] = merged.drop("state", "rediscovered")
            store.publish(run, out)
        finally:
            new.unpersist()
        store.clean(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, ts: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows per event-time window and group; works on a stream (closed windows, late data up to late) and on a table."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    e = e.withWatermark("_ts", late) if events.isStreaming else e
    return e.groupBy(F.window("_ts", window).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")
