"""Mixing sources to target weights by capped water-filling.

Targets: every source gets words by weight; one that would exceed
``max_epochs`` times its size stops there, and its excess is shared again by
weight among the rest, until none is above.  Words are then drawn: each
document is taken ``floor(target / size)`` whole times, and the rest of the
target is filled with further documents in a seeded hash order.  The last of
them is taken in part, so a source's taken words equal its rounded target.

The hash order is cut by a histogram of its leading digits, so no task sorts a
whole source: only the documents of one bin of a source are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
#: Hex digits of the hash that make a bin.
DIGITS = 3
#: Sources of which the table of targets is broadcast at most; with more, Spark joins by shuffle.
MOST_SOURCES = 20_000


def sizes(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """doc_id, source, size in words, tie (a hash of the text), and the columns that carry names."""
    return docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))


def targets(by_source: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """by_source: source, source_size.  Adds weight and target.

    A source stops at the cap if cap / weight is at most the water level, so
    sources in the order of that ratio fill one after the other; running sums
    give the level in one pass.  The windows run over one row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(up), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    s = s.withColumn("level", (F.sum("source_size").over(every) * share - F.col("capped_before")) / (F.sum("weight").over(every) - F.col("weight_before")))
    # the first source, in this order, whose ratio exceeds the level sets the level for it and all after it
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every)
    s = s.withColumn("at", level)
    target = F.when(F.col("at").isNull() | (F.col("ratio") < F.col("at.ratio")), F.col("cap")).otherwise(F.least("cap", F.col("at.level") * F.col("weight")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple = WEIGHTS, seed: int = 42, digits: int = DIGITS, carry: tuple = ()) -> DataFrame:
    """docs: doc_id, source, text; other columns are ignored.

    One row for each row of docs: doc_id, source, size, source_size, target,
    whole (times taken in full), part (words of one more, partial or full,
    repetition) and taken = whole * size + part, and the columns of docs that carry
    names.  A null text has size 0; a null
    source is a source, the last; sources of size 0 have target 0; an empty table
    gives no rows.  Repeated rows are rows like any other and tie in the order;
    ties are broken by size and by a hash of the text; rows that are equal in all of
    these are equal, so it doesn't matter which of them comes first.  Null ids have
    their place by the text, so many of them don't share a bin.
    """
    s = common.kept(sizes(docs), "sizes")
    all_of = sizes(docs, carry) if carry else s
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("tie").cast("string")))))
    dealt = lambda df: df.withColumn("order_key", key).withColumn("bin", F.substring("order_key", 1, digits))
    s, all_of = dealt(s), dealt(all_of)
    bins = common.kept(s.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    t = targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), share, max_epochs, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = t.withColumn("whole", whole.cast("long")).withColumn("rest", (F.round("target") - F.col("whole") * F.col("source_size")).cast("long"))
    t = common.kept(t, "targets")
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    b = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(run), F.lit(0))).withColumnRenamed("source", "b_source")
    b = b.join(common.small(t.select("source", "rest"), MOST_SOURCES), F.col("b_source").eqNullSafe(F.col("source")))
    # the bin in which the rest of the target runs out, if it does not end with a bin
    cut = b.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("bin_size") >= F.col("rest")))
    cut = cut.select(F.col("b_source").alias("c_source"), F.col("bin").alias("cut_bin"), "before")
    t = t.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source").withColumnRenamed("source", "t_source")
    t = common.small(common.kept(t, "cuts"), MOST_SOURCES)
    j = all_of.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    sure = j.where(F.coalesce(F.col("bin") != F.col("cut_bin"), F.lit(True)))
    sure = sure.withColumn("part", F.when(F.col("bin") < F.col("cut_bin"), F.col("size")).otherwise(0).cast("long"))
    inside = Window.partitionBy("source").orderBy("order_key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    edge = j.where(F.col("bin") == F.col("cut_bin")).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before"))).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target", "whole", "part", *carry]
    return sure.select(*names).unionByName(edge.select(*names)).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, with all their columns, as often as they are taken.

    A document taken in part, one for each source at most, has its first words,
    joined by single spaces, and the n_chars of these.
    """
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    m = mix(packed, carry=("row",), **options)
    full = m.withColumn("times", (F.col("whole") + F.when(F.col("part") == F.col("size"), F.when(F.col("size") > 0, 1).otherwise(0)).otherwise(0)).cast("int"))
    full = full.where("times > 0").select(F.explode(F.array_repeat("row", F.col("times"))).alias("row"))
    part = m.where("part > 0 and part < size").withColumn("part_text", F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(common.WORD), F.lit(0)), 1, F.col("part").cast("int")), " "))
    new = {"text": F.col("part_text")} | ({"n_chars": F.char_length("part_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    part = part.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))
    return full.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(part)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('42:' || doc_id) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM src),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0)) AS level
      FROM r WINDOW up AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN ratio < coalesce((SELECT min(ratio) FROM l WHERE ratio > level), 1e300) THEN cap
      ELSE least(cap, weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level)) END AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT s.*, source_size, target, whole, round(target)::BIGINT - whole * source_size AS rest,
      coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM g
"""
