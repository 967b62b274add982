"""The queue of possible duplicates for a reviewer.  Nothing is ever merged by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import matching, records

KINDS = {"person": "people", "organization": "organizations"}
OPEN = "open"


def queued(queue: DataFrame, kind: str, pairs: DataFrame) -> DataFrame:
    """queue (kind, a_id, b_id, reason, status) with the pairs that it lacks, the smaller id first; a pair that is there keeps its reason and what a reviewer said."""
    new = pairs.select(F.lit(kind).alias("kind"), F.least("a_id", "b_id").cast("long").alias("a_id"), F.greatest("a_id", "b_id").cast("long").alias("b_id"), F.col("reason"), F.lit(OPEN).alias("status"))
    new = new.where("a_id < b_id").groupBy("kind", "a_id", "b_id").agg(F.min("reason").alias("reason"), F.min("status").alias("status"))
    return queue.unionByName(new.join(queue.select("kind", "a_id", "b_id"), ["kind", "a_id", "b_id"], "left_anti"))


def decided(queue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """queue with the status of verdicts (kind, a_id, b_id, status)."""
    v = verdicts.select("kind", "a_id", "b_id", F.col("status").alias("_v"))
    return queue.join(v, ["kind", "a_id", "b_id"], "left").withColumn("status", F.coalesce("_v", "status")).drop("_v")


def named(queue: DataFrame, people: DataFrame, organizations: DataFrame) -> DataFrame:
    """The queue as a reviewer reads it: kind, both names, reason and status; people and organizations: id, display_name."""

    def of(kind: str, entities: DataFrame) -> DataFrame:
        a, b = (entities.select(F.col("id").cast("long").alias(f"{x}_id"), F.col("display_name").alias(f"{x}_name")) for x in "ab")
        return queue.where(F.col("kind") == kind).join(a, "a_id").join(b, "b_id")

    both = of("person", people).unionByName(of("organization", organizations))
    return both.select("kind", "a_id", "b_id", "a_name", "b_name", "reason", "status")


def listed(entities: DataFrame) -> DataFrame:
    """id and display_name in the order of the ids."""
    return entities.select("id", "display_name").orderBy("id")


def write_entities(state: dict[str, DataFrame], people: DataFrame, organizations: DataFrame, replaced: DataFrame, key=None, keep=None) -> dict[str, DataFrame]:
    """The next people, organizations, item_people, item_organizations and review queue.

    people and organizations: mentions of this run (item_url, normalized_name, role,
    source_text, display fields, seq).  Links of replaced items (item_url) are taken
    anew, others only gain; then every pair for review of the dimensions is queued.
    keep(name, df), if given, writes a table and reads it again.
    """
    keep = keep or (lambda name, df: df)
    p = people.select("normalized_name", F.col("name").alias("display_name"), "honorific", F.lit(None).cast("string").alias("profile_url"), "seq")
    o = organizations.select("normalized_name", F.col("name").alias("display_name"), "org_type", F.lit(None).cast("string").alias("url"), "seq")
    out = {"people": keep("people-next", records.first_forms(state["people"], p)), "organizations": keep("organizations-next", records.first_forms(state["organizations"], o))}
    links = people.select("item_url", "normalized_name", "role", F.col("affiliation").alias("affiliation_raw"), "source_text")
    out["item_people"] = records.upsert_links(state["item_people"], links, ["item_url", "normalized_name", "role"], replaced)
    out["item_organizations"] = records.upsert_links(state["item_organizations"], organizations.select("item_url", "normalized_name", "role", "source_text"), ["item_url", "normalized_name", "role"], replaced)
    queue = state["entity_alias_candidates"]
    for kind, table, pairs in (("person", "people", matching.person_pairs), ("organization", "organizations", matching.organisation_pairs)):
        queue = queued(queue, kind, pairs(out[table].select("id", F.col("display_name").alias("name")), key))
    return out | {"entity_alias_candidates": queue}
