"""One run of a source, from landed pages to a published state.

discover, route, read detail pages of the first events in scope, assemble,
validate, merge, link people and organizations, queue pairs for review, and
publish all tables by one pointer.  A failure leaves the state before.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..sources import adapters, html
from ..sources.snapshots import Store
from . import decisions, discovery, matching, records, review, runs, summary

EMPTY = {
    "records": schema.STORED,
    "people": schema.T.StructType([schema.T.StructField("id", schema.T.LongType()), *schema.PEOPLE.fields]),
    "organizations": schema.T.StructType([schema.T.StructField("id", schema.T.LongType()), *schema.ORGANIZATIONS.fields]),
    "item_people": schema.ITEM_PEOPLE,
    "item_organizations": schema.ITEM_ORGANIZATIONS,
    "entity_alias_candidates": schema.REVIEW,
    "discovered_items": schema.DISCOVERED_ITEMS,
}


class RunError(RuntimeError):
    """A run that failed as a whole, with its summary."""

    def __init__(self, message: str, said: dict):
        super().__init__(message)
        self.summary = said


@dataclass
class Result:
    summary: dict
    counts: dict
    warnings: list
    rejects: DataFrame


def targets(routed: DataFrame, source: discovery.Source) -> DataFrame:
    """url of the events in scope whose detail pages are read: the first ones, as many as source and scope allow."""
    most = min(source.scoped().most_details, source.detail_limit) if source.supports_detail else 0
    return routed.where((F.col("label") == "event") & F.col("in_scope")).orderBy("seq", "url").limit(most).select("url")


def details(landed: DataFrame, wanted: DataFrame, routed: DataFrame, source: discovery.Source) -> DataFrame:
    """url, content_type, provenance, parse_error, and the fields of the adapter, for each wanted page.

    A page that is no event by its content type is not parsed; one without the
    article is a parse failure.
    """
    adapter = adapters.load(source.adapter)
    got = wanted.join(landed.select(F.col("page_url").alias("url"), "http_status", "content_type", "fetched_at", "body"), "url", "left")
    ok = F.coalesce(F.col("http_status") < 400, F.lit(False)) & F.col("body").isNotNull()
    got = got.withColumn("fetched", ok)
    again = discovery.routed(routed.join(wanted, "url", "left_semi"), source, got.where("fetched").select("url", "content_type"))
    got = got.join(again.select("url", F.col("label").alias("now_label"), F.col("label_reason").alias("now_reason")), "url")
    read = adapter.detail(got.where(F.col("fetched") & (F.col("now_label") == "event") & decisions.fetchable(F.col("now_label"))).select(F.col("url").alias("item_url"), F.col("body").alias("html")))
    read = read.withColumnRenamed("item_url", "url").withColumn("parsed", F.col("parse_error").isNull())
    j = got.drop("body").join(read, "url", "left")
    status = F.when(~F.col("fetched") | F.col("parse_error").isNotNull(), "failed").otherwise("ok")
    error = F.when(~F.col("fetched"), F.concat(F.lit("http_error: "), F.coalesce(F.col("http_status").cast("string"), F.lit("no response")))).otherwise(F.col("parse_error"))
    return j.withColumn("detail_fetch_status", status).withColumn("detail_error", error).withColumn("parsed", F.coalesce("parsed", F.lit(False)))


def run(landed: DataFrame, source: discovery.Source, store: Store, run_id: str, now: str, cutoff: str | None = None, previous: dict | None = None, logger: logging.Logger | None = None) -> Result:
    """landed: page_url, final_url, http_status, content_type, fetched_at, body of the pages fetched for this run."""
    logger = logger or logging.getLogger("siftloom")
    adapter = adapters.load(source.adapter)
    stats: dict = {}

    def failed(stage: str, error: Exception) -> RunError:
        said = summary.build(source.source_id, "failed", run_id, stats, error=f"{stage}: {type(error).__name__}: {error}")
        summary.emit(said, logger, previous)
        return RunError(f"{stage} failed: {error}", said)

    keep = lambda name, df: store.staged(run_id, name, df)
    try:
        found = discovery.discover(landed, source, now, keep=keep)
        stats.update(discovery.counters(found))
        stats["items_discovered"] = discovery.checked(found, source, stats)
    except (discovery.DiscoveryError, discovery.EmptyListingError, ValueError) as e:
        raise failed("discovery", e) from e

    routed = keep("routed", discovery.routed(found.candidates, source))
    detail = keep("detail", details(landed, targets(routed, source), routed, source))
    late = detail.where("fetched").select("url", "now_label", "now_reason")
    routed = keep("routed-again", routed.join(late, "url", "left").withColumn("label", F.coalesce("now_label", "label")).withColumn("label_reason", F.coalesce("now_reason", "label_reason")).drop("now_label", "now_reason"))
    fields = [c for c in detail.columns if c not in ("url", "http_status", "content_type", "fetched_at", "fetched", "now_label", "now_reason", "parse_error", "parsed", "detail_fetch_status", "detail_error")]
    d = detail.select("url", F.col("fetched_at").alias("detail_fetched_at"), F.col("http_status").alias("detail_http_status"), "detail_fetch_status", "detail_error", "parsed", *(F.col(c).alias(f"_{c}") for c in fields))
    events = routed.where("in_scope and label = 'event'").join(d, "url", "left")
    page = lambda c: F.when(F.col("parsed"), F.nullif(F.col(f"_{c}"), F.lit("")))
    listing = {"title": F.col("title"), "category": F.col("category")}
    own = {c: F.coalesce(page(c), listing[c]) if c in listing and c in fields else listing[c] if c in listing else page(c) for c in dict.fromkeys([*fields, *listing])}
    raw = events.select(F.col("url").alias("item_url"), "source_name", F.col("discovered_at").alias("fetched_at"), "detail_fetched_at", "detail_http_status", F.coalesce("detail_fetch_status", F.lit("not_attempted")).alias("detail_fetch_status"), "detail_error", "parsed", F.col("source_timestamp").alias("_listed_start"), F.col("source_timestamp_raw").alias("_listed_raw"), "methods", "found_on", *(v.alias(c) for c, v in own.items()))
    n = adapter.normalize(keep("raw", raw))
    extras = F.map_filter(F.create_map(F.lit("discovery_methods"), F.array_join("methods", ","), F.lit("found_on"), F.array_join("found_on", " "), F.lit("listing_timestamp_raw"), F.col("_listed_raw")), lambda _, v: v.isNotNull())
    n = n.withColumn("event_start", F.coalesce("event_start", "_listed_start")).withColumn("extras", F.map_concat(F.map_filter(F.coalesce("extras", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(extras, k)), extras)).withColumn("http_status", F.lit(stats["http_status"]).cast("int"))
    lines = html.lines(landed.join(detail.where("parsed").select(F.col("url").alias("page_url")), "page_url", "left_semi").select(F.col("page_url").alias("item_url"), F.col("body").alias("html")))
    people, orgs = matching.mentions(matching.labelled(lines, getattr(adapter, "labels", None) or adapters.MENTION_LABELS))
    people, orgs = keep("people-said", people), keep("organizations-said", orgs)
    said = people.where("role = 'speaker'").groupBy("item_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "affiliation", "name"))), lambda x: F.struct(x.getField("affiliation").alias("affiliation"), x.getField("name").alias("name"))).alias("_speakers"))
    hosts = orgs.where("role in ('organizer', 'co-organizer')").groupBy("item_url").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "pos", "name"))), lambda x: x.getField("name"))).alias("_organizations"))
    n = n.join(said, "item_url", "left").join(hosts, "item_url", "left")
    held = n["speakers"] if "speakers" in n.columns else F.array().cast(schema.SPEAKERS)
    n = n.withColumn("speakers", F.when(F.size(F.coalesce(held, F.array().cast(schema.SPEAKERS))) > 0, held).otherwise(F.coalesce("_speakers", F.array().cast(schema.SPEAKERS)))).withColumn("organizations", F.coalesce("_organizations", F.array().cast("array<string>")))
    config = landed.sparkSession.createDataFrame([(source.source_id, source.institution, source.item_type, source.organizer, source.listing_url)], "source_name string, institution string, item_type string, organizer string, listing_url string")
    n = keep("normalized", n)
    whole = keep("assembled", records.assemble(n, config))
    side = n.select("item_url", "parse_warnings", "parsed")
    checked = keep("checked", whole.withColumn("errors", records.errors(whole)).join(side, "item_url"))
    valid, invalid = checked.where(F.size("errors") == 0), checked.where(F.size("errors") > 0)

    cover = valid.where("parsed").agg(F.count("*").alias("items_parsed"), *(runs.pct(F.count_if(x), F.count("*")).alias(c) for c, x in (("pct_with_date", F.coalesce(F.col("event_start"), F.lit("")) != ""), ("pct_with_speaker", F.size("speakers") > 0), ("pct_with_org", F.size("organizations") > 0)))).first().asDict()
    stats.update(detail.agg(F.count_if(~F.col("fetched")).alias("detail_failures"), F.count_if(F.col("parse_error").isNotNull()).alias("parse_failures")).first().asDict())
    good = valid.where("parsed").select("item_url")
    people, orgs = keep("people", people.join(good, "item_url", "left_semi")), keep("organizations", orgs.join(good, "item_url", "left_semi"))
    stats.update(items_parsed=cover["items_parsed"], invalid=invalid.count(), people_extracted=people.count(), organizations_extracted=orgs.count())

    state = {t: store.read(t, s) for t, s in EMPTY.items()}
    new = valid.select(*schema.RECORD.names, "parse_warnings")
    # rows of other sources are not this run's to call unseen
    mine, others = (state["records"].where(c) for c in (F.col("source_name") == source.source_id, F.col("source_name") != source.source_id))
    merged = records.merge(mine, new, "item_url", list(schema.CONTENT), now, records.content_hash, records.carry_rule(), cutoff, "parse_warnings", "extras")
    merged = keep("merged-records", merged)
    counts = records.counts(merged).first().asDict()
    tables = review.write_entities(state, people, orgs, good, keep=keep)
    tables["records"] = others.unionByName(merged.select(*schema.STORED.names))
    tables["discovered_items"] = discovery.upsert_discovered(state["discovered_items"], discovery.discovered_rows(routed))
    links = lambda t: lambda: records.orphans(tables[t], tables["records"])
    try:
        store.publish(run_id, tables, [links("item_people"), links("item_organizations")])
    except Exception as e:
        raise failed("store", e) from e
    out = summary.build(source.source_id, "success", run_id, stats, {"new": counts["new"], "changed": counts["changed"], "unchanged": counts["unchanged"], "not_seen_this_run": counts["not_seen"]}, {k: v for k, v in cover.items() if k != "items_parsed"})
    rejects = landed.sparkSession.createDataFrame([tuple(r) for r in invalid.select("item_url", "errors").limit(1000).collect()], "item_url string, errors array<string>")
    return Result(out, counts, summary.emit(out, logger, previous), rejects)
