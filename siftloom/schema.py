"""The shared record and the tables beside it."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SPEAKERS = T.ArrayType(_struct(affiliation=S, name=S))
IDENTITY = ("item_url", "source_name", "institution")
#: Fields that say what the item is, in the order of their names: the content hash is over these.
CONTENT = ("description", "event_end", "event_start", "event_type", "is_online", "item_type", "location", "organizations", "speakers", "timezone", "title")
PROVENANCE = ("source_url", "raw_text", "fetched_at", "http_status", "detail_fetched_at", "detail_http_status", "detail_fetch_status", "detail_error")
REQUIRED = ("item_url", "source_name", "institution", "item_type", "title", "source_url", "fetched_at", "http_status", "detail_fetch_status")
ITEM_TYPES, DETAIL_STATUS = ("event",), ("ok", "failed", "not_attempted")
_TYPES = {"speakers": SPEAKERS, "organizations": T.ArrayType(S), "is_online": T.BooleanType(), "http_status": T.IntegerType(), "detail_http_status": T.IntegerType()}
RECORD = T.StructType([T.StructField(f, _TYPES.get(f, S)) for f in (*IDENTITY, *CONTENT, *PROVENANCE)] + [T.StructField("extras", T.MapType(S, S))])
STORED = T.StructType([*RECORD.fields, T.StructField("content_hash", S), T.StructField("first_seen_at", S), T.StructField("last_seen_at", S)])
DISCOVERED = _struct(source_name=S, url=S, method=S, title=S, source_timestamp=S, source_timestamp_raw=S, discovered_at=S, page_url=S, category=S, seq=T.LongType())
PEOPLE = _struct(normalized_name=S, display_name=S, honorific=S, profile_url=S)
ORGANIZATIONS = _struct(normalized_name=S, display_name=S, org_type=S, url=S)
ITEM_PEOPLE = _struct(item_url=S, normalized_name=S, role=S, affiliation_raw=S, source_text=S)
ITEM_ORGANIZATIONS = _struct(item_url=S, normalized_name=S, role=S, source_text=S)
REVIEW = _struct(kind=S, a_id=T.LongType(), b_id=T.LongType(), reason=S, status=S)
DISCOVERED_ITEMS = _struct(discovered_url=S, source_name=S, discovery_methods=T.ArrayType(S), discovered_title=S, source_timestamp=S, source_timestamp_raw=S, first_discovered_at=S, last_discovered_at=S, in_scope=T.BooleanType(), scope_reason=S, content_class=S, class_reason=S)
#: Items of the first and second kind of sink.
NEWS_ITEMS = _struct(item_url=S, title=S, published_at=S, image_url=S, image_alt=S, raw_text=S, content_hash=S, first_seen=S, last_seen=S)
LEGACY_ITEMS = _struct(source_name=S, source_url=S, item_url=S, item_type=S, title=S, published_at=S, venue=S, description=S, raw_text=S, first_seen_at=S, last_seen_at=S, content_hash=S)
PERSON_MENTION = _struct(name=S, honorific=S, role=S, affiliation_raw=S, source_text=S)
ORGANISATION_MENTION = _struct(name=S, role=S, org_type=S, parent_raw=S, acronym=S, source_text=S)
RUN_METRICS = _struct(http_status=T.IntegerType(), pages_fetched=T.LongType(), items_discovered=T.LongType(), items_parsed=T.LongType(), not_seen_count=T.LongType(), parse_failures=T.LongType(), detail_failures=T.LongType(), people_extracted=T.LongType(), organizations_extracted=T.LongType(), pct_with_date=T.DoubleType(), pct_with_speaker=T.DoubleType(), pct_with_org=T.DoubleType())
#: What happens to a run, one row for each event; the last event of a run is its current row.
RUN_EVENTS = T.StructType([*_struct(run_id=S, event_seq=T.LongType(), source_id=S, started_at=S, finished_at=S, status=S, new_count=T.LongType(), unchanged_count=T.LongType(), changed_count=T.LongType(), failed_count=T.LongType(), error=S).fields, *RUN_METRICS.fields])
RUN_STATUS = ("running", "success", "failed", "skipped")
RUNS = _struct(run_id=S, source_id=S, started_at=S, finished_at=S, status=S, new_count=T.LongType(), unchanged_count=T.LongType(), changed_count=T.LongType(), failed_count=T.LongType(), items_discovered=T.LongType(), items_parsed=T.LongType(), pct_with_date=T.DoubleType(), pct_with_speaker=T.DoubleType(), pct_with_org=T.DoubleType(), error=S)
