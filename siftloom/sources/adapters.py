"""Adapters: how the pages of a kind of site are read.

An adapter gives listing(pages), detail(pages) and normalize(records), each from
DataFrame to DataFrame.  ``Spec`` is one that is declared: selectors of cards and
of detail fields, labels of lines that name people, time rules.  Sites whose items
are not in the markup name a hook, a function from pages and options to entries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, times, urls
from . import html


@runtime_checkable
class ListingParser(Protocol):
    """pages: source_name, page_url, html, fetched_at.  Discoveries, as schema.DISCOVERED."""

    def listing(self, pages: DataFrame) -> DataFrame: ...


@runtime_checkable
class Adapter(ListingParser, Protocol):
    def detail(self, pages: DataFrame) -> DataFrame:
        """pages: item_url, html.  item_url, parse_error, and a string column for each field."""

    def normalize(self, records: DataFrame) -> DataFrame:
        """Listing and detail fields as content of the shared record, with parse_warnings."""


REGISTRY: dict[str, Adapter] = {}
NEEDED = ("listing", "detail", "normalize")


def register(name: str, adapter: Adapter) -> Adapter:
    lacking = [f for f in NEEDED if not callable(getattr(adapter, f, None))]
    if lacking:
        raise ValueError(f"adapter {name} lacks {', '.join(lacking)}")
    REGISTRY[name] = adapter
    return adapter


def load(name: str) -> Adapter:
    if name not in REGISTRY:
        raise ValueError(f"no adapter is registered as {name}")
    return REGISTRY[name]


def discoveries(found: DataFrame, method: str, offset: str | None = None) -> DataFrame:
    """found: source_name, page_url, fetched_at, seq, href, title, timestamp_raw and, if any, timestamp and category.

    The records of one method: URLs resolved and made canonical, others than web
    links left out, titles collapsed, the time stamp given or read from its raw form.
    """
    have = set(found.columns)
    stamp = times.utc(F.col("timestamp_raw"), offset)
    url = urls.canonical(F.col("href"), F.col("page_url"))
    title = text.collapse(F.col("title"))
    out = found.select(
        "source_name",
        url.alias("url"),
        F.lit(method).alias("method"),
        F.when(title != "", title).alias("title"),
        (F.coalesce(F.when(F.col("timestamp") != "", F.col("timestamp")), stamp) if "timestamp" in have else stamp).alias("source_timestamp"),
        F.col("timestamp_raw").alias("source_timestamp_raw"),
        F.col("fetched_at").alias("discovered_at"),
        "page_url",
        (F.col("category") if "category" in have else F.lit(None).cast("string")).alias("category"),
        F.col("seq").cast("long").alias("seq"),
    )
    return out.where("url <> ''")


def from_hook(pages: DataFrame, adapter, options: dict) -> DataFrame:
    """Discoveries of the adapter's hook that options names; the hook gives the columns that discoveries() takes."""
    hook = getattr(adapter, "hooks", {}).get(options.get("hook"))
    if not callable(hook):
        raise ValueError(f"the adapter has no listing hook {options.get('hook')!r}")
    return discoveries(hook(pages, options), "html", options.get("utc_offset"))


@dataclass(frozen=True)
class Spec:
    """A declared adapter.

    container: without it a listing page is not what it was, and gives a parse error.
    start and end: fields that hold the times; clock says how they are written: "utc",
    "relabelled" (Z that means local time), "written" (start_date and start_time as
    '25th Sep 2025' and '15:30 PM'), "scheduled" (header_date and schedule), "dates"
    (a date in one of four forms), or "day" (as '25 Sep 2025').
    """

    cards: html.Cards
    container: str | None = None
    article: str | None = None
    fields: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)
    labels: dict[str, list[str]] = field(default_factory=dict)
    clock: str = "utc"
    offset: str = "+00:00"
    timezone: str | None = None
    title_suffix: str = ""
    location_prefix: str = ""
    description_labels: tuple = ()
    online_words: tuple = ("online",)
    extras: tuple = ()
    hooks: dict[str, Callable] = field(default_factory=dict)

    def listing(self, pages: DataFrame) -> DataFrame:
        return html.listing(pages, self.cards)

    def lost(self, pages: DataFrame) -> DataFrame:
        """page_url and parse_error of listing pages without the container: the site has changed, it is not just empty."""
        if self.container is None:
            return pages.select("page_url", F.lit(None).cast("string").alias("parse_error")).limit(0)
        there = html.fields(pages.select(F.col("page_url").alias("item_url"), "html"), {"has": self.container}, {"has": "*"})
        return there.where("has is null").select(F.col("item_url").alias("page_url"), F.lit(f"no {self.container}: has the layout changed?").alias("parse_error"))

    def detail(self, pages: DataFrame) -> DataFrame:
        wanted = dict(self.fields) | ({"_article": self.article} if self.article else {})
        got = html.fields(pages.select("item_url", "html"), wanted, dict(self.attributes) | {"_article": "*"})
        error = F.when(F.col("_article").isNull(), f"no {self.article}: not a page of an item, or the layout has changed") if self.article else F.lit(None).cast("string")
        return got.select("item_url", error.alias("parse_error"), *self.fields)

    def _times(self, have: set[str]) -> tuple[Column, Column, list[tuple[str, Column, Column]]]:
        """Start, end, and (field, raw, value) of what was read."""
        get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
        read = {"utc": times.utc, "relabelled": lambda c: times.relabelled(c, self.offset), "dates": times.first_date, "day": lambda c: F.date_format(F.try_to_date(F.trim(c), "d MMM yyyy"), "yyyy-MM-dd")}
        if self.clock in read:
            one = read[self.clock]
            start, end = one(get("event_start")), one(get("event_end"))
            checked = [("event_start", get("event_start"), start), ("event_end", get("event_end"), end)]
        elif self.clock == "scheduled":
            start, end = times.scheduled(get("header_date"), get("schedule"), self.offset), F.lit(None).cast("string")
            return start, end, [("event_start", get("header_date"), start)]
        elif self.clock == "written":
            start, end = F.lit(None).cast("string"), times.utc(get("event_end"))
            checked = [("event_end", get("event_end"), end)]
        else:
            raise ValueError(f"no clock is called {self.clock}")
        if {"start_date", "start_time"} <= have:  # of the listing, where the page says nothing
            own = times.utc(get("event_start"))
            fallback = times.written(get("start_date"), get("start_time"), self.offset)
            raw = F.coalesce(get("event_start"), F.trim(F.concat_ws(" ", get("start_date"), get("start_time"))))
            first = F.coalesce(own if self.clock == "written" else start, fallback)
            return first, end, [("event_start", F.when(raw != "", raw), first), *(x for x in checked if x[0] != "event_start")]
        return start, end, checked

    def normalize(self, records: DataFrame) -> DataFrame:
        have = set(records.columns)
        get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
        filled = lambda c: F.when(c != "", c)
        clean = lambda c: filled(text.collapse(c))
        cut = lambda c, end: F.when(c.endswith(end), F.substring(c, 1, F.length(c) - len(end))).otherwise(c) if end else c
        start, end, checked = self._times(have)
        warnings = F.map_from_entries(F.filter(F.array(*(F.when((raw != "") & value.isNull(), F.struct(F.lit(name).alias("key"), raw.alias("value"))) for name, raw, value in checked)), lambda x: x.isNotNull()))
        location = clean(F.regexp_replace(text.collapse(get("location")), f"^{self.location_prefix}", "") if self.location_prefix else get("location"))
        description = clean(get("description"))
        if self.description_labels:
            description = filled(F.regexp_replace(description, rf"(?i)^(?:{'|'.join(self.description_labels)})\s*:\s*", ""))
        online = F.when(location.rlike(rf"(?i)\b(?:{'|'.join(self.online_words)})\b"), True)
        extras = F.map_filter(F.create_map(*(x for k in self.extras for x in (F.lit(k), get(k).cast("string")))), lambda _, v: v.isNotNull()) if self.extras else F.create_map().cast("map<string,string>")
        own = {
            "title": cut(clean(get("title")), self.title_suffix),
            "event_start": start,
            "event_end": end,
            "timezone": F.lit(self.timezone).cast("string"),
            "location": location,
            "is_online": online,
            "event_type": clean(F.coalesce(filled(get("event_type")), get("category"))),
            "description": description,
            "extras": extras,
            "parse_warnings": warnings,
        }
        if "speaker" in have:
            own["speakers"] = speakers(get("speaker"), get("affiliation"))
        rest = [c for c in records.columns if c not in own and c not in (*self.fields, "speaker", "affiliation", "start_date", "start_time", "category")]
        return records.select(*rest, *(v.alias(k) for k, v in own.items()))


def speakers(raw: Column, affiliation: Column) -> Column:
    """One speaker of text like 'Prof A B, Some Place': up to the first comma the name, without titles; behind it, or given apart, the affiliation."""
    t = text.collapse(raw)
    name = F.regexp_replace(F.substring_index(t, ", ", 1), r"(?i)^(?:prof(?:essor)?|dr)\.?\s+", "")
    behind = F.when(t.contains(", "), F.substring(t, F.instr(t, ", ") + 2, F.length(t)))
    one = F.struct(F.coalesce(F.when(F.trim(behind) != "", F.trim(behind)), F.when(affiliation != "", affiliation)).alias("affiliation"), F.trim(name).alias("name"))
    return F.when(F.trim(name) != "", F.array(one)).otherwise(F.array().cast("array<struct<affiliation:string,name:string>>"))


def listing_rows(blocks: DataFrame, labels: tuple = ("Speaker", "Date", "Dates", "Time", "Venue")) -> DataFrame:
    """blocks: page_url, seq, lines (array), speaker, year, ref.  Items of a list page without links, from the lines of each block.

    Line one is the header date, line two the series; labelled lines come in any
    order; schedule lines stand before the last label; the title is between it and
    the speaker's own line; identity is made from the site's own year and number.
    """
    known = rf"(?i)^(?:{'|'.join(labels)}|Date of lecture \d+)\s*:"
    body = F.slice("lines", 3, F.greatest(F.size("lines") - 2, F.lit(0)))
    b = blocks.withColumn("_at", F.array_position(body, F.col("speaker"))).withColumn("_all", body)
    b = b.withColumn("_head", F.when(F.col("_at") > 0, F.slice("_all", F.lit(1), (F.col("_at") - 1).cast("int"))).otherwise(F.col("_all")))
    last = F.array_max(F.filter(F.transform("_head", lambda x, i: F.when(x.rlike(known), i + 1)), lambda i: i.isNotNull()))
    b = b.withColumn("_last", F.coalesce(last, F.lit(0)))
    value = lambda label: F.get(F.filter(F.transform(F.filter("lines", lambda x: x.startswith(label)), lambda x: F.trim(F.substring(x, len(label) + 1, 100_000))), lambda x: x.isNotNull()), F.lit(0))
    timed = F.filter(F.slice("_head", F.lit(1), F.col("_last")), lambda x: ~x.rlike(known) | F.lower(x).startswith("time"))
    schedule = F.array_join(F.filter(F.transform(timed, lambda x: F.regexp_replace(x, r"(?i)^Time\s*:\s*", "")), lambda x: x != ""), " | ")
    title = text.joined_lines(F.slice("_head", F.col("_last") + 1, F.greatest(F.size("_head") - F.col("_last"), F.lit(0))))
    behind = F.when(F.col("_at") > 0, F.get("_all", F.col("_at").cast("int")))
    return b.select(
        urls.synthetic(F.col("page_url"), F.col("year"), F.col("ref")).alias("item_url"), "page_url", "seq",
        F.get("lines", F.lit(0)).alias("header_date"), F.get("lines", F.lit(1)).alias("category"), value("Date:").alias("date_raw"),
        F.when(schedule != "", schedule).alias("schedule"), value("Venue:").alias("location"), title.alias("title"), "speaker",
        F.regexp_replace(behind, r"\.+$", "").alias("affiliation"),
    )


# Selectors and labels of the kinds of sites that are known.
MENTION_LABELS = {
    "speaker": ["Speaker", "Speakers", "Guest Speaker", "Keynote Speaker"],
    "chair": ["Chair", "Chairperson", "Session Chair", "Chaired by"],
    "moderator": ["Moderator", "Moderated by"],
    "host": ["Host", "Hosted by"],
    "organizer": ["Organizer", "Organiser", "Organizers", "Organisers", "Organized by", "Organised by"],
    "co-organizer": ["Co-organizer", "Co-organiser", "Co-organized by", "Co-organised by"],
}
TALK_FIELDS = {
    "title": "title",
    "speaker": ".field--name-field-event-speaker .field__item",
    "event_start": ".field--name-field-event-date .field__item time",
    "event_end": ".field--name-field-event-end-date .field__item time",
    "location": ".field--name-field-event-location .field__item",
    "event_type": ".field--name-field-event-type .field__item",
    "description": ".field--name-body",
    "image_url": ".field--name-field-event-image .field__item img",
    "detail_canonical_url": "link[rel=canonical]",
    "node_id": "article.node--type-events",
}
TALK_ATTRIBUTES = {"event_start": "datetime", "event_end": "datetime", "image_url": "src", "detail_canonical_url": "href", "node_id": "data-history-node-id"}

TALKS = register("talks", Spec(
    cards=html.Cards(item=".view-seminars-and-talks .view-content .event-card-wrapper", link=".event-name a", category=".event-category span", next_page="a[rel~=next]"),
    container=".view-seminars-and-talks .view-content", article="article.node--type-events", fields=TALK_FIELDS, attributes=TALK_ATTRIBUTES, clock="written", offset="+05:30",
    timezone="Asia/Kolkata", title_suffix=" | Humanities and Social Sciences", description_labels=("Abstract", "Description"), extras=("node_id", "detail_canonical_url"),
))
EVENTS = register("events", Spec(
    cards=html.Cards(item=".homepage-events .views-row", link=".views-field-title a", date=".views-field-field-event-date time"), article="article.node--type-event",
    fields={"title": ".field--name-title", "event_start": ".field--name-field-event-date time", "location": ".field--name-field-vanue", "event_type": ".field--name-field-event-type", "description": ".field--name-body"},
    attributes={"event_start": "datetime"}, labels=MENTION_LABELS, clock="relabelled", offset="+05:30", timezone="Asia/Kolkata", location_prefix="Venue ", online_words=("\0",),
))
SEMINAR_LIST = register("seminar-list", Spec(
    cards=html.Cards(item="div.page_content li"), container="div.page_content", clock="scheduled", offset="+05:30", timezone="Asia/Kolkata", online_words=("online", "zoom"), extras=("header_date", "date_raw", "schedule"),
))
DEPARTMENT_CARDS = register("department-cards", Spec(
    cards=html.Cards(item=".region-content div.card.my-4", link="a.marooncolor[href]", title="h5", date="time[datetime]", next_page="a[rel~=next]"), container=".region-content", article="article.node--type-events",
    fields={"title": "title", "description": ".col-12.pl-0.pb-4", "detail_canonical_url": "link[rel=canonical]", "node_id": "article.node--type-events"},
    attributes={"detail_canonical_url": "href", "node_id": "data-history-node-id"}, clock="relabelled", offset="+05:30", timezone="Asia/Kolkata",
    title_suffix=" | The Department of Mechanical Engineering", online_words=("online", "zoom", "teams", "webex", "google meet"), extras=("node_id", "detail_canonical_url"),
))
DATED_CARDS = register("dated-cards", Spec(
    cards=html.Cards(item=".view-events-listing .view-content .views-row", link="a.event-link[href]", title=".event-title", date=".event-date time", category=".event-venue"),
    container=".view-events-listing .view-content", clock="dates",
))
NEWS_CARDS = register("news-cards", Spec(cards=html.Cards(item=".views-row", title=".news-card-title", date="time"), clock="day"))


def news(records: DataFrame, base: str) -> DataFrame:
    """records: title, item_url, date_raw, image_url, image_alt, raw_text.  News as the first sink took it: published_at of dates like '3 Feb 2026', links resolved against base and otherwise left."""
    t = lambda c: F.when(text.collapse(F.col(c)) != "", text.collapse(F.col(c)))
    link = lambda c: F.when(F.trim(F.col(c)) != "", urls.resolved(F.trim(F.col(c)), F.lit(base)))
    return records.select(t("title").alias("title"), link("item_url").alias("item_url"), "date_raw", F.date_format(F.try_to_date(F.trim("date_raw"), "d MMM yyyy"), "yyyy-MM-dd").alias("published_at"), link("image_url").alias("image_url"), t("image_alt").alias("image_alt"), F.trim("raw_text").alias("raw_text"))
