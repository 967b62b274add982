"""Records: assembly, validation, content hash, and the merge of a batch into what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import times, urls


def blank(c: Column, kind: str) -> Column:
    """Null, '', [] or {}."""
    if kind.startswith(("array", "map")):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def assemble(merged: DataFrame, sources: DataFrame) -> DataFrame:
    """merged: source_name and what listing, detail and adapter gave; sources: source_name, institution, item_type, organizer, listing_url.

    Identity comes from the source alone; without organisations of its own a
    record has the source's organizer.
    """
    s = sources.select("source_name", F.col("institution").alias("_i"), F.col("item_type").alias("_t"), F.col("organizer").alias("_o"), F.col("listing_url").alias("_l"))
    j = merged.join(s, "source_name")
    have = set(merged.columns)
    get = lambda f: F.col(f).cast(schema.RECORD[f].dataType) if f in have else F.lit(None).cast(schema.RECORD[f].dataType)
    own = {
        "institution": F.col("_i"),
        "item_type": F.col("_t"),
        "source_url": F.col("_l"),
        "organizations": F.when(F.size(F.coalesce(get("organizations"), F.array().cast("array<string>"))) > 0, get("organizations")).when(F.coalesce(F.col("_o"), F.lit("")) != "", F.array("_o")).otherwise(F.array().cast("array<string>")),
        "speakers": F.coalesce(get("speakers"), F.array().cast(schema.SPEAKERS)),
        "extras": F.coalesce(get("extras"), F.create_map().cast("map<string,string>")),
    }
    return j.select(*(own.get(f.name, get(f.name)).alias(f.name) for f in schema.RECORD.fields))


def errors(df: DataFrame) -> Column:
    """array of what is wrong with each record of df, all of it, in a fixed order; empty if nothing is."""
    kinds = dict(df.dtypes)
    col = lambda f: F.col(f)
    checks: list[tuple[Column, Column | str]] = [(blank(col(f), kinds[f]), f"{f}: required") for f in schema.REQUIRED if f in kinds]
    for f in ("fetched_at", "detail_fetched_at"):
        if f in kinds:
            checks.append((~col(f).rlike(times.INSTANT), F.concat(F.lit(f"{f}: expected ISO 8601 UTC 'YYYY-MM-DDTHH:MM:SSZ', got '"), col(f), F.lit("'"))))
    for f in ("event_start", "event_end"):
        if f in kinds:
            checks.append((~(times.is_date(col(f)) | col(f).rlike(times.INSTANT)), F.concat(F.lit(f"{f}: expected ISO 8601 UTC 'YYYY-MM-DDTHH:MM:SSZ' or date-only 'YYYY-MM-DD', got '"), col(f), F.lit("'"))))
    if "item_url" in kinds:
        checks.append(((col("item_url") != "") & (urls.canonical(col("item_url")) != col("item_url")), F.concat(F.lit("item_url: not canonical ('"), col("item_url"), F.lit("')"))))
    if "item_type" in kinds:
        checks.append((~col("item_type").isin(*schema.ITEM_TYPES), "item_type: expected one of event"))
    if {"event_start", "event_end"} <= set(kinds):
        dated = times.is_date(col("event_start"))
        if "timezone" in kinds:
            checks.append((dated & (F.coalesce(col("timezone"), F.lit("")) == ""), "timezone: required when event_start is date-only (it is a local calendar date)"))
        mixed = dated != times.is_date(col("event_end"))
        both = col("event_start").isNotNull() & col("event_end").isNotNull()
        checks += [(both & mixed, "event_end: must be date-only exactly when event_start is"), (both & ~mixed & (col("event_end") < col("event_start")), "event_end: earlier than event_start")]
    last = []
    if "detail_fetch_status" in kinds:
        last.append((~F.coalesce(col("detail_fetch_status").isin(*schema.DETAIL_STATUS), F.lit(False)), "detail_fetch_status: expected one of ok, failed, not_attempted"))

    def said(some: list) -> Column:
        found = F.array(*(F.when(F.coalesce(bad, F.lit(False)), text if isinstance(text, Column) else F.lit(text)) for bad, text in some)).cast("array<string>")
        return F.filter(found, lambda x: x.isNotNull())

    # faults of list entries come with their places
    place = lambda f, i, what: F.concat(F.lit(f"{f}["), i.cast("string"), F.lit(f"]{what}"))
    lists = {
        "speakers": lambda s, i: F.when(s.isNull(), place("speakers", i, ": expected name and affiliation")).when(F.coalesce(s.getField("name"), F.lit("")) == "", place("speakers", i, ".name: required str")),
        "organizations": lambda o, i: F.when(F.coalesce(o, F.lit("")) == "", place("organizations", i, ": expected non-empty str")),
    }
    entries = [F.filter(F.transform(F.coalesce(col(f), F.array().cast(kinds[f])), fault), lambda x: x.isNotNull()) for f, fault in lists.items() if f in kinds]
    return F.concat(said(checks), *entries, said(last))


def content_hash(df: DataFrame) -> Column:
    """SHA-256 of the content fields as compact JSON with sorted keys; lists sorted, so their order is no change."""
    empty = F.lit("")
    by = lambda a, b: F.when(F.coalesce(a["name"], empty) != F.coalesce(b["name"], empty), F.when(F.coalesce(a["name"], empty) < F.coalesce(b["name"], empty), -1).otherwise(1)).when(F.coalesce(a["affiliation"], empty) == F.coalesce(b["affiliation"], empty), 0).when(F.coalesce(a["affiliation"], empty) < F.coalesce(b["affiliation"], empty), -1).otherwise(1)
    own = {"speakers": F.array_sort("speakers", by), "organizations": F.array_sort("organizations")}
    return F.sha2(F.to_json(F.struct(*(own.get(f, F.col(f)).alias(f) for f in schema.CONTENT if f in df.columns)), {"ignoreNullFields": "false"}), 256)


def legacy_hash(*columns: Column, missing: str = "") -> Column:
    """SHA-256 of fields joined by |; missing stands for null."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit(missing)) for c in columns)), 256)


def last_of_each(batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """One row for each key, the one of the greatest seq, with partial aggregation and no sort."""
    others = [c for c in batch.columns if c not in key]
    return batch.groupBy(*key).agg(F.max_by(F.struct(*others), seq).alias("_r")).select(*key, *(F.col(f"_r.{c}").alias(c) for c in others))


def merge(old: DataFrame, new: DataFrame, key: str, content: Sequence[str], now: str, digest, carry: Column | None = None, cutoff: str | None = None, unparsed: str | None = None, extras: str | None = None) -> DataFrame:
    """The next state of a table: old rows that new doesn't have, and new rows, with state and rediscovered.

    content: columns that the hash is over.  A blank one of a new row keeps its old
    value where carry holds (a missing value that the run can't vouch for), and
    where the map unparsed of new names it (it was there and could not be read);
    where carry holds the map extras gets its old entries too, new ones win.
    digest: DataFrame -> Column.  state is new, changed, unchanged or not_seen, by
    the hash after that; first_seen_at stays, last_seen_at is now for rows of new.
    rediscovered: last seen before cutoff.  One full join on the key.
    """
    kinds = dict(new.dtypes)
    stored = [c for c in old.columns if c != key]
    o = old.select(F.col(key).alias("_key"), F.struct(*stored).alias("_old"))
    n = new.select(key, F.struct(*(c for c in new.columns if c != key)).alias("_new"))
    j = o.join(n, o["_key"] == n[key], "full_outer")
    fresh, known = F.col("_new").isNotNull(), F.col("_old").isNotNull()

    def value(c: str) -> Column:
        now_, before = F.col(f"_new.{c}"), F.col(f"_old.{c}") if c in stored else F.lit(None).cast(kinds[c])
        held = F.coalesce(carry, F.lit(False)) if carry is not None else F.lit(False)
        if unparsed is not None:
            held = held | F.coalesce(F.array_contains(F.map_keys(F.col(f"_new.{unparsed}")), c), F.lit(False))
        if (carry is not None or unparsed is not None) and c in content:
            now_ = F.when(known & held & blank(now_, kinds[c]) & ~blank(before, kinds[c]), before).otherwise(now_)
        if c == extras and carry is not None:
            none = F.create_map().cast(kinds[c])
            fresh_ = F.coalesce(now_, none)
            old_ = F.map_filter(F.coalesce(before, none), lambda k, _: ~F.map_contains_key(fresh_, k))
            now_ = F.when(known & F.coalesce(carry, F.lit(False)), F.map_concat(old_, fresh_)).otherwise(now_)
        return F.when(fresh, now_).otherwise(before).alias(c)

    out = j.select(F.coalesce(F.col(key), F.col("_key")).alias(key), *(value(c) for c in new.columns if c != key), fresh.alias("_fresh"), known.alias("_known"), F.col("_old.content_hash").alias("_hash"), F.col("_old.first_seen_at").alias("_first"), F.col("_old.last_seen_at").alias("_last"))
    out = out.withColumn("content_hash", F.when(F.col("_fresh"), digest(out)).otherwise(F.col("_hash")))
    state = F.when(~F.col("_fresh"), "not_seen").when(~F.col("_known"), "new").when(F.col("_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    back = F.col("_fresh") & F.col("_known") & F.coalesce(F.col("_last") < F.lit(cutoff), F.lit(False))
    return out.select(*(c for c in new.columns if c != unparsed), "content_hash", F.coalesce("_first", F.lit(now)).alias("first_seen_at"), F.when(F.col("_fresh"), F.lit(now)).otherwise(F.col("_last")).alias("last_seen_at"), state.alias("state"), back.alias("rediscovered"))


def carry_rule(detail_status: str = "_new.detail_fetch_status") -> Column:
    """Missing content is no evidence where the detail page was not read."""
    return F.coalesce(F.col(detail_status), F.lit("")) != "ok"


def counts(merged: DataFrame) -> DataFrame:
    """new, changed, unchanged, not_seen and rediscovered rows of a merge."""
    return merged.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged", "not_seen")), F.count_if("rediscovered").alias("rediscovered"))


def fold_in_order(batch: DataFrame, key: str, seq: str, content_key: str) -> DataFrame:
    """state of every occurrence of a key within one batch of new keys: the first is new, a later one is compared with the one before it."""
    before = F.lag(content_key).over(Window.partitionBy(key).orderBy(seq))
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    return batch.withColumn("state", F.when(first, "new").when(before == F.col(content_key), "unchanged").otherwise("changed"))


def upsert_links(old: DataFrame, new: DataFrame, keys: Sequence[str], replaced: DataFrame | None = None, item: str = "item_url") -> DataFrame:
    """Links of replaced items go, other old ones stay, and new ones that aren't there are added."""
    kept = old if replaced is None else old.join(replaced.select(item).distinct(), item, "left_anti")
    return kept.unionByName(new.dropDuplicates(list(keys)).join(kept.select(*keys), list(keys), "left_anti"))


def numbered(df: DataFrame, *order: str, first: int = 1, name: str = "id") -> DataFrame:
    """df with numbers from first on by order, and no task that sees all rows: ranges of the order are counted, then each is numbered from what stands before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is asked for is not coalesced
    # kept, as the borders of ranges come from a sample that differs from job to job
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_at", 33)
    sizes = [(r[0], r[1]) for r in parts.groupBy(part.alias("p")).count().orderBy("p").collect()]  # one row for each partition
    starts, total = [], first
    for p, size in sizes:
        starts.append((p, total))
        total += size
    t = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    return parts.join(F.broadcast(t), part == F.col("_p")).withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_p", "_start")


def first_forms(dimension: DataFrame, mentions: DataFrame, key: str = "normalized_name", seq: str = "seq") -> DataFrame:
    """dimension (id, key, ...) with the first form of each key of mentions that it lacks; ids go on by seq."""
    others = [c for c in dimension.columns if c not in ("id", key)]
    new = mentions.where(F.col(key) != "").groupBy(key).agg(F.min_by(F.struct(*others), seq).alias("_f"), F.min(seq).alias("_s")).join(dimension.select(key), key, "left_anti")
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(new, "_s", key, first=top + 1)
    return dimension.unionByName(new.select(F.col("id").cast(dimension.schema["id"].dataType), key, *(F.col(f"_f.{c}").alias(c) for c in others)))


def orphans(links: DataFrame, records: DataFrame, key: str = "item_url") -> DataFrame:
    """Links without a record: must be empty before a publication."""
    return links.join(records.select(key), key, "left_anti")


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def stored(old: DataFrame, batch: DataFrame, key: str, content: Sequence[str], now: str, missing: str = "None") -> DataFrame:
    """Items of the first kind of sink against what is stored: key and state (new, known, updated; skipped without a key), by the hash of content."""
    keyed = batch.withColumn("_h", legacy_hash(*(F.col(c) for c in content), missing=missing))
    j = keyed.join(old.select(F.col(key).alias("_k"), F.col("content_hash").alias("_old")), F.col(key) == F.col("_k"), "left")
    state = F.when(F.coalesce(F.col(key), F.lit("")) == "", "skipped").when(F.col("_k").isNull(), "new").when(F.col("_h") == F.col("_old"), "known").otherwise("updated")
    return j.select(*batch.columns, F.col("_h").alias("content_hash"), state.alias("state"))
