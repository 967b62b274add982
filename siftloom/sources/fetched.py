"""Fetched responses as they land: failures as data, robots rules, pauses between requests, charsets, JSON files and configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls


def usable(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """responses: http_status and others.  Those with a body to read, and failures with error_type and error_reason."""
    bad = F.col("http_status").isNull() | (F.col("http_status") >= 400)
    kind = F.coalesce(F.col("error_type"), F.lit("http_error")) if "error_type" in responses.columns else F.when(F.col("http_status").isNull(), "no_response").otherwise("http_error")
    return responses.where(~bad), responses.where(bad).withColumn("error_type", kind).withColumn("error_reason", F.concat(F.lit("HTTP "), F.coalesce(F.col("http_status").cast("string"), F.lit("none"))))


def allowed(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """requests: url; robots: origin, http_status, disallow and allow (arrays of path prefixes).  Adds allowed.

    A status of 4xx allows all, none or 5xx nothing; else the longest rule that
    fits decides, and allow wins a tie.  One small row for each origin is joined.
    """
    r = robots.select(F.col("origin").alias("_o"), F.col("http_status").alias("_s"), "disallow", "allow")
    q = requests.withColumn("_origin", F.concat(F.lower(urls.part(F.col("url"), 1)), F.lit("://"), F.lower(urls.part(F.col("url"), 2)))).withColumn("_path", urls.path(F.col("url")))
    longest = lambda c: F.coalesce(F.array_max(F.transform(F.filter(c, lambda p: (p != "") & F.startswith(F.col("_path"), p)), F.length)), F.lit(0))
    j = q.join(r, F.col("_origin") == F.col("_o"), "left")
    ok = F.when(F.col("_s").isNull() | (F.col("_s") >= 500), False).when(F.col("_s") >= 400, True).otherwise(longest(F.col("allow")) >= longest(F.col("disallow")))
    return j.select(*requests.columns, ok.alias("allowed"))


def pauses(responses: DataFrame, delay_s: float) -> DataFrame:
    """url and fetched_at: seconds since the request before to the same host, and whether that is less than the delay."""
    w = Window.partitionBy(urls.host(F.col("url"))).orderBy("fetched_at", "url")
    gap = F.unix_timestamp("fetched_at") - F.unix_timestamp(F.lag("fetched_at").over(w))
    return responses.select("url", "fetched_at", gap.alias("pause_s"), F.coalesce(gap < delay_s, F.lit(False)).alias("too_soon"))


CHARSETS = ("ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")


def charset(body: Column, content_type: Column) -> Column:
    """The charset that the content type names, else what the bytes say: a mark at their start, a declaration in the first kilobyte, valid UTF-8, else ISO-8859-1."""
    named = F.upper(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w.-]+)", 1))
    head = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")
    declared = F.upper(F.coalesce(F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?\s*([\w.-]+)", 1), F.lit("")), F.nullif(F.regexp_extract(head, r"(?i)^\s*<\?xml[^>]+encoding=[\"']([\w.-]+)", 1), F.lit(""))))
    first = F.hex(F.substring(body, 1, 3))
    mark = F.when(first.startswith("EFBBBF"), "UTF-8").when(first.startswith("FEFF") | first.startswith("FFFE"), "UTF-16")
    same = lambda c: F.when(c.isin("LATIN-1", "LATIN1", "ISO8859-1", "WINDOWS-1252", "CP1252"), "ISO-8859-1").when(c.isin("ASCII"), "US-ASCII").otherwise(c)
    return same(F.coalesce(F.nullif(named, F.lit("")), mark, declared, F.when(F.is_valid_utf8(body.cast("string")), "UTF-8").otherwise("ISO-8859-1")))


def body_text(body: Column, content_type: Column) -> Column:
    """Text of bytes by their charset; one that isn't known here is read as UTF-8, with signs for what is invalid."""
    name = charset(body, content_type)
    out = F.when(name == CHARSETS[0], F.decode(body, CHARSETS[0]))
    for c in CHARSETS[1:]:
        out = out.when(name == c, F.decode(body, c))
    return F.regexp_replace(out.otherwise(F.make_valid_utf8(body.cast("string"))), "^\ufeff", "")


def headers(responses: DataFrame) -> DataFrame:
    """responses: url, final_url, http_status, content_type, body.  What a look at the headers tells: media type and charset apart, length, whether it was redirected and to another host."""
    mime = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    final = F.coalesce("final_url", "url")
    return responses.select("url", final.alias("final_url"), "http_status", mime.alias("media_type"), charset(F.col("body"), F.col("content_type")).alias("charset"), F.length("body").cast("long").alias("length"), (final != F.col("url")).alias("redirected"), (urls.host(final) != urls.host(F.col("url"))).alias("other_host"))


def unpacked(responses: DataFrame, now: str) -> DataFrame:
    """Responses with all columns of a landed fetch: what a fetch did not say stays null, the status too, but for the final URL and the time."""
    kinds = {"final_url": "string", "http_status": "int", "content_type": "string", "fetched_at": "string", "body": "string"}
    have = set(responses.columns)
    missing = {"final_url": F.col("url"), "fetched_at": F.lit(now)}
    return responses.select(*responses.columns, *(missing.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items() if c not in have))


def json_items(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON array of items, or a file of JSON lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out."""
    df.write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def configurations(df: DataFrame, known: tuple, key: str = "source_id", needed: tuple = ()) -> DataFrame:
    """What is wrong with configurations held as (source_id, settings map): unknown keys, needed ones that lack, and repeated ids, one row for each fault."""
    names = lambda keys: F.array(*map(F.lit, keys)).cast("array<string>")
    fault = lambda said, keys: df.select(key, F.explode(keys).alias("k")).select(key, F.concat(F.lit(said), "k").alias("fault"))
    have = F.map_keys("settings")
    return fault("unknown key: ", F.array_except(have, names(known))).unionByName(fault("needed key: ", F.array_except(names(needed), have))).unionByName(df.groupBy(key).count().where("count > 1").select(key, F.lit("repeated id").alias("fault")))
