"""Canonical URLs as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Query keys that track visitors or sessions.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "ref_src", "sid", "phpsessid", "jsessionid", "aspsessionid", "sessionid", "session_id")
#: The parts of a URI reference, by RFC 3986, appendix B: scheme, authority, path, query, fragment.
PARTS = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(.*)$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' if absent."""
    return F.regexp_extract(url, PARTS, n)


def host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def path(url: Column) -> Column:
    p = part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def decode(c: Column) -> Column:
    """Percent decoding; what can't be decoded stays, with + as a space."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def pairs(query: Column) -> Column:
    """array of struct(k, v), decoded, in the query's order; empty parts are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"), decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))


def tracking(key: Column) -> Column:
    k = F.lower(key)
    return k.startswith("utm_") | k.isin(*TRACKING)


def clean_query(query: Column) -> Column:
    """Without tracking keys, sorted by key (equal keys keep their order), encoded again."""
    left = F.filter(pairs(query), lambda p: ~tracking(p.getField("k")))
    numbered = F.transform(left, lambda p, i: F.struct(p.getField("k").alias("k"), i.alias("i"), p.getField("v").alias("v")))
    return F.array_join(F.transform(F.array_sort(numbered), lambda p: F.concat(encode(p.getField("k")), F.lit("="), encode(p.getField("v")))), "&")


def _climb(segments: Column) -> Column:
    """Dot segments resolved."""
    step = lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))
    out = F.aggregate(segments, F.array().cast("array<string>"), step)
    out = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
    joined = F.array_join(out, "/")
    return F.when(joined == "", "/").otherwise(joined)


def _resolved_path(base_path: Column, p: Column) -> Column:
    base = F.split(base_path, "/")
    base = F.when(F.element_at(base, -1) != "", F.slice(base, 1, F.greatest(F.lit(0), F.size(base) - 1))).otherwise(base)
    own = F.split(p, "/")
    all_ = F.when(p.startswith("/"), own).otherwise(F.concat(base, own))
    n = F.size(all_)
    kept = F.filter(F.transform(all_, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: (x.getField("s") != "") | (x.getField("i") == 0) | (x.getField("i") == n - 1))
    return _climb(F.transform(kept, lambda x: x.getField("s")))


def canonical(href: Column, page: Column | None = None) -> Column:
    """The canonical URL of an href on a page, '' if it has none.

    Resolved against the page; scheme and host in lower case, default ports,
    tracking keys, path sessions and fragments gone (but for #/ and #!/, which
    name an item), other keys sorted, the path as it is.
    """
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""), r"[\t\r\n]", "")
    raw = F.struct(clean(href).alias("h"), clean(page if page is not None else F.lit("")).alias("b"))
    return let(raw, lambda r: let(_split(r), lambda s: let(_joined(s), _written)))


def resolved(href: Column, page: Column) -> Column:
    """The href against the page by RFC 3986, otherwise as it is: no key is dropped and nothing sorted."""
    both = F.struct(F.trim(F.coalesce(href, F.lit(""))).alias("h"), F.coalesce(page, F.lit("")).alias("b"))

    def written(s: Column) -> Column:
        bare = (s["own"] == "") & (s["auth"] == "")
        path_ = F.when(~bare, s["path"]).when(s["path"] == "", s["base_path"]).otherwise(_resolved_path(s["base_path"], s["path"]))
        query = F.when(bare & (s["path"] == "") & ~s["asks"], s["base_query"]).otherwise(s["query"])
        authority = F.when(bare, s["base_auth"]).otherwise(s["auth"])
        scheme = F.when(s["own"] != "", s["own"]).otherwise(s["base"])
        tail = lambda sign, c: F.when(c != "", F.concat(F.lit(sign), c)).otherwise("")
        return F.concat(scheme, F.lit(":"), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""), path_, tail("?", query), tail("#", s["frag"]))

    return let(both, lambda r: let(_split(r), written))


def _split(r: Column) -> Column:
    """Scheme, and what follows it, of the href; the parts of the page."""
    h, b = r["h"], r["b"]
    own = F.lower(F.regexp_extract(h, SCHEME, 1))
    rest = F.when(own != "", F.regexp_extract(h, SCHEME, 2)).otherwise(h)
    names = ("auth", "path", "query", "frag")
    both = [part(rest, n).alias(k) for n, k in enumerate(names, 2)] + [part(b, n).alias(f"base_{k}") for n, k in enumerate(names, 2)]
    return F.struct((h != "").alias("some"), own.alias("own"), F.lower(part(b, 1)).alias("base"), rest.contains("?").alias("asks"), *both)


def _joined(s: Column) -> Column:
    """Scheme, authority, path, query and fragment of the href against the page."""
    whole = (s["own"] != "") & ((s["own"] != s["base"]) | (s["auth"] != ""))
    bare = ~whole & (s["auth"] == "")
    scheme = F.when(s["own"] != "", s["own"]).when((s["auth"] != "") & (s["base"] == ""), "https").otherwise(s["base"])
    path_ = F.when(~bare, s["path"]).when(s["path"] == "", s["base_path"]).otherwise(_resolved_path(s["base_path"], s["path"]))
    query = F.when(bare & (s["path"] == "") & ~s["asks"], s["base_query"]).otherwise(s["query"])
    authority = F.when(bare, s["base_auth"]).otherwise(s["auth"])
    name = F.rtrim(F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1)), F.lit("."))
    port = F.regexp_extract(authority, r"^(?:.*@)?(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,5}$"), port.cast("int"))
    path_ = F.regexp_replace(path_, r"(?i);(?:jsessionid|phpsessid|sid)=[^/?#]*", "")
    return F.struct(s["some"].alias("some"), scheme.alias("scheme"), name.alias("host"), port.alias("port"), number.alias("number"), path_.alias("path"), clean_query(query).alias("query"), s["frag"].alias("frag"))


def _written(j: Column) -> Column:
    good = j["some"] & j["scheme"].isin("http", "https") & (j["host"] != "") & ((j["port"] == "") | (j["number"] <= 65535))
    default = ((j["scheme"] == "http") & (j["number"] == 80)) | ((j["scheme"] == "https") & (j["number"] == 443))
    port = F.when((j["port"] == "") | default, "").otherwise(F.concat(F.lit(":"), j["number"].cast("string")))
    out = F.concat(j["scheme"], F.lit("://"), j["host"], port, F.when(j["path"] == "", "/").otherwise(j["path"]), F.when(j["query"] != "", F.concat(F.lit("?"), j["query"])).otherwise(""), F.when(j["frag"].rlike("^!?/"), F.concat(F.lit("#"), j["frag"])).otherwise(""))
    return F.when(F.coalesce(good, F.lit(False)), out).otherwise("")


def synthetic(page: Column, *identity: Column) -> Column:
    """An URL for an item without one: the page without query, and 16 hex digits of what identifies the item; null if nothing does."""
    values = F.filter(F.array(*(F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s+", " "))) for c in identity)), lambda x: x != "")
    at = F.regexp_replace(canonical(page, page), r"[?#].*$", "")
    digest = F.substring(F.sha2(F.array_join(values, "\x1f"), 256), 1, 16)
    return F.when(F.size(values) > 0, F.concat(at, F.lit("#/item/"), digest))
