"""Scope and routing of URLs: ordered rules, of which the first that holds decides."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls

LABELS = ("event", "announcement", "faculty")


def _slashed(p: str) -> str:
    return "/" + p.strip("/") + ("/" if p.strip("/") else "")


@dataclass(frozen=True)
class Scope:
    """Which URLs a source may use.  Hosts are exact, domains with their subdomains; prefixes end with a slash."""

    hosts: tuple = ()
    domains: tuple = ()
    prefixes: tuple = ("/",)
    excluded: tuple = ()
    external: bool = False
    query_keys: tuple = ()
    most_details: int = 20
    most_items: int = 40

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, tuple(v))
        put("hosts", (h.lower().rstrip(".") for h in self.hosts))
        put("domains", (d.lower().strip(".") for d in self.domains))
        put("prefixes", map(_slashed, self.prefixes))
        put("excluded", map(_slashed, self.excluded))
        put("query_keys", (k.lower() for k in self.query_keys))
        if not (self.hosts or self.domains or self.external):
            raise ValueError("a scope needs hosts or domains, or external")
        if self.most_details < 0 or self.most_items < 0:
            raise ValueError("caps must not be negative")

    @classmethod
    def of(cls, settings: dict) -> "Scope":
        """From a mapping; unknown keys are refused."""
        unknown = sorted(set(settings) - set(cls.__dataclass_fields__))
        if unknown:
            raise ValueError(f"a scope has no {', '.join(unknown)}")
        return cls(**settings)


def scope(url: Column, s: Scope) -> Column:
    """struct(in_scope, reason) of a canonical URL.  Exclusions come before prefixes; an external URL that is allowed needs no prefix."""
    scheme, host, path = F.lower(urls.part(url, 1)), urls.host(url), urls.path(url)
    known = F.lit(False)
    if s.hosts:
        known = known | host.isin(*s.hosts)
    for d in s.domains:
        known = known | (host == d) | host.endswith(f".{d}")
    decided = lambda ok, reason: F.struct(F.lit(ok).alias("in_scope"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    rules = [(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), decided(False, F.concat(F.lit("non-web scheme: "), F.when(F.coalesce(scheme, F.lit("")) == "", "none").otherwise(scheme), F.lit(":"))))]
    rules.append((host == "", decided(False, "no host")))
    if not s.external:
        rules.append((~known, decided(False, F.concat(F.lit("external host: "), host))))
    for p in s.excluded:
        rules.append((path.startswith(p) | (F.concat(path, F.lit("/")) == p), decided(False, f"excluded prefix: {p}")))
    if s.query_keys:
        keys = F.array_sort(F.array_intersect(F.array_distinct(F.transform(urls.pairs(urls.part(url, 4)), lambda p: F.lower(p.getField("k")))), F.array(*map(F.lit, s.query_keys))))
        rules.append((F.size(keys) > 0, decided(False, F.concat(F.lit("excluded query key (calendar/search/filter explosion): "), F.array_join(keys, ", ")))))
    if s.external:
        rules.append((~known, decided(True, F.concat(F.lit("external host allowed by allow_external: "), host))))
    pdf = F.lower(path).endswith(".pdf")
    for p in s.prefixes:
        rules.append((path.startswith(p) & pdf, decided(True, f"in scope (PDF under {p}: routed as pdf_document, never detail-fetched as HTML)")))
        rules.append((path.startswith(p), decided(True, F.concat(F.lit("in scope: "), host, F.lit(f" {p}")))))
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise(decided(False, F.concat(F.lit("outside allowed prefixes: "), path)))


@dataclass(frozen=True)
class Routes:
    """hosts of the source, labels by category of the listing card, and path prefixes by label, in order."""

    hosts: tuple = ()
    categories: dict = field(default_factory=dict)
    patterns: dict = field(default_factory=dict)

    def __post_init__(self):
        bad = {*self.categories.values(), *self.patterns} - set(LABELS)
        if bad:
            raise ValueError(f"labels {sorted(bad)} are none of {LABELS}")


def route(url: Column, r: Routes, content_type: Column | None = None, category: Column | None = None) -> Column:
    """struct(label, reason): external host, PDF (a known type beats the file name), category, URL pattern, or unknown."""
    host, path = urls.host(url), urls.path(url)
    mime = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1))) if content_type is not None else F.lit("")
    decided = lambda label, reason: F.struct(F.lit(label).alias("label"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    rules = []
    if r.hosts:
        rules.append((~host.isin(*(h.lower() for h in r.hosts)), decided("external_link", F.concat(F.lit("external host "), host, F.lit(f" (source hosts: {', '.join(h.lower() for h in r.hosts)})")))))
    rules.append((mime == "application/pdf", decided("pdf_document", "Content-Type application/pdf")))
    rules.append(((mime == "") & F.lower(path).endswith(".pdf"), decided("pdf_document", "path ends in .pdf (no Content-Type known yet)")))
    if category is not None:
        for name, label in r.categories.items():
            rules.append((F.lower(F.trim(category)) == name.lower(), decided(label, F.concat(F.lit("category label '"), category, F.lit("'")))))
    known = F.when(mime != "", F.concat(F.lit(" (Content-Type "), mime, F.lit(")"))).otherwise("")
    for label, prefixes in r.patterns.items():
        for p in prefixes:
            rules.append((path.startswith(p), decided(label, F.concat(F.lit(f"URL pattern {p}"), known))))
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    known = F.when(mime != "", F.concat(F.lit("; Content-Type "), mime)).otherwise("")
    return out.otherwise(decided("unknown", F.concat(F.lit("no rule matched (host "), host, F.lit(", path "), path, known, F.lit(")"))))


def fetchable(label: Column) -> Column:
    return ~label.isin("pdf_document", "external_link")


def capped(candidates: DataFrame, s: Scope, url: str = "url", seq: str = "seq", by: tuple = ()) -> DataFrame:
    """candidates with in_scope and reason; of each group of by, in-scope URLs after the first most_items, by seq, turn out of scope.

    With by, a running count per group over URLs in scope alone.  Without, the
    first most_items are found by a top-k and the place of the last of them is
    compared, so nothing is sorted in one task.
    """
    df = candidates.withColumn("d", scope(F.col(url), s))
    if by:
        run = F.sum(F.col("d.in_scope").cast("int")).over(Window.partitionBy(*by).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        over = F.col("d.in_scope") & (run > s.most_items)
    else:
        place = F.struct(F.col(seq), F.col(url))
        first = df.where("d.in_scope").orderBy(seq, url).limit(s.most_items)
        last = first.agg(F.max(place).alias("_last"))
        df = df.crossJoin(F.broadcast(last))  # one row
        over = F.col("d.in_scope") & (F.col("_last").isNull() | (place > F.col("_last")))
    df = df.withColumn("k", over)
    return df.select(*candidates.columns, (F.col("d.in_scope") & ~F.col("k")).alias("in_scope"), F.when(F.col("k"), f"over max_discovered_items ({s.most_items})").otherwise(F.col("d.reason")).alias("reason"))
