"""Pairs of names for a reviewer, by equi-joins on blocking keys instead of all pairs.

A pair of persons is for review if both names have as many parts, every part
equals the other's or is its initial, and one part of more than a letter is
equal: so it meets on (number of parts, place, part).  A pair of organisations is
if they differ only by center and centre: so it meets on the name spelled one way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def compatible(a: Column, b: Column) -> Column:
    """Equal, or one is the other's first letter."""
    return (a == b) | ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))


# The decisions.
SAFE, REVIEW, NO_MATCH = "safe match", "possible match requiring review", "do not match automatically"


def _decided(decision: str, reason: str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))


def person_match(a: Column, b: Column, key=None) -> Column:
    """struct(decision, reason) of two names as written; titles are left aside."""
    key = key or text.name_key
    of = lambda c: key(text.honorific(c).getField("name"))
    return person_decision(of(a), of(b))


def person_decision(ka: Column, kb: Column) -> Column:
    """person_match of two keys."""
    ta, tb = F.split(ka, " "), F.split(kb, " ")
    fits = F.forall(F.zip_with(ta, tb, compatible), lambda x: x)
    shared = F.exists(F.zip_with(ta, tb, lambda x, y: (x == y) & (F.length(x) > 1)), lambda x: x)
    return (
        F.when(ka == kb, _decided(SAFE, "the same name but for titles and punctuation"))
        .when(F.size(ta) != F.size(tb), _decided(NO_MATCH, "another number of name parts"))
        .when(~fits, _decided(NO_MATCH, "a name part differs"))
        .when(shared, _decided(REVIEW, "an initial fits a part and another part is the same"))
        .otherwise(_decided(NO_MATCH, "no whole name part is shared"))
    )


def without_acronym(c: Column) -> Column:
    """struct(name, acronym): an acronym in brackets at the end apart from the name."""
    n = text.collapse(c)
    inner = F.when(n.endswith(")"), F.regexp_replace(F.element_at(F.split(n, r"\("), -1), r"\)$", ""))
    before = F.rtrim(F.substring(n, F.lit(1), F.length(n) - F.length(inner) - 2))
    short = F.coalesce(text.acronym(inner) & (before != ""), F.lit(False))
    return F.struct(F.when(short, before).otherwise(n).alias("name"), F.when(short, inner).alias("acronym"))


def one_spelling(key: Column) -> Column:
    return F.regexp_replace(key, r"\bcenter\b", "centre")


def organisation_match(a: Column, b: Column, key=None) -> Column:
    """struct(decision, reason) of two organisations as written.  A bare acronym matches nothing."""
    key = key or text.name_key
    na, nb = without_acronym(a), without_acronym(b)
    ka, kb = key(na.getField("name")), key(nb.getField("name"))
    return (
        F.when(text.acronym(na.getField("name")) | text.acronym(nb.getField("name")), _decided(NO_MATCH, "a bare acronym stands for a name only on the page that defines it"))
        .when((ka == kb) & (na.getField("acronym").isNotNull() | nb.getField("acronym").isNotNull()), _decided(SAFE, "the same name, with its acronym in brackets"))
        .when(ka == kb, _decided(SAFE, "the same name"))
        .when(one_spelling(ka) == one_spelling(kb), _decided(REVIEW, "center and centre apart, the same name"))
        .otherwise(_decided(NO_MATCH, "different names"))
    )


def person_pairs(people: DataFrame, key=None) -> DataFrame:
    """people: id, name.  a_id < b_id, both names and the reason, for review.  key: the name as compared, text.name_key by default."""
    k = (key or text.name_key)(text.honorific(F.col("name")).getField("name"))
    p = people.select("id", "name", k.alias("k")).withColumn("parts", F.split("k", " "))
    t = p.select("id", "name", "k", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")).where(F.length("part") > 1)
    # blocks hold each key once, so a name that many bear meets no name twice as often
    keys = t.select("n", "at", "part", "k").distinct()
    a, b = (keys.select("n", "at", "part", F.col("k").alias(f"{x}_k")) for x in "ab")
    d = person_decision(F.col("a_k"), F.col("b_k"))
    found = a.join(b, ["n", "at", "part"]).where(F.col("a_k") != F.col("b_k")).select("a_k", "b_k", d.alias("d")).where(F.col("d.decision") == REVIEW).select("a_k", "b_k", "d.reason").distinct()
    return _of_keys(found, p)


def _of_keys(found: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs of keys, each in both orders, as pairs of the rows that have them, a_id < b_id."""
    a, b = (named.select(F.col("k").alias(f"{x}_k"), F.col("id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name")) for x in "ab")
    return found.join(a, "a_k").join(b, "b_k").where("a_id < b_id").select("a_id", "b_id", "a_name", "b_name", "reason")


def organisation_pairs(organisations: DataFrame, key=None) -> DataFrame:
    """organisations: id, name.  a_id < b_id, both names and the reason, for review.  A bare acronym meets nothing."""
    base = without_acronym(F.col("name")).getField("name")
    o = organisations.select("id", "name", base.alias("base")).where(~text.acronym(F.col("base"))).select("id", "name", (key or text.name_key)(F.col("base")).alias("k"))
    keys = o.select("k", one_spelling(F.col("k")).alias("one")).distinct()
    a, b = (keys.select("one", F.col("k").alias(f"{x}_k")) for x in "ab")
    found = a.join(b, "one").where(F.col("a_k") != F.col("b_k")).select("a_k", "b_k", F.lit("center and centre apart, the same name").alias("reason"))
    return _of_keys(found, o)


def review_pairs(entities: DataFrame, kind: str, decide=None, key=None) -> DataFrame:
    """entities: id, name.  The pairs for review of a kind ("person" or "organisation"); decide(a, b), if given, a function of two name columns to struct(decision, reason), may turn pairs down."""
    pairs = {"person": person_pairs, "organisation": organisation_pairs}[kind](entities, key)
    if decide is None:
        return pairs
    return pairs.withColumn("d", decide(F.col("a_name"), F.col("b_name"))).where(F.col("d.decision") == REVIEW).select("a_id", "b_id", "a_name", "b_name", F.col("d.reason").alias("reason"))


def labelled(lines: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """lines: item_url, seq, line.  role, label and value of lines that start with a label and a colon.

    Roles in the order given, longer labels first within a role, decide for a line.
    """
    order = [(role, name) for role, names in labels.items() for name in sorted(names, key=len, reverse=True)]
    quote = lambda s: "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in s)
    hit = F.lit(None).cast("struct<role:string,label:string,value:string>")
    for role, name in reversed(order):
        rule = rf"(?is)^\s*{quote(name)}\s*:\s*(.+)$"
        value = F.trim(F.regexp_extract("line", rule, 1))
        hit = F.when(value != "", F.struct(F.lit(role).alias("role"), F.lit(name).alias("label"), value.alias("value"))).otherwise(hit)
    return lines.withColumn("_h", hit).where("_h is not null").select("item_url", "seq", "_h.role", "_h.label", "_h.value", text.collapse(F.col("line")).alias("source_text"))


def mentions(labelled_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """People and organisations of labelled lines.

    Organisers are people if they start with a title, else organisations.  A name
    counts once for an item and role; an acronym that a page defines stands for
    its name on that page.
    """
    person_like = ~F.col("role").isin("organizer", "co-organizer") | text.titled(F.col("value"))
    first = lambda df, *keys: df.groupBy(*keys).agg(F.min_by(F.struct(*(c for c in df.columns if c not in keys)), F.struct("seq", "pos")).alias("_f")).select(*keys, "_f.*")
    base = ("item_url", "seq", "role", "source_text")
    p = labelled_lines.where(person_like).select(*base, F.posexplode(text.people(F.col("value"))).alias("pos", "one"))
    p = p.withColumn("p", text.person(F.col("one"))).where("p.name is not null").select(*base, "pos", "p.*").withColumn("normalized_name", text.name_key("name"))
    o = labelled_lines.where(~person_like).select(*base, F.posexplode(text.organisations(F.col("value"))).alias("pos", "one"))
    o = o.withColumn("o", text.organisation(F.col("one"))).where("o.name <> ''").select(*base, "pos", "o.*")
    defined = o.where("acronym is not null").groupBy("item_url", "acronym").agg(F.min_by("name", F.struct("seq", "pos")).alias("full_name")).withColumnsRenamed({"acronym": "known", "item_url": "on_page"})
    o = o.join(defined, (F.col("name") == F.col("known")) & (F.col("item_url") == F.col("on_page")) & F.col("acronym").isNull(), "left").drop("on_page")
    o = o.withColumn("acronym", F.coalesce("acronym", "known")).withColumn("name", F.coalesce("full_name", "name")).withColumn("org_type", text.organisation_type(F.col("name"))).drop("known", "full_name")
    # a name of signs that a key drops has no key
    o = o.where(F.col("name").rlike("(?U)[^\\s.,\"'“”‘’`]")).withColumn("normalized_name", text.name_key("name"))
    return first(p, "item_url", "normalized_name", "role"), first(o, "item_url", "normalized_name", "role")
