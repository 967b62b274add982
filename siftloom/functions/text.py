"""Text columns: white space, names, honorifics, splitting of people and organisations.

All native but name_key, which needs Unicode normalisation and case folding.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .binding import let

# Titles before a name, letters after one, first words of organisations, and the words that give an organisation's type, of which the first type counts.
TITLES = ("Dr", "Prof", "Mr", "Ms", "Mrs", "Shri", "Smt")
POST_NOMINALS = ("FRS", "FREng", "FRSC", "FNA", "FASc", "FNAE", "FNASc", "FAAAS", "PhD", "Ph.D.")
ORGANISATION_WORDS = ("Department", "Dept", "Centre", "Center", "School", "Institute", "Laboratory", "Lab", "Society", "Office", "Cell", "University", "College", "Foundation", "Agency", "Division", "Group", "Council", "Ministry", "Association", "Club")
ORGANISATION_TYPES = {"department": ("Department", "Dept"), "centre": ("Centre", "Center"), "school": ("School",), "laboratory": ("Laboratory", "Lab"), "institution": ("University", "Institute", "College")}

TITLE = f"(?:(?:{'|'.join(TITLES)})\\.?\\s+)"
#: Where a value may go on with another name.
JOINTS = r";|\n|\s+and\s+|\s+&\s+|&"
#: Where a person's name ends and what is said of them starts.
NAME_END = r"\s*[,;]|\s[—–-]\s|\s\("


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed; null as ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def empty(c: Column) -> Column:
    """Null or ''."""
    return c.isNull() | (c == "")


def honorific(c: Column) -> Column:
    """struct(honorific, name): leading titles apart from the rest; honorific null if there is none."""
    def parts(t: Column) -> Column:
        h = F.regexp_extract(t, f"(?i)^({TITLE}+)", 1)
        return F.struct(F.when(h != "", F.trim(h)).alias("honorific"), F.trim(F.regexp_replace(t, f"(?i)^{TITLE}+", "")).alias("name"))

    return let(collapse(c), parts)


def titled(c: Column) -> Column:
    """Whether text starts with a title and a letter behind it."""
    return c.rlike(f"(?i)^\\s*{TITLE}[a-z]")


def acronym(c: Column) -> Column:
    """Whether text is an acronym alone: 2 to 16 capitals, digits and &.- behind a capital."""
    return c.rlike("^[A-Z][A-Z0-9&.-]+$") & F.length(c).between(2, 16)


def _pieces(c: Column, joints: str, starts) -> Column:
    """The text cut before each joint; a piece for which starts(joint and all, without the joint) is false goes back to the one before it, joint and all."""
    marked = F.split(F.regexp_replace(c, f"(?i)({joints})", "\x1e$1"), "\x1e")
    bare = lambda p: F.regexp_replace(p, f"(?i)^(?:{joints})", "")

    def step(done: Column, p: Column) -> Column:
        n = F.size(done)
        longer = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(done, n - 1), F.lit("")), p)))
        return F.when((n == 0) | starts(p, bare(p)), F.concat(done, F.array(bare(p)))).otherwise(longer)

    return F.filter(F.transform(F.aggregate(marked, F.array().cast("array<string>"), step), collapse), lambda x: x != "")


def people(c: Column) -> Column:
    """The people of a labelled value.  If it has a comma, a joint starts a new person only before a title."""
    return let(F.trim(c), lambda v: _pieces(v, JOINTS, lambda _, bare: ~v.contains(",") | titled(bare)))


def organisations(c: Column) -> Column:
    """The organisations of a labelled value: cut at ; and lines, and at 'and' or '&' before an organisation's first word."""
    first = lambda bare: F.lower(F.regexp_extract(F.regexp_replace(bare, r"(?i)^\s*the\s+", ""), r"^\s*([A-Za-z]+)", 1))
    return _pieces(c, r";|\n|\s+(?:and|&)\s+", lambda p, bare: p.rlike(r"^[;\n]") | first(bare).isin(*(w.lower() for w in ORGANISATION_WORDS)))


def organisation(c: Column) -> Column:
    """struct(name, parent, acronym, org_type) of one organisation as written: the parent stands behind a comma, an acronym in brackets at the end of the name."""

    def read(t: Column) -> Column:
        halves = F.split(t, ", ", 2)
        return F.struct(F.trim(F.get(halves, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("parent"))

    def whole(h: Column) -> Column:
        inner = F.when(h["name"].endswith(")"), F.regexp_replace(F.element_at(F.split(h["name"], r"\("), -1), r"\)$", ""))
        before = F.rtrim(F.substring(h["name"], F.lit(1), F.length(h["name"]) - F.length(inner) - 2))
        short = F.coalesce(acronym(inner) & (before != ""), F.lit(False))
        name = F.when(short, before).otherwise(h["name"])
        return F.struct(name.alias("name"), F.when(h["parent"] != "", h["parent"]).alias("parent"), F.when(short, inner).alias("acronym"), organisation_type(name).alias("org_type"))

    return let(F.regexp_replace(collapse(c), r"^[ .;]+|[ .;]+$", ""), lambda t: let(read(t), whole))


def organisation_type(c: Column) -> Column:
    """The first type of which the text has a word; null if of none."""
    words = F.split(c, r"\W+")
    return F.coalesce(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, of))), kind) for kind, of in ORGANISATION_TYPES.items()))


def person(c: Column) -> Column:
    """struct(name, honorific, affiliation) of one person as written; name null if no letter is left.

    The name goes up to the first comma, semicolon, dash or bracket, and to the
    first letters after a name; a bracket of 30 characters at most that only more
    of the name follows is a nickname inside it.  Mail addresses are no affiliation.
    """
    trimmed = lambda x, more: F.regexp_replace(x, f"^[ ,;{more}]+|[ ,;{more}]+$", "")
    at = lambda x, i: F.coalesce(F.get(x, F.lit(i)), F.lit(""))

    def halves(h: Column) -> Column:
        """What stands before the first end and behind it; inside and behind a bracket that comes right there."""
        cut = F.split(h["name"], NAME_END, 2)
        rest = F.substring(h["name"], F.length(at(cut, 0)) + 1, F.length(h["name"]))
        inside = F.when(rest.startswith(" ("), F.split(F.substring(rest, F.lit(3), F.length(rest)), r"\)", 2))
        return F.struct(h["honorific"].alias("honorific"), at(cut, 0).alias("head"), at(cut, 1).alias("tail"), at(inside, 0).alias("inner"), F.get(inside, F.lit(1)).alias("after"))

    def nicknamed(p: Column) -> Column:
        more = F.split(F.coalesce(p["after"], F.lit("")), r"\s*[,;]|\s+[—–]", 2)
        surnames = F.split(F.trim(at(more, 0)), r"\s+")
        nick = F.length(p["inner"]).between(1, 30) & ~p["inner"].contains("(") & ~p["head"].rlike("[—–]") & p["after"].rlike(r"^\s") & F.forall(surnames, lambda w: w.rlike(r"^[A-Z][^()]*$"))
        nick = F.coalesce(nick, F.lit(False))
        name = F.when(nick, F.concat(p["head"], F.lit(" ("), p["inner"], F.lit(") "), F.trim(at(more, 0)))).otherwise(p["head"])
        return F.struct(p["honorific"].alias("honorific"), name.alias("name"), F.when(nick, F.regexp_replace(at(more, 1), r"^[ ,;—–]+", "")).otherwise(p["tail"]).alias("tail"))

    def lettered(p: Column) -> Column:
        words = F.split(collapse(p["name"]), " ")
        letters = lambda w: F.exists(F.array(*map(F.lit, POST_NOMINALS)), lambda x: w.startswith(x) & ~F.substring(w, F.length(x) + 1, F.lit(1)).rlike("[A-Za-z]"))
        first = F.coalesce(F.array_min(F.filter(F.transform(words, lambda w, i: F.when((i > 0) & letters(w), i)), lambda i: i.isNotNull())), F.size(words))
        after = F.array_join(F.slice(words, first + 1, F.greatest(F.size(words) - first, F.lit(0))), " ")
        tail = F.concat_ws(", ", F.when(after != "", after), F.when(p["tail"] != "", p["tail"]))
        name = F.array_join(F.slice(words, F.lit(1), first), " ")
        return F.struct(p["honorific"].alias("honorific"), trimmed(name, ":").alias("name"), trimmed(collapse(F.regexp_replace(tail, r"[^\s@(),;<>]+@[^\s@(),;<>]+", "")), "—–\\-").alias("tail"))

    done = lambda q: F.struct(F.when(q["name"].rlike("[A-Za-z]"), q["name"]).alias("name"), q["honorific"].alias("honorific"), F.when(q["tail"] != "", q["tail"]).alias("affiliation"))
    return let(honorific(c), lambda h: let(halves(h), lambda p: let(nicknamed(p), lambda n: let(lettered(n), done))))


def organisers(names: Column) -> Column:
    """Names without blanks and repeats, as first seen."""
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


@F.pandas_udf(StringType())
def name_key(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The one identity of names: NFKC, case folded, dots, commas and quotes as spaces, collapsed."""
    drop = str.maketrans(dict.fromkeys(".,\"'“”‘’`", " "))
    for s in names:
        yield s.map(lambda x: " ".join(unicodedata.normalize("NFKC", x or "").casefold().translate(drop).split()))


def ascii_key(c: Column) -> Column:
    """name_key of ASCII names, natively."""
    return collapse(F.translate(F.lower(F.coalesce(c, F.lit(""))), ".,\"'`", "     "))


def joined_lines(lines: Column) -> Column:
    """One title of its lines; a line that ends with a backslash goes on without a space."""
    step = lambda acc, x: F.when(acc.endswith("\\"), F.concat(F.regexp_replace(acc, r"\\$", ""), x)).when(acc == "", x).otherwise(F.concat(acc, F.lit(" "), x))
    t = F.trim(F.aggregate(lines, F.lit(""), step))
    return F.when(t != "", t)
