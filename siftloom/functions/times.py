"""Time stamps as ISO-8601 UTC text, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

DATE = r"^\d{4}-\d{2}-\d{2}$"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_date(c: Column) -> Column:
    """A date of the calendar, without a time."""
    return F.coalesce(c.rlike(DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull(), F.lit(False))


def offset_minutes(c: Column) -> Column:
    """Minutes of Z, UTC, +hh:mm or +hhmm; null for anything else."""
    sign = F.when(F.regexp_extract(c, r"^([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
    part = lambda n: F.regexp_extract(c, r"^[+-](\d{2}):?(\d{2})$", n).cast("int")
    return F.when(c.isin("Z", "UTC", "GMT"), 0).when(c.rlike(r"^[+-]\d{2}:?\d{2}$"), sign * (part(1) * 60 + part(2)))


def utc(c: Column, default_offset: str | None = None) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of ISO or RFC 822 text; null if it is no instant: a date alone, or local time without default_offset."""
    iso = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2})?(?:[.,]\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$"
    mail = r"^(?:[A-Za-z]{3},? )?(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2})(:\d{2})?(?: (Z|UTC|GMT|[+-]\d{4}))?$"
    get = F.regexp_extract

    def parts(t: Column) -> Column:
        """Local time, seconds and zone as written; local null if the text has neither form."""
        month = F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap(get(t, mail, 2))).cast("string"), 2, "0")
        day = F.concat(get(t, mail, 3), F.lit("-"), month, F.lit("-"), F.lpad(get(t, mail, 1), 2, "0"), F.lit(" "), get(t, mail, 4))
        is_iso, is_mail = t.rlike(iso), t.rlike(mail)
        pick = lambda a, b: F.when(is_iso, a).when(is_mail, b)
        return F.struct(pick(F.concat(get(t, iso, 1), F.lit(" "), get(t, iso, 2)), day).alias("local"), pick(get(t, iso, 3), get(t, mail, 5)).alias("second"), pick(get(t, iso, 4), get(t, mail, 6)).alias("zone"))

    def instant(p: Column) -> Column:
        local = F.concat(p["local"], F.when(p["second"] == "", ":00").otherwise(p["second"]))
        at = F.unix_timestamp(F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")))
        zone = F.when(p["zone"] == "", F.lit(default_offset)).otherwise(p["zone"])
        return utc_text(F.timestamp_seconds(at - let(zone, offset_minutes) * 60))

    return let(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), lambda t: let(parts(t), instant))


def relabelled(c: Column, offset: str) -> Column:
    """UTC of text that says Z but means local time at this offset."""
    return utc(F.regexp_replace(c, r"(?:Z|[+-]00:?00)$", ""), offset)


def _day(text: Column, formats: tuple = ("d MMM yyyy", "d MMMM yyyy")) -> Column:
    return F.coalesce(*(F.try_to_date(text, f) for f in formats))


def _clock(t: Column) -> Column:
    """struct(hour, minute, half) of a time of day as written: digits, then maybe minutes behind a colon or dot, then maybe a half of the day (a or p).  Null parts where there are none."""
    number = F.regexp_extract(t, r"(?<!\d)(\d{1,2})(?!\d)", 1).try_cast("int")
    minute = F.regexp_extract(t, r"(?<!\d)\d{1,2}[:.](\d\d)(?!\d)", 1)
    half = F.lower(F.regexp_extract(t, r"(?i)(?<![a-z])([ap])[. ]{0,2}m(?![a-z])", 1))
    return F.struct(number.alias("hour"), F.when(minute != "", minute).alias("minute"), F.when(half != "", half).alias("half"))


def _hour24(hour: Column, half: Column, midnight: bool = True) -> Column:
    """Of a 12-hour clock; an hour past noon stays, whatever half is said."""
    late = F.when((half == "p") & (hour < 12), hour + 12)
    return F.coalesce(late.when((half == "a") & (hour == 12), 0) if midnight else late, hour)


def _stamp(day: Column, hour: Column, minute: Column) -> Column:
    return F.concat(day, F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute)


def written(date: Column, time: Column, offset: str) -> Column:
    """UTC of a date like '25th Sep 2025' and a time like '15:30 PM' (the hours count if they are past noon) at this offset."""
    day = F.date_format(_day(F.trim(F.regexp_replace(date, r"(?i)(?<=\b\d{1,2})(?:st|nd|rd|th)\b", ""))), "yyyy-MM-dd")
    # what stands from the first hour:minute on
    at = F.regexp_extract(time, r"(?s)(?<!\w)(\d{1,2}:\d\d(?!\d).*)$", 1)
    return F.when(at != "", let(_clock(F.regexp_replace(at, r"(?s)^(\S+\s*(?:[AaPp][Mm]\b)?).*$", "$1")), lambda c: utc(_stamp(day, _hour24(c["hour"], c["half"]), c["minute"]), offset)))


def scheduled(header: Column, schedule: Column, offset: str) -> Column:
    """Start of an item from a header date dd-mm-yy and the first time of its schedule, in parts joined by ' | '.

    A time is hours with minutes, or hours with a half of the day.  The half may
    stand at a later time of the same part ('2.00 - 3.00 p.m.').  Without any time
    it is the date alone; null if the date is none.
    """
    numbers = F.split(F.trim(header), "-")
    number = lambda i: F.get(numbers, F.lit(i))
    plain = (F.size(numbers) == 3) & F.forall(numbers, lambda x: x.rlike("^[0-9]+$")) & (F.length(number(0)) == 2) & (F.length(number(1)) == 2) & F.length(number(2)).isin(2, 4)
    day = F.date_format(F.try_to_date(F.when(plain, F.concat_ws("-", F.lpad(number(2), 4, "20"), number(1), number(0))), "yyyy-MM-dd"), "yyyy-MM-dd")
    minutes, halved = r"\d{1,2}[:.]\d\d", r"(?i)\d{1,2}\s*[ap]\.?\s*m"
    timed = F.filter(F.split(F.coalesce(schedule, F.lit("")), r" \| "), lambda x: x.rlike(minutes) | x.rlike(halved))

    def start(part: Column) -> Column:
        # from the first number on that is a time
        begins = F.regexp_extract(part, r"(?is)(\d{1,2}(?:[:.]\d\d|\s*[ap]\.?\s*m).*)$", 1)
        # the first half that a number stands before, wherever it is in the part
        half = F.lower(F.regexp_extract(begins, r"(?i)\d\s*([ap])\.?\s*m", 1))
        hour = F.regexp_extract(begins, r"^(\d+)", 1).try_cast("int")
        minute = F.regexp_extract(begins, r"^\d+[:.](\d\d)", 1)
        return utc(_stamp(day, _hour24(hour, half, midnight=False), F.when(minute == "", "00").otherwise(minute)), offset)

    return F.when(F.size(timed) == 0, day).otherwise(start(F.get(timed, F.lit(0))))


def first_date(c: Column) -> Column:
    """YYYY-MM-DD of text in one of four forms, the first that fits."""
    return F.date_format(_day(c, ("yyyy-MM-dd", "d MMM yyyy", "d MMMM yyyy", "d/M/yyyy")), "yyyy-MM-dd")
