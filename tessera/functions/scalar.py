"""Dates, numbers, hashes and arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_to_length(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%d:%02d", F.floor(x / 60), x % 60))


def in_range(x: Column, low: int, high: int) -> Column:
    """x if a whole number of the range, else null."""
    n = x.try_cast("int")
    return F.when(n.between(low, high), n)


def dice(a: Column, b: Column) -> Column:
    """Overlap of two word lists as sets: 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def real_date(x: Column) -> Column:
    """A date if x is a real day written YYYY-MM-DD, else null."""
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))


def days_until(day: Column, now: Column) -> Column:
    return F.datediff(day, now)


def phase(start: Column, end: Column, now: Column) -> Column:
    """upcoming, today, ongoing, over, or tbd without dates."""
    first, last = F.coalesce(start, end), F.coalesce(end, start)
    return (
        F.when(first.isNull(), "tbd")
        .when(last < now, "over")
        .when((first == now) & (last == now), "today")
        .when(first <= now, "ongoing")
        .otherwise("upcoming")
    )


def written_date(x: Column) -> Column:
    """Mar 3, 2026"""
    return F.date_format(x, "MMM d, yyyy")


def relative_time(then: Column, now: Column) -> Column:
    """How long ago, in the largest unit, rounded under a day; a written date from 30 days on."""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    minutes, hours, days = half_up(s / 60), half_up(s / 3_600), F.floor(s / 86_400)
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    return (
        F.when(s < 45, "just now")
        .when(s < 3_600, F.when(minutes >= 60, "1 hour ago").otherwise(F.concat(F.greatest(minutes, F.lit(1)).cast("string"), F.lit(" min ago"))))
        .when(s < 86_400, F.when(hours >= 24, "yesterday").otherwise(some(hours, "hour")))
        .when(days == 1, "yesterday")
        .when(days < 7, some(days, "day"))
        .when(days < 30, some(F.floor(days / 7), "week"))
        .otherwise(written_date(then))
    )


def countdown(until: Column, now: Column) -> Column:
    """struct(days, hours, minutes, seconds, past) until a time, all 0 once it has passed."""
    s = F.greatest(F.unix_timestamp(until) - F.unix_timestamp(now), F.lit(0))
    part = lambda a, b: F.floor(s % a / b).cast("long")
    return F.struct(
        F.floor(s / 86_400).cast("long").alias("days"), part(86_400, 3_600).alias("hours"), part(3_600, 60).alias("minutes"), (s % 60).alias("seconds"),
        (F.unix_timestamp(until) <= F.unix_timestamp(now)).alias("past"),
    )


def date_range(start: Column, end: Column) -> Column:
    """A day, or two with what they share said once: Mar 3-5, 2026; Mar 3 - Apr 2, 2026."""
    first, last = F.coalesce(start, end), F.coalesce(end, start)
    day, month_day = (lambda x: F.date_format(x, "d")), (lambda x: F.date_format(x, "MMM d"))
    same_year = F.year(first) == F.year(last)
    return (
        F.when(first == last, written_date(first))
        .when(same_year & (F.month(first) == F.month(last)), F.concat(month_day(first), F.lit("–"), day(last), F.lit(", "), F.year(last).cast("string")))
        .when(same_year, F.concat(month_day(first), F.lit(" – "), written_date(last)))
        .otherwise(F.concat(written_date(first), F.lit(" – "), written_date(last)))
    )


def year_of(x: Column) -> Column:
    """The year that a text begins with, if after 1000."""
    y = F.substring(x, 1, 4).try_cast("int")
    return F.when(y > 1000, y)


def parse_length(x: Column) -> Column:
    """m:ss or whole seconds to seconds, from 1 to 3599; anything else is null."""
    t = F.trim(x)
    total = F.when(t.rlike(r"^\d{1,2}:[0-5]\d$"), F.split(t, ":")[0].try_cast("int") * 60 + F.split(t, ":")[1].try_cast("int")).when(t.rlike(r"^\d{1,4}$"), t.try_cast("int"))
    return F.when(total.between(1, 3_599), total)


def spoken_length(x: Column) -> Column:
    """2 minutes 33 seconds"""
    m, s = F.floor(x / 60), x % 60
    some = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))
    return F.when(x.isNull() | (x < 0), "unknown length").otherwise(F.concat_ws(" ", F.when(m > 0, some(m, "minute")), F.when((s > 0) | (m == 0), some(s, "second"))))


def sheet_seconds(x: Column) -> Column:
    """A spreadsheet's h:mm, h:mm:ss or share of a day, all of which mean minutes and seconds."""
    t = F.trim(x)
    parts = F.split(t, ":")
    clock = parts[0].try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int")
    return F.when(t.rlike(r"^\d{1,2}:\d{2}(?::\d{2})?$"), clock).when(t.rlike(r"^\d+(?:\.\d+)?$"), half_up(t.try_cast("double") * 1440).cast("int"))


def time_status(seconds: Column, warn: int = 330, limit: int = 360) -> Column:
    return F.when(seconds > limit, "over").when(seconds > warn, "close").when(seconds.isNotNull(), "ok")


def clamp_seconds(x: Column) -> Column:
    """A bound on lengths: none from 420 on, at least 60."""
    return F.when(x < 420, F.greatest(x, F.lit(60)))


def stable_hash(x: Column) -> Column:
    """32-bit FNV-1a over the characters' codes (ASCII texts)."""
    return F.aggregate(
        F.filter(F.split(x, ""), lambda c: c != ""),
        F.lit(2166136261).cast("long"),
        lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)),
    )


def json_list(x: Column) -> Column:
    """A JSON array of texts; anything else is an empty array."""
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def positive_ids(x: Column, most: int = 200) -> Column:
    """Distinct positive whole numbers of an array, in order, at most so many."""
    return F.slice(F.array_distinct(F.filter(x.cast("array<long>"), lambda v: v > 0)), 1, most)
