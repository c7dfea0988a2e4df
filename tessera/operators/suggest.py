"""Suggested values for a row's fields from what its group's other rows say, with confidence and alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: value, confidence (high, medium, low), alternatives by how many say so, and how many of all do where they don't agree.
_VALUE = "struct<value:string,confidence:string,alternatives:array<string>,note:string>"


def voted(rows: DataFrame, key: str, group: str, field: str, order: str, vocabulary: list[tuple[str, str]] | None = None, fallback: str | None = None) -> DataFrame:
    """(key, suggestion) for every row: what most other rows of its group say, else what patterns of a fallback column stand for.

    Most counts first, then the value that stands first by `order` among the group's rows, the row itself included. A row's own
    vote is taken out of its group's counts, so no pairs are made: what meets in one row are a group's different values. Votes
    are of medium confidence; values by the vocabulary, (pattern, value) in order, of a low one. Nulls don't vote. Rows without
    a group are judged by the fallback alone.
    """
    named = rows.where(F.col(group).isNotNull() & F.col(field).isNotNull())
    each = named.groupBy(F.col(group).alias("__g"), F.col(field).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    tally = each.groupBy("__g").agg(F.collect_list(F.struct("value", "n", "at")).alias("tally"))
    joined = rows.withColumn("__g", F.col(group)).join(tally, "__g", "left")
    less = F.transform("tally", lambda t: F.struct((t["n"] - F.when(t["value"] == F.col(field), 1).otherwise(0)).alias("n"), t["at"].alias("at"), t["value"].alias("value")))
    others = F.filter(less, lambda t: t["n"] > 0)
    ordered = F.array_sort(F.transform(others, lambda t: F.struct((-t["n"]).alias("less"), t["at"].alias("at"), t["value"].alias("value"))))
    total = F.aggregate(others, F.lit(0).cast("long"), lambda s, t: s + t["n"])
    said = F.concat((-ordered[0]["less"]).cast("string"), F.lit(" of "), total.cast("string"), F.lit(" say "), ordered[0]["value"])
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    by_vote = F.struct(
        ordered[0]["value"].alias("value"), F.lit("medium").alias("confidence"), F.transform(rest(ordered), lambda t: t["value"]).alias("alternatives"),
        F.when(F.size(ordered) > 1, said).alias("note"),
    )
    out = F.when(F.size(F.coalesce(ordered, F.array())) > 0, by_vote.cast(_VALUE))
    if vocabulary and fallback:
        hits = F.array_distinct(F.filter(F.array(*(F.when(F.col(fallback).rlike(p), F.lit(v)) for p, v in vocabulary)), lambda v: v.isNotNull()))
        low = F.struct(hits[0].alias("value"), F.lit("low").alias("confidence"), rest(hits).alias("alternatives"), F.lit(None).cast("string").alias("note"))
        out = F.coalesce(out, F.when(F.size(hits) > 0, low.cast(_VALUE)))
    return joined.select(key, out.alias("suggestion"))


def flagged(rows: DataFrame, key: str, group: str, flag: str) -> DataFrame:
    """(key, suggestion) of a yes or no: what most other rows of the group say; a tie says yes. Null without other rows."""
    yes = F.col(flag).cast("long")
    totals = rows.where(F.col(group).isNotNull() & F.col(flag).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.sum(yes).alias("yes"), F.count("*").alias("n"))
    joined = rows.withColumn("__g", F.col(group)).join(totals, "__g", "left")
    n = F.col("n") - F.when(F.col(flag).isNotNull(), 1).otherwise(0)
    own = F.col("yes") - F.coalesce(yes, F.lit(0))
    value = (2 * own >= n) & (own > 0)
    most = F.when(value, own).otherwise(n - own)
    note = F.when((own > 0) & (own < n), F.concat(most.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" are"), F.when(value, "").otherwise(" not")))
    made = F.struct(value.alias("value"), F.lit("medium").alias("confidence"), ((own > 0) & (own < n)).alias("disputed"), note.alias("note"))
    return joined.select(key, F.when(n > 0, made).alias("suggestion"))


def title_alternatives(title: Column) -> Column:
    """Other readings of a title with one bracket at its end that is no reprise: what is in it, if that is two words or more, and
    what stands before it."""
    before, inside = (F.trim(F.regexp_extract(title, r"^(.*?)\s*\(([^()]+)\)\s*$", i)) for i in (1, 2))
    good = (before != "") & ~inside.rlike(r"(?i)\breprise\b") & inside.rlike(r"\S\s+\S")
    return F.when(good, F.array(inside, before)).otherwise(F.array().cast("array<string>"))


def parts_confidence(singers: Column, ensemble: Column) -> Column:
    """How sure listed singers make the parts: none low, a crowd medium, one or two high."""
    n = F.size(singers)
    return F.when(singers.isNull() | (n <= 0), "low").when(F.coalesce(ensemble, F.lit(False)) | (n > 2), "medium").otherwise("high")
