"""Corrections from keyed maps, applied in a fixed order, with a report of what they did; rules with reasons."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold, squeezed
from tessera.session import scratch


@dataclass(frozen=True)
class Step:
    """One map: it sets `column`, by the columns of `key` as they are at this step, between bars."""

    name: str
    column: str
    key: tuple[str, ...]


def loose(key: Column) -> Column:
    return squeezed(fold(key))


def corrected(rows: DataFrame, corrections: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, DataFrame]:
    """(rows with their corrected columns and `applied`, report) of corrections (name, key, value).

    Every step looks its key up as it is, else without regard to case, accents and blanks; of several loosely equal keys the
    last counts. A later step's key is made of what earlier ones set. An empty value, or one of blanks, leaves the column as it
    is, but its key counts as used. Keys that begin with an underscore are comments. A key with a null in it is looked up by
    nothing. Of repeated keys the smallest value counts. Rows that repeat stay so.

    applied: array of (name, key, changed), in order. report: (name, key, n_rows, n_changed) of every correction, those that no
    row used with zeros. Both come from one written pass over the rows.
    """
    known = corrections.where("key IS NOT NULL AND NOT startswith(key, '_')").groupBy("name", "key").agg(F.min("value").alias("value"))
    now = rows.withColumn("applied", F.array().cast("array<struct<name:string,key:string,changed:boolean>>"))
    for step in steps:
        mine = known.where(F.col("name") == step.name).groupBy(loose(F.col("key")).alias("__loose"))
        found = mine.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("__map"), F.max("key").alias("__last"))
        key = F.concat_ws("|", *(F.col(c).cast("string") for c in step.key))
        whole = F.lit(True)
        for c in step.key:
            whole = whole & F.col(c).isNotNull()
        asked = now.withColumn("__key", F.when(whole, key)).withColumn("__loose", loose(F.col("__key"))).join(found, "__loose", "left")
        hit = F.when(F.map_contains_key("__map", F.coalesce("__key", F.lit(""))), F.col("__key")).otherwise(F.col("__last"))
        value = F.trim(F.try_element_at("__map", F.col("__hit")))
        new = F.when(value != "", value).otherwise(F.col(step.column))
        entry = F.array(F.struct(F.lit(step.name).alias("name"), F.col("__hit").alias("key"), (~F.col("__new").eqNullSafe(F.col(step.column))).alias("changed")))
        made = asked.withColumn("__hit", F.when(F.col("__map").isNotNull(), hit)).withColumn("__new", F.when(F.col("__hit").isNotNull(), new).otherwise(F.col(step.column)))
        now = made.withColumn("applied", F.when(F.col("__hit").isNotNull(), F.concat("applied", entry)).otherwise(F.col("applied"))).withColumn(step.column, F.col("__new"))
        now = now.select(*rows.columns, "applied")
    written = scratch(now, "corrected")
    used = written.select(F.explode("applied").alias("a")).groupBy("a.name", "a.key").agg(F.count("*").alias("n_rows"), F.sum(F.col("a.changed").cast("long")).alias("n_changed"))
    report = known.select("name", "key").join(used, ["name", "key"], "left").na.fill(0, ["n_rows", "n_changed"])
    return written, report


@dataclass(frozen=True)
class Rule:
    reason: str
    include: bool
    test: Column


def decided(rows: DataFrame, rules: Sequence[Rule], otherwise: str, rescues: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """rows with include and reason: the first rule whose test is true decides, else they are left out for `otherwise`. What is
    left out comes back by the first rescue whose test is true, whose name is then the reason. A null test is no hit."""
    reason, include = F.lit(otherwise), F.lit(False)
    for rule in reversed(rules):
        hit = F.coalesce(rule.test, F.lit(False))
        reason, include = F.when(hit, rule.reason).otherwise(reason), F.when(hit, rule.include).otherwise(include)
    back = F.lit(None).cast("string")
    for name, test in reversed(rescues):
        back = F.when(F.coalesce(test, F.lit(False)), name).otherwise(back)
    told = F.struct(include.alias("include"), reason.alias("reason"), back.alias("back"))
    kept = F.col("__told.include") | F.col("__told.back").isNotNull()
    return rows.withColumn("__told", told).select(
        *rows.columns, kept.alias("include"), F.when(F.col("__told.include"), F.col("__told.reason")).otherwise(F.coalesce("__told.back", "__told.reason")).alias("reason")
    )
