"""Counts, histograms, votes and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ladder(value: Column, buckets: Sequence[tuple[str, float | None, float | None]], unknown: str | None = None) -> Column:
    """The label of the first bucket (label, at least, at most) that holds the value."""
    out = F.when(value.isNull(), F.lit(unknown))
    for label, low, high in buckets:
        low_ok = value >= low if low is not None else F.lit(True)
        out = out.when(low_ok & (value <= high) if high is not None else low_ok, label)
    return out


def zero_filled(vocabulary: DataFrame, counted: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Every value of a (small, fixed) vocabulary with its count, 0 where there is none."""
    return vocabulary.join(counted, key, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def most_common(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """group, value, n, total: each group's most common value; ties go to the smallest, nulls last."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), F.asc_nulls_last(value))
    every = Window.partitionBy(*group)
    return (
        counted.withColumn("total", F.sum("n").over(every)).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    )


def vote(df: DataFrame, group: Sequence[str], voter: str, value: str, order: dict[str, int], seen: str) -> DataFrame:
    """One vote for each voter of a group (the first it casts); most votes, then the given order, then first seen."""
    first = Window.partitionBy(*group, voter).orderBy(seen)
    votes = df.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(first)).where("r = 1")
    counted = votes.groupBy(*group, value).agg(F.count("*").alias("votes"), F.min(seen).alias("at"))
    place = F.coalesce(*(F.when(F.col(value) == v, F.lit(i)) for v, i in order.items()), F.lit(len(order)))
    best = Window.partitionBy(*group).orderBy(F.desc("votes"), place, "at")
    return counted.withColumn("r", F.row_number().over(best)).where("r = 1").select(*group, value, "votes")


def children(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """key with an array of its children, in order."""
    item = F.struct(*order, *(f for f in fields if f not in order))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias(name))


def pivoted(df: DataFrame, key: str, position: str, values: Sequence[int], fields: Sequence[str]) -> DataFrame:
    """The children at given positions as columns of their parent: field_position."""
    aggs = [F.max(F.when(F.col(position) == v, F.col(f))).alias(f"{f}_{v}") for v in values for f in fields]
    return df.groupBy(key).agg(*aggs)


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """Largest key, rows, distinct keys: changes whenever rows come or go."""
    return df.agg(F.max(key).alias("max_key"), F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))
