"""Filters, sorts, paging and facets over a table of items with nested children."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold, folded, folded_contains, squeezed


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def query_tokens(query: str, most: int = 12) -> list[str]:
    return query.lower().split()[:most]


def matches_tokens(query: str, fields: Sequence[Column], most: int = 12) -> Column:
    """Every token of the query is somewhere in one of the folded fields."""
    return all_of([any_of([folded_contains(f, folded(t)) for f in fields]) for t in query_tokens(query, most)])


def matches_loosely(query: str, fields: Sequence[Column]) -> Column:
    """The whole query in one field, or, with two tokens and more, all tokens anywhere in the fields together. Every field is
    folded once a row, however many tokens there are."""
    wanted = " ".join(folded(query).split())
    parts = wanted.split()
    has = lambda t: lambda x: F.contains(x, F.lit(t))
    holds = lambda x: all_of([has(t)(x) for t in parts])

    def hit(texts: Column) -> Column:
        # a field without every token can't hold the whole, and tokens hold no blanks, so only others are squeezed
        whole = F.exists(texts, lambda x: holds(x) & F.contains(squeezed(x), F.lit(wanted)))
        if len(parts) < 2:
            return whole
        return all_of([F.exists(texts, has(t)) for t in parts]) | whole

    return F.exists(F.array(F.array(*(fold(F.coalesce(f, F.lit(""))) for f in fields))), hit)


def within(column: Column, low=None, high=None) -> Column:
    """Bounds that are given; null is outside as soon as one is."""
    bounds = [column >= low] if low is not None else []
    bounds += [column <= high] if high is not None else []
    return all_of([column.isNotNull(), *bounds]) if bounds else F.lit(True)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a total order (the last key must be unique), with the number of rows before paging."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))


def facets(df: DataFrame, predicates: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """(facet, value, n): counts of each facet's values under every filter but its own, in one pass over the rows."""
    others = lambda key: all_of([p for k, p in predicates.items() if k != key])
    legs = F.array(*(F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value"), F.coalesce(others(k), F.lit(False)).alias("on")) for k, v in values.items()))
    each = df.select(F.explode(F.filter(legs, lambda x: x["on"])).alias("x"))
    return each.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def top_by(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each partition in a total order. Spark limits each task's rows before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn(rank, number).where(F.col(rank) <= n)


def first_tier(df: DataFrame, tier: Column) -> DataFrame:
    """The rows of the best (smallest) tier that has any."""
    marked = df.withColumn("tier", tier)
    best = marked.agg(F.min("tier").alias("best"))
    return marked.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best")
