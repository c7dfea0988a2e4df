"""Ordered lists: repeats, caps, merging by anchors, splitting where a list begins again, unpivoting, reordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import titles
from tessera.functions.text import fold, match_fold, squeezed, title_keys


def loose_distinct(values: Column, most: int | None = None) -> Column:
    """Values without repeats by fold, the first spelling kept, empty ones left out; at most so many."""
    each = F.filter(F.transform(values, lambda v: squeezed(v)), lambda v: v != "")
    keys = F.transform(each, lambda v: fold(v))
    out = F.filter(each, lambda v, i: F.array_position(keys, fold(v)) == i + 1)
    return F.slice(out, 1, most) if most else out


def toggled(values: Column, value: Column) -> Column:
    """Without the value if it is there (by fold), else with it at the end."""
    same = lambda v: fold(v) == fold(value)
    return F.when(F.exists(values, same), F.filter(values, lambda v: ~same(v))).otherwise(F.array_append(values, value))


def moved(values: Column, start: Column, to: Column) -> Column:
    """The value at one place (from 1) put at another."""
    rest = F.concat(F.slice(values, 1, start - 1), F.slice(values, start + 1, F.size(values)))
    return F.concat(F.slice(rest, 1, to - 1), F.slice(values, start, F.lit(1)), F.slice(rest, to, F.size(values)))


def merged_ids(old: Column, new: Column, most: int, replace: Column) -> Column:
    """New ids behind the old ones, each once and at most so many; or in their place."""
    return F.slice(F.array_distinct(F.when(replace, new).otherwise(F.concat(old, new))), 1, most)


def inserted(best: DataFrame, other: DataFrame, partition: Sequence[str], key: str, place: str) -> DataFrame:
    """best's items and those that only `other` has, each behind the item of best that stands before it in other; items
    before any such come first. Adds place, from 1."""
    mine = best.select(*partition, key, F.col(place).alias("anchor"))
    matched = other.join(mine, [*partition, key], "left")
    so_far = Window.partitionBy(*partition).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    placed = matched.withColumn("behind", F.coalesce(F.last("anchor", ignorenulls=True).over(so_far), F.lit(0))).where("anchor IS NULL")
    both = mine.select(*partition, key, F.col("anchor").alias("behind"), F.lit(0).alias("list"), F.lit(0).cast("long").alias("at")).unionByName(
        placed.select(*partition, key, "behind", F.lit(1).alias("list"), F.col(place).cast("long").alias("at"))
    )
    number = F.row_number().over(Window.partitionBy(*partition).orderBy("behind", "list", "at", key))
    return both.select(*partition, key, (F.col("list") == 1).alias("added"), number.cast("long").alias("place"))


def split_where_repeated(df: DataFrame, partition: Sequence[str], key: str, order: str) -> DataFrame:
    """df with run, from 1: a new run begins where the first item of the list comes again."""
    whole = Window.partitionBy(*partition).orderBy(order)
    first = F.first(key).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("run", F.sum((F.col(key) == first).cast("int")).over(whole.rowsBetween(Window.unboundedPreceding, 0)))


def unpivoted(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """(keys, version, item, place): each column's values that are not null as a list of its own, renumbered."""
    long = df.select(*keys, order, F.explode(F.array(*(F.struct(F.lit(c).alias("version"), F.col(c).cast("string").alias("item")) for c in columns))).alias("x"))
    each = long.select(*keys, order, "x.version", "x.item").where("item IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*keys, "version").orderBy(order))
    return each.select(*keys, "version", "item", place.cast("long").alias("place"))


def grouped(df: DataFrame, partition: Sequence[str], section: str, order: str, item: str) -> DataFrame:
    """(partition, section, items): each section's items in order, those without a place last."""
    sort = F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.col(item).alias("item"))
    return df.groupBy(*partition, section).agg(F.transform(F.array_sort(F.collect_list(sort)), lambda x: x["item"]).alias("items"))


#: Most songs that one album's tracks give: a list, no sample.
MOST_TRACKS = 60
# Words of numbers that nobody sings.
INSTRUMENTAL = r"\b(?:overture|entr ?acte|instrumental|underscor(?:e|ing)|play ?off|exit music|bows|curtain call|incidental music|scene change)\b"


def songs_of_tracks(tracks: DataFrame, group: str, order: str, name: str, explicit: str, known: DataFrame | None = None) -> DataFrame:
    """(group, place, title, reprise, instrumental): an album's tracks as songs, in order: no explicit ones, none without a title,
    none that is known (group, key) or stood before; the first MOST_TRACKS of them."""
    title = titles.clean_track_title(F.col(name))
    keys = title_keys(F.col("title"))
    key = F.concat_ws("|", keys["main"], titles.reprise_number(F.col("title"), F.lit(False)).cast("string"))
    each = tracks.where(~F.coalesce(F.col(explicit), F.lit(False))).select(group, order, title.alias("title")).where("title IS NOT NULL")
    keyed = each.withColumns({"key": key, "main": keys["main"], "reprise": keys["reprise"]}).where("main <> ''")
    if known is not None:
        keyed = keyed.join(known.select(group, "key").distinct(), [group, "key"], "left_anti")
    first = keyed.groupBy(group, "key").agg(F.min_by(F.struct("title", "reprise"), order).alias("t"), F.min(order).alias("at"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("at"))
    placed = first.withColumn("place", place).where(F.col("place") <= MOST_TRACKS)
    return placed.select(group, "place", "t.title", "t.reprise", match_fold(F.col("t.title")).rlike(INSTRUMENTAL).alias("instrumental"))
