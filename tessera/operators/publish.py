"""Publishing rules: absorbed duplicates, links with a policy, sheet upserts, versions, gates and deny-lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def absorbed(main: DataFrame, other: DataFrame, key: Sequence[str], id_: str) -> DataFrame:
    """(id, kept_id): each row of `other` whose key `main` has goes into the smallest such row; the rest keep their id."""
    heads = main.groupBy(*key).agg(F.min(id_).alias("head"))
    return other.join(heads, list(key), "left").select(F.col(id_).alias("id"), F.coalesce("head", id_).alias("kept_id"))


def moved_links(links: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """links with a column's ids replaced by those that they were absorbed into; repeated links are one."""
    to = mapping.select(F.col("id").alias(column), "kept_id")
    return links.join(to, column, "left").withColumn(column, F.coalesce("kept_id", column)).drop("kept_id").distinct()


def relinked(rows: DataFrame, key: str, old: Column, policy: Column, found: Column) -> DataFrame:
    """(key, link): links to be written. A manual link stays, `none` has none, others take what was found; only
    differences are written."""
    link = F.when(policy == "manual", old).when(policy == "none", F.lit(None)).otherwise(found)
    return rows.where(~old.eqNullSafe(link)).select(key, link.alias("link"))


def sheet_actions(old: DataFrame, new: DataFrame, tombstones: DataFrame, key: str, fields: Sequence[str], edited: Column) -> DataFrame:
    """(key, action): deleted keys stay deleted, edited rows are kept, and rows that the sheet lost are stale."""
    a = old.select(key, F.struct(*fields).alias("was"), edited.alias("edited"))
    b = new.select(key, F.struct(*fields).alias("is"))
    dead = tombstones.select(key, F.lit(True).alias("dead"))
    action = (
        F.when(F.col("dead"), "tombstone")
        .when(F.col("was").isNull(), "insert")
        .when(F.col("edited"), "keep")
        .when(F.col("is").isNull(), "stale")
        .when(F.col("was").eqNullSafe(F.col("is")), "skip")
        .otherwise("update")
    )
    return a.join(b, key, "full_outer").join(dead, key, "left").select(key, action.alias("action"))


def most_stale(n: Column) -> Column:
    """How many rows a sheet may lose at once: a tenth, but five at least."""
    return F.greatest(F.lit(5), F.floor(n * 0.1)).cast("long")


def slug_upsert(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], edited: Column) -> DataFrame:
    """(key, action, changed): the first row of a key is taken, and the names of the fields that differ are listed."""
    a = old.select(key, *(F.col(f).alias(f"old_{f}") for f in fields), edited.alias("edited"), F.lit(True).alias("was"))
    b = new.select(key, *fields, F.lit(True).alias("is"))
    differs = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"old_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    joined = a.join(b, key, "full_outer").withColumn("changed", F.when(F.col("was") & F.col("is"), differs))
    action = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "missing").when(F.size("changed") == 0, "same").when(F.col("edited"), "kept").otherwise("updated")
    return joined.select(key, action.alias("action"), F.array_join("changed", ",").alias("changed"))


def versions(contents: DataFrame, day: str, at: str, digest: str) -> DataFrame:
    """(day, digest, version): the same content keeps the version that it first had; other content of a day gets the
    next number, so no version stands for two contents."""
    first = contents.groupBy(day, digest).agg(F.min(at).alias("first"))
    n = F.row_number().over(Window.partitionBy(day).orderBy("first", digest))
    return first.select(day, digest, F.concat_ws(".", F.date_format(day, "yyyy-MM-dd"), n.cast("string")).alias("version"))


def gate(compared: DataFrame, group: str, least_share: float) -> DataFrame:
    """Of (group, status): counts of each group before and after, and whether it shrank too far to be published."""
    before, after = F.count_if(F.col("status") != "added"), F.count_if(F.col("status") != "removed")
    counts = compared.groupBy(group).agg(before.alias("n_before"), after.alias("n_after"), F.count_if(F.col("status") == "changed").alias("n_changed"))
    return counts.withColumn("flagged", F.col("n_after") < least_share * F.col("n_before"))


def denied(candidates: DataFrame, deny: DataFrame, key: Sequence[str]) -> DataFrame:
    """Candidates that nobody has rejected for their key."""
    return candidates.join(deny.select(*key).distinct(), list(key), "left_anti")


def free_names(df: DataFrame, partition: Sequence[str], name: str, order: str, suffix: str = "-") -> DataFrame:
    """df with a name of its own for each row: the first of a name keeps it; others get -2, -3, ..., leaving out what
    some row is called already. Numbers that are taken count as gaps, so no search goes row by row."""
    own = df.select(*partition, F.col(name).alias("taken")).distinct()
    base = F.regexp_extract("taken", r"^(.*)" + suffix + r"([1-9][0-9]*)$", 1)
    number = F.regexp_extract("taken", r"^(.*)" + suffix + r"([1-9][0-9]*)$", 2).try_cast("int")
    gaps = own.withColumn("n", number).where("n >= 2").groupBy(*partition, base.alias(name)).agg(F.array_sort(F.collect_set("n")).alias("gaps"))
    nth = F.row_number().over(Window.partitionBy(*partition, name).orderBy(order))
    ranked = df.withColumn("nth", nth).join(gaps, [*partition, name], "left")
    # the nth number of those that are not taken: each taken one at or below it moves it up by one
    moved = F.aggregate(F.coalesce("gaps", F.array().cast("array<int>")), F.col("nth"), lambda n, g: F.when(g <= n, n + 1).otherwise(n))
    free = F.when(F.col("nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(suffix), moved.cast("string")))
    return ranked.withColumn("free", free).drop("nth", "gaps")
