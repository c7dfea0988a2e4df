"""Joins by precedence and range, ordered-list windows, deduplication."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scratch


def counts_of(parent: DataFrame, key: str, **legs: DataFrame) -> DataFrame:
    """parent with a count for each named leg (a table with the key): grouped first, so no row multiplies."""
    out = parent
    for name, leg in legs.items():
        out = out.join(leg.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return out


def first_match(left: DataFrame, keys: Sequence[Column], lookup: DataFrame, lookup_key: str, value: str, name: str) -> DataFrame:
    """The value of the first of several keys that the lookup (one row a key) knows."""
    out, found = left, []
    for i, key in enumerate(keys):
        leg = lookup.select(F.col(lookup_key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.withColumn(f"__l{i}", key).join(leg, F.col(f"__l{i}") == F.col(f"__k{i}"), "left").drop(f"__k{i}", f"__l{i}")
        found.append(f"__v{i}")
    return out.withColumn(name, F.coalesce(*found)).drop(*found)


def diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key and status of every row: added, removed, changed or same (null-safe)."""
    a = old.select(key, F.struct(*fields).alias("old"), F.lit(True).alias("was"))
    b = new.select(key, F.struct(*fields).alias("new"), F.lit(True).alias("is"))
    status = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "same")
        .otherwise("changed")
    )
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def keep_first(df: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a total order, and how many the key had."""
    window = Window.partitionBy(*key)
    ranked = df.withColumn("r", F.row_number().over(window.orderBy(*order))).withColumn("n_rows", F.count("*").over(window))
    return ranked.where("r = 1").drop("r")


def carried(df: DataFrame, partition: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """The last value so far that is not null."""
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def below_running_max(df: DataFrame, partition: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is under one that came before."""
    window = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("highest_before", F.max(value).over(window)).where(F.col(value) < F.col("highest_before"))


def longest_run(df: DataFrame, partition: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Each partition's longest run of consecutive flagged rows (0 if none)."""
    window = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("flag", flag).withColumn("n", F.row_number().over(window))
    island = F.col("n") - F.row_number().over(Window.partitionBy(*partition, "flag").orderBy(*order))
    runs = marked.withColumn("island", island).groupBy(*partition, "flag", "island").agg(F.count("*").alias("run"))
    return runs.groupBy(*partition).agg(F.coalesce(F.max(F.when(F.col("flag"), F.col("run"))), F.lit(0)).cast("long").alias("longest"))


def in_last_interval(starts: DataFrame, points: DataFrame, partition: Sequence[str], at: str, key: str) -> DataFrame:
    """Points with the key of the interval that they are in: the one that began last (ties by key), at the point's time at
    the latest. Both are laid in one order and the key is carried on, so no point meets all intervals of its partition."""
    both = starts.select(*partition, at, key, F.lit(0).alias("kind")).unionByName(points.select(*partition, at, F.lit(None).cast(starts.schema[key].dataType).alias(key), F.lit(1).alias("kind")))
    order = Window.partitionBy(*partition).orderBy(at, "kind", key).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(key, F.last(key, ignorenulls=True).over(order)).where((F.col("kind") == 1) & F.col(key).isNotNull()).drop("kind")


def in_next_interval(df: DataFrame, partition: Sequence[str], at: str, key: str) -> DataFrame:
    """Each row with the end of its interval: the partition's next time (ties by key), null for the last."""
    return df.withColumn("until", F.lead(at).over(Window.partitionBy(*partition).orderBy(at, key)))


def best_ranked(rows: DataFrame, *by: str) -> DataFrame:
    """(by, top): the highest rank of each group of rows (by, rank, n, key), with the sum of n and the smallest key of those that
    have it, as struct(rank, n, key)."""
    each = rows.groupBy(*by, "rank").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    return each.groupBy(*by).agg(F.max(F.struct("rank", "n", "key")).alias("top"))


def best_within(asks: DataFrame, known: DataFrame, group: str, asked: str, at: str, most: int) -> DataFrame:
    """(group, asked, top): best_ranked() of the known rows (group, at, rank, n, key) whose `at` differs from an asked number of
    their group by `most` at most. Asks with none give no row; asks must be distinct.

    Numbers are put in cells of width one, and cells in twice as wide ones, and so on. An ask takes the tops of the few widest
    cells that its range fills, and only numbers of the cells at the range's ends are compared with it one by one.
    """
    finite = lambda x: F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    cell = lambda x: F.floor(x).cast("long")
    levels = (2 * most).bit_length()
    part = lambda x: x.select("*", "top.*").drop("top")
    each = part(best_ranked(known.where(finite(at)), group, at)).withColumn("block", cell(F.col(at)))
    cells = part(best_ranked(each, group, "block")).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    wide = part(best_ranked(cells.withColumn("block", F.expr("shiftright(block, level)")), group, "level", "block"))
    a = asks.where(finite(asked)).withColumns({"low": cell(F.col(asked) - most) + 1, "high": cell(F.col(asked) + most)})
    # the cells from low to high, high left out: of each width one at either end, or none
    filled = F.expr(f"""flatten(transform(sequence(0, {levels}), k -> filter(array(
        named_struct('level', k, 'block', -shiftright(-low, k), 'odd', pmod(-shiftright(-low, k), 2) = 1 AND -shiftright(-low, k) < shiftright(high, k)),
        named_struct('level', k, 'block', shiftright(high, k) - 1, 'odd', pmod(shiftright(high, k), 2) = 1 AND -shiftright(-low, k) < shiftright(high, k))), x -> x.odd)))""")
    inner = a.select(group, asked, F.explode(filled).alias("x")).select(group, asked, "x.level", "x.block").join(wide, [group, "level", "block"])
    ends = F.array_distinct(F.array(*(cell(F.col(asked) + x) for x in (-most - 0.5, -most, most, most + 0.5))))
    outer = a.select(group, asked, F.explode(ends).alias("block")).join(each, [group, "block"]).where(F.abs(F.col(asked) - F.col(at)) <= most)
    found = inner.select(group, asked, "rank", "n", "key").unionByName(outer.select(group, asked, "rank", "n", "key"))
    return best_ranked(found, group, asked)


#: Most rows that a task of closure() sorts or groups at once, as far as keys allow.
ROWS = 1_000_000


def closure(edges: DataFrame, child: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """(child, ancestor, depth) of a hierarchy, the shortest depth of each pair; cycles end where nothing is new.

    Paths double: a round joins the paths that the last one found, or found shorter, with all that are known, so the rounds are
    as many as the logarithm of the hierarchy's depth. Each round is written, which keeps plans small. Raises if most_rounds
    don't suffice.
    """
    both = F.col("child").isNotNull() & F.col("ancestor").isNotNull()
    known = edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where(both).distinct().withColumns({"depth": F.lit(1), "fresh": F.lit(True)})
    for _ in range(most_rounds):
        known = scratch(known, "closure")
        if known.where("fresh").isEmpty():
            return known.drop("fresh")
        onward = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"), F.col("fresh").alias("later"))
        dealt, on, parts = known, ["ancestor"], math.ceil(known.count() / ROWS)
        meet = lambda a, b: a.join(b, on)
        if parts > 1:
            parts = max(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
            shared = known.groupBy("ancestor").agg(F.ceil(F.count("*") / ROWS).alias("tasks")).where("tasks > 1")
            shared, tasks = F.broadcast(scratch(shared, "shared")), F.coalesce("tasks", F.lit(1))  # a row for ROWS paths at most
            onward = onward.join(shared, "ancestor", "left").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("tasks")
            dealt, on = known.join(shared, "ancestor", "left").withColumn("task", F.pmod(F.xxhash64("child"), tasks)).drop("tasks"), ["ancestor", "task"]
            meet = lambda a, b: a.repartition(parts, *on).join(b.repartition(parts, *on), on)
        met = meet(dealt.where("fresh"), onward).unionByName(meet(dealt.where("NOT fresh"), onward.where("later")))
        longer = met.select("child", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"), F.lit(None).cast("int").alias("was"))
        every = known.select("child", "ancestor", "depth", F.col("depth").alias("was")).unionByName(longer)
        least = (every.repartition(parts, "child", "ancestor") if parts > 1 else every).groupBy("child", "ancestor")
        known = least.agg(F.min("depth").alias("depth"), F.min("was").alias("was")).select("child", "ancestor", "depth", (F.col("was").isNull() | (F.col("depth") < F.col("was"))).alias("fresh"))
    raise ValueError(f"the hierarchy is deeper than 2 ** {most_rounds}")


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """df with its rows' places from 1 in a total order. Rows are put in ranges and numbered inside each; only how many there are
    in each range meets in one place. Rows that are equal in the whole order are numbered in no certain one."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    put = scratch(sorted_.withColumns({"__part": F.spark_partition_id(), "__line": F.monotonically_increasing_id()}), "numbered")
    counts = put.groupBy("__part").agg(F.count("*").alias("n"), F.min("__line").alias("first"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")  # a row a range
    shifts = counts.select("__part", (before - F.col("first") + 1).alias("shift"))
    return put.join(shifts, "__part").withColumn(name, F.col("__line") + F.col("shift")).drop("__part", "__line", "shift")
