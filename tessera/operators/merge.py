"""Publishing a new snapshot over an old one: actions, guards, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def actions(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str], keep: Column | None = None) -> DataFrame:
    """key, action and the fields to write: insert, update, skip, retire (gone but to be kept) or delete."""
    a = old.select(key, *(F.col(f).alias(f"old_{f}") for f in fields), F.lit(1).alias("was"), (F.lit(False) if keep is None else keep).alias("keep"))
    b = new.select(key, *(F.col(f).alias(f"new_{f}") for f in fields), F.lit(1).alias("is"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    action = (
        F.when(F.col("was").isNull(), "insert")
        .when(F.col("is").isNull(), F.when(F.col("keep"), "retire").otherwise("delete"))
        .when(same, "skip")
        .otherwise("update")
    )
    value = lambda f: F.when(F.col("is").isNull(), F.col(f"old_{f}")).otherwise(F.col(f"new_{f}")).alias(f)
    return a.join(b, key, "full_outer").select(key, action.alias("action"), *map(value, fields))


def merged(acted: DataFrame) -> DataFrame:
    """The table after the actions, with a flag for retired rows."""
    return acted.where("action <> 'delete'").withColumn("retired", F.col("action") == "retire").drop("action")


def shrink_guard(old: DataFrame, new: DataFrame, least_share: float = 0.5) -> DataFrame:
    """One row: counts, and whether the new snapshot is large enough to replace the old."""
    a, b = old.agg(F.count("*").alias("n_old")), new.agg(F.count("*").alias("n_new"))
    return a.join(b, F.lit(True)).withColumn("allowed", F.col("n_new") >= least_share * F.col("n_old"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, checked) of each rule, in one pass; a rule that is null is violated."""
    counts = df.agg(F.count("*").alias("checked"), *(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))
    listed = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))
    return counts.select("checked", F.explode(listed).alias("r")).select("r.rule", "r.violations", "checked")


def reasons(checks: dict[str, Column]) -> Column:
    """The names of all checks that hold, in order."""
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())
