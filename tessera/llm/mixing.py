"""Mixing documents to target weights: token weights of (source, language, topic) cells are raked to marginals by
iterative proportional fitting, and documents are sampled by the calibrated probabilities.

DataFrame functions only. What is iterated is the table of cells, not the documents; each step is a pre-aggregated sum
of cells by one dimension, so a value that holds most cells is no single task's group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the present shares to this power, made to sum to 1: rare values gain, common ones lose.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.8}
#: Expected share of all tokens that is kept.
BUDGET = 0.5
MOST_ROUNDS, TOLERANCE = 50, 1e-10
#: Cells for one part of a written table of cells.
CELLS_A_PART = 200_000
#: Tables of cells or factors up to so many rows are broadcast; larger ones are joined.
MOST_BROADCAST_CELLS = 100_000
MISSING = "(none)"

# The topics and what tells them, first match first.
TOPICS = [("legal", r"(?i)licen[sc]e|copyright|all rights reserved"), ("contact", "[0-9@]")]
SHORT = 1_000


def topic_of(text: Column) -> Column:
    topic = F.when(text.isNull() | (F.length(text) == 0), MISSING)
    for name, pattern in TOPICS:
        topic = topic.when(text.rlike(pattern), name)
    return topic.when(F.length(text) < SHORT, "short").otherwise("prose")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighed(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens: missing values have a name of their own."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *named, topic_of(F.col("text")).alias("topic"), token_count(F.col("text")).alias("n_tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(value, share): target shares of a dimension's values."""
    mass = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("mass").alias("m")).where("m > 0")
    raised = mass.select("value", F.pow(F.col("m").cast("double"), F.lit(power)).alias("t"))
    return raised.join(raised.agg(F.sum("t").alias("all")), F.lit(True)).select("value", (F.col("t") / F.col("all")).alias("share"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], rounds: int = MOST_ROUNDS, tolerance: float = TOLERANCE
) -> tuple[DataFrame, float]:
    """cells (dimensions, which are strings, and mass) with weight: shares of 1 that keep the cells' interactions and
    meet the targets; and the residual, the largest share by which a factor still moved in the last round.

    targets: for each dimension, (value, share); a value without a target gets weight 0. Rounds end when no value's
    factor moves by more than tolerance, which one number tells the driver. Targets that contradict each other end at
    `rounds`, and the residual, which is above tolerance then, tells so.

    Each dimension's step is a job of its own, over cells that were written by the step before: sums of the weights by
    that dimension, which are pre-aggregated, and one join with them. No step's plan holds an earlier one.
    """
    columns = cells.columns
    now = cells.where("mass > 0").withColumns({"weight": F.col("mass").cast("double"), "moved": F.lit(0.0)})
    parts = 1 + now.count() // CELLS_A_PART
    for d, t in targets.items():
        now = now.join(t.select(F.col("value").alias(d), F.col("share").alias(f"t_{d}")), d, "left")
    now = saved(now.na.fill(0.0, [f"t_{d}" for d in targets]).coalesce(parts), "cells")
    values = now.agg(*(F.count_distinct(d).alias(d) for d in targets)).first()
    residual = 0.0
    for _ in range(rounds):
        for n, d in enumerate(targets):
            sums = now.groupBy(d).agg(F.sum("weight").alias("sum"))
            factor = F.when(F.col("sum") > 0, F.col(f"t_{d}") / F.col("sum")).otherwise(0.0)
            moved = F.when(F.col("weight") > 0, F.abs(factor - 1)).otherwise(0.0)
            stepped = now.join(F.broadcast(sums) if values[d] <= MOST_BROADCAST_CELLS else sums, d).select(
                *columns, *(f"t_{x}" for x in targets), (F.col("weight") * factor).alias("weight"), (F.greatest("moved", moved) if n else moved).alias("moved")
            )
            now = saved(stepped.coalesce(parts), "cells")
        residual = now.agg(F.max("moved")).first()[0] or 0.0
        if residual <= tolerance:
            break
    return now.select(*columns, "weight"), residual


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """raked cells with probability: weight over mass, scaled so that the expected tokens are `budget` of all; where
    the scaled value is over 1 it is 1, and the others are scaled up for it."""
    rated = saved(cells.withColumn("rate", F.col("weight") / F.col("mass")), "cells")
    total = rated.agg(F.sum("mass")).first()[0]
    scale, capped = None, -1
    while total:
        over = F.lit(False) if scale is None else F.col("rate") * scale >= 1
        sums = rated.agg(
            F.count_if(over), F.sum(F.when(over, F.col("mass"))), F.sum(F.when(~over, F.col("weight")))
        ).first()
        if sums[0] == capped or not sums[2]:
            break
        capped = sums[0]
        scale = (budget * total - (sums[1] or 0)) / sums[2]
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * F.lit(float(scale or 0.0))))


def draw(doc_id: Column, seed: str) -> Column:
    """A value in [0, 1) for each document, the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), doc_id.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(
    docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = BUDGET, seed: str = "mix", targets: dict[str, DataFrame] | None = None
) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, kept for every document, and residual: how far the fitting
    was from its end (see rake), the same in all rows.

    Missing source, lang or text have a value of their own, (none), that is raked as any other; documents without
    words have no mass and are kept with probability 0. Rows that repeat a doc_id share a draw, so they are kept or
    dropped together; a null doc_id is never kept. An empty table gives an empty result; other columns are not read.
    The texts are read once: what is written of them is their cells and token counts.
    """
    each = saved(weighed(docs), "weighed")
    cells = saved(each.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("mass")), "cells")
    wanted = targets or {d: tempered(cells, d, powers[d]) for d in DIMENSIONS}
    raked, residual = rake(cells, wanted)
    done = saved(calibrated(raked, budget).select(*DIMENSIONS, "probability"), "cells")
    if done.count() <= MOST_BROADCAST_CELLS:
        done = F.broadcast(done)
    probability = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return (
        each.join(done, list(DIMENSIONS), "left")
        .withColumn("probability", probability)
        .select(
            "doc_id", *DIMENSIONS, "n_tokens", "probability",
            F.coalesce(draw(F.col("doc_id"), seed) < F.col("probability"), F.lit(False)).alias("kept"), F.lit(residual).alias("residual"),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that mix() keeps, whole."""
    kept = mix(docs, **options).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
