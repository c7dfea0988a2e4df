"""Filter interaction audit: what every order of five filters removes, from one count a failure mask.

A document's failures are a mask of five bits. Under an order of the filters it goes at the first filter that it fails, so
the step of its removal is settled by a prefix of the order: filters it passes, then one that it fails. The orders that
share a prefix are an interval of lexicographic (Lehmer) ranks. Each mask's count is added where such an interval starts and
taken off where it ends; a running sum over the 120 ranks gives what every order removes at every step.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_UPPER = bytes(range(65, 91))
_TAILS = bytes(range(0x80, 0xC0))
_MARKS = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The mask of the four filters that look at one text: under 200 words, under half of them distinct, over 2 % capital
    letters, a mark. Words are what stands between the six ASCII white-space characters, as bytes.split parts them."""
    words = text.split()
    points = len(text.translate(None, _TAILS))
    capitals = len(text) - len(text.translate(None, _UPPER))
    few, same = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return few | same << 1 | (100 * capitals > 2 * points) << 2 | bool(_MARKS.search(text)) << 3


def interval_ends() -> list[tuple[int, int, int, int]]:
    """(mask, step, rank, +1 or -1): where the intervals of orders that remove a mask at a step start and end. Derived from
    the 325 prefixes of the 120 orders; at most 32 * 650 rows, whatever the data."""
    starts: dict[str, int] = {}
    for rank, order in enumerate(ORDERS):
        for step in range(1, len(FILTERS) + 1):
            starts.setdefault(order[:step], rank)
    ends = []
    for mask in range(1, 1 << len(FILTERS)):
        failed = {f for bit, f in enumerate(FILTERS) if mask >> bit & 1}
        for prefix, rank in starts.items():
            if prefix[-1] in failed and failed.isdisjoint(prefix[:-1]):
                ends.append((mask, len(prefix), rank, 1))
                if (end := rank + factorial(len(FILTERS) - len(prefix))) < len(ORDERS):
                    ends.append((mask, len(prefix), end, -1))
    return ends


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters they fail, and those labelled good or toxic.

    Only digests of texts are shuffled. Equal texts fail the first four filters alike, so copies are counted by digest, part
    and label before they meet their smallest doc_id: a digest of very many copies is a few rows by then.
    """

    def work(columns: list) -> dict:
        ids, parts, texts = columns
        return {
            "doc_id": ids, "part": parts, "mask": [failures(t) for t in texts], "digest": [hashlib.sha256(t).digest() for t in texts],
        }

    plain = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    judged = map_rows(plain, work, "doc_id long, part string, mask int, digest binary")
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    marked = judged.join(marks, "doc_id", "left").na.fill(False, ["quality", "toxic"])
    kind = ["digest", "part", "mask", "quality", "toxic"]
    # rows of one doc_id first, so that the rows of a group's smallest doc_id are known: these alone are no copies
    ids = marked.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    groups = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    fresh = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    told = groups.withColumn("first", first).withColumn("fresh", fresh)
    copies = 1 << FILTERS.index("E")
    pair = F.array(F.struct(F.col("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))
    each = told.select("part", "quality", "toxic", F.explode(pair).alias("m")).where("m.n > 0")
    n = F.col("m.n")
    return each.groupBy("part", F.col("m.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(F.when(F.col("quality"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


def _pick(letter: Column, values: dict[str, Column]) -> Column:
    out = F.when(F.lit(False), F.lit(0).cast("long"))
    for f, value in values.items():
        out = out.when(letter == f, value)
    return out


def totals(counts: DataFrame) -> DataFrame:
    """Of masks(): what every order does at every step, 600 rows a part."""
    spark = counts.sparkSession
    failing = lambda f: F.col("mask").bitwiseAND(1 << FILTERS.index(f)) != 0
    count = lambda hit, name: F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(name)
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *(count(failing(f), f"fails_{f}") for f in FILTERS), *(count(F.col("mask") == 1 << FILTERS.index(f), f"only_{f}") for f in FILTERS),
    )
    ends = F.broadcast(spark.createDataFrame(interval_ends(), "mask int, step int, rank int, sign int"))
    sums = ["removed", "good_lost", "toxic_lost"]
    signed = counts.join(ends, "mask").select("part", "step", "rank", *((F.col(a) * F.col("sign")).alias(b) for a, b in zip(["n", "good", "toxic"], sums)))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    grid = parts.select("part", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("rank")).select("part", steps.alias("step"), "rank")
    zeros = grid.select("part", "step", "rank", *(F.lit(0).cast("long").alias(c) for c in sums))
    differences = signed.unionByName(zeros).groupBy("part", "step", "rank").agg(*(F.sum(c).alias(c) for c in sums))
    ranks = Window.partitionBy("part", "step").orderBy("rank")
    removed = differences.select("part", "step", "rank", *(F.sum(c).over(ranks).alias(c) for c in sums))
    order = F.element_at(F.array(*(F.lit(o) for o in ORDERS)), F.col("rank") + 1)
    named = removed.join(parts, "part").withColumn("filter_order", order).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    gone = F.sum("removed").over(Window.partitionBy("part", "rank").orderBy("step"))
    every = F.sum("removed").over(Window.partitionBy("part", "letter"))
    of = lambda name: _pick(F.col("letter"), {f: F.col(f"{name}_{f}") for f in FILTERS})
    return named.select(
        "part", "filter_order", "step", (F.col("total") - gone).alias("kept"), "removed", (of("fails") - F.col("removed")).alias("redundant"),
        of("only").alias("unique_fails"), "good_lost", "toxic_lost", every.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null source as the part ''. A document is good (toxic) if any row of labels with its
    doc_id says so; other labels and their nulls count as no. A text is a copy if it equals that of a smaller doc_id: rows
    that repeat a doc_id are no copies of each other, and a row without a doc_id is neither copy nor original, but is
    counted. Empty tables give no rows. Other columns are not read.
    """
    return totals(masks(docs, labels))
