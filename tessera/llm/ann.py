"""Nearest neighbours by collision counting: single projections, sorted, with query-centred windows that widen.

Every vector has its place in M sorted arrays, one for each random projection. Around a query's own projection a
window of half-width W * R / 2 is cut from each array; a vector that is in at least NEEDED of the M windows has
collided often enough and is verified, by its exact distance. R grows by a factor of STEP (virtual rehashing: no
array is built again), but never beyond the K-th best verified distance, at which it ends.

The arrays are kept by blocks of vectors, each small enough for a task. A block's vectors are shuffled and sorted once a pass,
and the queries stream past them, however many there are. A query is first answered by one block; its K-th distance there
bounds the windows in all other blocks, which cut them once. The answers of the blocks, K for each query, are merged. What
grows with both is the queries alone: each is sent once to every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved

K = 10
#: Projections, collisions needed, width of a window for distance 1, growth of the radius.
M, NEEDED, W, STEP = 200, 127, 2.0, 1.1
#: Vectors of one block.
BLOCK = 16_384
SEED = 20_240_607


def projections(dim: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, m))


class SortedProjections:
    """The index of one block: each projection's values in order, and whose they are. The arrays lie in a row, far enough
    apart to be searched at once."""

    def __init__(self, vectors: np.ndarray, directions: np.ndarray) -> None:
        image = np.ascontiguousarray((vectors @ directions).T)
        m, self.size = image.shape
        order = np.argsort(image, axis=1)
        self.most = float(np.abs(image).max(initial=0.0)) + 1.0
        self.base = np.arange(m) * self.size
        self.offset = np.arange(m) * (4 * self.most)
        self.values = (np.take_along_axis(image, order, axis=1) + self.offset[:, None]).ravel()
        self.who = order.astype(np.int32).ravel()

    def windows(self, image: np.ndarray) -> Windows:
        return Windows(self, image)

    def within(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each array, the places of values from low to high."""
        low, high = (np.clip(x, -self.most, self.most) + self.offset for x in (low, high))
        return np.searchsorted(self.values, low), np.searchsorted(self.values, high, side="right")


class Windows:
    """One query's windows, one in each array, and how many of them hold each vector. They only ever widen."""

    def __init__(self, index: SortedProjections, image: np.ndarray) -> None:
        self.index, self.image = index, image
        self.low = self.high = index.within(image, image)[0]
        self.counts = np.zeros(index.size, np.int64)

    def widen(self, half: float) -> np.ndarray:
        a, b = self.index.within(self.image - half, self.image + half)
        a, b, who = np.minimum(a, self.low), np.maximum(b, self.high), self.index.who
        new = [who[x:y] for x, y in zip([*a.tolist(), *self.high.tolist()], [*self.low.tolist(), *b.tolist()]) if x < y]
        if new:
            self.counts += np.bincount(np.concatenate(new), minlength=len(self.counts))
        self.low, self.high = a, b
        return self.counts


class Block:
    """The vectors of one block with their arrays, and searches in it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = M, needed: int = NEEDED, width: float = W, step: float = STEP) -> None:
        self.ids, self.vectors, self.needed, self.width, self.step = ids, vectors, needed, width, step
        self.directions = projections(vectors.shape[1], m)
        self.index = SortedProjections(vectors, self.directions)
        self.norms = (vectors**2).sum(1)
        self.spread = float(np.sqrt((vectors.var(0)).sum())) or 1.0
        self.names, self.name = np.unique(ids, return_inverse=True)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(query_id, ids, distances, how many were verified) of each query's nearest verified vectors, up to all that tie with
        the k-th different id. bars: distances of which only such up to them are wanted, for each query."""
        ids, vectors, name = self.ids, self.vectors, self.name
        for query_id, query, image, bar in zip(query_ids, queries, queries @ self.directions, bars.tolist()):
            wanted = min(k, int((self.names != query_id).sum()))
            radius = bar if np.isfinite(bar) else self.spread / 2
            windows = self.index.windows(image)
            verified = np.zeros(len(ids), bool)
            distance = np.full(len(ids), np.inf)
            least = np.full(len(self.names), np.inf)  # of each id
            verified[ids == query_id] = True
            own = int(verified.sum())
            while wanted:
                hit = np.flatnonzero((windows.widen(self.width * radius / 2) >= self.needed) & ~verified)
                if len(hit):
                    verified[hit] = True
                    # those clearly beyond the k-th best id are left out by a quicker sum
                    rough = self.norms[hit] - 2 * (vectors[hit] @ query) + query @ query
                    squares = least**2
                    np.minimum.at(squares, name[hit], rough)
                    most = min(np.partition(squares, wanted - 1)[wanted - 1], bar * bar)
                    near = hit[rough <= most + 1e-6 * (1 + abs(most))]
                    distance[near] = np.sqrt(((vectors[near] - query) ** 2).sum(1))
                    np.minimum.at(least, name[near], distance[near])
                    bar = min(bar, np.partition(least, wanted - 1)[wanted - 1])
                if bar <= radius or verified.all():
                    break
                radius = min(radius * self.step, bar)
            took = np.flatnonzero((distance <= bar) & (distance < np.inf))
            yield query_id, ids[took], distance[took], int(verified.sum()) - own


def nearest(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K, bars: np.ndarray | None = None, **options: float
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Block.nearest() over vectors in memory."""
    return Block(ids, vectors, **options).nearest(query_ids, queries, k, np.full(len(query_ids), np.inf) if bars is None else bars)


def usable(embeddings: DataFrame) -> DataFrame:
    """Different (vec_id, vector of doubles): not null, zero, empty, or with null or non-finite components."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
        .where("vec_id IS NOT NULL AND vector IS NOT NULL")
        .where(finite)
        .where(F.exists("vector", lambda x: x != 0))
        .distinct()
    )


def search(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id divisible by `every`) its k nearest found by Euclidean
    distance, nearest first, ties to the smaller vec_id; the query's own row is no candidate of it. And verified: of how
    many vectors the query's distance was computed.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a
    vec_id; vectors of different lengths are never compared. Rows that repeat a vec_id and vector count once; if
    the vectors differ, the nearer one counts. Queries with fewer candidates get all; other columns are not read.
    """
    spark = embeddings.sparkSession
    rows = saved(usable(embeddings).withColumn("dim", F.size("vector")), "vectors")
    sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    # a block holds about BLOCK vectors of one length, by hash
    blocks = spark.createDataFrame([(d, max(1, -(-n // BLOCK))) for d, n in sizes.items()], "dim int, blocks int")
    spot = F.xxhash64("vec_id")
    placed = rows.join(F.broadcast(blocks), "dim").withColumn("block", F.pmod(spot, "blocks").cast("int"))
    asked = placed.where(F.col("vec_id") % every == 0)

    def answers(block: Block, queries: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = block.nearest(queries["vec_id"].to_numpy(), np.stack(queries["vector"].to_list()), k, queries["bar"].to_numpy(float))
        for query_id, ids, distances, verified in found:
            order = np.lexsort((ids, distances))
            keep = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]
            # the first row of a block has no vec_id, but tells what was verified
            columns = {"vec_id": [None, *ids[keep].tolist()], "score": [None, *distances[keep]], "verified": [verified] + [0] * len(keep)}
            yield pd.DataFrame({"query_id": query_id} | columns).astype({"vec_id": "Int64"})

    def past(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks in a row: the vectors of each, then its queries."""
        now, held, block = None, [], None
        for frame in frames:
            for key, part in frame.groupby(["dim", "block"], sort=False):
                if key != now:
                    now, held, block = key, [], None
                queries = part["bar"].notna()
                if not queries.all():
                    vectors = part[~queries]
                    held.append((vectors["vec_id"].to_numpy(), np.stack(vectors["vector"].to_list())))
                if queries.any() and held:
                    if block is None:
                        block, held = Block(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])), [()]
                    yield from answers(block, part[queries])

    def answered(queries: DataFrame) -> DataFrame:
        """queries: dim, block, vec_id, vector, bar; each meets the vectors of its block."""
        columns = ["dim", "block", "vec_id", "vector", "bar"]
        vectors = placed.join(queries.select("dim", "block").distinct(), ["dim", "block"], "left_semi").withColumn("bar", F.lit(None).cast("double"))
        both = vectors.select(*columns).unionByName(queries.select(*columns)).repartition("dim", "block")
        ordered = both.sortWithinPartitions("dim", "block", F.col("bar").isNotNull())
        return ordered.mapInPandas(past, "query_id long, vec_id long, score double, verified long")

    first = saved(answered(asked.withColumn("bar", F.lit(float("inf")))), "first")
    bars = first.where("vec_id IS NOT NULL").groupBy("query_id").agg(
        F.when(F.count_distinct("vec_id") >= k, F.max("score")).otherwise(float("inf")).alias("bar")
    )
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))
    known = asked.join(bars.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf"))))
    second = answered(known.select("dim", F.explode(others).alias("block"), "vec_id", "vector", "bar"))

    each = saved(first.unionByName(second), "answers")
    totals = each.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    once = each.where("vec_id IS NOT NULL").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).join(totals, "query_id").select("query_id", "rank", "vec_id", "score", "verified")
