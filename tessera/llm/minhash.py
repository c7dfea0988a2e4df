"""Near-duplicate groups: min-max hashing, banding, and links confirmed on whole shingle sets.

Each permutation gives two signature values, its minimum and its maximum over the set, so a signature of 2p
values costs p hash evaluations per shingle; both agree between two sets with the probability of their Jaccard
similarity. A band is some values of different permutations.

Candidates are never all pairs of a bucket. First every set of a bucket meets one of its members, that which most
sets meet in all buckets. Only where confirmed links leave a bucket in more than one piece, sets of different
pieces meet, and of these only such as can be similar enough:

- Shingles that no other set of such buckets has are in no intersection, and in every union.
- Two sets that share nothing beyond the bucket's lead share no more than either shares with the lead, so by their
  sizes alone most such pairs are out; others are found by a shingle that they share and the lead lacks.
- That holds for sets near the lead. As distances of sets obey the triangle inequality, a pair similar enough is
  either near the lead as a whole, or far from it as a whole; far sets meet in their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, saved, texts_of
from tessera.llm.graph import components
from tessera.llm.words import mixed, shingle_sets

WORDS, PERCENT, PERMUTATIONS, ROWS = 5, 75, 64, 4


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """Signatures of non-empty sets: a row each, of all minima, then all maxima."""
    seeds = mixed(np.arange(2 * permutations, dtype=np.uint64), 77)
    every = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    for k in range(permutations):
        image = every * (seeds[k] | np.uint64(1)) + seeds[permutations + k]
        out[:, k] = np.minimum.reduceat(image, at)
        out[:, permutations + k] = np.maximum.reduceat(image, at)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One key for each band of so many values; the band's number is part of the key."""
    n, width = signatures.shape
    bands = signatures[:, : width // rows * rows].reshape(n, -1, rows)
    key = np.broadcast_to(mixed(np.arange(bands.shape[1], dtype=np.uint64), 5), bands.shape[:2]).copy()
    for k in range(rows):
        key = mixed(key ^ bands[:, :, k], k)
    return key


def _set_keys(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    return tuple([int(mixed(s, seed).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for seed in (11, 12))


def signatures(texts: DataFrame, words: int, permutations: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (equal for equal sets only), bands."""

    def work(columns: list) -> dict:
        ids, each = columns
        sets = shingle_sets(each, words)
        k1, k2 = _set_keys(sets)
        bands: list = [[] for _ in sets]
        full = [i for i, s in enumerate(sets) if len(s)]
        for at in range(0, len(full), 64):
            part = full[at : at + 64]
            keys = band_keys(min_max([sets[i] for i in part], permutations), rows).view(np.int64)
            for i, row in zip(part, keys):
                bands[i] = row
        return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "k1": k1, "k2": k2, "bands": bands}

    return map_rows(texts, work, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


#: Similarity to the lead, in per cent less than the least similarity of a link, from which a set is near; and the
#: similarity, 40 points below 1, under which it is far. No link joins a set that is not near to one that is not far.
_NEAR_BELOW, _FAR = 40, 60


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with the size of their intersection. A set that many pairs share is only copied by the join,
    whose large partitions Spark splits."""
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(q) - len(_beyond(q, p)) for p, q in zip(_rows(batch.column(2)), _rows(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(common, pa.int64())], ["a", "b", "common"])

    joined = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long, common long")


def _linked(compared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    n = groups.select("id", "n")
    sized = compared.join(n.withColumnsRenamed({"id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"id": "b", "n": "nb"}), "b")
    return sized.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _residues(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(lead, id, shingle): of members (lead, id), the shingles that the lead lacks."""
    one, two = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("lead", "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [_beyond(q, p) for p, q in zip(_rows(batch.column(2)), _rows(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(left, pa.list_(pa.int64()))], ["lead", "id", "left"])

    joined = members.join(two, "id").join(one, "lead").select("lead", "id", "set_lead", "set_id")
    made = joined.mapInArrow(run, "lead long, id long, left array<long>")
    return made.select("lead", "id", F.explode("left").alias("shingle"))


def _rows(lists: pa.ListArray) -> list[np.ndarray]:
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def _beyond(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What q has and p lacks; both sorted and distinct, p not empty."""
    at = np.searchsorted(p, q)
    return q[p[np.minimum(at, len(p) - 1)] != q]


def near_duplicates(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, permutations: int = PERMUTATIONS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (is that document).

    A link joins two documents whose sets of distinct word shingles (lower-cased A-Z) have at least percent
    similarity. A document of fewer words is one shingle; a null, empty or blank text has no shingles, n_shingles
    0, and is linked with nothing. Rows that repeat a doc_id count as one document, of the row with the smallest
    set key; rows without a doc_id take no part; other columns are not read. An empty table gives an empty result.
    """
    texts = texts_of(docs)
    signed = saved(signatures(texts, words, permutations, rows), "signatures")
    nodes = signed.groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles")).alias("s")).select("doc_id", "s.*")
    # equal sets are one node from here on: copies, however many, are pre-aggregated to their smallest doc_id
    groups = saved(nodes.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n")), "groups")

    placed = signed.join(groups.select(F.col("id").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    banded = placed.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    # written, here and below, so that the joins have two plain exchanges and Spark can split a bucket of very many sets
    shared = saved(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    buckets = saved(banded.join(shared, "key"), "buckets")  # only members of buckets that hold different sets

    met = buckets.groupBy("id").agg(F.sum("size").alias("met"))
    most = buckets.join(met, "id").groupBy("key").agg(F.max(F.struct("met", (-F.col("id")).alias("a"))).alias("most"))
    leads = saved(most.select("key", (-F.col("most.a")).alias("lead")), "leads")
    led = saved(buckets.join(leads, "key"), "led")
    pair = [F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")]
    pairs = led.where("id <> lead").select(*pair).distinct()
    wanted = buckets.select("id").distinct().join(groups, "id").select(F.col("id").alias("doc_id"), "k1", "k2")
    sets = saved(_sets(texts.join(wanted.select("doc_id"), "doc_id", "left_semi"), wanted, words), "sets")
    compared = saved(_compared(pairs, sets), "compared")
    links = saved(_linked(compared, groups, percent), "links")
    found = saved(components(links), "components")

    more = _late_pairs(led, found, groups, sets, compared, percent).distinct().join(compared, ["a", "b"], "left_anti")
    late = saved(_linked(_compared(more, sets), groups, percent), "links")
    if not late.isEmpty():
        found = components(links.unionByName(late))

    return (
        nodes.join(groups.select("k1", "k2", "id"), ["k1", "k2"], "left")
        .join(found, "id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )


def _late_pairs(led: DataFrame, found: DataFrame, groups: DataFrame, sets: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different pieces of a bucket that can still be similar enough."""
    member = led.where("size > 2").join(found, "id", "left").select("key", "lead", "id", F.coalesce("component", "id").alias("piece"))
    split = member.groupBy("key").agg(F.min("piece").alias("p"), F.max("piece").alias("q")).where("p < q")
    loose = saved(member.join(split.select("key"), "key", "left_semi"), "loose")

    shingles = sets.join(loose.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("shingle"))
    alone = shingles.groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").groupBy("id").agg(F.count("*").alias("u"))
    sized = groups.select("id", "n").join(alone, "id", "left").select("id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    able = loose.join(sized, "id").where(100 * (F.col("n") - F.col("u")) >= percent * F.col("n"))

    a, b = F.least("id", "lead"), F.greatest("id", "lead")
    known = compared.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "common")
    sizes = groups.select(F.col("id").alias("lead"), F.col("n").alias("n_lead"))
    able = able.withColumns({"_a": a, "_b": b}).join(known, ["_a", "_b"], "left").join(sizes, "lead")
    able = able.withColumn("common", F.coalesce("common", "n"))  # the lead itself
    union = F.col("n") + F.col("n_lead") - F.col("common")
    able = saved(able.select("key", "lead", "id", "piece", "n", "u", "common", (100 * F.col("common") / union).alias("nearness")), "able")
    near, far = able.where(F.col("nearness") >= percent - _NEAR_BELOW), able.where(F.col("nearness") < _FAR)

    def met(x: DataFrame, by: list[str], also=F.lit(True)) -> DataFrame:
        columns = [c for c in x.columns if c not in by]
        p, q = (x.select(*by, *(F.col(c).alias(c + s) for c in columns)) for s in "xy")
        most_common = F.least(F.col("nx") - F.col("ux"), F.col("ny") - F.col("uy"))
        least_union = F.greatest(F.col("nx") + F.col("uy"), F.col("ny") + F.col("ux"))
        fits = (F.col("idx") < F.col("idy")) & (F.col("piecex") != F.col("piecey")) & (100 * most_common >= percent * least_union)
        return p.join(q, by).where(fits & also).select(F.col("idx").alias("a"), F.col("idy").alias("b"))

    inside = (100 + percent) * F.least("commonx", "commony") >= percent * (F.col("nx") + F.col("ny"))
    residues = saved(_residues(near.where("id <> lead").select("lead", "id").distinct(), sets), "residues")
    about = able.select("id", "piece", "n", "u").distinct()
    residues = residues.join(about, "id")
    mixed_up = residues.groupBy("lead", "shingle").agg(F.min("piece").alias("p"), F.max("piece").alias("q")).where("p < q")
    beyond = residues.join(mixed_up.select("lead", "shingle"), ["lead", "shingle"], "left_semi")
    return (
        met(near.select("key", "id", "piece", "n", "u", "common"), ["key"], inside)
        .unionByName(met(beyond.select("lead", "shingle", "id", "piece", "n", "u"), ["lead", "shingle"]))
        .unionByName(met(far.select("key", "id", "piece", "n", "u"), ["key"]))
    )


def _sets(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, shingles): sorted hashes of the wanted documents."""

    def work(columns: list) -> dict:
        ids, each = columns
        sets = shingle_sets(each, words)
        k1, k2 = _set_keys(sets)
        return {"doc_id": ids, "k1": k1, "k2": k2, "shingles": [np.sort(s.view(np.int64)) for s in sets]}

    made = map_rows(texts, work, "doc_id long, k1 long, k2 long, shingles array<long>")
    return (
        made.join(wanted, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "shingles")
    )
