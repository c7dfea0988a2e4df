"""Repeated passages by level-wise doubling: what repeats at one length alone is looked at, at twice that length.

The first level takes windows of half the wanted length. Not all of them: of the half-windows inside a wanted
window the one with the smallest hash, which equal windows share, so a wanted window that repeats always holds a
half-window of the first level that repeats. Those that do are extended to whole windows, and only these are
counted; levels of twice, four times, ... the length go on the same way until nothing survives, and each document is
given the longest level that it shares. Each level is one pre-aggregated count, so a passage that very many documents
share costs a row a task there.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, saved, texts_of
from tessera.llm.words import mixed, sequence_hashes, word_hashes

WINDOW = 50
#: Up to so many document ids are broadcast to thin out the texts before a shuffle (8 bytes each); above, the join
#: alone does it.
MOST_BROADCAST_IDS = 1_000_000

_PLACE = np.uint64((1 << 26) - 1)
_EMPTY = hashlib.sha256(b"").hexdigest()


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each width consecutive values."""
    n, size, least = len(values) - width + 1, 1, values
    if n <= 0:
        return values[:0]
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[:n], least[width - size : width - size + n])


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the half-windows, for each window the place of its smallest half-window, leftmost of equals)."""
    half = sequence_hashes(words, window // 2)
    places = np.arange(len(half), dtype=np.uint64)
    return half, (sliding_min(half & ~_PLACE | places, window - window // 2 + 1) & _PLACE).astype(np.int64)


def profile(texts: DataFrame, window: int) -> DataFrame:
    """Each document's word count, keys of its word sequence, digest of its words, and first-level windows."""

    def work(columns: list) -> dict:
        ids, rows, each = columns
        words, bounds = word_hashes(each, lower=False)
        out: dict = {k: [] for k in ("n_words", "s1", "s2", "sha256", "hashes", "places")}
        for text, a, b in zip(each, bounds[:-1].tolist(), bounds[1:].tolist()):
            own = words[a:b]
            whole = [int(mixed(sequence_hashes(own, b - a), seed).sum(dtype=np.uint64).astype(np.int64)) for seed in (1, 2)]
            half, least = anchors(own, window)
            places = np.unique(least)
            plain = b" ".join(text.encode("utf-8", "surrogatepass").split())
            for k, v in zip(out, (b - a, *whole, hashlib.sha256(plain).hexdigest(), half[places].view(np.int64), places.astype(np.int32))):
                out[k].append(v)
        return {"doc_id": ids, "row": rows} | out

    return map_rows(
        texts, work, "doc_id long, row long, n_words long, s1 long, s2 long, sha256 string, hashes array<long>, places array<int>"
    )


def _repeated(windows: DataFrame) -> DataFrame:
    """windows (doc_id, hashes, places) to (doc_id, place, first): those whose hash more documents hold, with the
    smallest of them."""
    each = windows.select("doc_id", F.explode(F.arrays_zip("hashes", "places")).alias("w")).select(
        F.col("w.hashes").alias("hash"), "doc_id", F.col("w.places").alias("place")
    )
    shared = each.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # written, so that the join has two plain exchanges and Spark can split a passage that very many documents hold
    return each.join(saved(shared.select("hash", "first"), "shared"), "hash").select("doc_id", "place", "first")


def _with_texts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """texts joined with places by (doc_id, row); few enough ids are broadcast first, to shuffle no other texts."""
    if places.count() <= MOST_BROADCAST_IDS:
        texts = texts.join(F.broadcast(places.select("doc_id")), "doc_id", "left_semi")
    return texts.join(places, ["doc_id", "row"]).select("doc_id", "row", "text", "places")


def _extended(texts: DataFrame, alive: DataFrame, window: int, length: int) -> DataFrame:
    """Windows of length whose parts of the level before are alive: (doc_id, row, hashes, places)."""

    def work(columns: list) -> dict:
        ids, rows, each, places = columns
        words, bounds = word_hashes(each, lower=False)
        hashes, kept = [], []
        for at, a, b in zip(places, bounds[:-1].tolist(), bounds[1:].tolist()):
            own = words[a:b]
            on = np.zeros(b - a + 1, bool)
            on[np.asarray(at, np.int64)] = True
            if length == window:
                found = np.flatnonzero(on[anchors(own, window)[1]])
            else:
                n = max(0, b - a - length + 1)
                found = np.flatnonzero(on[:n] & on[length // 2 : length // 2 + n])
            hashes.append(sequence_hashes(own, length)[found].view(np.int64))
            kept.append(found.astype(np.int32))
        return {"doc_id": ids, "row": rows, "hashes": hashes, "places": kept}

    return map_rows(_with_texts(texts, alive), work, "doc_id long, row long, hashes array<long>, places array<int>")


def _by_document(windows: DataFrame, keys: DataFrame, where: Column | bool = True) -> DataFrame:
    found = windows.where(where) if where is not True else windows
    return found.groupBy("doc_id").agg(F.collect_list("place").alias("places")).join(keys.select("doc_id", "row"), "doc_id")


def remove_repeats(docs: DataFrame, window: int = WINDOW, longest: int | None = None, texts_too: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, longest (longest level at which the document shares a window; 0 if
    none) and, if texts_too, kept_text.

    Each word goes that a window of so many words covers, of which an equal one starts in a document with a
    smaller doc_id; windows are judged on the input. A null, empty or short text has no windows and loses
    nothing. Of rows that repeat a doc_id one counts, that with the smallest text hash; rows without a doc_id
    take no part; other columns are not read. An empty table gives an empty result. longest: doubling goes on to
    this length at most, by default to window.
    """
    texts = texts_of(docs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    about = saved(profile(texts, window), "profile")
    again = about.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("row").alias("one")).where("n > 1")
    if not again.isEmpty():
        about = saved(
            about.join(again, "doc_id", "left").where("n IS NULL OR row = one").drop("n", "one").dropDuplicates(["doc_id"]), "profile"
        )
        texts = texts.join(about.select("doc_id", "row"), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id"])

    # whole copies are settled by their word sequence, and only its first document goes on
    firsts = saved(about.groupBy("s1", "s2", "n_words").agg(F.min("doc_id").alias("first_copy"), F.count("*").alias("copies")), "firsts")
    keyed = saved(about.drop("hashes", "places").join(firsts, ["s1", "s2", "n_words"]), "keys")
    leading = keyed.where(F.col("doc_id") == F.col("first_copy")).where(F.col("n_words") >= window).select("doc_id", "row", "n_words")

    first_level = about.where(F.size("places") > 0).join(leading, ["doc_id", "row"], "left_semi")
    alive = saved(_by_document(_repeated(first_level), leading), "level")
    windows = saved(_extended(texts, alive, window, window), "windows")
    repeats = saved(_repeated(windows), "repeats")
    levels = [repeats.select("doc_id", F.lit(window).alias("level")).distinct()]
    length, alive = 2 * window, repeats
    while longest is None or length <= longest:
        at = saved(_by_document(alive, leading.where(F.col("n_words") >= length)), "level")
        if at.isEmpty():
            break
        alive = saved(_repeated(_extended(texts, at, window, length)), "repeats")
        levels.append(alive.select("doc_id", F.lit(length).alias("level")).distinct())
        length *= 2
    deepest = levels[0]
    for more in levels[1:]:
        deepest = deepest.unionByName(more)
    deepest = deepest.groupBy("doc_id").agg(F.max("level").alias("longest"))

    def cut(columns: list) -> dict:
        ids, rows, each, places = columns
        removed, digests, kept_texts = [], [], []
        for text, at in zip(each, places):
            words = text.encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + window + 1, np.int32)
            np.add.at(edge, np.asarray(at, np.int64), 1)
            np.add.at(edge, np.asarray(at, np.int64) + window, -1)
            covered = (np.cumsum(edge)[: len(words)] > 0).tolist()
            kept = b" ".join([w for w, c in zip(words, covered) if not c])
            removed.append(sum(covered))
            digests.append(hashlib.sha256(kept).hexdigest())
            kept_texts.append(kept.decode("utf-8", "surrogatepass") if texts_too else None)
        return {"doc_id": ids, "cut": removed, "cut_sha256": digests, "cut_text": kept_texts}

    marked = _by_document(repeats, leading, F.col("first") < F.col("doc_id"))
    changed = map_rows(_with_texts(texts, saved(marked, "marks")), cut, "doc_id long, cut long, cut_sha256 string, cut_text string")
    reached = F.col("n_words") if longest is None else F.least(F.col("n_words"), F.lit(longest))
    doublings = F.floor(F.log2(reached / window))
    whole = (F.pow(F.lit(2.0), doublings) * window).cast("int")
    copy = (F.col("doc_id") != F.col("first_copy")) & (F.col("n_words") >= window)
    result = (
        keyed.join(changed, "doc_id", "left")
        .join(deepest.withColumnRenamed("doc_id", "first_copy"), "first_copy", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
            F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha256", "sha256")).alias("kept_sha256"),
            F.greatest(F.coalesce("longest", F.lit(0)), F.when((F.col("copies") > 1) & (F.col("n_words") >= window), whole).otherwise(0)).alias("longest"),
            *([F.when(copy, F.lit("")).otherwise(F.col("cut_text")).alias("cut_text")] if texts_too else []),
        )
    )
    if texts_too:
        plain = texts.select("doc_id", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).alias("all_text"))
        result = result.join(plain, "doc_id").select(
            *result.columns[:-1], F.coalesce("cut_text", "all_text").alias("kept_text")
        )
    return result
