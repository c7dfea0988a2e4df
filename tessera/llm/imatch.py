"""I-Match fingerprints: the terms of a band of inverse document frequencies, sorted, hashed over randomised lexicon
subsets.

The band keeps terms that are neither rare nor common. The lexicon is cut into random subsets at several rates: at
rate 4**-j each subset holds one in SUBSETS * 4**j of its terms. A document's fingerprint is, for every rate and
subset, a hash of its sorted distinct terms there, or a dash. Two fingerprints are as alike as the share of equal
hashes, at the rate where they are most: short texts agree in the dense subsets, long ones in the sparse.

DataFrame functions only. The texts are shuffled once, by blocks of doc_ids; looking up terms, fingerprints and the
next document's all happen inside those blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, texts_of

#: The band, as shares of all documents that hold a term.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.1
SUBSETS, RATES = 16, 4
#: A rate counts where so many of its subsets hold terms of either text.
ENOUGH = 4
#: Documents of 2**BLOCK_BITS successive doc_ids are one block.
BLOCK_BITS = 8
#: A lexicon of so many terms is broadcast. The band bounds it (a term is in LEAST_SHARE of the documents, so there
#: are at most the mean number of distinct terms / LEAST_SHARE); one that is larger is joined.
MOST_BROADCAST_TERMS = 1_000_000
TERM = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """(term, subset, level): terms of the band; a term of level n is in the subsets of the first n + 1 rates."""
    n = texts.count()
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    digest = F.md5("term")
    wide = lambda a: F.conv(F.substring(digest, a, 8), 16, 10).cast("long")
    level = sum((F.when(wide(9) < 2 ** (32 - 2 * j), 1).otherwise(0) for j in range(1, RATES)), F.lit(0))
    return counted.where((F.col("df") >= F.greatest(F.lit(2.0), F.lit(least * n))) & (F.col("df") <= most * n)).select(
        "term", (wide(1) % SUBSETS).cast("int").alias("subset"), level.cast("int").alias("level")
    )


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def fingerprint(found: Column) -> Column:
    """Of an array of (term, subset, level) in term order: RATES * SUBSETS hashes, as one text."""
    hashed = lambda a: F.when(F.size(a) == 0, "-").otherwise(F.substring(F.md5(F.array_join(a, " ")), 1, 6))

    def subsets(own: Column) -> Column:
        one = lambda s: F.transform(F.filter(own, lambda t: t["subset"] == s), lambda t: t["term"])
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: _with(one(s), hashed)), ".")

    def printed(own: Column, j: int) -> list[Column]:
        """This rate and the sparser ones, each of what the one before has left."""
        if j == RATES:
            return []
        return [_with(F.filter(own, lambda t: t["level"] >= j), lambda o: F.concat_ws(":", subsets(o), *printed(o, j + 1)))]

    return _with(found, lambda f: printed(f, 0)[0])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints; of whole-text fingerprints (no term of the band) 1 if equal, else 0."""

    def rate(j: int) -> Column:
        x, y = (F.split(F.split(c, ":")[j], "[.]") for c in (a, b))
        both = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != "-") | (p["y"] != "-"))
        share = lambda o: F.when(
            F.size(o) >= (1 if j == 0 else ENOUGH), F.size(F.filter(o, lambda p: p["x"] == p["y"])) / F.size(o)
        )
        return _with(both, share)

    whole = a.startswith("x") | b.startswith("x")
    return F.when(whole, (a == b).cast("double")).otherwise(F.coalesce(F.greatest(*(rate(j) for j in range(RATES))), F.lit(0.0)))


def _with_next(texts: DataFrame) -> DataFrame:
    """texts by block with the next document's text: ascending (doc_id, text), after the last the first.

    Only the first document of each block is joined to the block before it.
    """
    cut = texts.withColumn("block", F.shiftright("doc_id", BLOCK_BITS))
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    own = cut.withColumn("nth", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    heads = own.where("nth = 1").select("block", F.col("text").alias("head"))
    before = successors(cut.select("block").distinct()).select(F.col("next").alias("block"), F.col("block").alias("at"))
    heads = heads.join(before, "block").select(F.col("at").alias("block"), "head")
    edge = F.col("after").isNull()
    return own.join(heads, "block").select(
        "block", "nth", "doc_id", "text", F.when(edge, F.col("head")).otherwise(F.col("after")).alias("after"), edge.alias("edge")
    )


def successors(blocks: DataFrame) -> DataFrame:
    """(block, next) of distinct numbers, ascending, the first after the last.

    Ranges of numbers are ordered each by itself; only the first number of each range is ordered by one task.
    """
    n = max(2, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = saved(blocks.repartitionByRange(n, "block").select("block", F.spark_partition_id().alias("range")), "blocks")
    firsts = ranged.groupBy("range").agg(F.min("block").alias("first"))
    ends = firsts.join(firsts.agg(F.min("first").alias("least")), F.lit(True)).select(
        "range", F.coalesce(F.lead("first").over(Window.orderBy("range")), "least").alias("then")
    )
    inside = F.lead("block").over(Window.partitionBy("range").orderBy("block"))
    return ranged.withColumn("inside", inside).join(ends, "range").select("block", F.coalesce("inside", "then").alias("next"))


def edited(text: Column, after: Column) -> Column:
    """The last quarter of the characters replaced by as many first ones of the next text, or all it has."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(after, F.lit(1), quarter))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. A text without a term of the band has a fingerprint of its whole text, so equal
    texts always have equal fingerprints. Repeated rows are documents of their own, equal ids in order of their
    texts; the only document of a table is its own next. Rows without a doc_id take no part; other columns are not
    read; an empty table gives an empty result.
    """
    texts = texts_of(docs)
    words = saved(lexicon(texts, least, most), "lexicon").withColumn("known", F.lit(True))
    # a term that no text holds keeps each document in the join
    words = words.unionByName(words.sparkSession.sql("SELECT '' AS term, -1 AS subset, -1 AS level, false AS known"))
    if words.count() <= MOST_BROADCAST_TERMS:
        words = F.broadcast(words)

    base = _with_next(texts).withColumn("edited", edited(F.col("text"), F.col("after")))
    versions = [("text", 0), ("edited", 1), ("after", 2)]
    listed = F.array(
        *(
            F.struct(
                F.lit(v).alias("version"),
                (F.array_append(terms(F.col(c)), F.lit("")) if v == 0 else terms(F.when(F.col("edge") | F.lit(v < 2), F.col(c)))).alias("terms"),
            )
            for c, v in versions
        )
    )
    digests = {
        "doc_id": F.col("doc_id"), "n_chars": F.length("text").cast("long"), "edited_sha256": F.sha2(F.col("edited"), 256),
        "m0": F.md5("text"), "m1": F.md5("edited"), "m2": F.md5("after"), "edge": F.col("edge"),
    }
    about = base.select("block", "nth", F.struct(*(c.alias(n) for n, c in digests.items())).alias("info"), listed.alias("versions"))
    about = about.select("block", "nth", "info", F.explode("versions").alias("v"))
    each = about.select("block", "nth", "info", F.col("v.version").alias("version"), F.explode("v.terms").alias("term")).join(words, "term")
    # one row a document carries its digests; the others are as narrow as can be
    each = each.select("block", "nth", F.when(~F.col("known"), F.col("info")).alias("info"), F.when(F.col("known"), F.struct("version", "term", "subset", "level")).alias("t"))
    held = each.groupBy("block", "nth").agg(F.first("info", ignorenulls=True).alias("info"), F.array_sort(F.collect_list("t")).alias("found"))
    once = list(digests)
    held = held.select("block", "nth", "info.*", "found")

    def printed(v: int) -> Column:
        own = F.filter("found", lambda t: t["version"] == v)
        return _with(own, lambda o: F.when(F.size(o) == 0, F.concat(F.lit("x"), F.col(f"m{v}"))).otherwise(fingerprint(o)))

    made = held.select("block", "nth", *once, *(printed(v).alias(f"f{v}") for v in (0, 1)), F.when(F.col("edge"), printed(2)).alias("f2"))
    after = F.coalesce("f2", F.lead("f0").over(Window.partitionBy("block").orderBy("nth")))
    return made.withColumn("after", after).select(
        "doc_id", "n_chars", "edited_sha256", F.col("f0").alias("fingerprint"), F.col("f1").alias("edited_fingerprint"),
        likeness(F.col("f0"), F.col("f1")).alias("near_edited"), likeness(F.col("f0"), F.col("after")).alias("near_next"),
    )
