"""A written full-text index of segments: postings with positions, changed by deltas, merged when it is read.

A segment holds the postings of the documents that were added with it, each file's in the order of terms, so that a prefix reads the
pages of a file that can hold it and no others; their lengths beside them; and the ids that it makes void in earlier segments. A change writes
one segment of its own documents. The manifest gets a row when a segment is whole: what has no row is not read. Compaction
writes what is left of all segments as one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.operators.search import K1, B

#: Most void ids that are sent to all tasks, so that postings stay where they are; above that they are shuffled to be joined.
BROADCAST = 1_000_000
#: About as many terms are put in order at a time.
STEP = 500_000
_MANIFEST = "segment int, n long, length long, void_n long, void_length long"


def _postings(rows: DataFrame) -> DataFrame:
    """(doc, field, term, places, length) for each term of rows of (doc, field, terms, length), each place from 0 in its list."""
    key_name = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(2)).to_numpy()
            # rows of about STEP terms at a time
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // STEP, prepend=-1, append=np.iinfo(np.int64).max))
            for begin, end in zip(cuts[:-1], cuts[1:]):
                part, size = batch.slice(begin, end - begin), sizes[begin:end].astype(np.int64)
                terms = part.column(2).flatten().dictionary_encode()
                if not len(terms):
                    continue
                row = np.repeat(np.arange(len(size)), size)
                place = np.arange(len(terms)) - np.repeat(np.cumsum(size) - size, size)
                code = terms.indices.to_numpy().astype(np.int64)
                key = row * len(terms.dictionary) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(place[order], pa.int32()))
                at = pa.array(row[order[first]])
                columns = [part.column(0).take(at), part.column(1).take(at), terms.dictionary.take(pa.array(code[order[first]])), places, part.column(3).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=[key_name, "field", "term", "places", "length"])

    return rows.mapInArrow(run, f"{key_name} {rows.dtypes[0][1]}, {_POSTING}")


@dataclass(frozen=True)
class Index:
    """An index below a folder that driver and executors share. doc: the name and type of the documents' key."""

    spark: SparkSession
    folder: str
    doc: str = "doc_id"
    kind: str = "long"

    def segments(self) -> list[tuple]:
        """The manifest's rows: as many as there were changes since the last compaction."""
        try:
            found = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(map(tuple, found))

    def _read(self, table: str, columns: str) -> DataFrame:
        known = [s[0] for s in self.segments()]
        paths = [f"{self.folder}/{table}/segment={k}" for k in known]
        schema = f"{self.doc} {self.kind}, {columns}"
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment int")
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows whose document no later segment makes void."""
        last = self._read("void", "at int").groupBy(self.doc).agg(F.max("segment").alias("gone"))
        if len(self.segments()) < 2:
            return rows.drop("segment")
        if sum(s[3] for s in self.segments()) <= BROADCAST:
            last = F.broadcast(last)
        return rows.join(last, self.doc, "left").where("gone IS NULL OR segment >= gone").drop("gone", "segment")

    def lengths(self) -> DataFrame:
        """(doc, length) of all documents."""
        return self._live(self._read("lengths", "length long"))

    def totals(self) -> tuple[int, int]:
        """How many documents there are, and the sum of their lengths, from the manifest alone."""
        rows = self.segments()
        return sum(r[1] - r[3] for r in rows), sum(r[2] - r[4] for r in rows)

    def changed(self, docs: DataFrame, fields: dict[str, Column], removed: DataFrame | None = None) -> int:
        """Add documents, in place of what the index has of them, and take others out: one new segment, whose number is
        returned. removed: documents' keys. Rows without a key take no part; rows that repeat one are one document, whose fields
        follow each other in no certain order. The work is in proportion to the change, but for one pass over (key, length) to
        count what becomes void.
        """
        known = self.segments()
        number = known[-1][0] + 1 if known else 0
        at = f"segment={number}"
        named = docs.where(F.col(self.doc).isNotNull())
        texts = named.select(F.col(self.doc).cast(self.kind), *(F.coalesce(c, F.lit("")).alias(f"_{n}") for n, c in fields.items()))
        # texts are shuffled once, to bring a document's together, and parted into tokens once; its postings stay in its task
        whole = texts.groupBy(self.doc).agg(*(F.array_join(F.collect_list(f"_{n}"), " ").alias(f"_{n}") for n in fields))
        each = F.array(*(F.struct(F.lit(n).alias("field"), tokens(F.col(f"_{n}")).alias("terms")) for n in fields))
        listed = whole.select(self.doc, each.alias("fields"))
        listed = listed.withColumn("length", F.aggregate("fields", F.lit(0).cast("long"), lambda n, f: n + F.size(f["terms"])))
        made = _postings(listed.select(self.doc, F.explode("fields").alias("f"), "length").select(self.doc, "f.field", "f.terms", "length"))
        made.sortWithinPartitions("term", self.doc).write.mode("overwrite").parquet(f"{self.folder}/postings/{at}")
        # lengths stand in the postings; a document without any has none
        held = self.spark.read.schema(f"{self.doc} {self.kind}, length long").parquet(f"{self.folder}/postings/{at}").groupBy(self.doc).agg(F.max("length").alias("length"))
        size = named.select(F.col(self.doc).cast(self.kind)).distinct().join(held, self.doc, "left").select(self.doc, F.coalesce("length", F.lit(0).cast("long")).alias("length"))
        size.write.mode("overwrite").parquet(f"{self.folder}/lengths/{at}")
        size = self.spark.read.schema(f"{self.doc} {self.kind}, length long").parquet(f"{self.folder}/lengths/{at}")
        gone = size.select(self.doc)
        if removed is not None:
            gone = gone.unionByName(removed.where(F.col(self.doc).isNotNull()).select(F.col(self.doc).cast(self.kind))).distinct()
        # what was not in the index has nothing to be made void
        old = self.lengths().join(gone, self.doc, "left_semi") if known else size.limit(0)
        old.select(self.doc, F.lit(number).alias("at")).write.mode("overwrite").parquet(f"{self.folder}/void/{at}")
        count = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first())
        row = self.spark.createDataFrame([(number, *count(size), *count(old))], _MANIFEST)
        row.write.mode("append").parquet(f"{self.folder}/manifest")
        return number

    def compacted(self, folder: str) -> Index:
        """The same index as one segment, in another folder."""
        out = Index(self.spark, folder, self.doc, self.kind)
        self.lengths().write.parquet(f"{folder}/lengths/segment=0")
        live = self._live(self._read("postings", _POSTING))
        live.sortWithinPartitions("term", self.doc).write.parquet(f"{folder}/postings/segment=0")
        self.spark.createDataFrame([], f"{self.doc} {self.kind}, at int").write.parquet(f"{folder}/void/segment=0")
        self.spark.createDataFrame([(0, *self.totals(), 0, 0)], _MANIFEST).write.parquet(f"{folder}/manifest")
        return out

    def postings(self, prefixes: Sequence[str] = (), terms: Sequence[str] = (), field: str | None = None) -> DataFrame:
        """(doc, field, term, places, length) of live documents; of these prefixes and terms alone, where any are given. Which pages
        can hold them is settled by the scan."""
        found = self._read("postings", _POSTING)
        if prefixes or terms:
            hit = F.lit(False)
            for p in prefixes:
                hit = hit | F.startswith("term", F.lit(p))
            found = found.where(hit | F.col("term").isin(*terms) if terms else hit)
        return self._live(found.where(F.col("field") == field) if field else found)

    def ranked(self, query: Sequence[str], weights: dict[str, float]) -> DataFrame:
        """(doc, score): documents in which every query token begins some term, by BM25 with field weights."""
        probe = F.array(*(F.when(F.startswith("term", F.lit(t)), F.lit(t)) for t in query))
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("field") == name, w).otherwise(weight)
        each = self.postings(query).withColumn("token", F.explode(F.filter(probe, lambda t: t.isNotNull())))
        hits = each.groupBy(self.doc, "token").agg(F.sum(F.size("places") * weight).alias("wtf"), F.max("length").alias("length"))
        n, length = self.totals()
        holding = hits.groupBy("token").agg(F.count("*").alias("df"))  # a row for each token of the query
        idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("wtf") + K1 * (1 - B + B * F.col("length") / F.lit(length / max(n, 1)))
        scored = hits.join(F.broadcast(holding), "token").groupBy(self.doc)
        found = scored.agg(F.sum(idf * F.col("wtf") * (K1 + 1) / norm).alias("score"), F.count("*").alias("n_tokens"))
        return found.where(F.col("n_tokens") == len(query)).drop("n_tokens")

    def phrase(self, words: Sequence[str], field: str, begins: bool = False) -> DataFrame:
        """(doc, place): documents whose field holds the words one after the other, the last one as a prefix, and where they
        first do; begins: at its beginning alone."""
        *whole, last = words
        each = self.postings([last], whole, field)
        # where the phrase would start, by the place of each of its words
        shifts = F.array(*(F.when(F.col("term") == w, F.lit(i)) for i, w in enumerate(whole)), F.when(F.startswith("term", F.lit(last)), F.lit(len(whole))))
        placed = each.select(self.doc, F.explode(F.filter(shifts, lambda s: s.isNotNull())).alias("i"), "places").select(self.doc, "i", F.explode("places").alias("at"))
        starts = placed.select(self.doc, "i", (F.col("at") - F.col("i")).alias("place")).where("place = 0" if begins else "place >= 0").distinct()
        full = starts.groupBy(self.doc, "place").agg(F.count("*").alias("n")).where(F.col("n") == len(words))
        return full.groupBy(self.doc).agg(F.min("place").alias("place"))


_POSTING = "field string, term string, places array<int>, length long"
