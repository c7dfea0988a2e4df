"""Token-id files: fixed-size id blocks, transposed into byte or bit planes, each plane compressed with zstandard.

Folder layout (all written by Spark, so any store that Spark writes will do):

  chunks/  one row per block: part, chunk, first (ids of the part before it), n_ids, planes (compressed, low
           plane first), open_docs (documents that began before), doc_ids and doc_starts (those that begin here)
  index/   the chunk index: part, chunk, start (ids of the whole file before the block), n_ids, n_docs, bytes

Parts are ranges of doc_id in ascending order, and documents ascend within a part; no document is split
between parts, but a document may run over any number of blocks.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, slices, texts_of
from tessera.llm.words import Clash, Known, ranges, told_apart

BLOCK = 65_536
CHUNKS = (
    "part int, chunk int, first long, n_ids int, planes array<binary>, open_docs long, doc_ids array<long>, "
    "doc_starts array<int>"
)


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = 3) -> list[bytes]:
    """uint32 ids as 4 byte planes or 32 bit planes, each compressed."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = rows.T
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int) -> np.ndarray:
    """The ids again; 4 planes are byte planes, 32 are bit planes."""
    unpack = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpack.decompress(p), np.uint8) for p in planes]
    if len(raw) == 32:
        bits = np.stack([np.unpackbits(p, count=n_ids, bitorder="little") for p in raw])
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(np.stack(raw).T).reshape(-1).view("<u4")


class Encoder:
    """Whole texts to id bytes (little-endian uint32).

    The byte-level pre-tokenizer always parts a text between an ASCII letter and another ASCII character behind it, and
    before a space that follows a non-space, and looks no further than one character past a token. So a text's ids are
    those of its pieces between such places. Pieces are told apart by hashes, which their bytes confirm; those that were
    met last stay known, up to most_known. New pieces are encoded side by side, as one text, whose ids are dealt to the
    pieces by the bytes that each id stands for. A special token that stands in a text is spelled by ordinary pieces;
    with spelled=False, as the queries have it, it gets its own id, which is the library's default.
    """

    _SIDE_BY_SIDE = 1_024

    def __init__(self, path: str, most_known: int = 500_000, spelled: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = spelled
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # a character of a token stands for a byte
            self.n_bytes[i] = len(token.encode()) if token in self.special else len(token)
        self.known, self.most_known, self.calls = Known("ids_at", "n_ids", "met"), most_known, 0
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece. Those of a space and what is no space at either end are the same side by side."""
        plain = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == 32 and 33 <= p[1] < 127 and 33 <= p[-1] < 127]
        out: list = [None] * len(pieces)
        for at in range(0, len(plain), self._SIDE_BY_SIDE):
            part = plain[at : at + self._SIDE_BY_SIDE]
            ids = self._encoded([b"".join([pieces[i] for i in part]).decode()])[0]
            ends = np.cumsum([len(pieces[i]) for i in part])
            cuts = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends, side="right").tolist()
            for i, a, b in zip(part, [0, *cuts], cuts):
                out[i] = ids[a:b]
        others = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(others, self._encoded([pieces[i].decode("utf-8", "surrogatepass") for i in others])):
            out[i] = ids
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(mark in t for mark in self.special)]
        if not odd:
            try:
                return self._by_pieces([t.encode("utf-8", "surrogatepass") for t in texts])
            except Clash:
                return [x.tobytes() for x in self._encoded(texts)]
        alone = dict(zip(odd, self._encoded([texts[i] for i in odd])))
        rest = iter(self([t for i, t in enumerate(texts) if i not in alone]))
        return [alone[i].tobytes() if i in alone else next(rest) for i in range(len(texts))]

    def _by_pieces(self, coded: list[bytes]) -> list[bytes]:
        """The texts' ids; raises Clash if different pieces share a hash."""
        self.calls += 1
        known, text = self.known, b"".join(coded)
        raw = np.frombuffer(text, np.uint8)
        bounds = np.cumsum([0, *map(len, coded)])
        if not len(raw):
            return [b""] * len(coded)
        starts = piece_starts(raw, bounds)
        hashes, first, size, which = told_apart(raw, starts)
        old, at = known.find(hashes, raw, first, size)
        known.met[at] = self.calls
        pieces = [text[a : a + n] for a, n in zip(first[~old].tolist(), size[~old].tolist())]
        ids = self._new(pieces)
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        known.add(hashes[~old], pieces, ids_at=len(self.ids) + np.cumsum(n_ids) - n_ids, n_ids=n_ids, met=np.full(len(ids), self.calls))
        self.ids = np.concatenate([self.ids, *ids])
        spot = np.searchsorted(known.hash, hashes)[which]
        n_ids = known.n_ids[spot]
        out = self.ids[ranges(known.ids_at[spot], n_ids)].astype("<u4").tobytes()
        ends = np.concatenate([[0], np.cumsum(n_ids)])[np.searchsorted(starts, bounds)] * 4
        if len(known.hash) > self.most_known:
            self._forget()
        return [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _forget(self) -> None:
        """Leave the pieces that were met last, at most half of most_known."""
        known, most = self.known, max(1, self.most_known // 2)
        on = known.met > np.partition(known.met, -most)[-most]
        self.ids = self.ids[ranges(known.ids_at[on], known.n_ids[on])]
        known.keep(on)
        known.ids_at = np.cumsum(known.n_ids) - known.n_ids


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN = ~_LETTER
_SIGN[128:] = False
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True


def piece_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text's start, at an ASCII character behind an ASCII letter, and at a space behind
    what is surely no white space: an ASCII sign, or a character of two bytes other than those of the first block."""
    cut = np.zeros(len(raw) + 1, bool)
    behind = _SOLID[raw]
    behind[1:] |= (raw[1:] >= 128) & (raw[1:] < 192) & (raw[:-1] >= 0xC3) & (raw[:-1] < 0xE0)
    cut[1:-1] = _LETTER[raw[:-1]] & _SIGN[raw[1:]] | (raw[1:] == 32) & behind[:-1]
    cut[bounds] = True
    return np.flatnonzero(cut[:-1])


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path, spelled=False)


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, block: int = BLOCK, kind: str = "byte", parts: int = 0
) -> None:
    """Encode every text, append end_id, and write the file in ascending doc_id order.

    A null text counts as empty (its end id alone); repeated rows are written each, equal ids in order of
    their texts; rows without a doc_id take no part; other columns are not read; an empty table makes an
    empty file. parts: ranges of doc_id, by default as many as the scan has partitions.
    """
    spark = docs.sparkSession
    schema = spark.createDataFrame([], CHUNKS).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held = bytearray()
        chunk = first = seq = 0
        begun: list[tuple[int, int]] = []  # doc_id, place in held

        def flush(n_bytes: int) -> pa.RecordBatch:
            nonlocal chunk, first, seq
            ids = np.frombuffer(bytes(held[:n_bytes]), "<u4")
            here = [x for x in begun if x[1] < n_bytes]
            row = {
                "part": part, "chunk": chunk, "first": first, "n_ids": len(ids), "planes": to_planes(ids, kind),
                "open_docs": seq, "doc_ids": [x[0] for x in here], "doc_starts": [x[1] // 4 for x in here],
            }
            del held[:n_bytes]
            begun[:] = [(d, at - n_bytes) for d, at in begun[len(here) :]]
            chunk, first, seq = chunk + 1, first + len(ids), seq + len(here)
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for piece in slices(batch, 1 << 19):
                ids, texts = (c.to_pylist() for c in piece.columns)
                for doc, coded in zip(ids, encoder(vocabulary)(texts)):
                    begun.append((doc, len(held)))
                    held += coded
                    held += end
                    while len(held) >= 4 * block:
                        yield flush(4 * block)
        if held:
            yield flush(len(held))

    texts = texts_of(docs)
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    ordered = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "none").parquet(f"{folder}/chunks")

    chunks = spark.read.schema(schema).parquet(f"{folder}/chunks")
    chunks.join(part_starts(chunks), "part").select(
        "part",
        "chunk",
        (F.col("part_start") + F.col("first")).alias("start"),
        "n_ids",
        F.size("doc_ids").alias("n_docs"),
        F.aggregate("planes", F.lit(0), lambda a, p: a + F.octet_length(p)).alias("bytes"),
    ).write.parquet(f"{folder}/index")


def part_starts(chunks: DataFrame) -> DataFrame:
    """(part, part_start): ids before each part. One row per part reaches the driver, not per block or document."""
    spark = chunks.sparkSession
    rows, start = [], 0
    for part, n in sorted(chunks.groupBy("part").agg(F.sum("n_ids")).collect()):
        rows.append((part, start))
        start += n
    return spark.createDataFrame(rows, "part int, part_start long")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and, if with_ids, ids (little-endian
    uint32 bytes) of every document, read from the file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    pieces = "part int, doc long, doc_id long, chunk int, start long, n_tokens long, crc long, ids binary"
    arrow = to_arrow_schema(spark.createDataFrame([], pieces).schema)
    chunks = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                raw = memoryview(from_planes(row["planes"], row["n_ids"]).tobytes())
                starts = row["doc_starts"]
                docs, names = list(range(row["open_docs"], row["open_docs"] + len(starts))), list(row["doc_ids"])
                if not starts or starts[0]:  # the end, or a middle piece, of a document that began before
                    starts, docs, names = [0, *starts], [row["open_docs"] - 1, *docs], [None, *names]
                ends = [*starts[1:], row["n_ids"]]
                out = []
                for k, (doc, name, a, b) in enumerate(zip(docs, names, starts, ends)):
                    part = raw[4 * a : 4 * b]
                    whole = name is not None and k < len(docs) - 1
                    out.append(
                        {
                            "part": row["part"], "doc": doc, "doc_id": name, "chunk": row["chunk"],
                            "start": row["first"] + a, "n_tokens": b - a, "crc": zlib.crc32(part) if whole else None,
                            "ids": None if whole and not with_ids else bytes(part),
                        }
                    )
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    joined = chunks.mapInArrow(run, pieces).groupBy("part", "doc").agg(
        F.max("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.sum("n_tokens").alias("n_tokens"),
        F.max("crc").alias("crc"),
        F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("pieces"),
    )
    ids = F.aggregate("pieces", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return joined.join(part_starts(chunks), "part").select(
        "doc_id",
        (F.col("part_start") + F.col("start")).alias("start"),
        "n_tokens",
        F.coalesce("crc", F.crc32(ids)).alias("ids_crc32"),
        *([ids.alias("ids")] if with_ids else []),
    )


def read_range(spark: SparkSession, folder: str, start: int, end: int) -> DataFrame:
    """(start, ids): the ids from `start` to before `end` of the whole file, in pieces, each with its first id's place and its ids as
    little-endian uint32 bytes. The index tells which blocks hold them: files of other parts are not opened, and other blocks'
    planes are not decompressed. What is beyond the file is not there; an empty range gives no rows."""
    index = spark.read.parquet(f"{folder}/index").where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > start) & F.lit(start < end))
    bounds = index.agg(F.min("part"), F.max("part")).first()
    found = spark.read.schema(CHUNKS).parquet(f"{folder}/chunks").where(F.col("part").between(bounds[0], bounds[1]) if bounds[0] is not None else F.lit(False))
    wanted = found.join(index.select("part", "chunk", "start"), ["part", "chunk"]).select("start", "n_ids", "planes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                first, n, planes = (c[at].as_py() for c in batch.columns)
                a, b = max(start, first), min(end, first + n)
                ids = from_planes(planes, n)[a - first : b - first]
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    return wanted.mapInArrow(run, "start long, ids binary")


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write a token file to the shared folder and read every document's digest back from it."""
    folder = shared_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, vocabulary)
    return read_tokens(docs.sparkSession, folder, with_ids=False)
