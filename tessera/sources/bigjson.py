"""One large JSON document, read by many tasks: the elements of an array field, each as a text of its own.

The file is read as text that is parted at every comma, so Spark splits it by byte ranges as it does lines. Whether a piece
begins inside a string, how deep it is nested, and which element it belongs to depend on all pieces before it. Each of these is
a running sum, over splits by a window over their totals, a row each, and inside a split by walking through it. So the text is
read several times, but what is shuffled are those rows, and of each split the elements that it shares with another. (An
element, or a stretch without a comma, must fit into a task.)
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import scratch

#: A string's inner characters: Java recurses once a turn of a repeated group unless it is possessive.
_INNER = r'(?:[^"\\]++|\\.)*+'


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b'"\\[]{}')] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1


def _fixed_splits(spark: SparkSession) -> SparkSession:
    """A session whose files are split alike at each reading: by default that depends on how many executors are there."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    if not own.conf.get("spark.sql.files.minPartitionNum", None):
        own.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    return own


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(path, start, piece): a document's text between signs; a split's pieces in their order. gzip files are one split."""
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[pa.RecordBatch]]]:
    """((path, start), its rows, some at a time): the splits of a task, one after the other."""

    def runs():
        for rows in batches:
            path, start = rows.column("path"), rows.column("start").to_numpy()
            other = (np.diff(start) != 0) | pc.not_equal(path.slice(1), path.slice(0, max(len(path) - 1, 0))).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(other) + 1).tolist(), len(path)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    yield (path[lo].as_py(), int(start[lo])), rows.slice(lo, hi - lo)

    for key, group in groupby(runs(), itemgetter(0)):
        yield key, (rows for _, rows in group)


def _texts(rows: pa.RecordBatch) -> pa.Array:
    return rows.column("piece").cast(pa.string())  # a session may send them with offsets of eight bytes


def _signs(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sign: its piece, whether it is a quote that isn't escaped, and by how much it would nest deeper."""
    n, (_, ends, data) = len(pieces), pieces.buffers()
    ends = np.frombuffer(ends, np.int32)[pieces.offset : pieces.offset + n + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    at = np.flatnonzero(_SIGNS[data])
    sign, piece = data[at], np.searchsorted(ends[1:] - ends[0], at, side="right")
    at = at + piece  # no sign stands beside one of the next piece: a comma is between them
    quote, slash = sign == ord('"'), at[sign == ord("\\")]
    if len(slash):
        # of backslashes in a row, every other one escapes what follows
        i = np.arange(len(slash))
        escapes = (i - np.maximum.accumulate(np.where(np.diff(slash, prepend=-2) != 1, i, 0))) % 2 == 0
        quote &= ~np.isin(at, slash[escapes] + 1, assume_unique=True)
    return piece, quote, _STEP[sign]


class _Walk:
    """Pieces in their order: of each, whether it begins and ends inside a string, and how deep."""

    def __init__(self, inside: bool, depth: int) -> None:
        self.inside, self.depth = inside, depth

    def over(self, pieces: pa.Array) -> None:
        n, (piece, quote, step) = len(pieces), _signs(pieces)
        within = (np.cumsum(quote) - quote + self.inside) % 2 == 1
        self.ends_inside = (np.cumsum(np.bincount(piece[quote], minlength=n)) + self.inside) % 2 == 1
        self.after = np.cumsum(np.bincount(piece, np.where(within, 0, step), minlength=n)).astype(np.int64) + self.depth
        self.begins_inside, self.before = np.append(self.inside, self.ends_inside[:-1]), np.append(self.depth, self.after[:-1])
        self.inside, self.depth = bool(self.ends_inside[-1]), int(self.after[-1])
        #: a comma at depth 2, outside strings, is between elements
        self.ends = (self.after == 2) & ~self.ends_inside

    def opening(self, pieces: pa.Array, name: re.Pattern) -> tuple[int, str] | None:
        """The first piece in which the field's array opens, at depth 1, or the document's first, and what follows there."""
        for i in np.flatnonzero(~self.begins_inside & (self.before <= 1)):
            if found := name.match(text := pieces[int(i)].as_py()):
                return int(i), text[found.end() :]
        return None

    def closing(self, begin: int) -> int:
        """The first piece from there on that ends above depth 2, with which an open array is over; or their number."""
        low = np.flatnonzero(self.after[begin:] < 2)
        return begin + int(low[0]) if len(low) else len(self.after)


_TOTALS = "path string, start long, quotes long, outer long, inner long"


def _totals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many quotes a split has, and how much deeper it ends if it begins outside or inside a string."""
    for (path, start), runs in _splits(batches):
        quotes = outer = inner = 0
        for rows in runs:
            _, quote, step = _signs(_texts(rows))
            within = (np.cumsum(quote) - quote + quotes) % 2 == 1
            quotes, outer, inner = quotes + int(quote.sum()), outer + int(step[~within].sum()), inner + int(step[within].sum())
        yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "quotes": [quotes], "outer": [outer], "inner": [inner]})


_COUNTS = "path string, start long, opens boolean, n_opened long, over_opened boolean, n_open long, over_open boolean"


def _counts(name: re.Pattern, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the array opens in a split; and how many elements end there before it is over, if it is, for an array that opens
    there and for one that was open before."""
    for (path, start), runs in _splits(batches):
        walk, opens, n, over = None, False, [0, 0], [False, False]
        for rows in runs:
            walk, pieces = walk or _Walk(*_state(rows, "inside", "depth")), _texts(rows)
            walk.over(pieces)
            begins = [0 if opens else None, 0]
            if not opens and (found := walk.opening(pieces, name)):
                opens, begins[0] = True, found[0]
            for k, begin in enumerate(begins):
                if begin is not None and not over[k]:
                    end = walk.closing(begin)
                    n[k], over[k] = n[k] + int(walk.ends[begin:end].sum()), end < len(pieces)
        yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "opens": [opens], "n_opened": [n[0]], "over_opened": [over[0]], "n_open": [n[1]], "over_open": [over[1]]})


def _state(rows: pa.RecordBatch, *names: str) -> list:
    state = [rows.column(name)[0].as_py() for name in names]
    if None in state:
        raise ValueError("a file is split in another way than when it was first read")
    return state


_PARTS = "path string, place long, start long, element string, is_last boolean"
_PART = pa.schema([("path", pa.string()), ("place", pa.int64()), ("start", pa.int64()), ("element", pa.string()), ("is_last", pa.bool_())])


def _parts(name: re.Pattern, shared: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What splits have of the array's elements: whole ones, or those that another split may have a part of."""

    def given(path: str, start: int, place: int, texts: list, is_last: bool) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict({"path": [path] * n, "place": list(range(place, place + n)), "start": [start] * n, "element": texts, "is_last": [False] * (n - 1) + [is_last]}, _PART)

    for (path, start), runs in _splits(batches):
        walk, over = None, False
        for rows in runs:
            if walk is None:
                inside, depth, has, opens, place = _state(rows, "inside", "depth", "has", "opens", "place")
                walk, over, first, rest = _Walk(inside, depth), not has, not opens, []  # first: the element that was open before
            if over:
                continue
            pieces, begin = _texts(rows), 0
            walk.over(pieces)
            if opens:
                if not (found := walk.opening(pieces, name)):
                    continue
                opens, begin = False, found[0]
                pieces = pa.concat_arrays([pieces.slice(0, begin), pa.array([found[1]], pieces.type), pieces.slice(begin + 1)])
            end = walk.closing(begin)
            over = end < len(pieces)
            stop = min(end + 1, len(pieces))
            cuts = [0, *(np.flatnonzero(walk.ends[begin:stop]) + 1).tolist()]
            open_ = cuts[-1] < stop - begin
            if open_:
                cuts.append(stop - begin)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pieces.slice(begin, stop - begin)), ",").to_pylist()
            texts[0] = ",".join([*rest, texts[0]])
            rest = [texts.pop()] if open_ and not over else []
            # a long element's parts are put together when it ends
            if texts and first:
                if shared:
                    yield given(path, start, place, texts[:1], over and len(texts) == 1)
                first, place, texts = False, place + 1, texts[1:]
            if texts and not shared:
                yield given(path, start, place, texts, over)
            place += len(texts)
        if shared and walk and not over and rest:
            yield given(path, start, place, [",".join(rest)], False)


def array_elements(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(path, place, element) of the array under a top-level field of each JSON document below path, in the document's order.

    place counts from 0. An empty array, a document without the field, or with something else there, gives no rows. Elements
    are not parsed: read them with from_json or parse_json, each of which tells a broken one by itself. Nested arrays and
    objects, escaped quotes, and brackets or commas in strings may stand anywhere. A field given twice counts by its first.
    Each task is sent a row a split.
    """
    pieces, name = _pieces(_fixed_splits(spark), path, ","), re.compile(r'\s*\{?\s*"' + re.escape(field) + r'"\s*:\s*\[', re.ASCII)
    each = Window.partitionBy("path").orderBy("start")
    before = each.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    inside = pieces.mapInArrow(_totals, _TOTALS).withColumn("inside", running("quotes") % 2 == 1)
    begun = scratch(inside.select("path", "start", "inside", running(F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).alias("depth")), "begun")
    counted = pieces.join(F.broadcast(begun), ["path", "start"], "left").mapInArrow(partial(_counts, name), _COUNTS)
    first = F.min(F.when(F.col("opens"), F.col("start"))).over(Window.partitionBy("path"))
    phase = counted.withColumn("first", first).withColumn("opens", F.coalesce(F.col("start") == F.col("first"), F.lit(False)))
    own = lambda opened, open_: F.when(F.col("opens"), F.col(opened)).when(F.col("start") > F.col("first"), F.col(open_))
    told = phase.select("path", "start", "opens", own("n_opened", "n_open").alias("n"), own("over_opened", "over_open").alias("over"))
    gone = F.coalesce(F.max("over").over(before), F.lit(False))
    placed = told.select("path", "start", "opens", "over", (F.col("n").isNotNull() & ~gone).alias("has"), running("n").alias("place"))
    states = scratch(placed.join(begun, ["path", "start"]), "states")
    taken = lambda rows, how, shared: pieces.join(F.broadcast(rows), ["path", "start"], how).mapInArrow(partial(_parts, name, shared), _PARTS)
    # splits that hold an array from its first to its last element share none
    parts = taken(states.where("has AND NOT (opens AND over)"), "inner", True).groupBy("path", "place")
    joined = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "element"))), lambda p: p["element"]), ",").alias("element"), F.max("is_last").alias("is_last"))
    whole = taken(states, "left", False).select("path", "place", "element", "is_last").unionByName(joined)
    element = F.when(F.col("is_last"), _before_close(F.col("element"))).otherwise(F.col("element"))
    return whole.select("path", "place", F.trim(F.regexp_replace(element, r"(?s)^\s+|\s+$", "")).alias("element")).where("element <> ''")


def _before_close(text: Column) -> Column:
    """What stands before the bracket that closes an array, whatever is nested before it: the text is walked once by its signs."""
    quote = lambda c: c == '"'
    closed = lambda s, c: s["closed"] | (~s["quoted"] & (s["depth"] == 0) & (c == "]"))
    step = lambda s, c: F.struct(
        F.when(s["quoted"], s["depth"]).when(c.rlike(r"^[\[{]$"), s["depth"] + 1).when(c.rlike(r"^[\]}]$"), s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
        (s["quoted"] != quote(c)).alias("quoted"), closed(s, c).alias("closed"), (s["size"] + F.when(closed(s, c), 0).otherwise(F.length(c))).alias("size"),
    )
    signs = F.regexp_extract_all(text, F.lit(r'(?s)\\.|["\[\]{}]|[^"\\\[\]{}]++'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("closed"), F.lit(0).alias("size"))
    return F.substring(text, F.lit(1), F.aggregate(signs, start, step)["size"])


def write_documents(elements: DataFrame, path: str, group: str, field: str, version: str) -> None:
    """A document for each group (rows without one go), below path: {"version": ..., field: [elements]}, in order of `at`.
    elements: (group, at, element as JSON text). A group is written by one task, line by line."""
    line = ["group", "kind", "at", "value"]
    own = elements.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.lit(1).alias("kind"), F.col("at").cast("long"), F.col("element").alias("value"))
    # the last element has no comma behind it: each has one before it, but the first
    comma = F.when(F.col("kind") == 1, F.when(F.lag("kind").over(Window.partitionBy("group").orderBy(*line[1:])) == 1, F.lit(",")).otherwise(F.lit("")))
    opening = F.to_json(F.struct(F.lit(version).alias("version")))
    ends = own.select("group").distinct().select("group", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat(F.regexp_replace(opening, "}$", ""), F.lit(f',"{field}":[')).alias("value")),
        F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("]}").alias("value")),
    )).alias("e")).select("group", "e.*")
    # the window has put them in order: a sort by what is behind the comma now would be another one
    lines = own.unionByName(ends).select("group", "kind", "at", "value", F.coalesce(comma, F.lit("")).alias("comma")).sortWithinPartitions(*line)
    lines.select("group", F.concat("comma", "value").alias("value")).write.partitionBy("group").text(path)


#: How many opening brackets the beginning of a document may hold in its strings.
_HEAD = 16


def _begun(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pieces of splits, numbered."""
    for (path, _), runs in _splits(batches):
        texts = []
        for rows in runs:
            texts += rows.column("piece").slice(0, _HEAD - len(texts)).to_pylist()
        yield pa.RecordBatch.from_pydict({"path": [path] * len(texts), "line": list(range(len(texts))), "value": texts})


def head(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """(path, the fields of a schema): the plain values that stand at a document's beginning, before its first array or object,
    from its first split alone. Null where a field doesn't stand there."""
    begun = _pieces(spark, path, "[").where("start = 0").mapInArrow(_begun, "path string, line long, value string")
    lead = begun.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda p: p["value"]), "[").alias("lead"))
    pair = rf'\s*+"{_INNER}"\s*+:\s*+(?:"{_INNER}"|[^\s"{{}}\[\],]++)\s*+,?+'
    plain = F.regexp_replace(F.regexp_extract("lead", rf"(?s)^\s*\{{(?:{pair})*+", 0), r",?\s*$", "}")
    return lead.select("path", F.from_json(plain, fields).alias("h")).select("path", "h.*")
