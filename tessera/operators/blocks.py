"""Lists in marked-up texts: lines to candidate lists, and the list of each document that tells most.

A document's lines are read once by a small machine that knows which list, act and passage it is in; it gives a row for each
list item. All that follows - whole lists, their scores, the choice, places and repeats - is aggregates over these rows.

Lines are `== Heading ==` (more signs, deeper), `; label`, `'''label'''`, `* item` or `# item` (more signs, deeper), `Act 2`
alone, and any others, which are notes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words by which a label ends a list's passage, names a production, or counts for and against its list.
STOP_WORDS = [
    "notes?", "keys?", "legend", "song notes", "footnotes", "sources?", "cut songs?", "deleted songs?", "songs? cut", "cut numbers", "other songs", "additional songs",
    "screen", "film(?: version)?", "movie(?: version)?", "unused songs", "orchestration", "instrumentation", "band", "recordings?", "cast recordings?",
    "original cast album", "album", "charts?", "discography", "singles", "history", "changes", "differences", "variations",
]
PRODUCTION_WORDS = [
    "production", "broadway", "west end", "london", "off-broadway", "revival", "original", "revised", "revision", "current", "version", "tour", "concert", "workshop",
    r"\b(?:1[89]|20)\d\d\b", "film", "movie", "licen[cs]", "premiere", "staging", "script",
]
ACTS = {"one": 1, "two": 2, "three": 3, "four": 4, "i": 1, "ii": 2, "iii": 3, "iv": 4, "first": 1, "second": 2, "third": 3}
SCORES = [
    (r"film|movie|soundtrack|screen", -1000),
    (r"current|revised|revision|licen[cs]|definitive|final|standard|\bonwards\b|to (?:the )?present|\bsince\s+(?:1[89]|20)\d\d\b", 300),
    (r"(?<!pre-|off-|off )\bbroadway\b", 100),
    (r"off-broadway|off broadway|workshop|tryout|pre-broadway|reading|out-of-town", -50),
    (r"\b(?:concept|complete works|recording|album|cd|demo|studio|highlights|replacements?)\b", -150),
    (r"\b(?:were|was|later|since been)\s+(?:cut|dropped|removed|replaced|reworked|rewritten)|\bearl(?:y|ier) (?:version|draft|production)s?\b", -100),
]
RECORDING = r"\b(?:concept|complete works|recording|album|cd|demo|studio|highlights)\b"
ENSEMBLE_WORDS = ["company", "ensemble", "chorus", "full company", "cast", "all"]
INSTRUMENTAL_WORDS = ["overture", "entr'acte", "instrumental", "exit music", "bows", "orchestra"]
LEAST_ITEMS = 3

_HEADING = re.compile(r"^(=+)\s*(.*?)\s*=+\s*$")
_ITEM = re.compile(r"^\s*([*#]+)\s*(.*)$")
_LABEL = re.compile(r"^\s*;\s*(.*)$|^\s*'''([^']+)'''\s*:?\s*$")
_ACT = re.compile(rf"^(?:(?:act|part)\s+(\d+|{'|'.join(sorted(ACTS, key=len, reverse=True))})|(first|second|third) act)\b", re.I)
_BARE_ACT = re.compile(_ACT.pattern + r"\s*[:.]?\s*$", re.I)
_STOP = re.compile(rf"^(?:{'|'.join(STOP_WORDS)})\b", re.I)
_PRODUCTION = re.compile("|".join(PRODUCTION_WORDS), re.I)
_SIDE = re.compile(r"^(?:side|disc|cd|record)\s*(?:\d+|one|two|[ab])$|^(?:scene|sc\.)\s*\w+\b", re.I)
#: A dash between blanks, or two, outside quotes and brackets, parts a title from who sings it.
_DASH = re.compile(r'("[^"]*"|\([^()]*\))|(?<=[\s")\]])(--|[–—-])(?=\s)')
_NUMBERED = re.compile(r"^(?:no\.\s*)?\d{1,3}[a-z]?[.)]\s+", re.I)
_REPRISE = re.compile(r"\s*[(\[]?\breprise\b(?:\s+\d+)?[)\]]?\s*$", re.I)
_NAMES = re.compile(r"\s*(?:,|;|&|\band\b|\bwith\b)\s*")
_MUSIC = re.compile(rf"\b(?:{'|'.join(INSTRUMENTAL_WORDS)})\b", re.I)


def act_of(label: str) -> int | None:
    if not (m := _ACT.match(label)):
        return None
    word = (m[1] or m[2]).lower()
    return int(word[:9]) if word.isdigit() else ACTS[word]


def kind_of(label: str) -> str:
    """act, stop, production, none (a side or a scene) or other."""
    x = re.sub(r"[:.]+$", "", label).strip()
    if not x or _SIDE.match(x):
        return "none"
    if act_of(x) is not None:
        return "act"
    if _STOP.match(x):
        return "stop"
    return "production" if _PRODUCTION.search(x) and len(x.split(" ")) <= 10 else "other"


def item_of(text: str) -> dict | None:
    """title, singers, ensemble, instrumental, reprise of an item's text; None without a letter or digit in its title."""
    text = _NUMBERED.sub("", re.sub(r"\s+", " ", re.sub(r"''+|<[^<>]*>", "", text))).strip()
    dash = next((m for m in _DASH.finditer(text) if m[2]), None)
    title, sung = (text[: dash.start()], text[dash.end() :]) if dash else (text, "")
    title = title.strip()
    reprise = bool(_REPRISE.search(title))
    title = _REPRISE.sub("", title).strip().strip('"').strip()
    if not re.search(r"\w", title):
        return None
    names = [n for n in (x.strip(' ."()') for x in _NAMES.split(sung)) if n]
    singers = list(dict.fromkeys(n for n in names if n.lower() not in ENSEMBLE_WORDS))
    music = bool(_MUSIC.search(title) or _MUSIC.search(sung))
    return {
        "title": title, "singers": [] if music else singers, "ensemble": not music and any(n.lower() in ENSEMBLE_WORDS for n in names), "instrumental": music, "reprise": reprise,
    }


def items_of(text: str) -> Iterator[dict]:
    """The items of all lists of a text, in order, each with the number and label of its list, its act and its notes' place.

    A heading or label of production words begins another list, as does an act that comes again or goes back; stop words end
    the passage until a heading of the same or a higher level, an act or a production. An item that ends in a colon with deeper
    items behind it heads them and is none itself. Lists without items don't count.
    """
    lines = text.split("\n")
    block, act, most, filled = 0, None, 0, False
    label = waiting = None
    stopped: int | None = None
    for k, raw in enumerate(lines):
        heading, item = _HEADING.match(raw), _ITEM.match(raw)
        mark = _LABEL.match(raw)
        name = heading[2] if heading else mark and (mark[1] or mark[2] or "").strip("' :") or (raw.strip() if not item and _BARE_ACT.match(raw.strip()) else None)
        level = len(heading[1]) if heading else 99
        if item and _BARE_ACT.match(item[2].strip()):
            item, name = None, item[2].strip()
        if name is not None and (heading or mark or not item):
            if heading and stopped is not None and level > stopped:
                continue
            if heading:
                stopped = None
            kind = kind_of(name)
            if kind == "stop":
                stopped = level
            elif kind == "act":
                stopped = None
                now = act_of(name.strip())
                if filled and (now < most or (now == 1 and most == 1 and (act is None or waiting is not None))):
                    block, label, most, filled = block + 1, waiting, 0, False
                act, waiting = now, None
            elif kind == "production":
                stopped = None
                if filled or label is not None:
                    block, most, filled = block + 1, 0, False
                label, act, waiting = re.sub(r"[:.]+$", "", name).strip(), None, None
            elif kind == "other":
                waiting = name
            continue
        if stopped is not None or not item:
            continue
        after = _ITEM.match(lines[k + 1]) if k + 1 < len(lines) else None
        if item[2].rstrip().endswith(":") and after and len(after[1]) > len(item[1]):
            continue
        if (made := item_of(item[2])) is None:
            continue
        most, filled, waiting = max(most, act or 0), True, None
        yield {"block": block, "label": label, "line": k, "act": act} | made


_ITEMS = "block int, label string, line int, act int, title string, singers array<string>, ensemble boolean, instrumental boolean, reprise boolean"


def listed_items(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, label, line, act, title, singers, ensemble, instrumental, reprise): all items of all lists of each text.

    A null or empty text has none, as has one without a list; texts that repeat a key give repeated items.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {_ITEMS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = list(items_of(batch.column(1)[at].as_py()))
                for cut in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([{key: batch.column(0)[at].as_py()} | r for r in rows[cut : cut + 10_000]], arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    return docs.where(F.col(text).rlike(r"(?m)^\s*[*#]")).select(key, text).mapInArrow(run, schema)


def block_score(label: Column, told: Column, n: Column) -> Column:
    """How much a list tells: label words for and against it, the share of its items that name somebody, and its length."""
    said = F.coalesce(label, F.lit(""))
    points = sum((F.when(said.rlike(f"(?i){pattern}"), value).otherwise(0) for pattern, value in SCORES), F.lit(0))
    revival = said.rlike(r"(?i)\brevival\b") & ~said.rlike("(?i)current|licen[cs]|standard|revised")
    share = F.when(said.rlike(f"(?i){RECORDING}"), 0).otherwise(F.floor(told * 200 / n + 0.5))
    return (points - F.when(revival, 30).otherwise(0) + share + F.least(n, F.lit(40))).cast("int")


def scored_lists(items: DataFrame, key: str, least: int = LEAST_ITEMS) -> DataFrame:
    """(key, block, label, n, n_told, score, chosen) of the lists of at least so many items.

    Where a list that is no recording's names somebody for half of its items, lists that don't stand back. The best score is
    chosen, of equal ones the first list.
    """
    sung = (F.size("singers") > 0) | F.col("ensemble")
    count = lambda hit: F.sum(F.when(hit, 1).otherwise(0))
    lists = items.groupBy(key, "block").agg(F.first("label").alias("label"), F.count("*").alias("n"), count(sung).alias("n_sung"), count(sung | F.col("instrumental")).alias("n_told"))
    lists = lists.where(F.col("n") >= least)
    named = (F.col("n_sung") * 2 >= F.col("n")) & ~F.coalesce("label", F.lit("")).rlike(f"(?i){RECORDING}")
    scored = lists.withColumn("score", block_score(F.col("label"), F.col("n_told"), F.col("n"))).withColumn("rank", F.struct(named.alias("named"), "score", -F.col("block")))
    best = F.max("rank").over(Window.partitionBy(key))
    return scored.select(key, "block", "label", "n", "n_told", "score", (F.col("rank") == best).alias("chosen"))


def chosen_items(items: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """(key, place, title, act, singers, ensemble, instrumental, reprise) of each document's chosen list. A title that stands
    there again is kept once, by its first line, unless it is a reprise; a reprise of a number that nobody sings is one too."""
    own = items.join(lists.where("chosen").select(key, "block"), [key, "block"])
    title = F.lower(F.regexp_replace("title", r"[^\p{L}\p{N}]+", " "))
    again = Window.partitionBy(key, "same", "reprise").orderBy("line")
    silent = F.max(F.col("instrumental") & ~F.col("reprise")).over(Window.partitionBy(key, "same"))
    named = (F.size("singers") > 0) | F.col("ensemble")
    once = own.withColumn("same", title).withColumns({"nth": F.row_number().over(again), "silent": silent}).where("nth = 1 OR reprise")
    place = F.row_number().over(Window.partitionBy(key).orderBy("line")).cast("int")
    music = F.col("instrumental") | (F.col("reprise") & F.col("silent") & ~named)
    return once.select(key, place.alias("place"), "title", "act", "singers", "ensemble", music.alias("instrumental"), "reprise")
