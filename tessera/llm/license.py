"""License scans: an Aho-Corasick automaton over word-normalised text, and a shunting-yard parser for tag expressions.

One automaton holds the notice phrases and the tag marker. Text is lower-cased (A-Z only) and reduced to
words, so a phrase is found wherever its words stand consecutively, whatever stands between them. In texts with
the tag marker, the longest well-formed expression of known identifiers after each tag is read from the original text and
parsed; prose that follows it on the line does not count, and neither does anything from the next tag on.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, texts_of

# The base phrases of the contract and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice phrases beyond the base, in words as the scan sees them.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu general public license version 2": "gpl-2.0",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Licences that allow reuse with attribution alone.
PERMISSIVE = frozenset({
    "0bsd", "afl-3.0", "apache-2.0", "blueoak-1.0.0", "bsd-1-clause", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc-by-3.0", "cc-by-4.0", "cc0-1.0", "isc", "mit",
    "mit-0", "ncsa", "postgresql", "psf-2.0", "python-2.0", "unicode-3.0", "unlicense", "upl-1.0", "wtfpl", "x11", "zlib",
})
#: Families of public identifiers: name, versions, endings.
FAMILIES = [
    ("gpl", "1.0 2.0 3.0", " -only -or-later"), ("lgpl", "2.0 2.1 3.0", " -only -or-later"), ("agpl", "1.0 3.0", " -only -or-later"),
    ("gfdl", "1.1 1.2 1.3", " -only -or-later"), ("apache", "1.0 1.1 2.0", ""), ("mpl", "1.0 1.1 2.0", ""), ("epl", "1.0 2.0", ""), ("eupl", "1.0 1.1 1.2", ""),
    ("bsd", "1 2 3 4", "-clause"), ("cddl", "1.0 1.1", ""), ("cecill", "1.0 2.0 2.1", ""), ("ofl", "1.0 1.1", ""), ("osl", "1.0 2.0 2.1 3.0", ""), ("afl", "1.1 1.2 2.0 2.1 3.0", ""),
    ("artistic", "1.0 2.0", ""), ("odc-by", "1.0", ""), ("odbl", "1.0", ""), ("pddl", "1.0", ""), ("zpl", "1.1 2.0 2.1", ""), ("lppl", "1.0 1.1 1.2 1.3a 1.3c", ""),
    *((f"cc-by{kind}", "1.0 2.0 2.5 3.0 4.0", "") for kind in ("", "-nc", "-nd", "-sa", "-nc-nd", "-nc-sa")),
]
#: Identifiers outside these families.
SINGLE = (
    "0bsd blueoak-1.0.0 bsd-3-clause-clear bsl-1.0 busl-1.1 bzip2-1.0.6 cc-pddc cc0-1.0 cecill-b cecill-c cpl-1.0 curl elastic-2.0 etalab-2.0 ftl hpnd icu ijg isc "
    "json libpng libtiff mit mit-0 mit-cmu ms-pl ms-rl mulanpsl-2.0 ncsa openssl php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat sspl-1.0 tcl unicode-3.0 "
    "unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zlib-acknowledgement"
).split()
IDENTIFIERS = frozenset(SINGLE) | {f"{n}-{v}{e}" for n, versions, ends in FAMILIES for v in versions.split() for e in ends.split(" ")}
#: Exceptions that may stand behind WITH.
EXCEPTIONS = frozenset(
    (
        "389-exception autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 ecos-exception-2.0 font-exception-2.0 "
        "gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 "
        "swift-exception u-boot-exception-2.0 universal-foss-exception-1.0 wxwindows-exception-3.1"
    ).split()
)


def known(operand: str, exception: bool = False) -> bool:
    """Whether a lower-case operand is a public identifier, one with a plus, or a reference of a document's own."""
    if exception:
        return operand in EXCEPTIONS or operand.startswith("additionref-")
    return operand.removesuffix("+") in IDENTIFIERS or operand.startswith("licenseref-") or (operand.startswith("documentref-") and ":licenseref-" in operand)


#: How sure a place makes us: a parsed tag, a notice phrase, a base phrase.
CERTAINTY = {"tag": 1.0, "notice": 0.9, "base": 0.6}

#: Bytes of UTF-8: letters A-Z fall to lower case, other ASCII but digits and a-z parts words, all else is kept.
_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: A tag where its words start, up to its expression.
_TAG = re.compile(r"(?<![0-9A-Za-z\x80-\U0010ffff])spdx-license-identifier\s*:\s*", re.I | re.A)
#: What an expression goes on with, on its line.
_NEXT = re.compile(r"[^\S\n\r]*(\(|\)|[0-9A-Za-z](?:[\w.+:-]*[0-9A-Za-z+])?)", re.A)
#: A word of prose: what no identifier that we don't know looks like.
_PROSE = re.compile(r"[A-Z]?[a-z]*[.:]?")
_TOKEN = re.compile(r"\(|\)|[^\s()]+")
_RANK = {"with": 3, "and": 2, "or": 1}


class BadExpression(ValueError):
    pass


def postfix(expression: str) -> list[str]:
    """Shunting-yard: a tag expression in postfix order. WITH binds before AND, AND before OR."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if not operand_next:
                raise BadExpression(expression)
            waiting.append(token)
        elif token == ")":
            if operand_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise BadExpression(expression)
            waiting.pop()
        elif low in _RANK:
            if operand_next:
                raise BadExpression(expression)
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand_next = True
        else:
            if not operand_next:
                raise BadExpression(expression)
            out.append(low)
            operand_next = False
    while waiting:
        if waiting[-1] == "(":
            raise BadExpression(expression)
        out.append(waiting.pop())
    if operand_next:
        raise BadExpression(expression)
    return out


def evaluate(expression: str, allowed: frozenset[str] = PERMISSIVE) -> tuple[bool, set[str]]:
    """Whether the allowed licences satisfy an expression, and the licences that it names.

    AND needs both sides, OR one; an exception joined by WITH adds rights, so its licence decides.
    """
    stack: list[tuple[bool, set[str]]] = []
    for token in postfix(expression):
        if token not in _RANK:
            stack.append((token in allowed, {token}))
            continue
        (right_ok, right), (left_ok, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left_ok, {f"{x} with {y}" for x in left for y in right}))
        else:
            large, small = (left, right) if len(left) >= len(right) else (right, left)
            large |= small
            stack.append((left_ok and right_ok if token == "and" else left_ok or right_ok, large))
    return stack[0]


def longest_expression(text: str, start: int, end: int) -> tuple[str, bool]:
    """The longest well-formed expression of known identifiers that stands at start, on one line and before end, and whether
    it breaks off behind an AND: then more is asked than can be read. An AND before a word of prose is prose itself."""
    at = whole = start
    depth = 0
    before = ""
    operand_next, broken = True, False
    while token := _NEXT.match(text, at, end):
        low = token[1].lower()
        if low == "(":
            if not operand_next or before == "with":
                break
            depth += 1
        elif low == ")":
            if operand_next or not depth:
                break
            depth -= 1
        elif low in _RANK:
            if operand_next:
                break
            operand_next = True
            if at == whole:
                broken = low == "and"
        else:
            if not operand_next or not known(low, before == "with"):
                broken = broken and not _PROSE.fullmatch(token[1])
                break
            operand_next = False
        before = low
        at = token.end()
        if not operand_next and not depth:
            whole, broken = at, False
    return text[start:whole], broken


def tagged(text: str, start: int, end: int) -> tuple[bool, set[str]]:
    """Whether a tag's expression allows reuse, and the licences that it names: none without a known one."""
    expression, broken = longest_expression(text, start, end)
    if not expression:
        return False, set()
    ok, named = evaluate(expression)
    return ok and not broken, named


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    kinds: dict[str, list[tuple[str, str]]] = {TAG: [("tag", "")]}
    for kind, table in (("base", BASE), ("notice", NOTICES)):
        for phrase, label in table.items():
            kinds.setdefault(phrase, []).append((kind, label))
    for phrase, what in kinds.items():
        found.add_word(f" {phrase} ", (len(phrase.split()), what))
    found.make_automaton()
    return found


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def places(text: str) -> tuple[int, list[tuple[str, str, int]]]:
    """How many words text has, and (kind, label, first word) of every place found."""
    words = _words(text)
    plain = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    out: list[tuple[str, str, int]] = []
    at = before = 0
    tagged_text = False
    for end, (n, what) in automaton().iter(plain):
        before += plain.count(" ", at, end)
        at = end
        for kind, label in what:
            if kind == "tag":
                tagged_text = True
            else:
                out.append((kind, label, before - n))
    if tagged_text:
        tags = list(_TAG.finditer(text))
        word = at = 0
        for m, end in zip(tags, [*(t.start() for t in tags[1:]), len(text)]):
            word += len(_words(text[at : m.start()]))
            at = m.start()
            ok, named = tagged(text, m.end(), end)
            out += [("permissive" if ok else "restricted", x, word) for x in sorted(named)]
    return len(words), out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places: array of (kind, label, word) for each document.

    Kinds: base and notice phrases; permissive and restricted are licences named by a tag, by what its
    whole expression evaluates to.

    A null or empty text has no words and no places; repeated rows give repeated results; other columns are
    not read. Rows without a doc_id take no part. A tag without a known identifier counts for nothing; licences whose
    expression breaks off behind an AND are restricted.
    """

    def work(columns: list) -> dict:
        ids, texts = columns
        found = [places(t) for t in texts]
        return {
            "doc_id": ids,
            "n_words": [n for n, _ in found],
            "places": [[{"kind": k, "label": x, "word": w} for k, x, w in ps] for _, ps in found],
        }

    return map_rows(
        texts_of(docs), work, "doc_id long, n_words long, places array<struct<kind:string,label:string,word:long>>"
    )


def summary(scanned: DataFrame) -> DataFrame:
    """One row per document: counts, first and last base places, labels, score."""
    base = F.filter("places", lambda p: p["kind"] == "base")
    starts = F.transform(base, lambda p: p["word"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    sure = F.transform(
        "places",
        lambda p: F.when(p["kind"].isin("permissive", "restricted"), CERTAINTY["tag"])
        .when(p["kind"] == "notice", CERTAINTY["notice"])
        .otherwise(CERTAINTY["base"]),
    )
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
        F.exists("places", lambda p: p["kind"] == "permissive").alias("permissive_tag"),
    )
