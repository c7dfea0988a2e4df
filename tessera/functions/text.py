"""Text as Column expressions. Four folds exist side by side; each operator names the one it uses."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1)
def _accents() -> tuple[str, str]:
    """Lower-case letters with accents, and the letters below: by canonical decomposition, over Latin, Greek, Cyrillic."""
    source, target = [], []
    for point in [*range(0xC0, 0x590), *range(0x1E00, 0x2000)]:
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != char and char == char.lower():
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


def strip_accents(x: Column) -> Column:
    """Lower-case text without accents or combining marks."""
    return F.regexp_replace(F.translate(x, *_accents()), r"\p{M}", "")


def fold(x: Column) -> Column:
    """Search fold: lower case, no accents, curly apostrophes straight. Plain ASCII needs the first alone."""
    return F.when(x.rlike(r"[^\x00-\x7f]"), F.translate(strip_accents(F.lower(x)), "‘’ʼ", "'''")).otherwise(F.lower(x))


def folded_contains(x: Column, folded: str) -> Column:
    """Whether fold(x) holds a folded text. Folding leaves ASCII as it is, so a plain hit needs no fold."""
    full = F.contains(fold(x), F.lit(folded))
    return F.contains(F.lower(x), F.lit(folded)) | full if folded.isascii() else full


def folded(query: str) -> str:
    """fold() of a text that the driver holds."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    return plain.translate(str.maketrans("‘’ʼ", "'''"))


# Letters that the display fold spells out, and the marks it makes plain.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "…": "..."}
PLAIN = {"‘": "'", "’": "'", "ʼ": "'", "“": '"', "”": '"', "–": "-", "—": "-"}


def display_fold(x: Column) -> Column:
    """The fold above, with special letters spelled out and typographic marks plain."""
    x = F.translate(strip_accents(F.lower(x)), "".join(PLAIN), "".join(PLAIN.values()))
    for a, b in SPELLED.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def key_fold(x: Column) -> Column:
    """Builder fold: & is a word, apostrophes go, all but a-z and 0-9 is a space."""
    x = F.regexp_replace(F.replace(strip_accents(F.lower(x)), F.lit("&"), F.lit(" and ")), "['‘’ʼ]", "")
    return squeezed(F.regexp_replace(x, "[^a-z0-9]+", " "))


def match_fold(x: Column) -> Column:
    """Matching fold: as the builder's, but letters and digits of any script stay."""
    x = F.regexp_replace(F.replace(strip_accents(F.lower(x)), F.lit("&"), F.lit(" and ")), "['‘’ʼ`]", "")
    return squeezed(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))


def nocase(x: Column) -> Column:
    """ASCII-only lower case, as a NOCASE collation compares."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_article(x: Column) -> Column:
    return F.regexp_replace(x, "^(the|a|an) ", "")


def match_key(x: Column) -> Column:
    return drop_article(match_fold(x))


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def words(x: Column) -> Column:
    return F.filter(F.split(squeezed(x), " "), lambda w: w != "")


def slug(x: Column) -> Column:
    """a-z, 0-9 and dashes; all digits get a suffix, nothing left is named."""
    s = F.regexp_replace(F.regexp_replace(fold(x), "['’]", ""), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", "show").when(s.rlike("^[0-9]+$"), F.concat(s, F.lit("-show"))).otherwise(s)


def clean(x: Column) -> Column:
    """No invisible or control characters, single spaces, empty is null."""
    x = F.regexp_replace(x, "[​‎‏‪-‮⁠-⁩﻿­]", "")
    return F.nullif(squeezed(F.regexp_replace(x, r"[\x00-\x1f\x7f]", " ")), F.lit(""))


def squash(x: Column) -> Column:
    """No spaces, doubled letters once."""
    return F.regexp_replace(F.replace(x, F.lit(" "), F.lit("")), r"(.)\1+", "$1")


def without_parentheses(x: Column) -> Column:
    return squeezed(F.regexp_replace(x, r"\([^)]*\)", " "))


def title_keys(x: Column) -> Column:
    """struct(main, core, subs, squash, reprise): keys by which titles are matched."""
    plain = F.regexp_replace(x, r"(?i)\s*[(\[-]\s*reprise[^)\]]*[)\]]?\s*$", "")
    inner = F.transform(F.regexp_extract_all(plain, F.lit(r"\(([^)]*)\)"), F.lit(1)), match_fold)
    parts = F.when(plain.contains("/"), F.transform(F.split(plain, "/"), match_fold)).otherwise(F.array().cast("array<string>"))
    subs = F.concat(F.filter(inner, lambda s: s.contains(" ")), F.filter(parts, lambda s: F.length(s) >= 3))
    main = match_key(plain)
    return F.struct(
        main.alias("main"),
        match_key(without_parentheses(plain)).alias("core"),
        subs.alias("subs"),
        squash(main).alias("squash"),
        x.rlike("(?i)reprise").alias("reprise"),
    )


def html_text(x: Column) -> Column:
    """Text of a page: comments, scripts and styles go, tags are spaces, common entities are characters."""
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " ")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return squeezed(x)


def natural_key(x: Column) -> Column:
    """A key that sorts texts as a reader does: no regard to case and accents, and numbers in them by their size."""
    number = lambda c: F.regexp_replace(c, "^0+(?=[0-9])", "")
    chunks = F.regexp_extract_all(x, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    sized = F.transform(chunks, lambda c: F.when(c.rlike("^[0-9]"), F.concat(F.lpad(F.length(number(c)).cast("string"), 4, "0"), number(c))).otherwise(c))
    return F.collate(F.array_join(sized, ""), "UNICODE_CI_AI")
