"""What a row is shown as: initials, shortened texts, merged credits, keys and labels; and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import fold, key_fold, match_fold, squeezed, strip_accents

# Words that give no initial where others do.
SMALL_WORDS = ["the", "a", "an", "of", "and", "in", "on", "to", "for", "with", "at", "de", "la", "le"]
SENTENCES = 3


def initials(name: Column, most: int = 2) -> Column:
    """The first letters of a name's words, without small ones where others are left; ? for none."""
    words = F.filter(F.transform(F.split(strip_accents(F.lower(name)), r"[\s\-–—/]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    large = F.filter(words, lambda w: ~w.isin(SMALL_WORDS))
    use = F.when(F.size(large) > 0, large).otherwise(words)
    out = F.array_join(F.transform(F.slice(use, 1, most), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, "?").otherwise(out)


def shortened(text: Column, most: int = 600) -> Column:
    """The first three sentences, as many as fit; a first one that doesn't is cut, with a mark. Empty for null."""
    plain = squeezed(F.coalesce(text, F.lit("")))
    found = F.regexp_extract_all(plain, F.lit(r"[^.!?]++[.!?]++(?:\s|$)"), F.lit(0))
    each = F.slice(F.when(F.size(found) > 0, found).otherwise(F.array(plain)), 1, SENTENCES)
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    step = lambda s, x: F.when(s["full"] | (F.length(s["text"]) + F.length(x) > most), F.struct(s["text"].alias("text"), F.lit(True).alias("full"))).otherwise(
        F.struct(F.concat(s["text"], x).alias("text"), F.lit(False).alias("full"))
    )
    fitting = F.trim(F.aggregate(each, start, step)["text"])
    cut = F.when(F.length(plain) > most, F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…"))).otherwise(plain)
    return F.when(fitting != "", fitting).otherwise(F.when(F.size(found) > 0, F.rtrim(F.substring(plain, 1, most))).otherwise(cut))


def capped(text: Column, most: int) -> Column:
    """A text of at most so many characters, the last one a mark where something was cut."""
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def contains_words(text: Column, words: Column) -> Column:
    """Whether a folded text holds folded words, whole; empty ones are nowhere."""
    return (words != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), words, F.lit(" ")))


def core_title(title: Column) -> Column:
    """A title without brackets and what a dash says of its recording, folded for matching."""
    x = F.regexp_replace(title, r"(?i)\s[-–—]\s(?:from|live|feat|featuring)\b.*$", "")
    return match_fold(F.regexp_replace(x, r"\([^)]*\)|\[[^\]]*\]", " "))


def song_key(title: Column, reprise: Column) -> Column:
    """What makes two titles one song: letters of other scripts stay, others are folded away; reprises are songs of their own."""
    foreign = F.regexp_replace(title, r"\p{IsLatin}", "").rlike(r"\p{L}")
    key = F.when(foreign, fold(title)).otherwise(F.coalesce(F.nullif(key_fold(title), F.lit("")), fold(title)))
    return F.concat(key, F.lit("|"), F.coalesce(reprise, F.lit(False)).cast("int").cast("string"))


def credit_lines(music: Column, lyrics: Column, book: Column) -> Column:
    """array of (role, who): somebody who did several things stands once."""
    m, y, b = (F.nullif(F.trim(x), F.lit("")) for x in (music, lyrics, book))
    same = lambda p, q: F.coalesce(F.lower(p) == F.lower(q), F.lit(False))
    line = lambda role, who: F.when(who.isNotNull(), F.struct(F.lit(role).alias("role"), who.alias("who")))
    both = same(m, y)
    lines = F.when(both & same(m, b), F.array(line("Music, lyrics & book", m))).when(both, F.array(line("Music & lyrics", m), line("Book", b))).when(
        same(b, y), F.array(line("Music", m), line("Lyrics & book", b))
    )
    return F.filter(lines.otherwise(F.array(line("Music", m), line("Lyrics", y), line("Book", b))), lambda x: x.isNotNull())


def score_label(score: Column) -> Column:
    return F.when(score >= 85, "Great match").when(score >= 70, "Likely match").when(score.isNotNull(), "Maybe")


_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The product of two 32-bit numbers, modulo 2**32, in halves, so that no long runs over."""
    low, high = a.bitwiseAND(0xFFFF) * b, F.shiftright(a, 16) * b
    return (low.bitwiseAND(_MASK) + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def seeded_draw(seed: Column, turn: int = 1) -> Column:
    """The so-manieth uniform draw, from 0 to below 1, of a 32-bit counter generator with a seed; the same on any machine."""
    increment = 0x6D2B79F5 * turn & _MASK
    a = (seed.cast("long").bitwiseAND(_MASK) + increment).bitwiseAND(_MASK)
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(1))
    more = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(61))).bitwiseAND(_MASK)
    t = t.bitwiseXOR(more)
    return t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0)
