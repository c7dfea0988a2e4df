"""Albums as Column expressions: which are recordings of a show, and how good each promises to be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import drop_article, key_fold, squash
from tessera.functions.titles import album_tier

# Words of albums that are never offered, and of casts in other languages (languages and places, then houses).
BAD_WORDS = [
    "karaoke", "instrumentals?", "backing tracks?", "tribute", "made famous", "covers?", "lullab(?:y|ies)", "piano", "originally performed", "in the style of", "workout",
    "guitar", "accompaniment", "sing ?a ?long", "minus one", "performance tracks?", "music box", "strings?", "8 ?bit", "meditation", "sleep", "commentary", "interview",
    "talking", "jazz", "holiday", "christmas", "violin", "orchestral suite", "songbook", "the songs of", "plays", "sings", "bluegrass", "medley", "parody", "radio edit",
    "remix(?:es)?", "choir", "choral", "for kids", "lounge", "audiobook", "unabridged", "hits of", "greatest", "best of", "selections from",
]
FOREIGN_WORDS = [
    "besetzung", "deutsche", "german", "deutsch", "wiener", "wien", "vienna", "hamburg", "stuttgart", "berlin", "st gallen", "francaise", "french", "version francaise",
    "dutch", "nederlandse", "japanese", "japan", "tokyo", "takarazuka", "shiki", "toho", "korean", "korea", "seoul", "svenska", "swedish", "espanol", "spanish",
    "en espanol", "elenco", "argentina", "buenos aires", "mexico", "madrid", "italiano", "italian", "hungarian", "czech", "polish", "polska", "danish", "norwegian",
    "finnish", "suomi", "brasil", "brazil", "portugues", "hebrew", "chinese", "mandarin", "russian", "estonian", "icelandic",
    "originalbesetzung", "musiktheater", "stadttheater", "staatstheater", "landestheater", "volksoper", "ronacher", "raimund ?theater", "regensburg", "bonn", "magdeburg",
    "linz", "bremen", "dresden", "leipzig", "munchen", "munich", "koln", "dusseldorf", "tecklenburg", "thun", "amstetten", "salzburg", "graz", "zurich", "basel", "kassel",
    "mainz", "oberhausen", "fussen", "essen", "bochum", "hannover",
]
LEAD_TRAILERS = ["musical", "highlights", "live", "in concert", "the broadway musical", "a new musical", "the new musical", "original cast"]
_UNWANTED = rf"\b(?:{'|'.join(BAD_WORDS + FOREIGN_WORDS)})\b"


def _hay(name: Column, artist: Column) -> Column:
    return F.concat(key_fold(F.coalesce(name, F.lit(""))), F.lit(" | "), key_fold(F.coalesce(artist, F.lit(""))))


def unwanted(name: Column, artist: Column) -> Column:
    """Whether an album is one that is never offered, by its name or its artist's: covers, karaoke, casts in other languages."""
    return _hay(name, artist).rlike(_UNWANTED)


def lead(name: Column) -> Column:
    """What stands before a bracket, colon or dash of an album's name, without what says that it is a show's."""
    cut = F.split(F.coalesce(name, F.lit("")), r"\s*[(\[:]\s*|\s+[-–—]\s+")[0]
    return F.regexp_replace(drop_article(key_fold(cut)), rf" (?:the )?(?:{'|'.join(LEAD_TRAILERS)})$", "")


def leads_to(found: Column, wanted: Column) -> Column:
    """Whether a lead names one of an array of wanted ones: alike, or behind somebody's possessive."""

    def hit(x: Column) -> Column:
        same = (found == x) | (squash(found) == squash(x)) | (drop_article(found) == drop_article(x))
        before = F.regexp_replace(F.substring(found, F.lit(1), F.length(found) - F.length(x)), "(?: the)? $", "")
        owned = F.endswith(found, F.concat(F.lit(" "), x)) & before.endswith("s")
        return (x != "") & (found != "") & (same | owned)

    return F.exists(wanted, hit)


def classified(name: Column, artist: Column, leads: Column, film: Column | None = None, prefer: dict[str, int] | None = None, any_name: bool = False) -> Column:
    """struct(tier, rank) of an album that is a usable recording of a show, else null.

    leads: the names, folded, by which the show's albums go. film: whether those of its film are wanted. prefer: patterns of folded
    names and what they add to the rank. any_name: an album of the name alone is a recording too. Highlights lose 8 and singles
    20 in rank, not in tier. A null name or artist counts as empty.
    """
    n = key_fold(F.coalesce(name, F.lit("")))
    tier = album_tier(F.coalesce(name, F.lit("")))
    if any_name:
        tier = F.coalesce(tier, F.lit(55))
    rank = tier - F.when(n.rlike(r"\bhighlights\b"), 8).otherwise(0) - F.when(n.rlike(r"\b(?:single|ep)\s*$"), 20).otherwise(0)
    for pattern, bonus in (prefer or {}).items():
        rank = rank + F.when(n.rlike(pattern), bonus).otherwise(0)
    of_film = (tier == 62) & ~(F.lit(False) if film is None else F.coalesce(film, F.lit(False)))
    usable = leads_to(lead(name), leads) & ~unwanted(name, artist) & tier.isNotNull() & ~of_film
    return F.when(F.coalesce(usable, F.lit(False)), F.struct(tier.cast("int").alias("tier"), rank.cast("int").alias("rank")))
