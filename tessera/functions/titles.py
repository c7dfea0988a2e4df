"""Titles, names, credits and albums as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import drop_article, fold, key_fold, match_fold, match_key, slug, squash, squeezed, words

# Number words of a reprise; words that no show name is found by; words that make another person of a name.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "ii": 2, "iii": 3, "iv": 4}
STOPWORDS = ["the", "a", "an", "of", "and", "to", "in", "on", "for", "at", "with"]
NOT_THE_SAME = [
    "young", "younger", "little", "old", "older", "adult", "teen", "teenage", "baby", "child", "kid", "grown", "junior", "jr", "senior", "sr", "madame", "mme", "mrs",
    "missus", "father", "mother", "son", "daughter", "brother", "sister", "uncle", "aunt", "grandma", "grandpa", "granny", "grandfather", "grandmother", "cousin",
    "wife", "husband", "widow",
]
# Spellings of the six ranges, and what tells a range in a voice type.
RANGES = {
    "Soprano": ["soprano", "sop", "s"],
    "Mezzo-soprano": ["mezzo", "mezzo soprano", "mezzosoprano", "mezzo sop", "mz", "mez", "ms"],
    "Alto": ["alto", "a", "contralto"],
    "Tenor": ["tenor", "t", "ten"],
    "Baritone": ["baritone", "bari", "bar"],
    "Bass": ["bass", "b"],
}
VOICES = [
    ("bass[ -]*baritone", "Baritone"), ("baritenor", "Tenor"), ("counter[ -]*tenor", "Alto"), ("contralto", "Alto"), ("mezzo", "Mezzo-soprano"),
    ("soprano", "Soprano"), ("treble", "Soprano"), (r"\balto\b", "Alto"), ("tenor", "Tenor"), ("baritone", "Baritone"), (r"\bbass\b", "Bass"),
    (r"\bbelt(?:er)?\b", "Mezzo-soprano"),
]
# What an album's name tells of its kind, first hit first.
ORIGINAL = r"\boriginal (?:\d{4} )?(?:broadway|london|west end|off broadway|new york|australian|cast|uk)\b.*\b(?:cast|company|recording)\b|\boriginal cast\b"
NOT_ORIGINAL = r"\b(?:revival|new broadway|new london|new york revival|\d{4} broadway|encore)\b"
TIERS = [
    (r"\b(?:in concert|concert|anniversary|dream cast|staged concert)\b", 72),
    (r"\b(?:studio cast|concept (?:album|recording|cast)|concept|world premiere|premiere recording)\b", 82),
    ("original", 100),
    (r"\b(?:revival|new broadway|new london|\d{4} broadway|\d{4} london|encore|west end cast|broadway cast|london cast|cast recording|cast album|cast)\b", 88),
    (r"\b(?:motion picture|soundtrack|original score|film|movie)\b", 62),
    (r"\b(?:musical|recording|highlights)\b", 60),
]
# What in brackets tells one version of a song from another.
DISTINGUISHER = (
    r"^(?:act|part|pt|no|version|reprise|finale)\b|\b(?:act|part|pt)\s*(?:\d+|one|two|three|i{1,3}|iv)\b|\breprise\b|\bversion\b|^(?:\d+|i{1,3}|iv)$"
)
# Words in a track's name by which it is no straight performance of the song.
SUSPECT_WORDS = [
    "demo", "instrumental", "karaoke", "underscore", "playoff", "play off", "remix", "acoustic", "radio edit", "pop version", "dialogue", "alternate", "alt take",
    "extended", "ringtone", "commentary", "interview", "backing", "accompaniment", "track by track", "exit music", "bows", "curtain call", "utterance", "spoken",
    "single version", "end credits?", "end title", "credits version", "intro", "outro", "introduction", "segue", "underscoring", "play ?out",
]
SUSPECT = rf"\b(?:{'|'.join(SUSPECT_WORDS)})\b"
# What a track's name says of its recording, behind a dash or in brackets.
TRACK_TAIL = r"(?i)\s[-–—]\s(?:from|live|original|bonus|single|demo|remaster(?:ed)?)\b.*$"
NOTE_WORDS = [
    "cast", "recording", "broadway", "london", "west end", "soundtrack", "live", "version", "from", "feat\\.?", "featuring", "remaster(?:ed)?", "bonus", "edit",
]
TRACK_NOTE = rf"(?i)\s*[(\[][^)\]]*\b(?:{'|'.join(NOTE_WORDS)})\b[^)\]]*[)\]]"
CORE_TAIL = r"(?i)\s[-–—]\s(?:from|live|feat|featuring|original|bonus)\b.*$"
GROUPS = r"\([^)]*\)|\[[^\]]*\]"
REPRISE = r"(?i)\breprise\b"
REPRISE_NUMBER = r"(?i)\breprise\s*(?:no\.?\s*|#\s*)?(\d{1,2}|one|two|three|four|five|ii|iii|iv)\b"


def literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def reprise_number(title: Column, flag: Column) -> Column:
    """0 for no reprise, 1 for one without a number, else its number."""
    said = F.lower(F.regexp_extract(title, REPRISE_NUMBER, 1))
    n = F.coalesce(said.try_cast("int"), F.try_element_at(literal_map(NUMBER_WORDS), said))
    return F.when(~flag & ~title.rlike(REPRISE), 0).when(n >= 1, n).otherwise(1)


def show_name_keys(name: Column) -> Column:
    """The key of a name, and that without a trailing "musical"."""
    key = match_key(name)
    return F.filter(F.array_distinct(F.array(key, F.trim(F.regexp_replace(key, " (?:the |a new |the new |the broadway )?musical$", "")))), lambda k: k != "")


def significant_words(name: Column) -> Column:
    """Words without the commonest; all where no other is left."""
    each = words(match_fold(name))
    left = F.filter(each, lambda w: ~w.isin(STOPWORDS))
    return F.when(F.size(left) > 0, left).otherwise(each)


def search_term(title: Column, show: Column) -> Column:
    t = squeezed(F.regexp_replace(title, r"\([^)]*\)", " "))
    return F.trim(F.concat_ws(" ", t, F.trim(F.replace(F.regexp_replace(show, r"(?i)^the\s+", ""), F.lit("!"), F.lit("")))))


def clean_track_title(name: Column) -> Column:
    """A track's name without notes on its recording; null if nothing is left."""
    return F.nullif(squeezed(F.regexp_replace(F.regexp_replace(name, TRACK_TAIL, ""), TRACK_NOTE, "")), F.lit(""))


def recording_title(title: Column, reprise: Column) -> Column:
    return F.when(reprise & ~title.rlike(REPRISE), F.concat(title, F.lit(" (Reprise)"))).otherwise(title)


def surnames(*credits: Column) -> Column:
    """Distinct last words of at least four letters of all persons in the credit lines."""
    people = F.flatten(F.array(*(F.split(F.coalesce(c, F.lit("")), r"(?i)\s*(?:,|&|\band\b|\bwith\b|;|/)\s*") for c in credits)))
    last = F.transform(people, lambda p: F.element_at(F.split(match_fold(p), " "), -1))
    return F.array_distinct(F.filter(last, lambda w: F.length(w) >= 4))


def human_list(items: Column) -> Column:
    """a / a and b / a, b and c"""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(head, F.lit(" and "), F.element_at(items, -1)))


def singers_line(singers: Column, most: int = 3) -> Column:
    """a / a & b / a, b, c & 2 more"""
    names = F.filter(F.transform(singers, lambda s: F.trim(s)), lambda s: s != "")
    n = F.size(names)
    head = lambda k: F.array_join(F.slice(names, 1, k), ", ")
    few = F.concat(head(F.greatest(n - 1, F.lit(0))), F.lit(" & "), F.element_at(names, -1))
    many = F.concat(head(F.lit(most)), F.lit(" & "), (n - most).cast("string"), F.lit(" more"))
    return F.when(n == 0, "").when(n == 1, names[0]).when(n <= most, few).otherwise(many)


def article_url(title: Column) -> Column:
    """The address of an encyclopedia article; null without a title."""
    coded = F.replace(F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    for code, char in (("%3A", ":"), ("%2F", "/"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(char))
    return F.when(title != "", F.concat(F.lit("https://en.wikipedia.org/wiki/"), coded))


def event_slug(name: Column) -> Column:
    """A festival's slug: no brackets, no "Star Festival" or "Regional" at the end, 60 characters at most."""
    short = squeezed(F.regexp_replace(name, r"\([^)]*\)", " "))
    short = F.regexp_replace(F.regexp_replace(short, r"(?i)\s*(?:regional\s+)?star\s+fest(?:ival)?$", ""), r"(?i)\s+regional$", "")
    cut = lambda x: F.regexp_replace(F.substring(slug(x), 1, 60), "-+$", "")
    return F.when(F.trim(short) != "", cut(short)).otherwise(cut(name))


def import_key(*parts: Column) -> Column:
    """A row's key in its sheet: folded parts between bars."""
    return F.concat(F.lit("sheet:"), F.concat_ws("|", *(squeezed(fold(F.coalesce(p, F.lit("")))) for p in parts)))


def vocal_range(value: Column) -> Column:
    """The range that a spelling names, null for none or an unknown one."""
    key = F.trim(F.regexp_replace(fold(F.trim(value)), r"[.\s_-]+", " "))
    return F.try_element_at(literal_map({a: r for r, names in RANGES.items() for a in names}), key)


def voice_range(voice: Column) -> Column:
    """The range of a voice type: its spelling, else of the hit that stands first."""
    f = match_fold(voice)
    hits = F.array(*(F.struct(F.regexp_instr(f, F.lit(p)).alias("at"), F.lit(n).alias("n"), F.lit(r).alias("range")) for n, (p, r) in enumerate(VOICES)))
    return F.coalesce(vocal_range(voice), F.array_min(F.filter(hits, lambda h: h["at"] > 0))["range"])


def album_tier(name: Column) -> Column:
    """How good a recording an album's name promises; null for none."""
    n, out = key_fold(name), F.when(F.lit(False), 0)
    for pattern, tier in TIERS:
        if pattern == "original":
            out = out.when(n.rlike(ORIGINAL) & ~n.rlike(NOT_ORIGINAL), F.when(n.rlike(r"\blive\b"), 90).otherwise(tier))
        else:
            out = out.when(n.rlike(pattern), tier)
    return out


def ladder_keys(title: Column) -> Column:
    """struct of what the title ladder compares: whole, core, sections, brackets, distinguishers, reprise, suspect."""
    full = key_fold(title)
    inside = F.transform(F.regexp_extract_all(title, F.lit(GROUPS), F.lit(0)), lambda g: key_fold(F.substring(g, F.lit(2), F.length(g) - 2)))
    inner = F.filter(inside, lambda p: p != "")
    outside = F.transform(F.split(F.regexp_replace(title, GROUPS, " "), r"\s*[/:;–—]\s*|\s+-\s+"), key_fold)
    marks = F.filter(inner, lambda p: p.rlike(DISTINGUISHER) & (p != "reprise"))
    return F.struct(
        full.alias("full"), key_fold(F.regexp_replace(F.regexp_replace(title, CORE_TAIL, ""), GROUPS, " ")).alias("core"),
        F.concat(inner, F.filter(outside, lambda p: p != "")).alias("parts"), inner.alias("inner"),
        F.array_join(F.array_sort(marks), "|").alias("marks"), full.rlike(r"\breprise\b").alias("reprise"), full.rlike(SUSPECT).alias("suspect"),
    )


def _same(x: Column, y: Column) -> Column:
    return (x != "") & (y != "") & ((x == y) | (squash(x) == squash(y)) | (drop_article(x) == drop_article(y)))


def ladder_level(track: Column, title: Column, aliases: Column | None = None) -> Column:
    """Of two ladder_keys, and an array of the title's other names: 100 exact ... 72 close, null below 70. A reprise matches a
    reprise alone; a suspect track loses 25."""
    others = F.transform(aliases, key_fold) if aliases is not None else F.array().cast("array<string>")
    named = lambda al: _same(al, track["full"]) | _same(al, track["core"]) | F.exists(track["parts"], lambda p: _same(p, al))
    many = (F.size(title["parts"]) > 1) & (F.size(title["inner"]) == 0)
    marks = track["marks"] == title["marks"]
    n_words = lambda x: F.size(F.split(x, " "))
    within = lambda p: F.contains(F.concat(F.lit(" "), track["full"], F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))
    a, b = F.array_distinct(F.split(track["core"], " ")), F.array_distinct(F.split(title["core"], " "))
    overlap = 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    subtitle = lambda p: ~p.rlike(DISTINGUISHER) & (n_words(p) >= 2) & (_same(p, track["core"]) | _same(p, track["full"]))
    close = marks & (track["core"] != "") & (title["core"] != "") & (F.least(n_words(track["core"]), n_words(title["core"])) >= 2) & (overlap >= 0.8)
    level = (
        F.when(track["full"] == title["full"], 100)
        .when(_same(track["full"], title["full"]), 96)
        .when(marks & _same(track["core"], title["core"]), 94)
        .when(marks & (title["core"] != "") & F.exists(track["parts"], lambda p: _same(p, title["core"])), 90)
        .when(many & F.forall(title["parts"], within), 90)
        .when(F.coalesce(F.exists(others, named), F.lit(False)), 88)
        .when(F.exists(title["inner"], subtitle), 88)
        .when(many & F.exists(title["parts"], lambda p: (n_words(p) >= 2) & _same(p, track["core"])), 78)
        .when(close, 72)
    )
    level = level - F.when(track["suspect"] & ~title["suspect"], 25).otherwise(0)
    asked = (track["full"] != "") & (title["full"] != "") & (track["reprise"] == title["reprise"])
    return F.when(asked & (level >= 70), level)


def character_match(a: Column, b: Column, shared: Column) -> Column:
    """exact, first (a first name) or last (a family name that no other character shares), of two match keys."""
    wa, wb = F.split(a, " "), F.split(b, " ")
    short = F.when(F.size(wa) < F.size(wb), wa).otherwise(wb)
    long = F.when(F.size(wa) < F.size(wb), wb).otherwise(wa)
    w = short[0]
    other = lambda words_: F.exists(words_, lambda x: x.isin(NOT_THE_SAME))
    tail, head = F.slice(long, 2, F.size(long)), F.slice(long, 1, F.size(long) - 1)
    usable = (a != "") & (b != "") & (F.size(wa) != F.size(wb)) & (F.size(short) == 1) & (F.length(w) >= 3)
    last = (F.element_at(long, -1) == w) & ~other(head) & ~head[0].isin("st", "saint") & ~F.array_contains(shared, w)
    return F.when((a == b) & (a != ""), "exact").when(usable & (long[0] == w), F.when(~other(tail), "first")).when(usable & last, "last")


def kind_of_singers(singers: Column, ensemble: Column, instrumental: Column) -> Column:
    """struct(kind, reason): solo or duet, or why neither."""
    n = F.size(singers)
    kind = F.when(~instrumental & ~ensemble, F.when(n == 1, "solo").when(n == 2, "duet"))
    reason = F.when(instrumental, "instrumental").when(ensemble, "ensemble").when(n == 0, "unknown").when(n > 2, "group")
    return F.struct(kind.alias("kind"), reason.alias("reason"))


def listed(values: Column) -> Column:
    """Values as one line, with commas and per cent signs in them escaped."""
    return F.array_join(F.transform(values, lambda v: F.replace(F.replace(v, F.lit("%"), F.lit("%25")), F.lit(","), F.lit("%2C"))), ",")


def unlisted(line: Column) -> Column:
    """The values of such a line, trimmed, empty ones and repeats (by fold) left out."""
    each = F.transform(F.split(line, ","), lambda v: F.trim(F.replace(F.regexp_replace(v, "(?i)%2C", ","), F.lit("%25"), F.lit("%"))))
    each = F.filter(each, lambda v: v != "")
    folded_ = F.transform(each, lambda v: squeezed(fold(v)))
    return F.filter(each, lambda v, i: F.array_position(folded_, squeezed(fold(v))) == i + 1)
