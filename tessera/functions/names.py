"""Names of persons as Column expressions: canonical forms, forms of address, and the parts by which a name is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import key_fold

# Titles that a canonical name goes without when two more words follow, and particles that keep them.
TITLES = [
    "prof", "professor", "dr", "doctor", "mr", "mrs", "ms", "miss", "sir", "captain", "capt", "lieutenant", "lt", "general", "madame", "monsieur", "elder", "sister",
    "brother", "father", "mother", "aunt", "uncle", "count", "countess", "prince", "princess", "duke", "duchess", "baron", "baroness", "lord", "lady", "dame", "king",
    "queen", "tsar", "czar", "emperor", "empress", "grand duke", "grand duchess", "vice principal", "principal", "headmaster", "headmistress", "coach", "nurse",
    "officer", "detective", "reverend",
]
PARTICLES = ["of", "de", "von", "van", "la", "le", "the", "di", "da"]
# Words of address, those that are no rank, and those that tell a man or a woman.
HONORIFICS = [
    "mr", "mrs", "ms", "miss", "dr", "doctor", "sir", "lady", "lord", "madame", "madam", "mme", "monsieur", "mademoiselle", "mlle", "prof", "professor", "captain",
    "capt", "father", "mother", "sister", "brother", "aunt", "uncle", "elder", "officer", "detective", "sergeant", "judge", "reverend", "rev", "count", "countess",
    "baron", "baroness", "duke", "duchess", "king", "queen", "prince", "princess", "general", "colonel", "major", "lieutenant", "lt", "nurse", "coach", "principal",
    "dean", "senator", "governor", "mayor", "herr", "frau", "fraulein", "signor", "signora", "senor", "senora", "don", "dona",
]
NEUTRAL = [
    "mr", "mrs", "ms", "miss", "dr", "doctor", "prof", "professor", "coach", "principal", "officer", "detective", "sergeant", "judge", "reverend", "rev", "nurse",
    "dean", "mayor", "senator", "governor", "herr", "frau", "fraulein", "monsieur", "madame", "madam", "mme", "mademoiselle", "mlle", "signor", "signora", "senor",
    "senora",
]
MALE = ["mr", "sir", "lord", "monsieur", "father", "brother", "uncle", "count", "baron", "duke", "king", "prince", "herr", "signor", "senor", "don"]
FEMALE = [
    "mrs", "ms", "miss", "lady", "madame", "madam", "mme", "mademoiselle", "mlle", "mother", "sister", "aunt", "countess", "baroness", "duchess", "queen", "princess",
    "frau", "fraulein", "signora", "senora", "dona",
]
# Words that make another role of a name, before it and behind it; epithets; words that name nobody alone.
AGES = [
    "young", "younger", "old", "older", "little", "lil", "big", "baby", "small", "medium", "adult", "teen", "teenage", "child", "kid",
]
NUMERAL = r"i{1,3}|iv|v|vi{0,3}|ix|x|\d+|jr|sr|junior|senior"
EPITHETS = [
    "great", "magnificent", "mighty", "amazing", "incredible", "fabulous", "famous", "wonderful", "marvelous", "marvellous", "terrible", "infamous", "notorious",
    "celebrated", "renowned", "glorious", "splendid", "fantastic", "remarkable",
]
NAMELESS = [
    "the", "mr", "mrs", "ms", "miss", "dr", "young", "old", "little", "lady", "lord", "sir", "de", "von", "van", "la", "le", "du", "des", "di", "da", "del", "of", "and",
    "st",
]


def canonical(name: Column) -> Column:
    """A name's form for comparing: no article or title, one spelling of each form of address."""
    return canonical_key(key_fold(name))


def canonical_key(key: Column) -> Column:
    """canonical() of a name by its key_fold."""
    x = F.regexp_replace(key, "^the ", "")
    x = F.regexp_replace(F.regexp_replace(x, r"\b(?:mme|madam)\b", "madame"), r"\bmlle\b", "mademoiselle")
    x = F.regexp_replace(x, rf"^(?:{'|'.join(TITLES)}) (?!(?:{'|'.join(PARTICLES)}) )(?=\S+ \S)", "")
    for word, short in (("doctor", "dr"), ("mister", "mr"), ("professor", "prof"), ("saint", "st")):
        x = F.regexp_replace(x, rf"\b{word}\b", short)
    return x


def quoted(name: Column) -> Column:
    return F.regexp_extract(name, '"([^"]+)"', 1)


def core_words(name: Column) -> Column:
    """Words without quoted names, middle initials and a leading article."""
    plain = F.regexp_replace(F.regexp_replace(name, '"[^"]*"', " "), r"\b\p{Lu}\.(?=\s)", " ")
    return F.filter(F.split(F.regexp_replace(key_fold(plain), "^the ", ""), " "), lambda w: w != "")


def name_parts(name: Column) -> Column:
    """struct(n, words, cn, hon, bare, nick, quick, aged): all by which a name is found."""
    n, core, nick = key_fold(name), core_words(name), quoted(name)
    titled = (F.size(core) > 1) & F.get(core, F.lit(0)).isin(HONORIFICS)
    words = F.split(n, " ")
    return F.struct(
        n.alias("n"), words.alias("words"), canonical(name).alias("cn"), F.when(titled, core[0]).alias("hon"),
        F.when(titled, F.slice(core, 2, F.size(core))).otherwise(core).alias("bare"), key_fold(nick).alias("nick"),
        F.lower(F.regexp_replace(nick, r"\W", "")).alias("quick"), (words[0].isin(AGES) | name.rlike(r"(?i)^(?:the\s+)?\S+-year-old\b")).alias("aged"),
    )


def proper_prefixes(words: Column) -> Column:
    """The texts of a word list's first words: one, two, ... all but one."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).otherwise(
        F.array().cast("array<string>")
    )


def proper_suffixes(words: Column) -> Column:
    return F.when(
        F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, k + 1, F.size(words)), " "))
    ).otherwise(F.array().cast("array<string>"))


def without_letter(word: Column, inner: bool = False) -> Column:
    """A word with one letter left out, each way; inner: neither its first letter nor one of its last two, and the last of a
    run of equal letters alone."""
    n = F.length(word)
    at = F.when(n > (3 if inner else 0), F.sequence(F.lit(2) if inner else F.lit(1), n - 2 if inner else n)).otherwise(F.array().cast("array<int>"))
    if inner:
        at = F.filter(at, lambda i: F.substring(word, i, F.lit(1)) != F.substring(word, i + 1, F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))


def with_gap(word: Column) -> Column:
    """A word with one letter hidden, each way: words of one length that differ in one letter share one of these."""
    n = F.length(word)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.lit("_"), F.substring(word, i + 1, n)))
