"""Names of one scope's persons: variants merged, and spelled mentions resolved.

Both work by keys. A name gives keys, a mention asks for keys, and what stands behind a key is aggregated to its smallest and
largest name before anything is joined: they are equal if the key has one name alone, and that is all the rules ask. So no
pairs of names are made, however many share a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.functions.text import key_fold
from tessera.session import scratch


def _none() -> Column:
    return F.array().cast("array<string>")


def _last(words: Column) -> Column:
    return F.get(words, F.size(words) - 1)


def _first(words: Column) -> Column:
    return F.get(words, F.lit(0))


def _some(*keys: Column) -> Column:
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def _pre(sign: str, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{sign}:"), k))


def _variant_keys(each: DataFrame) -> DataFrame:
    """scope, name and at with the name's form without blanks, what a longer name offers, what a shorter one asks for, and whether
    it has letters. Folds are columns of their own: what is taken from them, word by word, would make them again each time."""
    name, key, nick, cn, rw, cw = map(F.col, ("name", "key", "nick", "cn", "rw", "cw"))
    folded = each.withColumns({"key": key_fold(name), "nick": key_fold(names.quoted(name))}).withColumn("cn", names.canonical_key(key))
    folded = folded.withColumns({"rw": F.split(key, " "), "cw": F.split(cn, " ")})
    n = F.size(cw)
    # a tail of numerals makes another role
    heads = F.filter(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.exists(F.slice(cw, k + 1, n), lambda w: ~w.rlike(f"^(?:{names.NUMERAL})$")),
    )
    ends = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.concat_ws(" ", m, cw[0], _last(cw)))).otherwise(_none())
    rank = F.when((F.size(rw) > 2) & rw[0].isin(names.HONORIFICS), F.concat_ws(" ", rw[0], _last(rw)))
    known = F.filter(F.when(nick != "", F.array(nick, F.concat_ws(" ", nick, _last(rw)))).otherwise(_none()), lambda k: k != key)
    epithet = F.when((F.size(rw) == 3) & (rw[0] == "the") & F.get(rw, F.lit(1)).isin(names.EPITHETS), F.get(rw, F.lit(2)))
    offers = F.concat(
        _pre("head", F.transform(heads, lambda k: F.array_join(F.slice(cw, F.lit(1), k), " "))), _pre("ends", ends), _pre("rank", _some(rank)), _pre("nick", known),
        _pre("epithet", _some(epithet)),
    )
    asks = F.concat(
        F.array(F.concat(F.lit("head:"), cn), F.concat(F.lit("nick:"), key)),
        _pre("ends", _some(F.when(n >= 2, F.concat_ws(" ", n, cw[0], _last(cw))))),
        _pre("rank", _some(F.when((F.size(rw) == 2) & rw[0].isin(names.HONORIFICS), key))), _pre("epithet", _some(F.when(F.size(rw) == 1, rw[0]))),
    )
    form = F.replace(cn, F.lit(" "), F.lit(""))
    return folded.select("scope", "name", "at", form.alias("form"), F.array_distinct(offers).alias("offers"), F.array_distinct(asks).alias("asks"), (key != "").alias("named"))


def merged_variants(people: DataFrame, scope: str, at: str, name: str) -> DataFrame:
    """(scope, name, canonical): the name under which each name of a scope stands.

    A name goes into a longer one that it begins, whose first and last word it has, whose rank and surname or nickname it is, or
    whose epithet form has it, if there is just one such name; several leave it alone. Where that name goes into another, both
    stand under the last one; names that go into each other in a circle stay apart. Of names with one canonical form, the first
    by `at` stands for all. Repeated names count once; rows without a scope or a name, or with an empty one, take no part.
    """
    each = people.where(F.col(scope).isNotNull()).groupBy(F.col(scope).alias("scope"), F.col(name).alias("name")).agg(F.min(at).alias("at"))
    # written, so that names are folded once; a filter of names before that would be moved to where they are read, or made
    each = scratch(_variant_keys(each), "keys").where("named")
    target = F.struct("at", "name")
    behind = each.select("scope", F.explode("offers").alias("key"), target.alias("t")).groupBy("scope", "key").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    found = each.select("scope", "name", F.explode("asks").alias("key")).join(behind, ["scope", "key"])
    one = found.groupBy("scope", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi AND lo.name <> name")
    up = scratch(each.select("scope", "name", "at", "form").join(one.select("scope", "name", F.col("lo.name").alias("to")), ["scope", "name"], "left"), "variants")
    # pointers are doubled until only circles, if any, are left: before that, each round settles at least one more name
    open_before = None
    while (left := up.where("to IS NOT NULL").count()) and left != open_before:
        open_before = left
        next_ = up.select("scope", F.col("name").alias("to"), F.col("to").alias("then"), *([F.col("end").alias("far")] if "end" in up.columns else []))
        joined = up.join(next_, ["scope", "to"], "left")
        end = F.when(F.col("to").isNotNull() & F.col("then").isNull(), F.coalesce("far", "to") if "end" in up.columns else F.col("to"))
        settled = F.coalesce("end", end) if "end" in up.columns else end
        up = scratch(joined.select("scope", "name", "at", "form", F.when(end.isNull(), F.col("then")).alias("to"), settled.alias("end")), "variants")
    ends = up.select("scope", "name", "at", "form", (F.coalesce("end", "name") if "end" in up.columns else F.col("name")).alias("root"))
    heads = ends.where("name = root").select("scope", "name", "at", "form")
    firsts = heads.groupBy("scope", "form").agg(F.min(F.struct("at", "name")).alias("first"))
    stands = heads.join(firsts, ["scope", "form"]).select("scope", F.col("name").alias("root"), F.col("first.name").alias("canonical"))
    return ends.select("scope", "name", "root").join(stands, ["scope", "root"]).select("scope", "name", "canonical")


#: The rules of resolved_mentions() in their order. `first`: the first listed of several names counts; all others need one alone.
RULES = [
    "exact", "title", "initial", "nickname", "first_last", "typo", "first_names", "rank", "address", "surname_initial", "word", "age", "first_word", "bare_word",
    "short", "near", "part", "near_last",
]
_NUMBER = {rule: n for n, rule in enumerate(RULES)}


def _numbered(rule: int, keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(rule).alias("rule"), k.alias("key")))


def _rules(keys: dict[str, Column]) -> Column:
    """array of struct(rule, key)."""
    return F.concat(*(_numbered(_NUMBER[rule], k) for rule, k in keys.items()))


def _one_edit(word: Column, offered: bool, inner: bool = False) -> Column:
    """Keys that two words share if they are one letter apart, one offering, the other asking."""
    whole, less = ("whole", "less") if offered else ("less", "whole")
    keys = F.concat(_pre(whole, F.array(word)), _pre(less, names.without_letter(word, inner)))
    return keys if inner else F.concat(keys, _pre("gap", names.with_gap(word)))


def _offered(name: Column, p: Column) -> Column:
    """By which keys a person can be found, a rule at a time. p: name_parts of the name."""
    words, bare, hon, n = p["words"], p["bare"], p["hon"], p["n"]
    plain = ~p["aged"]
    first, last, long = _first(bare), _last(bare), F.size(bare) >= 2
    untitled = F.regexp_replace(n, "^the ", "")
    owned = F.transform(F.regexp_extract_all(name, F.lit(r"([\p{L}\p{N}]+)(?:['’]s|s['’]|['’])(?:\s|$)"), F.lit(1)), key_fold)
    own = F.concat(owned, F.transform(owned, lambda w: F.concat(w, F.lit("s"))))
    single = F.filter(F.array_distinct(words), lambda w: ~w.isin(names.NAMELESS) & ~F.array_contains(own, w))
    sex = F.when(hon.isin(names.MALE), "m").when(hon.isin(names.FEMALE), "f")
    # who may be meant by a man's, a woman's, or another form of address
    who = F.concat(
        F.when(hon.isNull(), F.array(F.lit("m"), F.lit("f"), F.lit("n"))).when(sex == "m", F.array(F.lit("m"))).when(sex == "f", F.array(F.lit("f")))
        .otherwise(F.array(F.lit("m"), F.lit("f"))), F.transform(_some(hon), lambda h: F.concat(F.lit("="), h)),
    )
    reach = F.concat(F.array(F.lit("any")), F.when(F.size(bare) == 1, F.array(F.lit("one"))).otherwise(_none()), F.array(F.concat(F.lit("first "), first)))
    address = F.flatten(F.transform(who, lambda w: F.transform(reach, lambda r: F.concat_ws(" ", w, r, last))))
    only = lambda hit, keys: F.when(F.coalesce(hit, F.lit(False)), keys).otherwise(_none())
    titled = F.filter(names.proper_prefixes(F.split(untitled, " ")), lambda k: F.startswith(untitled, F.concat(k, F.lit(" of "))))
    return _rules({
        "title": titled,
        "initial": F.transform(names.proper_suffixes(words), lambda s: F.concat_ws(" ", F.substring(words[0], 1, 1), s)),
        "nickname": only(p["quick"] != "", F.array(p["quick"])),
        "first_last": only(long, F.concat(F.array(F.concat_ws(" ", first, last)), only((p["nick"] != "") & ~p["nick"].contains(" "), F.array(F.concat_ws(" ", p["nick"], last))))),
        "typo": only(long, F.transform(_one_edit(last, True), lambda k: F.concat_ws(" ", first, k))),
        "first_names": only(plain, F.filter(names.proper_prefixes(bare), lambda k: k.contains(" "))),
        "rank": only(plain & hon.isNotNull() & (F.size(bare) >= 1), F.array(F.concat_ws(" ", hon, last))),
        "address": only(plain & (F.size(bare) >= 1), address),
        "surname_initial": only(long, F.array(F.concat_ws(" ", first, F.substring(last, 1, 1)))),
        "word": only(plain, single),
        "age": only(p["aged"] & F.array_contains(single, words[0]), F.array(words[0])),
        "first_word": only(plain & F.array_contains(single, words[0]), F.array(words[0])),
        "bare_word": only(plain & F.array_contains(single, first), F.array(first)),
        "short": only(plain & (F.length(first) > 4) & ~name.rlike(r"(?i)['’]s\b"), F.transform(F.sequence(F.lit(3), F.greatest(F.length(first) - 2, F.lit(3))), lambda k: F.substring(first, F.lit(1), k))),
        "near": only(plain & (F.size(bare) >= 1), _one_edit(first, True, inner=True)),
        "part": F.array_distinct(F.concat(names.proper_prefixes(words), names.proper_suffixes(words))),
        "near_last": only(plain & long, _one_edit(last, True, inner=True)),
    })


def _asked(token: Column, p: Column) -> Column:
    """Which keys a mention asks for, a rule at a time."""
    n = F.regexp_replace(p["n"], "^the ", "")
    words, bare, hon = F.split(n, " "), p["bare"], p["hon"]
    first, last, long, single = _first(bare), _last(bare), F.size(bare) >= 2, F.size(words) == 1
    only = lambda hit, keys: F.when(F.coalesce(hit, F.lit(False)), keys).otherwise(_none())
    quick = F.lower(F.regexp_replace(token, r"\W", ""))
    who = F.when(hon.isin(names.MALE), F.array(F.lit("m"), F.concat(F.lit("="), hon))).when(hon.isin(names.FEMALE), F.array(F.lit("f"), F.concat(F.lit("="), hon)))
    who = who.otherwise(F.array(F.lit("n"), F.concat(F.lit("="), hon)))
    reach = F.when(F.size(bare) == 1, F.array(F.lit("any"))).otherwise(F.array(F.lit("one"), F.concat(F.lit("first "), first)))
    initial, rest = F.regexp_extract(token, r"^([A-Z])\.\s*(\S.*)$", 1), F.regexp_extract(token, r"^([A-Z])\.\s*(\S.*)$", 2)
    given, letter = F.regexp_extract(token, r"^(\p{Lu}[\p{L}'’-]+)\s+(\p{Lu})\.?$", 1), F.regexp_extract(token, r"^(\p{Lu}[\p{L}'’-]+)\s+(\p{Lu})\.?$", 2)
    old = n.isin(names.AGES)
    return _rules({
        "title": F.array(n),
        "initial": only(initial != "", F.array(F.concat_ws(" ", F.lower(initial), key_fold(rest)))),
        "nickname": only(quick != "", F.array(quick)),
        "first_last": only(long, F.array(F.concat_ws(" ", first, last))),
        "typo": only(long & (F.length(last) >= 5), F.transform(_one_edit(last, False), lambda k: F.concat_ws(" ", first, k))),
        "first_names": only(long, F.array(F.array_join(bare, " "))),
        "rank": only(hon.isNotNull(), F.array(F.concat_ws(" ", hon, last))),
        "address": only(hon.isin(names.NEUTRAL), F.flatten(F.transform(who, lambda w: F.transform(reach, lambda r: F.concat_ws(" ", w, r, last))))),
        "surname_initial": only(given != "", F.array(F.concat_ws(" ", key_fold(given), F.lower(letter)))),
        "word": only(single, F.array(n)), "age": only(single & old, F.array(n)), "first_word": only(single, F.array(n)), "bare_word": only(single, F.array(n)),
        "short": only(single & (F.length(n) >= 3) & ~old, F.array(n)),
        "near": only(single & (F.length(n) >= 5), _one_edit(n, False, inner=True)),
        "part": only(~single, F.array(n)),
        "near_last": only(single & (F.length(n) >= 5) & ~token.rlike(r"(?i)^the\s"), _one_edit(n, False, inner=True)),
    })


def resolved_mentions(mentions: DataFrame, people: DataFrame, scope: str, token: str, at: str, name: str, character: str | None = None) -> DataFrame:
    """(scope, token, character, rule): whom each mention of a scope names, and by which rule; null for nobody or several.

    character: the column of people with the name to report, where a row is another name of somebody. RULES are tried in order
    and the first whose hit is one name alone decides. Equal names, canonical forms, or forms without blanks come first: of
    several, the first by `at`. Then a title completed by "of ..."; initial and surname; nickname; first and last word; a typo
    in the surname and first names alone, unless several have that first and last word; rank, or form of address, and surname;
    first name and an initial; a word that one name has, where "Young ..." is no plain name; a word of age; first words; the
    beginning of a first name or one letter more or less in it, unless a plain name has the word; first or last words of a
    name; one letter more or less in a surname, unless any name has the word. "the" before a mention doesn't count.

    Repeated mentions and names count once; rows without a scope, or with an empty name, take no part. A mention of marks alone
    names nobody. All rules are one exchange of keys and one of mentions: a mention's hits are put in order where they meet.
    """
    told = F.col(character) if character else F.col(name)
    parts = lambda c: names.name_parts(F.col(c)).alias("p")
    cast = people.where(F.col(scope).isNotNull() & (key_fold(F.col(name)) != "")).groupBy(F.col(scope).alias("scope"), F.col(name).alias("name"))
    cast = cast.agg(F.min(F.struct(F.col(at).alias("at"), told.alias("told"))).alias("t")).select("scope", "name", F.struct("t.at", "name", "t.told").alias("t"), parts("name"))
    asked = mentions.where(F.col(scope).isNotNull() & F.col(token).isNotNull()).select(F.col(scope).alias("scope"), F.col(token).alias("token")).distinct()
    asked = asked.withColumn("spelled", F.regexp_replace("token", r"\bMadam\b", "Madame")).select("scope", "token", "spelled", parts("spelled"))
    forms = lambda p: F.array(
        F.concat(F.lit("name:"), F.regexp_replace(p["n"], "^the ", "")), F.concat(F.lit("form:"), p["cn"]), F.concat(F.lit("squashed:"), F.replace(p["cn"], F.lit(" "), F.lit("")))
    )
    p = F.col("p")
    words = _numbered(-1, F.filter(F.array_distinct(p["words"]), lambda w: w != ""))
    offers = F.array_distinct(F.concat(_numbered(0, forms(p)), _offered(F.col("name"), p), words))
    single = F.regexp_replace(p["n"], "^the ", "")
    asks = F.array_distinct(F.concat(_numbered(0, forms(p)), _asked(F.col("spelled"), p), _numbered(-1, F.array(single))))
    behind = cast.select("scope", "t", F.explode(offers).alias("k")).groupBy("scope", "k.rule", "k.key").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    hits = asked.where(single != "").select("scope", "token", F.explode(asks).alias("k")).select("scope", "token", "k.rule", "k.key").join(behind, ["scope", "rule", "key"])
    plain_form = ~F.col("key").startswith("squashed:")
    by_rule = hits.groupBy("scope", "token", "rule").agg(F.coalesce(F.min(F.when(plain_form, F.col("lo"))), F.min("lo")).alias("lo"), F.max("hi").alias("hi"))
    ruled = by_rule.groupBy("scope", "token").agg(
        F.max((F.col("rule") == _NUMBER["first_last"]).cast("int")).alias("full"), F.max((F.col("rule") == _NUMBER["word"]).cast("int")).alias("plain"),
        F.max((F.col("rule") == -1).cast("int")).alias("has"), F.max(F.when(F.col("rule") == -1, F.col("lo") == F.col("hi"))).alias("alone"),
        F.collect_list(F.when((F.col("rule") == 0) | (F.col("rule") > 0) & (F.col("lo") == F.col("hi")), F.struct("rule", "lo"))).alias("ones"),
    )
    number = lambda *rules: [_NUMBER[r] for r in rules]
    many_words = F.col("token").rlike(r"(?i)^\W*the\s") | F.regexp_replace(key_fold(F.col("token")), "^the ", "").contains(" ")
    open_ = (
        lambda h: ~(h["rule"].isin(number("typo", "first_names")) & (F.col("full") == 1))
        & ~(h["rule"].isin(number("short", "near")) & (F.col("plain") == 1)) & ~(h["rule"].isin(number("near", "near_last")) & (F.col("has") == 1))
        & ~((h["rule"] == _NUMBER["title"]) & ~many_words & (F.col("has") == 1) & ~F.col("alone"))
    )
    best = ruled.select("scope", "token", F.array_min(F.filter("ones", open_)).alias("best"))
    rule = F.when(F.col("best").isNotNull(), F.element_at(F.array(*map(F.lit, RULES)), F.col("best.rule") + 1))
    return asked.select("scope", "token").join(best, ["scope", "token"], "left").select("scope", "token", F.col("best.lo.told").alias("character"), rule.alias("rule"))
