"""Queries over casts: a dozen consecutive parts are a show, their names, decorated, its persons and their mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import cast
from tessera.plans.fields import chosen, sql_chosen, sql_key
from tessera.session import table

#: Persons' names and their mentions, with A and B for the words of a part's name; LETTERS are other forms of these words.
PERSONS = [
    "A B", "A", "Dr. A B", "Doctor B", "The A", "A J. B", 'Max "A" B', "Captain B", "Captain Olga B", "Young A", "A B II", "B", "The Great B", "The B of A", "A Quentin B",
    "Mrs. Olga B", "Mr. A", "Prince A Quentin", "Madame B", "AB", "Little B", "Sister A B", "A B's Mother",
]
MENTIONS = [
    "A B", "A", "B", "S. B", "A b", "Mr. B", "Captain B", "Dr. B", "The B", "a", "A Bx", "the A B", "Mrs. A B", "Young", "Madam B", "A Quentin", "Max B", "Madame Olga B",
    "R. B", "b", "aa", "bb", "A Olga B", "Olga", "J. B", "Max", "Little", "!", "L. B", "The aa", "Captain Olga",
]
#: The beginning of the first word, the initial of the last, each with its third letter twice, and a full name's short one.
LETTERS = {"a": "<3>", "b": "<4>", "aa": "<5>", "bb": "<6>", "The aa": "the <5>", "A b": "<1> <4>"}


def _marked(forms: list[str]) -> list[str]:
    return [LETTERS.get(f) or f.replace("A", "<1>").replace("B", "<2>") for f in forms]


def _written(forms: list[str], key: Column) -> Column:
    """A form with its letters filled in. They are capitals and single, so that none stands in another's word."""
    first, last = (F.initcap(F.element_at(F.split("p_name", " "), k)) for k in (1, 2))
    out = chosen(_marked(forms), key)
    twice = lambda x: F.concat(F.substring(x, 1, 3), F.substring(x, 3, 99))
    for sign, value in (("<1>", first), ("<2>", last), ("<3>", F.substring(first, 1, 3)), ("<4>", F.substring(last, 1, 1)), ("<5>", twice(first)), ("<6>", twice(last))):
        out = F.replace(out, F.lit(sign), value)
    return out


def _sql_written(forms: list[str], key: str) -> str:
    first, last = (f"(upper(string_split(p_name, ' ')[{k}][1]) || string_split(p_name, ' ')[{k}][2:])" for k in (1, 2))
    out = sql_chosen(_marked(forms), key)
    twice = lambda x: f"({x}[1:3] || {x}[3:])"
    for sign, value in (("<1>", first), ("<2>", last), ("<3>", f"{first}[1:3]"), ("<4>", f"{last}[1]"), ("<5>", twice(first)), ("<6>", twice(last))):
        out = f"replace({out}, '{sign}', {value})"
    return out


def _cast(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey") + F.floor(F.col("p_partkey") / 12)
    # many rows are a small file, which few tasks would read and write names for; with a number, so that small rows aren't put together
    part = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 12).alias("play"), "p_partkey", "p_name", "p_size")
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "play")
    return part.select("play", "p_partkey", _written(PERSONS, key).alias("name"), _written(MENTIONS, 5 * key + F.col("p_size")).alias("mention"))


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """The name under which each person of a show stands."""
    return cast.merged_variants(_cast(spark, d), "play", "p_partkey", "name").withColumnRenamed("scope", "play")


def resolved_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Whom each mention of a show's list names, and by which rule."""
    people = _cast(spark, d)
    return cast.resolved_mentions(people, people, "play", "mention", "p_partkey", "name").withColumnRenamed("scope", "play")


def _any(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql_canonical(x: str) -> str:
    titles, particles = "|".join(names.TITLES), "|".join(names.PARTICLES)
    return f"""(SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_matches(y, '^({titles}) \\S+ \\S') AND NOT regexp_matches(y, '^({titles}) ({particles}) ')
    THEN regexp_replace(y, '^({titles}) ', '') ELSE y END, '\\bdoctor\\b', 'dr', 'g'), '\\bmister\\b', 'mr', 'g'), '\\bprofessor\\b', 'prof', 'g'), '\\bsaint\\b', 'st', 'g')
    FROM (SELECT regexp_replace(regexp_replace(regexp_replace({sql_key(x)}, '^the ', ''), '\\b(mme|madam)\\b', 'madame', 'g'), '\\bmlle\\b', 'mademoiselle', 'g') AS y))"""


_SHOWS = f"""SELECT p_partkey // 12 AS play, p_partkey, {_sql_written(PERSONS, "(p_partkey + p_partkey // 12)")} AS name,
  {_sql_written(MENTIONS, "(5 * (p_partkey + p_partkey // 12) + p_size)")} AS mention FROM part"""
_QUOTED = "regexp_extract(name, '\"([^\"]+)\"', 1)"

#: Every pair of names is compared by the rules as they are told; chains are walked.
NAME_VARIANTS = f"""
WITH RECURSIVE s AS ({_SHOWS}),
n AS (SELECT play, name, min(p_partkey) AS pos, {sql_key("name")} AS k, string_split({sql_key("name")}, ' ') AS rw, {_sql_canonical("name")} AS cn,
  string_split({_sql_canonical("name")}, ' ') AS cw, {sql_key(_QUOTED)} AS nick FROM s GROUP BY play, name),
e AS (SELECT c.play, c.name, max(d.name) AS target FROM n c JOIN n d ON c.play = d.play AND c.name <> d.name WHERE
  (len(c.rw) = 2 AND c.rw[1] IN {_any(names.HONORIFICS)} AND len(d.rw) > 2 AND d.rw[1] = c.rw[1] AND d.rw[-1] = c.rw[2])
  OR (d.nick <> '' AND c.k IN (d.nick, d.nick || ' ' || d.rw[-1]) AND c.k <> d.k)
  OR (len(c.rw) = 1 AND len(d.rw) = 3 AND d.rw[1] = 'the' AND d.rw[2] IN {_any(names.EPITHETS)} AND d.rw[3] = c.rw[1])
  OR (len(d.cw) > len(c.cw) AND c.cw[1] = d.cw[1] AND NOT (starts_with(d.cn, c.cn || ' ') AND len(list_filter(d.cw[len(c.cw) + 1:], lambda w: NOT regexp_full_match(w, '{names.NUMERAL}'))) = 0)
    AND (starts_with(d.cn, c.cn || ' ') OR len(c.cw) >= 2 AND c.cw[-1] = d.cw[-1]))
  GROUP BY 1, 2 HAVING count(DISTINCT d.name) = 1),
w AS (SELECT play, name, name AS root, 0 AS i FROM n UNION ALL SELECT w.play, w.name, e.target, i + 1 FROM w JOIN e ON e.play = w.play AND e.name = w.root WHERE i < 20),
r AS (SELECT play, name, arg_max(root, i) AS root FROM w GROUP BY 1, 2),
h AS (SELECT play, name AS root, first_value(name) OVER (PARTITION BY play, replace(cn, ' ', '') ORDER BY pos) AS canonical FROM n ANTI JOIN e USING (play, name))
SELECT r.play, name, canonical FROM r JOIN h ON h.play = r.play AND h.root = r.root"""


def _near(a: str, b: str) -> str:
    """One letter more or less, neither the first nor one of the last."""
    short, long = f"CASE WHEN length({a}) < length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) < length({b}) THEN {b} ELSE {a} END"
    return f"""(abs(length({a}) - length({b})) = 1 AND (SELECT i > 1 AND i < length(s) AND s[i:] = l[i + 1:] FROM (SELECT s, l, coalesce(list_min(list_filter(range(1, length(s) + 1), lambda j: s[j] <> l[j])), length(s) + 1) AS i
    FROM (SELECT {short} AS s, {long} AS l))))"""


def _resolved() -> str:
    """Every mention is held against every name of its play, a rule at a time."""
    core = lambda x: f"list_filter(string_split(regexp_replace({sql_key(f'''regexp_replace(regexp_replace({x}, '\"[^\"]*\"', ' ', 'g'), '\\b[A-Z]\\.\\s', '  ', 'g')''')}, '^the ', ''), ' '), lambda w: w <> '')"
    parts = lambda x: f"""{sql_key(x)} AS n, string_split({sql_key(x)}, ' ') AS ws, {_sql_canonical(x)} AS cn, {core(x)} AS core"""
    titled = f"len(core) > 1 AND core[1] IN {_any(names.HONORIFICS)}"
    male, female = _any(names.MALE), _any(names.FEMALE)
    fits = f"(c.hon IS NULL OR c.hon = t.hon OR (t.hon IN {male} AND c.hon NOT IN {female}) OR (t.hon IN {female} AND c.hon NOT IN {male}))"
    same_last = "c.bare[-1] = t.bare[-1]"
    has = "list_contains(c.single, t.u)"
    one = "NOT contains(t.u, ' ')"
    rules = {
        "title": "starts_with(c.u, t.u || ' of ')",
        "initial": "t.ini <> '' AND starts_with(c.ws[1], lower(t.ini)) AND ends_with(c.n, ' ' || t.rest)",
        "nickname": "c.quick <> '' AND c.quick = t.quick",
        "first_last": f"len(t.bare) >= 2 AND len(c.bare) >= 2 AND {same_last} AND (c.bare[1] = t.bare[1] OR (c.nick <> '' AND c.nick = t.bare[1]))",
        "typo": "len(t.bare) >= 2 AND len(c.bare) >= 2 AND c.bare[1] = t.bare[1] AND length(t.bare[-1]) >= 5 AND c.bare[-1] <> t.bare[-1] AND levenshtein(c.bare[-1], t.bare[-1]) = 1",
        "first_names": "len(t.bare) >= 2 AND NOT c.aged AND len(c.bare) > len(t.bare) AND c.bare[:len(t.bare)] = t.bare",
        "rank": f"NOT c.aged AND c.hon = t.hon AND {same_last}",
        "address": f"t.hon IN {_any(names.NEUTRAL)} AND NOT c.aged AND {same_last} AND {fits} AND (len(t.bare) = 1 OR len(c.bare) = 1 OR c.bare[1] = t.bare[1])",
        "surname_initial": "t.given <> '' AND len(c.bare) >= 2 AND c.bare[1] = lower(t.given) AND starts_with(c.bare[-1], lower(t.letter))",
        "word": f"{one} AND {has} AND NOT c.aged",
        "age": f"{one} AND {has} AND t.u IN {_any(names.AGES)} AND c.ws[1] = t.u",
        "first_word": f"{one} AND {has} AND NOT c.aged AND c.ws[1] = t.u",
        "bare_word": f"{one} AND {has} AND NOT c.aged AND c.bare[1] = t.u",
        "short": f"{one} AND length(t.u) >= 3 AND t.u NOT IN {_any(names.AGES)} AND NOT c.aged AND length(c.bare[1]) > length(t.u) + 1 AND starts_with(c.bare[1], t.u) AND NOT regexp_matches(c.name, '(?i)[''’]s\\b')",
        "near": f"{one} AND length(t.u) >= 5 AND NOT c.aged AND {_near('c.bare[1]', 't.u')}",
        "part": "contains(t.u, ' ') AND (starts_with(c.n, t.u || ' ') OR ends_with(c.n, ' ' || t.u))",
        "near_last": f"{one} AND length(t.u) >= 5 AND NOT regexp_matches(t.name, '(?i)^the\\s') AND NOT c.aged AND len(c.bare) >= 2 AND {_near('c.bare[-1]', 't.u')}",
    }
    tally = ", ".join(f"count(*) FILTER ({test}) AS n_{rule}, min(c.name) FILTER ({test}) AS who_{rule}" for rule, test in rules.items())
    blocks = {"typo": "n_first_last = 0", "first_names": "n_first_last = 0", "short": "n_word = 0", "near": "n_word = 0 AND n_has = 0", "near_last": "n_has = 0",
              "title": "(several OR n_has = 0 OR n_has = 1)"}
    steps = " ".join(f"WHEN n_{r} = 1 AND {blocks.get(r, 'true')} THEN {{'character': who_{r}, 'rule': '{r}'}}" for r in rules)
    return f"""
WITH s AS ({_SHOWS}),
c0 AS (SELECT play, name, min(p_partkey) AS pos, {parts("name")}, {sql_key(_QUOTED)} AS nick, lower(regexp_replace({_QUOTED}, '[^A-Za-z0-9_]', '', 'g')) AS quick,
  list_transform(regexp_extract_all(name, '([A-Za-z0-9]+)(?:''s|s''|'')(?:\\s|$)', 1), lambda w: lower(w)) AS owned FROM s GROUP BY play, name),
c AS (SELECT *, regexp_replace(n, '^the ', '') AS u, CASE WHEN {titled} THEN core[1] END AS hon, CASE WHEN {titled} THEN core[2:] ELSE core END AS bare, ws[1] IN {_any(names.AGES)} AS aged,
  list_filter(ws, lambda w: w NOT IN {_any(names.NAMELESS)} AND NOT list_contains(owned, w) AND NOT list_contains(list_transform(owned, lambda o: o || 's'), w)) AS single FROM c0),
t0 AS (SELECT DISTINCT play, mention, regexp_replace(mention, '\\bMadam\\b', 'Madame') AS name FROM s),
t1 AS (SELECT play, mention, name, {parts("name")} FROM t0),
t AS (SELECT *, regexp_replace(n, '^the ', '') AS u, CASE WHEN {titled} THEN core[1] END AS hon, CASE WHEN {titled} THEN core[2:] ELSE core END AS bare,
  lower(regexp_replace(name, '[^A-Za-z0-9_]', '', 'g')) AS quick, regexp_extract(name, '^([A-Z])\\.\\s*(\\S.*)$', 1) AS ini, {sql_key("regexp_extract(name, '^([A-Z])\\.\\s*(\\S.*)$', 2)")} AS rest,
  regexp_extract(name, '^([A-Z][A-Za-z''-]+)\\s+([A-Z])\\.?$', 1) AS given, regexp_extract(name, '^([A-Z][A-Za-z''-]+)\\s+([A-Z])\\.?$', 2) AS letter FROM t1),
g AS (SELECT t.play, t.mention, bool_or(contains(t.u, ' ') OR regexp_matches(t.mention, '(?i)^[^A-Za-z0-9_]*the\\s')) AS several,
  arg_min(c.name, c.pos) FILTER (t.u <> '' AND (c.u = t.u OR c.cn = t.cn)) AS same, arg_min(c.name, c.pos) FILTER (t.u <> '' AND replace(c.cn, ' ', '') = replace(t.cn, ' ', '')) AS squashed,
  count(*) FILTER (list_contains(c.ws, t.u)) AS n_has, {tally} FROM t LEFT JOIN c ON c.play = t.play AND t.u <> '' GROUP BY 1, 2),
r AS (SELECT play, mention, CASE WHEN coalesce(same, squashed) IS NOT NULL THEN {{'character': coalesce(same, squashed), 'rule': 'exact'}} {steps} END AS hit FROM g)
SELECT play, mention AS token, hit.character AS character, hit.rule AS rule FROM r"""


RESOLVED_MENTIONS = _resolved()

QUERIES = {"name_variants": (name_variants, NAME_VARIANTS), "resolved_mentions": (resolved_mentions, RESOLVED_MENTIONS)}
