"""Queries of albums, submitted rows and suggested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import albums, labels
from tessera.functions.text import match_key
from tessera.operators import lists, suggest, validate
from tessera.plans.fields import chosen, sql_chosen
from tessera.session import table

#: Album and artist, {} for a part's name, with the tier and rank expected where its show's films are not wanted.
ALBUMS = [
    ("{} (Original Broadway Cast Recording)", "", 100, 110), ("The {}: Original London Cast", "", 100, 100), ("{} (Original Cast Recording) [Live]", "", 90, 90),
    ("{} (Highlights from the Original Cast Recording)", "", 100, 92), ("{} (2012 Broadway Revival Cast) - Single", "", 88, 68), ("{} in Concert", "", 72, 72),
    ("{} (Studio Cast Recording)", "", 82, 82), ("{} (Motion Picture Soundtrack)", "", None, None), ("{} The Musical", "Company", 60, 60), ("{} - New Songs", "Somebody", None, None),
    ("{} (Karaoke Cast Recording)", "", None, None), ("{} (Cast Recording)", "The Piano Guys", None, None), ("{} (Wiener Besetzung, Cast Recording)", "", None, None),
    ("Somebody's {} (Cast Recording)", "", 88, 88), ("Disneys the {} (Cast Album)", "", 88, 88), ("New {} (Cast Album)", "", None, None), ("Other Show (Original Cast Recording)", "", None, None),
    ("{} (World Premiere Recording) EP", "", 82, 62), ("", "", None, None), ("{} (Highlights)", "", 60, 52), ("{}: A New Musical (Cast Recording)", "Company", 88, 88),
]


def album_classes(spark: SparkSession, d: str) -> DataFrame:
    """Which albums are recordings of the show that a part's name is, their tier and rank; Broadway's original is preferred."""
    k = F.col("p_partkey")
    name, artist = F.replace(chosen([a[0] for a in ALBUMS], k), F.lit("{}"), F.initcap("p_name")), chosen([a[1] for a in ALBUMS], k)
    found = albums.classified(name, artist, F.array(match_key(F.col("p_name"))), prefer={r"\boriginal broadway\b": 10})
    return table(spark, d, "part").select("p_partkey", albums.unwanted(name, artist).alias("unwanted"), found["tier"].alias("tier"), found["rank"].alias("rank"))


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) for v in values) + "]"


ALBUM_CLASSES = f"""SELECT p_partkey, p_partkey % {len(ALBUMS)} IN (10, 11, 12) AS unwanted, CAST({_listed([a[2] for a in ALBUMS])}[p_partkey % {len(ALBUMS)} + 1] AS INT) AS tier,
  CAST({_listed([a[3] for a in ALBUMS])}[p_partkey % {len(ALBUMS)} + 1] AS INT) AS rank FROM part"""

KINDS = ["solo", " Duet", "trio", "", "SOLO"]
LENGTHS = ["3:25", "61:00", "325", "", "0:00", "59:59", "3:5"]
FLAGS = ["yes", "0", "", "maybe", "TRUE"]
NUMBERS = ["12", "-1", "1.5", "", "9999999999999999999999", "twelve"]
LINKS = ["https://a.example.org/x?y#z", "http://a.example.org/", "https://example.org", "https://evil.com/example.org", "", "https://user@example.org/", "https://exa mple.org/", "https://notexample.org"]


def _submissions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows that were typed in: some fields good, some wrong, some empty."""
    k = F.col("p_partkey")
    title = F.when(k % 11 == 0, F.lit(" \t ")).when(k % 11 == 1, F.repeat("p_name", 20)).otherwise(F.concat(F.lit("  "), "p_name", F.lit("  ​ x ")))
    notes = F.when(k % 6 == 0, F.concat("p_name", F.lit(" \r\n\n\n\n end"))).when(k % 6 == 1, F.lit("\n"))
    return table(spark, d, "part").select(
        "p_partkey", title.alias("title"), chosen(KINDS, k).alias("kind"), chosen(LENGTHS, k).alias("length"), chosen(FLAGS, F.col("p_size")).alias("mature"),
        chosen(NUMBERS, F.col("p_size")).alias("year"), chosen(LINKS, k).alias("link"), notes.alias("notes"), (k % 4).alias("n_parts"),
        F.when(k % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("genre"),
    )


def validated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each row's clean fields, and what is wrong with each."""
    c = F.col
    fields = [
        validate.text("title", c("title"), "Title", required=True, most=120), validate.one_of("kind", c("kind"), "Kind", ["solo", "duet"], required=True),
        validate.length("length", c("length"), "Length"), validate.flag("mature", c("mature"), "Mature content"), validate.integer("year", c("year"), "Year", 0, 3000),
        validate.https_url("link", c("link"), "Link", ["example.org"]), validate.text("notes", c("notes"), "Notes", most=2000, lines=True),
        validate.rule("parts", (F.lower(F.trim("kind")) == "solo") & (c("n_parts") != 1), "A solo needs exactly 1 part"),
        validate.rule("parts", (F.lower(F.trim("kind")) == "duet") & (c("n_parts") != 2), "A duet needs exactly 2 parts"),
    ]
    made = validate.validated(validate.first_spelling(_submissions(spark, d), "genre", "p_partkey"), fields, ["p_partkey", "genre"])
    told = F.transform(F.array_sort(F.map_keys("errors")), lambda e: F.concat(e, F.lit(": "), F.col("errors")[e]))
    return made.withColumn("errors", F.array_join(told, "; "))


def _validated_sql() -> str:
    pick = lambda values, key: sql_chosen(values, key)
    errors = {
        "kind": "CASE p_partkey % 5 WHEN 2 THEN 'Kind must be one of: solo, duet' WHEN 3 THEN 'Kind is required' END",
        "length": "CASE p_partkey % 7 WHEN 1 THEN 'Length must be between 0:01 and 59:59' WHEN 2 THEN 'Length must look like m:ss (e.g. 3:25)' WHEN 4 THEN 'Length must be between 0:01 and 59:59' WHEN 6 THEN 'Length must look like m:ss (e.g. 3:25)' END",
        "link": "CASE p_partkey % 8 WHEN 1 THEN 'Link must be a full https:// address' WHEN 3 THEN 'Link must be of example.org' WHEN 5 THEN 'Link must be a full https:// address' WHEN 6 THEN 'Link must be a full https:// address' WHEN 7 THEN 'Link must be of example.org' END",
        "mature": "CASE WHEN p_size % 5 = 3 THEN 'Mature content must be yes or no' END",
        "parts": "CASE WHEN p_partkey % 5 IN (0, 4) AND p_partkey % 4 <> 1 THEN 'A solo needs exactly 1 part' WHEN p_partkey % 5 = 1 AND p_partkey % 4 <> 2 THEN 'A duet needs exactly 2 parts' END",
        "title": "CASE p_partkey % 11 WHEN 0 THEN 'Title is required' WHEN 1 THEN CASE WHEN length(p_name) * 20 > 120 THEN 'Title must be at most 120 characters' END END",
        "year": "CASE p_size % 6 WHEN 1 THEN 'Year must be between 0 and 3000' WHEN 2 THEN 'Year must be a whole number' WHEN 4 THEN 'Year must be between 0 and 3000' WHEN 5 THEN 'Year must be a whole number' END",
    }
    told = ", ".join(f"'{name}: ' || ({error})" for name, error in errors.items())
    length = "CASE WHEN p_partkey % 7 = 1 THEN NULL ELSE [205, NULL, NULL, NULL, NULL, 3599, NULL][p_partkey % 7 + 1] END"
    return f"""
WITH g AS (SELECT lower(p_type) AS f, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END, p_partkey) AS genre FROM part GROUP BY 1)
SELECT p_partkey, genre, CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN repeat(p_name, 20) ELSE p_name || ' x' END AS title, ['solo', 'duet', NULL, NULL, 'solo'][p_partkey % 5 + 1] AS kind,
  CAST({length} AS INT) AS length, [true, false, false, false, true][p_size % 5 + 1] AS mature, CASE WHEN p_size % 6 = 0 THEN 12::BIGINT END AS year,
  CASE WHEN p_partkey % 8 IN (0, 2) THEN {pick(LINKS, "p_partkey")} END AS link, CASE WHEN p_partkey % 6 = 0 THEN p_name || chr(10) || chr(10) || 'end' END AS notes, concat_ws('; ', {told}) AS errors
FROM part JOIN g ON f = lower(p_type)"""


VALIDATED = _validated_sql()


def suggested_types(spark: SparkSession, d: str) -> DataFrame:
    """For each part, the type that its brand's other parts of a size have most, else what its name stands for."""
    part = table(spark, d, "part").withColumn("shelf", F.concat_ws("/", "p_brand", "p_size"))
    found = suggest.voted(part, "p_partkey", "shelf", "p_type", "p_partkey", [("bolt|gear", "SMALL"), ("red|ring", "PROMO"), ("ring", "LARGE")], "p_name")
    s = F.col("suggestion")
    return found.select("p_partkey", s["value"].alias("value"), s["confidence"].alias("confidence"), F.array_join(s["alternatives"], "|").alias("alternatives"), s["note"].alias("note"))


SUGGESTED = """
WITH v AS (SELECT a.p_partkey, b.p_type AS value, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY 1, 2),
f AS (SELECT a.p_partkey, b.p_type AS value, min(b.p_partkey) AS seen FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size GROUP BY 1, 2),
o AS (SELECT p_partkey, list(value ORDER BY n DESC, seen) AS vs, max(n) AS most, sum(n)::BIGINT AS total FROM v JOIN f USING (p_partkey, value) GROUP BY 1),
w AS (SELECT p_partkey, list_distinct(list_filter([CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'SMALL' END, CASE WHEN regexp_matches(p_name, 'red|ring') THEN 'PROMO' END, CASE WHEN regexp_matches(p_name, 'ring') THEN 'LARGE' END], lambda x: x IS NOT NULL)) AS ws,
  list_filter([CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'SMALL' END, CASE WHEN regexp_matches(p_name, 'red|ring') THEN 'PROMO' END, CASE WHEN regexp_matches(p_name, 'ring') THEN 'LARGE' END], lambda x: x IS NOT NULL) AS hits FROM part)
SELECT p_partkey, coalesce(vs[1], hits[1]) AS value, CASE WHEN vs IS NOT NULL THEN 'medium' WHEN len(hits) > 0 THEN 'low' END AS confidence,
  CASE WHEN vs IS NOT NULL THEN array_to_string(vs[2:], '|') WHEN len(hits) > 0 THEN array_to_string(hits[2:], '|') END AS alternatives,
  CASE WHEN len(vs) > 1 THEN most || ' of ' || total || ' say ' || vs[1] END AS note FROM w LEFT JOIN o USING (p_partkey)"""


def suggested_flags(spark: SparkSession, d: str) -> DataFrame:
    """For each part, whether most others of its brand and type are large."""
    part = table(spark, d, "part").withColumn("shelf", F.concat_ws("/", "p_brand", "p_type")).withColumn("large", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") > 25))
    s = F.col("suggestion")
    return suggest.flagged(part, "p_partkey", "shelf", "large").select("p_partkey", s["value"].alias("value"), s["disputed"].alias("disputed"), s["note"].alias("note"))


SUGGESTED_FLAGS = """
WITH p AS (SELECT p_partkey, p_brand || '/' || p_type AS shelf, CASE WHEN p_partkey % 9 <> 0 THEN p_size > 25 END AS large FROM part),
c AS (SELECT a.p_partkey, count(b.large) FILTER (b.large) AS yes, count(b.large) AS n FROM p a LEFT JOIN p b ON a.shelf = b.shelf AND a.p_partkey <> b.p_partkey GROUP BY 1)
SELECT p_partkey, CASE WHEN n > 0 THEN yes > 0 AND yes >= n - yes END AS value, CASE WHEN n > 0 THEN yes > 0 AND yes < n END AS disputed,
  CASE WHEN yes > 0 AND yes < n THEN CASE WHEN yes >= n - yes THEN yes || ' of ' || n || ' are' ELSE (n - yes) || ' of ' || n || ' are not' END END AS note FROM c"""

PEOPLE = ["Ann Lee", " ann lee ", "Bo", "", "Cy X", None]


def label_fields(spark: SparkSession, d: str) -> DataFrame:
    """What parts are shown as: initials, cut names, merged credits, keys, labels, and a draw by their key."""
    k, who = F.col("p_partkey"), F.array(*map(F.lit, PEOPLE))
    by = lambda n: F.element_at(who, (F.floor(k / n) % 6 + 1).cast("int"))
    title = F.concat(F.lit("The "), F.initcap("p_name"), F.lit(" [x] – From the Film"))
    credits = F.transform(labels.credit_lines(by(1), by(6), by(36)), lambda c: F.concat(c["role"], F.lit(": "), c["who"]))
    return table(spark, d, "part").select(
        "p_partkey", labels.initials(title).alias("initials"), labels.capped(F.concat("p_name", F.lit(" and more")), 14).alias("capped"), labels.core_title(title).alias("core"),
        labels.contains_words(labels.core_title(title), F.element_at(F.split("p_name", " "), 2)).alias("holds"), labels.song_key(F.concat(F.upper("p_name"), F.lit("'s!")), k % 2 == 0).alias("key"),
        F.array_join(credits, "; ").alias("credits"), labels.score_label((k % 101).cast("int")).alias("label"), labels.seeded_draw(k * 7_919, 3).alias("draw"),
    )


def _people(n: int) -> str:
    return "[" + ", ".join("NULL" if p is None else f"'{p}'" for p in PEOPLE) + f"][(p_partkey // {n}) % 6 + 1]"


LABEL_FIELDS = f"""
WITH p AS (SELECT *, nullif(trim({_people(1)}), '') AS m, nullif(trim({_people(6)}), '') AS y, nullif(trim({_people(36)}), '') AS b,
  (p_partkey * 7919 + 5494697439 % 4294967296) % 4294967296 AS a FROM part),
i AS (SELECT *, (xor(a, a >> 15)::HUGEINT * (a | 1)::HUGEINT % 4294967296)::BIGINT AS t FROM p),
j AS (SELECT *, xor(t, ((t + (xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT % 4294967296)::BIGINT) % 4294967296)) AS u FROM i)
SELECT p_partkey, upper(string_split(p_name, ' ')[1][1]) || upper(string_split(p_name, ' ')[2][1]) AS initials,
  CASE WHEN length(p_name) + 9 > 14 THEN rtrim(substr(p_name || ' and more', 1, 13)) || '…' ELSE p_name || ' and more' END AS capped, 'the ' || p_name AS core, true AS holds,
  p_name || 's|' || (p_partkey % 2 = 0)::INT AS key,
  CASE WHEN m IS NOT NULL AND lower(m) = lower(y) AND lower(m) = lower(b) THEN 'Music, lyrics & book: ' || m
    WHEN m IS NOT NULL AND lower(m) = lower(y) THEN concat_ws('; ', 'Music & lyrics: ' || m, 'Book: ' || b)
    WHEN lower(b) = lower(y) THEN concat_ws('; ', 'Music: ' || m, 'Lyrics & book: ' || b) ELSE concat_ws('; ', 'Music: ' || m, 'Lyrics: ' || y, 'Book: ' || b) END AS credits,
  CASE WHEN p_partkey % 101 >= 85 THEN 'Great match' WHEN p_partkey % 101 >= 70 THEN 'Likely match' ELSE 'Maybe' END AS label, xor(u, u >> 14) / 4294967296.0::DOUBLE AS draw FROM j"""


def album_songs(spark: SparkSession, d: str) -> DataFrame:
    """Songs of albums, which are a brand's parts of a size: no explicit tracks, none twice, none that is known."""
    k = F.col("p_partkey")
    note = chosen(["", " (Original Cast Recording)", " - Live", " (Reprise)", " (feat. X)", " Overture"], k)
    tracks = table(spark, d, "part").select(
        "p_brand", "p_partkey", F.when(k % 13 == 0, F.lit(" (Live Version)")).otherwise(F.concat(F.initcap("p_name"), note)).alias("track"), (F.col("p_size") % 9 == 0).alias("explicit")
    )
    known = table(spark, d, "part").where("p_size = 1").select("p_brand", F.concat("p_name", F.lit("|0")).alias("key"))
    return lists.songs_of_tracks(tracks, "p_brand", "p_partkey", "track", "explicit", known)


ALBUM_SONGS = """
WITH t AS (SELECT p_brand, p_partkey, p_name, p_partkey % 6 AS f, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS cap FROM part WHERE p_size % 9 <> 0 AND p_partkey % 13 <> 0),
k AS (SELECT *, p_name || CASE f WHEN 3 THEN '|1' WHEN 5 THEN ' overture|0' ELSE '|0' END AS key FROM t),
n AS (SELECT DISTINCT p_brand, p_name || '|0' AS key FROM part WHERE p_size = 1),
f AS (SELECT * FROM k ANTI JOIN n USING (p_brand, key) QUALIFY row_number() OVER (PARTITION BY p_brand, key ORDER BY p_partkey) = 1)
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS place, cap || CASE f WHEN 3 THEN ' (Reprise)' WHEN 5 THEN ' Overture' ELSE '' END AS title, f = 3 AS reprise, f = 5 AS instrumental
FROM f QUALIFY place <= 60"""

QUERIES = {
    "label_fields": (label_fields, LABEL_FIELDS), "album_songs": (album_songs, ALBUM_SONGS),
    "album_classes": (album_classes, ALBUM_CLASSES), "validated_rows": (validated_rows, VALIDATED), "suggested_types": (suggested_types, SUGGESTED),
    "suggested_flags": (suggested_flags, SUGGESTED_FLAGS),
}
