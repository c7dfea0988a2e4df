"""Queries of text, date and number functions, each over a whole table with decorated values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar, text, titles
from tessera.session import table


def chosen(values: list[str], key: Column) -> Column:
    """One of the values, by the key."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def sql_chosen(values: list[str], key: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[{key} % {len(values)} + 1]"


def sql_key(x: str) -> str:
    """key_fold and match_fold of ASCII texts."""
    return f"trim(regexp_replace(regexp_replace(replace(lower({x}), '&', ' and '), '[''`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def sql_match_key(x: str) -> str:
    return f"regexp_replace({sql_key(x)}, '^(the|a|an) ', '')"


def length_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lengths written and read in every form, their status against the limits, and bounds."""
    part = table(spark, d, "part")
    s = ((F.col("p_size") * 13 + F.col("p_partkey")) % 4_000).cast("int")
    written = F.when(F.col("p_partkey") % 4 == 0, s.cast("string")).otherwise(scalar.seconds_to_length(s))
    sheet = F.when(F.col("p_partkey") % 3 == 0, F.concat(scalar.seconds_to_length(s % 1_400), F.lit(":00"))).otherwise(scalar.seconds_to_length(s % 1_400))
    return part.select(
        "p_partkey", written.alias("written"), scalar.parse_length(written).alias("seconds"), scalar.sheet_seconds(sheet).alias("sheet"), scalar.spoken_length(s).alias("spoken"),
        scalar.time_status(s % 500).alias("status"), scalar.clamp_seconds(s % 500).alias("bound"), scalar.in_range((s - 100).cast("string"), 0, 3_000).alias("in_range"),
        scalar.half_up(s / 7).cast("long").alias("rounded"),
    )


LENGTHS = """
WITH p AS (SELECT p_partkey, CAST((p_size * 13 + p_partkey) % 4000 AS INT) AS s FROM part),
w AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN s::VARCHAR ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS written FROM p)
SELECT p_partkey, written,
  CAST(CASE WHEN regexp_matches(written, '^\\d{1,2}:[0-5]\\d$|^\\d{1,4}$') AND s BETWEEN 1 AND 3599 THEN s END AS INT) AS seconds, CAST(s % 1400 AS INT) AS sheet,
  concat_ws(' ', CASE WHEN s >= 60 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END END,
    CASE WHEN s % 60 > 0 OR s < 60 THEN (s % 60) || ' second' || CASE WHEN s % 60 = 1 THEN '' ELSE 's' END END) AS spoken,
  CASE WHEN s % 500 > 360 THEN 'over' WHEN s % 500 > 330 THEN 'close' ELSE 'ok' END AS status, CAST(CASE WHEN s % 500 < 420 THEN greatest(s % 500, 60) END AS INT) AS bound,
  CAST(CASE WHEN s - 100 BETWEEN 0 AND 3000 THEN s - 100 END AS INT) AS in_range, CAST(floor(s / 7 + 0.5) AS BIGINT) AS rounded FROM w""".replace("\\\\", "\\")


def relative_times(spark: SparkSession, d: str) -> DataFrame:
    """How long ago events were, at a moment before the last of them, and the time that is left until others."""
    events = table(spark, d, "events")
    now = F.to_timestamp(F.lit("2024-01-20 12:00:00"))
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    left = scalar.countdown(ts, now)
    return events.select("event_id", scalar.relative_time(ts, now).alias("ago"), left["days"].alias("days"), left["hours"].alias("hours"), left["minutes"].alias("minutes"), left["past"].alias("past"))


RELATIVE = """
WITH e AS (SELECT event_id, date_trunc('second', ts) AS t, CAST(epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) AS s FROM events),
u AS (SELECT *, CAST(floor(s / 60 + 0.5) AS BIGINT) AS m, CAST(floor(s / 3600 + 0.5) AS BIGINT) AS h, CAST(floor(s / 86400) AS BIGINT) AS dd, greatest(-s, 0) AS r FROM e)
SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN s < 3600 THEN CASE WHEN m >= 60 THEN '1 hour ago' ELSE greatest(m, 1) || ' min ago' END
  WHEN s < 86400 THEN CASE WHEN h >= 24 THEN 'yesterday' ELSE h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' END WHEN dd = 1 THEN 'yesterday' WHEN dd < 7 THEN dd || ' days ago'
  WHEN dd < 30 THEN (dd // 7) || ' week' || CASE WHEN dd // 7 = 1 THEN '' ELSE 's' END || ' ago' ELSE strftime(t, '%b %-d, %Y') END AS ago,
  CAST(r // 86400 AS BIGINT) AS days, CAST(r % 86400 // 3600 AS BIGINT) AS hours, CAST(r % 3600 // 60 AS BIGINT) AS minutes, s >= 0 AS past FROM u"""


def date_fields(spark: SparkSession, d: str) -> DataFrame:
    """Ranges from an order's day to its last line's, written; years, and which written days are real."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.max("l_shipdate")).alias("end"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left").withColumn("start", F.to_date("o_orderdate"))
    odd = F.concat(F.year("start").cast("string"), F.lit("-02-"), F.lpad((F.col("o_orderkey") % 4 + 27).cast("string"), 2, "0"))
    return o.select("o_orderkey", scalar.date_range(F.col("start"), F.col("end")).alias("days"), scalar.year_of(F.col("start").cast("string")).alias("year"), scalar.real_date(odd).alias("real"), odd.alias("said"))


DATES = """
WITH l AS (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS f FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, coalesce(f, CAST(o_orderdate AS DATE)) AS e FROM orders LEFT JOIN l ON o_orderkey = l_orderkey),
x AS (SELECT *, year(s) || '-02-' || lpad((o_orderkey % 4 + 27)::VARCHAR, 2, '0') AS said FROM o)
SELECT o_orderkey, CASE WHEN s = e THEN strftime(s, '%b %-d, %Y') WHEN year(s) = year(e) AND month(s) = month(e) THEN strftime(s, '%b %-d') || '–' || strftime(e, '%-d, %Y')
  WHEN year(s) = year(e) THEN strftime(s, '%b %-d') || ' – ' || strftime(e, '%b %-d, %Y') ELSE strftime(s, '%b %-d, %Y') || ' – ' || strftime(e, '%b %-d, %Y') END AS days,
  CAST(year(s) AS INT) AS year, TRY_CAST(said AS DATE) AS real, said FROM x"""

DECORATIONS = [
    "", " (Reprise)", " (Reprise 2)", " - Live at Home", " (Original Broadway Cast Recording)", " reprise iii", " The Musical", "!", " (Part II)", " [2011 Remaster]", " - Remastered 2009",
]
HEADS = ["The ", "", "A ", ""]


def title_fields(spark: SparkSession, d: str) -> DataFrame:
    """Decorated part names: their reprise number, name keys, search term and clean forms."""
    part = table(spark, d, "part").withColumn("title", F.concat(chosen(HEADS, F.col("p_partkey")), F.initcap("p_name"), chosen(DECORATIONS, F.col("p_partkey"))))
    flag, t = F.col("p_size") % 10 == 0, F.col("title")
    return part.select(
        "p_partkey", "title", titles.reprise_number(t, flag).cast("int").alias("reprise_no"), F.array_join(titles.show_name_keys(t), "|").alias("name_keys"),
        F.array_join(titles.significant_words(t), " ").alias("significant"), titles.search_term(t, F.concat(F.lit("The "), "p_brand", F.lit("!"))).alias("term"),
        titles.clean_track_title(t).alias("clean"), titles.recording_title(t, flag).alias("recording"),
    )


TITLE_FIELDS = rf"""
WITH p AS (SELECT p_partkey, p_brand, p_size % 10 = 0 AS flag, {sql_chosen(HEADS, "p_partkey")} || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
  || {sql_chosen(DECORATIONS, "p_partkey")} AS title FROM part),
k AS (SELECT *, {sql_match_key("title")} AS mk, {sql_key("title")} AS fk, lower(regexp_extract(title, '{titles.REPRISE_NUMBER}', 1)) AS said FROM p)
SELECT p_partkey, title, CAST(CASE WHEN NOT flag AND NOT regexp_matches(title, '{titles.REPRISE}') THEN 0 WHEN said = '' THEN 1 ELSE coalesce(TRY_CAST(said AS INT), CASE said WHEN 'iii' THEN 3 ELSE 1 END) END AS INT) AS reprise_no,
  array_to_string(list_distinct([mk, trim(regexp_replace(mk, ' (the |a new |the new |the broadway )?musical$', ''))]), '|') AS name_keys,
  array_to_string(list_filter(string_split(fk, ' '), lambda w: w NOT IN ('the', 'a', 'an', 'of', 'and', 'to', 'in', 'on', 'for', 'at', 'with')), ' ') AS significant,
  trim(trim(regexp_replace(regexp_replace(title, '\([^)]*\)', ' ', 'g'), '\s+', ' ', 'g')) || ' ' || p_brand) AS term,
  regexp_replace(title, ' (- Live at Home|- Remastered 2009|\(Original Broadway Cast Recording\)|\[2011 Remaster\])$', '') AS clean,
  CASE WHEN flag AND NOT regexp_matches(title, '{titles.REPRISE}') THEN title || ' (Reprise)' ELSE title END AS recording FROM k""".replace("list_distinct([mk, ", "list_filter([mk, ").replace(
    "musical$', ''))]), '|') AS name_keys", "musical$', ''))], lambda x, i: i = 1 OR x <> mk), '|') AS name_keys"
)

PEOPLE = ["Ann Lee, Bo Marchetti", "Cy Coleman & Dorothy Fields", "Ed Ito; Flo Grunwald/Gus Hill", "Hal and Ivy Newman with Jo Ba", "Kim Oz"]


def credit_fields(spark: SparkSession, d: str) -> DataFrame:
    """Credit lines of parts: surnames, joined lists, addresses, slugs and keys."""
    part = table(spark, d, "part").withColumn("credit", chosen(PEOPLE, F.col("p_partkey"))).withColumn("names", F.split("credit", r"\s*[,&;/]\s*"))
    name = F.concat(F.initcap("p_name"), chosen([" Star Festival", " (East) Regional", "", " Regional STAR Fest"], F.col("p_partkey")))
    return part.select(
        "p_partkey", F.array_join(titles.surnames(F.col("credit"), F.lit(None).cast("string")), " ").alias("surnames"), titles.human_list(F.col("names")).alias("human"),
        titles.singers_line(F.concat("names", F.array("p_brand", "p_type")), 3).alias("singers"), titles.article_url(F.concat("p_name", F.lit(" (é/ü)"))).alias("url"),
        titles.event_slug(name).alias("slug"), titles.import_key(F.lit("solo"), F.upper("p_name"), F.lit(None).cast("string")).alias("key"),
        text.nocase(F.upper("p_name")).alias("nocase"), text.display_fold(F.concat(F.upper("p_name"), F.lit("–Straße…"))).alias("display"), text.key_fold(F.concat("p_brand", F.lit("'s & Co."))).alias("key_fold"),
        text.clean(F.concat(F.lit(" \t"), "p_name", F.lit("​\u0007 "))).alias("clean"),
    )


CREDITS = rf"""
WITH p AS (SELECT *, {sql_chosen(PEOPLE, "p_partkey")} AS credit, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS cap FROM part),
n AS (SELECT *, string_split_regex(credit, '\s*[,&;/]\s*') AS names, string_split_regex(credit, '(?i)\s*(?:,|&|\band\b|\bwith\b|;|/)\s*') AS people FROM p),
m AS (SELECT *, list_concat(names, [p_brand, p_type]) AS singers FROM n)
SELECT p_partkey, array_to_string(list_filter(list_transform(people, lambda x: string_split(lower(trim(x)), ' ')[-1]), lambda w: length(w) >= 4), ' ') AS surnames,
  CASE WHEN len(names) = 1 THEN names[1] ELSE array_to_string(names[:-2], ', ') || ' and ' || names[-1] END AS human,
  CASE WHEN len(singers) <= 3 THEN array_to_string(singers[:len(singers) - 1], ', ') || ' & ' || singers[len(singers)] ELSE array_to_string(singers[:3], ', ') || ' & ' || (len(singers) - 3) || ' more' END AS singers,
  'https://en.wikipedia.org/wiki/' || replace(p_name, ' ', '_') || '_(%C3%A9/%C3%BC)' AS url, replace(p_name, ' ', '-') AS slug, 'sheet:solo|' || p_name || '|' AS key,
  p_name AS nocase, p_name || '-strasse...' AS display, replace(lower(p_brand), '#', ' ') || 's and co' AS key_fold, p_name AS clean FROM m"""

VOICE_WORDS = ["Sop.", "mezzo-soprano", "T", "Bass-baritone", "tenor/baritone", "high belter", "Contralto", "lyric soprano, alto", "speaking", ""]


def voice_fields(spark: SparkSession, d: str) -> DataFrame:
    """Voice words of parts, as a spelling of a range and as a voice type."""
    v = chosen(VOICE_WORDS, F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", v.alias("voice"), titles.vocal_range(v).alias("spelled"), titles.voice_range(v).alias("range"))


VOICE = f"""
SELECT p_partkey, {sql_chosen(VOICE_WORDS, "p_partkey")} AS voice, ['Soprano', 'Mezzo-soprano', 'Tenor', NULL, NULL, NULL, 'Alto', NULL, NULL, NULL][p_partkey % 10 + 1] AS spelled,
  ['Soprano', 'Mezzo-soprano', 'Tenor', 'Baritone', 'Tenor', 'Mezzo-soprano', 'Alto', 'Soprano', NULL, NULL][p_partkey % 10 + 1] AS range FROM part"""

ALBUMS = [
    " (Original Broadway Cast Recording)", " (Original London Cast) [Live]", " (2012 Broadway Revival)", " - In Concert", " (Concept Album)", " (Motion Picture Soundtrack)", " The Musical",
    " Songs", " (Original Score)",
]


def album_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The best edition of every brand's albums of a name: tier, then the earliest, then the most tracks."""
    name = F.concat("p_name", chosen(ALBUMS, F.col("p_partkey")))
    albums = table(spark, d, "part").select("p_brand", "p_name", "p_partkey", "p_size", name.alias("album"), titles.album_tier(name).alias("tier")).where("tier IS NOT NULL")
    best = F.max_by(F.struct("p_partkey", "album", "tier"), F.struct("tier", -F.col("p_size"), -F.col("p_partkey"))).alias("best")
    return albums.groupBy("p_brand", "p_name").agg(best, F.count("*").alias("n")).select("p_brand", "p_name", "best.p_partkey", "best.album", F.col("best.tier").cast("int").alias("tier"), "n")


ALBUM_TIERS = f"""
WITH a AS (SELECT p_brand, p_name, p_partkey, p_size, p_name || {sql_chosen(ALBUMS, "p_partkey")} AS album, [100, 90, 88, 72, 82, 62, 60, NULL, 62][p_partkey % 9 + 1] AS tier FROM part)
SELECT p_brand, p_name, p_partkey, album, CAST(tier AS INT) AS tier, count(*) OVER (PARTITION BY p_brand, p_name) AS n FROM a WHERE tier IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY p_brand, p_name ORDER BY tier DESC, p_size, p_partkey) = 1"""

#: Track, title and another name of the title, with {} for a part's name, and the level expected of them.
LADDER = [
    ("{}", "{}", "", 100), ("The {}!", "{}", "", 96), ("{} Playofff", "{} Play Offf", "", 96), ("{} (Live in Town)", "{}", "", 94), ("{} - From the Film", "{}", "", 94),
    ("An Opening: {}", "{}", "", 90), ("Morning Song and {} Together", "Morning Song / {}", "", 90), ("{}", "Other Words", "The {}", 88), ("One; {}", "Other Words", "{}", 88),
    ("Call of {}", "Other Words (Call Of {})", "", 88), ("{}", "{} / Evening Song", "", 78), ("the one about {} then", "The One About {} Now", "", 72),
    ("{} Radio Edit", "{} Radioedit", "", 71), ("{} Demo", "{} Demo", "", 100), ("{} (Radio Edit)", "{}", "", None), ("{} (Karaoke)", "Other Words", "{}", None),
    ("{} (Bows)", "{}", "", None), ("{} [End Credits]", "{}", "", None), ("{}, Alternate Take", "{}", "", None), ("{} (Introduction)", "{}", "", None), ("{} (Reprise)", "{}", "", None),
    ("{} (Reprise)", "{} [Reprise]", "", 100), ("{} (Act II)", "{}", "", None), ("One {}", "{} Two", "", None), ("{}", "Other Words", "", None), ("()", "{}", "", None),
]


def title_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The level at which every part's track name matches a title, by its whole name, core, sections, other names and words."""
    form = lambda k: F.replace(chosen([x[k] for x in LADDER], F.col("p_partkey")), F.lit("{}"), F.initcap("p_name") if k else F.col("p_name"))
    keyed = table(spark, d, "part").select("p_partkey", titles.ladder_keys(form(0)).alias("t"), titles.ladder_keys(form(1)).alias("q"), F.array(form(2)).alias("others"))
    return keyed.select("p_partkey", titles.ladder_level(F.col("t"), F.col("q"), F.col("others")).cast("int").alias("level"))


TITLE_LADDER = f"SELECT p_partkey, CAST([{', '.join('NULL' if x[3] is None else str(x[3]) for x in LADDER)}][p_partkey % {len(LADDER)} + 1] AS INT) AS level FROM part"


def list_codec(spark: SparkSession, d: str) -> DataFrame:
    """Lists of values as one escaped line and back; JSON lists, ids, repeats without regard to case."""
    part = table(spark, d, "part")
    values = F.array("p_brand", F.concat("p_name", F.lit(", 5%")), F.upper("p_brand"), "p_type")
    line = titles.listed(values)
    ids = F.array((F.col("p_partkey") % 5 - 2), F.col("p_partkey"), F.col("p_partkey"), F.col("p_size").cast("long"))
    broken = F.when(F.col("p_partkey") % 3 == 0, F.lit("no list")).otherwise(F.to_json(values))
    return part.select("p_partkey", line.alias("line"), F.array_join(titles.unlisted(line), "|").alias("back"), F.array_join(scalar.positive_ids(ids), ",").alias("ids"), F.size(scalar.json_list(broken)).alias("n_json"))


LIST_CODEC = """
WITH i AS (SELECT *, [p_partkey % 5 - 2, p_partkey, p_partkey, p_size::BIGINT] AS v FROM part)
SELECT p_partkey, p_brand || ',' || p_name || '%2C 5%25,' || upper(p_brand) || ',' || p_type AS line, p_brand || '|' || p_name || ', 5%|' || p_type AS back,
  array_to_string(list_filter(v, lambda x, n: x > 0 AND NOT list_contains(v[:n - 1], x)), ',') AS ids, CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 4 END AS INT) AS n_json FROM i"""


def character_matches(spark: SparkSession, d: str) -> DataFrame:
    """How names of a brand's parts name each other; a last word that several carry names none."""
    forms = ["Young {}", "{}", "{} Hill", "Ada {}", "The {}", "Saint {}"]
    who = F.element_at(F.split("p_name", " "), -1)
    name = F.array(*(F.format_string(f.replace("{}", "%s"), who) for f in forms))
    part = table(spark, d, "part").select("p_brand", F.explode(name).alias("name"))
    names = part.select("p_brand", text.match_key(F.col("name")).alias("key")).distinct()
    last = F.element_at(F.split("key", " "), -1)
    shared = names.groupBy("p_brand", last.alias("last")).agg(F.count("*").alias("n")).where("n > 6").groupBy("p_brand").agg(F.collect_set("last").alias("shared"))
    # two names that match share their only word with the other's first or last
    ends = F.array_distinct(F.array(F.split("key", " ")[0], last))
    a = names.select("p_brand", F.col("key").alias("a"), F.explode(ends).alias("end"))
    b = names.select("p_brand", F.col("key").alias("b"), F.explode(ends).alias("end"))
    pairs = a.join(b, ["p_brand", "end"]).where("a < b").select("p_brand", "a", "b").distinct().join(shared, "p_brand", "left")
    match = titles.character_match(F.col("a"), F.col("b"), F.coalesce("shared", F.array().cast("array<string>")))
    return pairs.select("p_brand", "a", "b", match.alias("match")).where("match IS NOT NULL")


CHARACTERS = r"""
WITH w AS (SELECT DISTINCT p_brand, lower(string_split(p_name, ' ')[-1]) AS w FROM part),
n AS (SELECT DISTINCT p_brand, unnest(['young ' || w, w, w || ' hill', 'ada ' || w, 'saint ' || w]) AS key FROM w),
l AS (SELECT p_brand, string_split(key, ' ')[-1] AS last, count(*) AS n FROM n GROUP BY 1, 2),
p AS (SELECT x.p_brand, x.key AS a, y.key AS b, CASE WHEN length(x.key) < length(y.key) THEN x.key ELSE y.key END AS s, CASE WHEN length(x.key) < length(y.key) THEN y.key ELSE x.key END AS g
  FROM n x JOIN n y ON x.p_brand = y.p_brand AND x.key < y.key AND contains(x.key, ' ') <> contains(y.key, ' ')),
q AS (SELECT p.*, string_split(g, ' ') AS gw, coalesce(n, 0) AS n FROM p LEFT JOIN l ON l.p_brand = p.p_brand AND l.last = s)
SELECT p_brand, a, b, CASE WHEN gw[1] = s THEN 'first' ELSE 'last' END AS match FROM q WHERE length(s) >= 3 AND (gw[1] = s OR gw[2] = s AND gw[1] NOT IN ('young', 'saint') AND n <= 6)"""


def kinds_of_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as songs: their speakers decide the kind."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") != "system", F.col("role"))).alias("who"), F.count("*").alias("n"), F.max((F.col("turn") >= 8).cast("int")).alias("long"))
    kind = titles.kind_of_singers(F.col("who"), F.col("long") == 1, F.col("n") == 1)
    return turns.select("conv_id", kind["kind"].alias("kind"), kind["reason"].alias("reason"))


KINDS = """
WITH t AS (SELECT conv_id, count(DISTINCT CASE WHEN role <> 'system' THEN role END) AS k, count(*) AS n, max(turn) >= 8 AS long FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN n > 1 AND NOT long THEN CASE k WHEN 1 THEN 'solo' WHEN 2 THEN 'duet' END END AS kind,
  CASE WHEN n = 1 THEN 'instrumental' WHEN long THEN 'ensemble' WHEN k = 0 THEN 'unknown' WHEN k > 2 THEN 'group' END AS reason FROM t"""

QUERIES = {
    "length_fields": (length_fields, LENGTHS),
    "relative_times": (relative_times, RELATIVE),
    "date_fields": (date_fields, DATES),
    "title_fields": (title_fields, TITLE_FIELDS),
    "credit_fields": (credit_fields, CREDITS),
    "voice_fields": (voice_fields, VOICE),
    "album_tiers": (album_tiers, ALBUM_TIERS),
    "title_ladder": (title_ladder, TITLE_LADDER),
    "list_codec": (list_codec, LIST_CODEC),
    "character_matches": (character_matches, CHARACTERS),
    "kinds_of_turns": (kinds_of_turns, KINDS),
}
