"""Queries of lists in marked-up texts, corrections, and rules with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import blocks, correct, relate, variants
from tessera.session import table


def marked_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, text): every page's headings, links and paragraphs as lines of a marked-up text, of a kind by their place."""
    each = F.regexp_extract_all("html", F.lit(r"<(?:p|b|li|h1)>(?:<a[^>]*>)?([^<]+)"), F.lit(1))

    def line(text: Column, i: Column) -> Column:
        words = F.split(F.trim(text), r"\s+")
        some = lambda a, b: F.array_join(F.slice(words, a, b), " ")
        kind = (i * 7 + F.col("page_id")) % 17
        forms = {
            0: F.concat(F.lit("* "), some(1, 3), F.lit(" – "), some(4, 1)), 1: F.concat(F.lit("* "), some(1, 2)), 2: F.concat(F.lit("# "), some(1, 2), F.lit(" (Reprise) - "), some(3, 1), F.lit(" and Company")),
            3: F.lit("; Act I"), 4: F.concat(F.lit("** "), some(2, 2)), 5: F.concat(F.lit("; "), some(1, 1), F.lit(" production")), 6: F.concat(F.lit("== "), some(1, 2), F.lit(" ==")),
            7: F.lit("* Overture"), 8: F.concat(F.lit("; "), some(1, 2)), 9: F.lit("=== Notes ==="), 10: F.lit("; Act II"), 11: F.concat(F.lit("* "), some(1, 1), F.lit(":")), 12: F.lit("; Current version"),
        }
        out = F.concat(F.lit("* "), some(1, 3), F.lit(" – "), some(4, 1), F.lit(", "), some(5, 1))
        for k, form in forms.items():
            out = F.when(kind == k, form).otherwise(out)
        return out

    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(each, line), "\n").alias("text"))


def page_lists(spark: SparkSession, d: str) -> DataFrame:
    """The lists of every page's text, scored, and the one that is chosen."""
    return blocks.scored_lists(blocks.listed_items(marked_pages(spark, d), "page_id", "text"), "page_id")


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of every page's chosen list."""
    items = blocks.listed_items(marked_pages(spark, d), "page_id", "text")
    found = blocks.chosen_items(items, blocks.scored_lists(items, "page_id"), "page_id")
    return found.withColumn("singers", F.array_join("singers", "|"))


STEPS = [
    correct.Step("titles", "title", ("production", "title")), correct.Step("shows", "production", ("production",)), correct.Step("characters", "character", ("production", "character")),
    correct.Step("genres", "genre", ("genre",)), correct.Step("notes", "note", ("kind", "production", "title")),
]


def _sheet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a sheet's rows, and corrections made of every seventh part: some keys spelled loosely, some of no row."""
    part = table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "solo").otherwise("duet")
    rows = part.select("p_partkey", kind.alias("kind"), F.col("p_brand").alias("production"), F.col("p_name").alias("title"), F.col("p_type").alias("character"), F.lower("p_type").alias("genre"), F.lit(None).cast("string").alias("note"))
    some, k = part.where("p_partkey % 7 = 0"), F.col("p_partkey")
    entry = lambda name, key, value: F.struct(F.lit(name).alias("name"), key.alias("key"), value.alias("value"))
    show = F.when(k % 2 == 0, F.concat(F.lit("Show of "), F.col("p_brand"))).otherwise(F.col("p_brand"))
    each = F.array(
        entry("titles", F.when(k % 2 == 0, F.upper(F.concat_ws("|", "p_brand", "p_name"))).otherwise(F.concat_ws("|", "p_brand", "p_name")), F.concat(F.initcap("p_name"), F.lit(" "))),
        entry("shows", F.when(k % 4 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("_"), F.col("p_brand"))), F.concat(F.lit("Show of "), F.col("p_brand"))),
        entry("characters", F.concat_ws("|", show, F.lower("p_type")), F.when(k % 3 == 0, F.lit(" ")).otherwise(F.initcap("p_type"))),
        entry("genres", F.concat("p_type", F.lit("  "), (k % 2).cast("string")), F.lit("none")), entry("genres", F.when(k % 5 == 0, F.col("p_type")), F.col("p_type")),
        entry("notes", F.concat_ws("|", F.lit("solo"), show, F.initcap("p_name")), F.concat(F.lit("see "), F.col("p_name"))),
    )
    return rows, some.select(F.explode(each).alias("e")).select("e.*")


def corrected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows after five maps, and which keys were used."""
    rows, _ = correct.corrected(*_sheet(spark, d), STEPS)
    used = F.transform("applied", lambda a: F.concat_ws(":", a["name"], a["key"], a["changed"].cast("string")))
    return rows.select("p_partkey", "kind", "production", "title", "character", "genre", "note", F.array_join(used, ";").alias("applied"))


def correction_report(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each correction was used for and changed, those of no use with zeros."""
    return correct.corrected(*_sheet(spark, d), STEPS)[1]


def _corrections_sql() -> str:
    """Each step by two lookups: the key as it is, then loosely."""
    loose = lambda x: f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"
    cap = "array_to_string(list_transform(string_split({0}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
    show = "CASE WHEN p_partkey % 2 = 0 THEN 'Show of ' || p_brand ELSE p_brand END"
    sql = f"""
WITH s AS (SELECT * FROM part WHERE p_partkey % 7 = 0),
a AS (SELECT 'titles' AS name, CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand || '|' || p_name) ELSE p_brand || '|' || p_name END AS key, {cap.format("p_name")} AS value FROM s
  UNION ALL SELECT 'shows', CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE '_' || p_brand END, 'Show of ' || p_brand FROM s
  UNION ALL SELECT 'characters', {show} || '|' || lower(p_type), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE {cap.format("p_type")} END FROM s
  UNION ALL SELECT 'genres', p_type || '  ' || p_partkey % 2, 'none' FROM s UNION ALL SELECT 'genres', CASE WHEN p_partkey % 5 = 0 THEN p_type END, p_type FROM s
  UNION ALL SELECT 'notes', 'solo|' || {show} || '|' || {cap.format("p_name")}, 'see ' || p_name FROM s),
k AS (SELECT name, key, min(value) AS value, {loose("key")} AS near FROM a WHERE key IS NOT NULL AND NOT starts_with(key, '_') GROUP BY name, key),
n AS (SELECT name, near, max(key) AS key FROM k GROUP BY 1, 2),
r0 AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'solo' ELSE 'duet' END AS kind, p_brand AS production, p_name AS title, p_type AS character, lower(p_type) AS genre, NULL::VARCHAR AS note, []::VARCHAR[] AS applied FROM part)"""
    for i, step in enumerate(STEPS):
        key = " || '|' || ".join(f"r.{c}" for c in step.key)
        new = f"CASE WHEN k.value <> '' THEN k.value ELSE r.{step.column} END"
        sql += f""",
r{i + 1} AS (SELECT r.* REPLACE ({new} AS {step.column},
  CASE WHEN k.key IS NULL THEN r.applied ELSE list_append(r.applied, '{step.name}:' || k.key || ':' || (({new}) IS DISTINCT FROM r.{step.column})::VARCHAR) END AS applied)
  FROM r{i} r LEFT JOIN k e ON e.name = '{step.name}' AND e.key = {key} LEFT JOIN n ON n.name = '{step.name}' AND n.near = {loose(key)} LEFT JOIN k ON k.name = '{step.name}' AND k.key = coalesce(e.key, n.key))"""
    return sql


CORRECTED = f"""{_corrections_sql()}
SELECT p_partkey, kind, production, title, character, genre, note, array_to_string(applied, ';') AS applied FROM r{len(STEPS)}"""
REPORT = f"""{_corrections_sql()},
u AS (SELECT regexp_extract(x, '^([a-z]+):', 1) AS name, regexp_extract(x, '^[a-z]+:(.*):[a-z]+$', 1) AS key, count(*) AS n_rows, count(*) FILTER (ends_with(x, ':true')) AS n_changed
  FROM (SELECT unnest(applied) AS x FROM r{len(STEPS)}) GROUP BY 1, 2)
SELECT k.name, k.key, coalesce(n_rows, 0) AS n_rows, coalesce(n_changed, 0) AS n_changed FROM k LEFT JOIN u ON u.name = k.name AND u.key = k.key"""


def _rules() -> tuple[list[correct.Rule], list[tuple[str, Column]]]:
    t = F.col("text")
    return [
        correct.Rule("no-text", False, t.isNull() | (F.trim(t) == "")), correct.Rule("mail", False, t.contains("@")), correct.Rule("source-blocked", False, F.col("source").isin("src3", "src5")),
        correct.Rule("long", True, F.length(t) >= 3_000), correct.Rule("numbers", False, t.rlike("[0-9]{6}")), correct.Rule("language", True, F.col("lang").isin("en", "de")),
    ], [("marked-quality", (F.col("quality") == 1) & (F.col("toxic") == 0)), ("heading", t.rlike(r"^[^\n.]{1,80}\n"))]


def decided_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which documents are taken, and why: a table of rules, the first hit wins; what is left out may be rescued."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rules, rescues = _rules()
    return correct.decided(table(spark, d, "documents").join(labels, "doc_id", "left"), rules, "other-language", rescues).select("doc_id", "include", "reason")


DECIDED = r"""
WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
r AS (SELECT documents.doc_id, text, quality, toxic, CASE WHEN coalesce(trim(text), '') = '' THEN 'no-text' WHEN contains(text, '@') THEN 'mail' WHEN source IN ('src3', 'src5') THEN 'source-blocked'
  WHEN length(text) >= 3000 THEN 'long' WHEN regexp_matches(text, '[0-9]{6}') THEN 'numbers' WHEN lang IN ('en', 'de') THEN 'language' ELSE 'other-language' END AS reason FROM documents LEFT JOIN l USING (doc_id)),
b AS (SELECT *, CASE WHEN quality = 1 AND toxic = 0 THEN 'marked-quality' WHEN regexp_matches(text, '\A[^\n.]{1,80}\n') THEN 'heading' END AS back FROM r)
SELECT doc_id, reason IN ('long', 'language') OR back IS NOT NULL AS include, CASE WHEN reason IN ('long', 'language') THEN reason ELSE coalesce(back, reason) END AS reason FROM b"""

def _json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties as JSON texts of many shapes: some missing, some broken, some with keys that none may have."""
    props, k = F.col("props"), F.col("event_id") % 9
    inside = lambda a, b: F.concat(F.lit(a), props, F.lit(b))
    text = (
        F.when(k == 1, None).when(k == 2, "  ").when(k == 3, F.substring(props, 1, 5)).when(k == 4, inside('{"a": {"constructor": ', "}}"))
        .when(k == 5, inside("[", ', {"b c": {"__proto__": 1}}]')).when(k == 6, inside('{"prototype": {"x": ', ', "y": [{"prototype": null}]}}')).otherwise(props)
    )
    return table(spark, d, "events").select("event_id", text.alias("json"))


def checked_json(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each JSON text, and where."""
    found = variants.checked(_json_texts(spark, d), "event_id", "json")
    return found.select("event_id", "error", F.array_join("paths", " ").alias("paths"))


CHECKED_JSON = """
SELECT event_id, CASE WHEN event_id % 9 IN (1, 2) THEN 'missing' WHEN event_id % 9 = 3 OR NOT json_valid(props) THEN 'invalid' WHEN event_id % 9 IN (4, 5, 6) THEN 'forbidden' END AS error,
  CASE event_id % 9 WHEN 4 THEN '$.a.constructor' WHEN 5 THEN '$[1]."b c".__proto__' WHEN 6 THEN '$.prototype $.prototype.y[0].prototype' ELSE '' END AS paths FROM events"""


def json_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Numbers in the events' JSON texts: how many, and their sum, at every path."""
    good = variants.parsed(_json_texts(spark, d), "event_id", "json").where("error IS NULL")
    leaves = variants.walked(good, "event_id", "value").select("path", F.try_variant_get("value", "$", "double").alias("number"))
    return leaves.groupBy("path").agg(F.count("*").alias("n"), F.sum("number").alias("total"))


JSON_LEAVES = """
WITH e AS (SELECT event_id % 9 AS k, (props->>'$.k')::DOUBLE AS v FROM events),
p AS (SELECT unnest(CASE WHEN k IN (0, 7, 8) THEN [{'path': '$.k', 'v': v}] WHEN k = 4 THEN [{'path': '$.a', 'v': NULL}, {'path': '$.a.constructor', 'v': NULL}, {'path': '$.a.constructor.k', 'v': v}]
  WHEN k = 5 THEN [{'path': '$[0]', 'v': NULL}, {'path': '$[0].k', 'v': v}, {'path': '$[1]', 'v': NULL}, {'path': '$[1]."b c"', 'v': NULL}, {'path': '$[1]."b c".__proto__', 'v': 1.0}]
  WHEN k = 6 THEN [{'path': '$.prototype', 'v': NULL}, {'path': '$.prototype.x', 'v': NULL}, {'path': '$.prototype.x.k', 'v': v}, {'path': '$.prototype.y', 'v': NULL},
    {'path': '$.prototype.y[0]', 'v': NULL}, {'path': '$.prototype.y[0].prototype', 'v': NULL}] ELSE [] END) AS x FROM e)
SELECT x.path AS path, count(*) AS n, sum(x.v) AS total FROM p GROUP BY 1"""


def collated_names(spark: SparkSession, d: str) -> DataFrame:
    """Parts in a reader's order of their names: case and accents don't count, numbers go by size."""
    name = F.concat(F.initcap(F.translate("p_name", "eo", "éÖ")), F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.lit("No. ")).otherwise(F.lit("0")), F.col("p_size").cast("string"))
    part = table(spark, d, "part").select("p_partkey", name.alias("name")).withColumn("key", text.natural_key(F.col("name")))
    return relate.numbered(part, ["key", "p_partkey"]).select("p_partkey", "name", "place")


COLLATED = """
WITH p AS (SELECT p_partkey, p_size, p_name, array_to_string(list_transform(string_split(lower(translate(p_name, 'eo', 'éö')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'No. ' ELSE '0' END || p_size AS name FROM part)
SELECT p_partkey, name, row_number() OVER (ORDER BY p_name || ' ' || CASE WHEN p_partkey % 2 = 0 THEN 'no ' ELSE '' END || lpad(p_size::VARCHAR, 9, '0'), p_partkey) AS place FROM p"""

QUERIES = {
    "checked_json": (checked_json, CHECKED_JSON), "json_leaves": (json_leaves, JSON_LEAVES), "collated_names": (collated_names, COLLATED),
    "page_lists": (page_lists, None), "page_numbers": (page_numbers, None), "corrected_rows": (corrected_rows, CORRECTED), "correction_report": (correction_report, REPORT),
    "decided_documents": (decided_documents, DECIDED),
}
