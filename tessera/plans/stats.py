"""Queries that count, group and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import aggregate, relate
from tessera.session import table

# Event types in their order of display.
TYPES = ["signup", "view", "click", "purchase", "error", "refund"]
PRICES = [("under 50k", None, 50_000), ("50k-100k", None, 100_000), ("100k-200k", None, 200_000), ("200k-350k", None, 350_000), ("over 350k", None, None)]


def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A ladder of price buckets, with an Unknown bucket only if some value is."""
    price = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice"))
    return table(spark, d, "orders").groupBy(aggregate.ladder(price, PRICES, "Unknown").alias("bucket")).agg(F.count("*").alias("n"))


HISTOGRAM = """
SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Unknown' WHEN o_totalprice <= 50000 THEN 'under 50k' WHEN o_totalprice <= 100000 THEN '50k-100k'
  WHEN o_totalprice <= 200000 THEN '100k-200k' WHEN o_totalprice <= 350000 THEN '200k-350k' ELSE 'over 350k' END AS bucket, count(*) AS n
FROM orders GROUP BY 1"""


def zero_filled_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users of every event type, also of types without events."""
    vocabulary = spark.createDataFrame(list(enumerate(TYPES)), "ord long, event_type string")
    counted = table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("n"))
    return aggregate.zero_filled(vocabulary, counted, "event_type")


ZERO_FILLED = """
SELECT v.ord, v.event_type, count(DISTINCT user_id) AS n
FROM (VALUES (0::BIGINT, 'signup'), (1, 'view'), (2, 'click'), (3, 'purchase'), (4, 'error'), (5, 'refund')) v(ord, event_type)
LEFT JOIN events e ON e.event_type = v.event_type GROUP BY 1, 2"""


def argmax_group(spark: SparkSession, d: str) -> DataFrame:
    """Each part brand's most common return flag; ties to the smallest."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregate.most_common(rows, ["p_brand"], "l_returnflag").select("p_brand", "l_returnflag", "n", "total")


ARGMAX = """
WITH c AS (SELECT p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT p_brand, l_returnflag, n, CAST(sum(n) OVER (PARTITION BY p_brand) AS BIGINT) AS total FROM c
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, l_returnflag NULLS LAST) = 1"""


def stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counts and totals by nation and segment, with subtotals."""
    rows = (
        table(spark, d, "orders")
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return rows.rollup("n_name", "c_mktsegment").agg(
        F.count("*").alias("n_orders"),
        F.count_if(F.col("o_orderstatus") == "F").alias("n_final"),
        F.round(F.sum("o_totalprice"), 0).alias("price"),
        F.coalesce(F.max("o_totalprice"), F.lit(0.0)).alias("largest"),
    )


ROLLUP = """
SELECT n_name, c_mktsegment, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'F') AS n_final, round(sum(o_totalprice), 0) AS price,
  coalesce(max(o_totalprice), 0) AS largest
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)"""


def profile(spark: SparkSession, d: str) -> DataFrame:
    """Many measures of the documents in one pass."""
    text = F.col("text")
    return table(spark, d, "documents").agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("n_sources"), F.count_if(text.isNull()).alias("n_null"),
        F.count_if(F.col("lang") == "en").alias("n_en"), F.sum("n_chars").alias("chars"), F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"), F.count_if(F.contains(text, F.lit("@"))).alias("n_mail"),
        F.count_if(F.col("n_chars") > 5000).alias("n_long"), F.round(F.avg("n_chars"), 4).alias("mean"),
        F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest_id"),
    )


PROFILE = """
SELECT count(*) AS n, count(DISTINCT source) AS n_sources, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (lang = 'en') AS n_en,
  CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS shortest, max(n_chars) AS longest, count(*) FILTER (contains(text, '@')) AS n_mail,
  count(*) FILTER (n_chars > 5000) AS n_long, round(avg(n_chars), 4) AS mean,
  (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1) AS longest_id FROM documents"""


def pivot_children(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.pivoted(table(spark, d, "lineitem").where("l_linenumber <= 2"), "l_orderkey", "l_linenumber", [1, 2], ["l_partkey", "l_quantity"])


PIVOT = """
SELECT l_orderkey, max(l_partkey) FILTER (l_linenumber = 1) AS l_partkey_1, max(l_quantity) FILTER (l_linenumber = 1) AS l_quantity_1,
  max(l_partkey) FILTER (l_linenumber = 2) AS l_partkey_2, max(l_quantity) FILTER (l_linenumber = 2) AS l_quantity_2
FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1"""


def nested_children(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their lines as an ordered array, rendered."""
    lines = aggregate.children(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], [], "lines")
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_quantity"].cast("int"))), ";")
    return joined.select("o_orderkey", "o_orderstatus", shown.alias("lines"))


NESTED = """
SELECT o_orderkey, o_orderstatus, string_agg(l_linenumber || ':' || l_partkey || ':' || CAST(l_quantity AS INT), ';' ORDER BY l_linenumber, l_partkey, l_quantity) AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def entity_counts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    out = relate.counts_of(table(spark, d, "customer"), "c_custkey", n_orders=orders, n_open=orders.where("o_orderstatus = 'O'"), n_large=orders.where("o_totalprice > 300000"))
    return out.select("c_custkey", "c_name", "n_orders", "n_open", "n_large")


ENTITY = """
SELECT c_custkey, c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n_large FROM customer"""


def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Each user's favourite event of a day counts once; most days, then the display order, then first seen."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return aggregate.vote(events, ["user_id"], "day", "event_type", {t: i for i, t in enumerate(TYPES)}, "event_id")


VOTE = """
WITH v AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) = 1),
c AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS seen FROM v WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, event_type, votes FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC,
  CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 5 END, seen) = 1"""


def sorted_counts(spark: SparkSession, d: str) -> DataFrame:
    """Values by count, then by folded name, numbered."""
    counted = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.collect_set("p_type").alias("t"))
    placed = relate.numbered(counted, [F.desc("n"), F.lower("p_brand")])
    return placed.select("p_brand", "n", F.array_join(F.array_sort("t"), " ").alias("types"), "place")


SORTED_COUNTS = """
WITH c AS (SELECT p_brand, count(*) AS n, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS types FROM part GROUP BY 1)
SELECT p_brand, n, types, row_number() OVER (ORDER BY n DESC, lower(p_brand)) AS place FROM c"""


def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return aggregate.fingerprint(table(spark, d, "orders"), "o_orderkey")


FINGERPRINT = "SELECT max(o_orderkey) AS max_key, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys FROM orders"


def block_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of documents with a property, by source and language: what kind of text a source holds."""
    text = F.col("text")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return table(spark, d, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("n"), share(text.rlike("[0-9]")).alias("digits"), share(text.rlike("@")).alias("mail"),
        share(text.rlike("(?i)licen[sc]e")).alias("licence"), share(F.col("n_chars") < 500).alias("short"),
    )


SHARES = """
SELECT source, lang, count(*) AS n, round(avg(regexp_matches(text, '[0-9]')::INT), 6) AS digits, round(avg(regexp_matches(text, '@')::INT), 6) AS mail,
  round(avg(regexp_matches(text, '(?i)licen[sc]e')::INT), 6) AS licence, round(avg((n_chars < 500)::INT), 6) AS short
FROM documents GROUP BY 1, 2"""

QUERIES = {
    "bucket_histogram": (bucket_histogram, HISTOGRAM),
    "zero_filled_distinct": (zero_filled_distinct, ZERO_FILLED),
    "argmax_group": (argmax_group, ARGMAX),
    "stats_rollup": (stats_rollup, ROLLUP),
    "profile": (profile, PROFILE),
    "pivot_children": (pivot_children, PIVOT),
    "nested_children": (nested_children, NESTED),
    "entity_counts": (entity_counts, ENTITY),
    "majority_vote": (majority_vote, VOTE),
    "sorted_counts": (sorted_counts, SORTED_COUNTS),
    "table_fingerprint": (table_fingerprint, FINGERPRINT),
    "block_shares": (block_shares, SHARES),
}
