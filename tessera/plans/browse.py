"""Queries that filter, search, sort and page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators import browse
from tessera.session import table

BRANDS = ["Brand#1", "Brand#2", "Brand#7", "Brand#12"]


def browse_filter(spark: SparkSession, d: str) -> DataFrame:
    """Search token, size range, brand list, and an EXISTS on children."""
    part = table(spark, d, "part")
    sold = table(spark, d, "lineitem").where(F.col("l_quantity") >= 40).select(F.col("l_partkey").alias("p_partkey"))
    wanted = [browse.matches_tokens("e", [F.col("p_name"), F.col("p_type")]), browse.within(F.col("p_size"), 5, 40), F.col("p_brand").isin(BRANDS)]
    return part.where(browse.all_of(wanted)).join(sold, "p_partkey", "left_semi").select("p_partkey", "p_name", "p_brand", "p_size")


BROWSE_FILTER = """
SELECT p_partkey, p_name, p_brand, p_size FROM part
WHERE (contains(lower(strip_accents(p_name)), 'e') OR contains(lower(strip_accents(p_type)), 'e'))
  AND p_size BETWEEN 5 AND 40 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#7', 'Brand#12')
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40)"""


def page_sorted(spark: SparkSession, d: str) -> DataFrame:
    """A page of a total order, unknown values last, with the total before paging."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'")
    price = F.when(F.col("o_totalprice") < 400000, F.col("o_totalprice"))
    found = browse.page(orders.withColumn("price", price), [F.col("price").desc_nulls_last(), F.col("o_orderkey")], 50, 25)
    return found.select("o_orderkey", "price", "total")


PAGE_SORTED = """
WITH f AS (SELECT o_orderkey, CASE WHEN o_totalprice < 400000 THEN o_totalprice END AS price FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, price, (SELECT count(*) FROM f) AS total FROM f
ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 25"""


def token_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(browse.matches_tokens("éa the", [F.col("text"), F.col("source")])).select("doc_id", "lang", "n_chars")


TOKEN_SEARCH = """
SELECT doc_id, lang, n_chars FROM documents
WHERE (contains(lower(strip_accents(text)), 'ea') OR contains(lower(strip_accents(source)), 'ea'))
  AND (contains(lower(strip_accents(text)), 'the') OR contains(lower(strip_accents(source)), 'the'))"""


def loose_search_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return docs.where(browse.matches_loosely("src1 ention", [F.col("text"), F.col("source")])).select("doc_id", "quality", "toxic")


LOOSE_SEARCH = """
WITH f AS (SELECT d.doc_id, quality, toxic, lower(strip_accents(text)) AS t, lower(strip_accents(source)) AS s
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, quality, toxic FROM f
WHERE contains(t, 'src1 ention') OR contains(s, 'src1 ention')
   OR (contains(t || ' ' || s, 'src1') AND contains(t || ' ' || s, 'ention'))"""


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each facet's counts under every filter but its own."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    filters = {
        "status": F.col("o_orderstatus").isin("O", "F"),
        "segment": F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"),
        "priority": F.col("o_orderpriority") == "2-HIGH",
    }
    values = {"status": F.col("o_orderstatus"), "segment": F.lower("c_mktsegment"), "priority": F.col("o_orderpriority")}
    return browse.facets(rows, filters, values)


FACETS = """
WITH r AS (SELECT o_orderstatus IN ('O', 'F') AS a, c_mktsegment IN ('MACHINERY', 'FURNITURE') AS b, o_orderpriority = '2-HIGH' AS c,
                  o_orderstatus, lower(c_mktsegment) AS segment, o_orderpriority
           FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM r WHERE b AND c GROUP BY 2
UNION ALL SELECT 'segment', segment, count(*) FROM r WHERE a AND c GROUP BY 2
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM r WHERE a AND b GROUP BY 2"""


def similar_topk(spark: SparkSession, d: str) -> DataFrame:
    """The six parts most like each part of every 100th key: pairs come from shared brand, type and size, and from the brand alone
    only where these give less than six."""
    part = table(spark, d, "part").where("p_partkey IS NOT NULL").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    asked = part.where(F.col("p_partkey") % 100 == 0).select(*(F.col(c).alias(f"q_{c[2:]}") for c in part.columns))
    same_type = (F.col("p_type") == F.col("q_type")).cast("int")
    near = F.when(F.abs(F.col("p_size") - F.col("q_size")) <= 3, 2).otherwise(0)
    score = (4 * same_type + near + F.when(F.col("p_name") == F.col("q_name"), 1).otherwise(0)).cast("int")

    def ranked(pairs: DataFrame) -> DataFrame:
        scored = pairs.where("p_partkey <> q_partkey").withColumn("score", score).where("score > 0")
        return browse.top_by(scored, ["q_partkey"], [F.desc("score"), F.col("p_name"), F.col("p_partkey")], 6).select("q_partkey", "rank", "p_partkey", "score")

    # of parts that differ by their key alone, six and the asked one can count; of one size, six that have not the asked name
    seven = browse.top_by(part, ["p_brand", "p_type", "p_size", "p_name"], [F.col("p_partkey")], 7).drop("rank")
    firsts = browse.top_by(seven, ["p_brand", "p_type", "p_size"], [F.col("p_name"), F.col("p_partkey")], 14).drop("rank")
    size = F.col("q_size").cast("long")
    around = asked.withColumn("at", F.explode(F.sequence(size - 3, size + 3)))
    close = (F.col("p_brand") == F.col("q_brand")) & (F.col("p_type") == F.col("q_type")) & (F.col("p_size") == F.col("at"))
    named = F.col("p_name") == F.col("q_name")
    found = ranked(around.join(seven, close & named).unionByName(around.join(firsts, close).where(~F.coalesce(named, F.lit(False)))).drop("at"))
    full = found.where("rank = 6").select("q_partkey")
    others = ranked(asked.join(full, "q_partkey", "left_anti").join(seven, F.col("p_brand") == F.col("q_brand")))
    both = found.join(full, "q_partkey", "left_semi").unionByName(others)
    return both.select("q_partkey", F.col("rank").cast("long").alias("rank"), "p_partkey", "score")


SIMILAR = """
WITH s AS (SELECT q.p_partkey AS q_partkey, p.p_partkey, p.p_name,
    CAST(4 * (p.p_type = q.p_type)::INT + CASE WHEN abs(p.p_size - q.p_size) <= 3 THEN 2 ELSE 0 END + (p.p_name = q.p_name)::INT AS INT) AS score
  FROM part q JOIN part p ON p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey WHERE q.p_partkey % 100 = 0)
SELECT * FROM (SELECT q_partkey, row_number() OVER (PARTITION BY q_partkey ORDER BY score DESC, p_name, p_partkey) AS rank, p_partkey, score
  FROM s WHERE score > 0) WHERE rank <= 6"""


def quiz_rank(spark: SparkSession, d: str) -> DataFrame:
    """Weighted points with a fit matrix, as a percentage; the best twelve."""
    part = table(spark, d, "part")
    fit = F.create_map(*(F.lit(x) for pair in {"ECONOMY": 1.0, "STANDARD": 0.5, "SMALL": 0.3, "MEDIUM": 0.15, "LARGE": 0.25}.items() for x in pair))
    size = F.when(F.col("p_size").between(10, 20), 1.0).when(F.col("p_size").between(5, 30), 0.5).otherwise(0.0)
    points = 25 * F.coalesce(F.try_element_at(fit, F.col("p_type")), F.lit(0.0)) + 35 * size + F.when(F.col("p_brand").isin(BRANDS), 15).otherwise(0)
    ranked = part.withColumn("points", points).withColumn("percent", F.floor(100 * F.col("points") / 75 + 0.5).cast("long"))
    order = [F.desc("percent"), F.desc("points"), F.asc("p_name"), F.asc("p_partkey")]
    return ranked.orderBy(*order).limit(12).select("p_partkey", "p_name", F.round("points", 4).alias("points"), "percent")


QUIZ = """
WITH s AS (SELECT p_partkey, p_name,
  25 * CAST(CASE p_type WHEN 'ECONOMY' THEN 1.0 WHEN 'STANDARD' THEN 0.5 WHEN 'SMALL' THEN 0.3 WHEN 'MEDIUM' THEN 0.15 WHEN 'LARGE' THEN 0.25 ELSE 0 END AS DOUBLE)
  + 35 * CAST(CASE WHEN p_size BETWEEN 10 AND 20 THEN 1.0 WHEN p_size BETWEEN 5 AND 30 THEN 0.5 ELSE 0 END AS DOUBLE)
  + CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#7', 'Brand#12') THEN 15 ELSE 0 END AS points FROM part)
SELECT p_partkey, p_name, round(points, 4) AS points, CAST(floor(100 * points / 75 + 0.5) AS BIGINT) AS percent FROM s
ORDER BY percent DESC, points DESC, p_name, p_partkey LIMIT 12"""


def first_tier(spark: SparkSession, d: str) -> DataFrame:
    """The best tier that has any rows."""
    part = table(spark, d, "part")
    tier = F.when((F.col("p_size") == 50) & (F.col("p_brand") == "Brand#99"), 1).when((F.col("p_size") == 50) & (F.col("p_type") == "PROMO"), 2).otherwise(3)
    return browse.first_tier(part, tier).select("p_partkey", "p_name", "tier")


FIRST_TIER = """
WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_size = 50 AND p_brand = 'Brand#99' THEN 1 WHEN p_size = 50 AND p_type = 'PROMO' THEN 2 ELSE 3 END AS tier FROM part)
SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)"""


def article_sorted_names(spark: SparkSession, d: str) -> DataFrame:
    """The first names without their article, numbers in order of value."""
    name = F.regexp_replace(F.lower("c_name"), "^(the|a|an) ", "")
    key = F.concat(F.regexp_extract(name, "^[^0-9]*", 0), F.lpad(F.regexp_extract(name, "([0-9]+)", 1), 12, "0"))
    return table(spark, d, "customer").withColumn("sort_key", key).orderBy("sort_key", "c_custkey").limit(40).select("c_custkey", "sort_key")


ARTICLE_SORTED = """
WITH n AS (SELECT c_custkey, regexp_replace(lower(c_name), '^(the|a|an) ', '') AS name FROM customer)
SELECT c_custkey, regexp_extract(name, '^[^0-9]*', 0) || lpad(regexp_extract(name, '([0-9]+)', 1), 12, '0') AS sort_key FROM n
ORDER BY sort_key, c_custkey LIMIT 40"""


def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By number, else by folded name, smallest id first."""
    nation = table(spark, d, "nation")
    wanted = spark.createDataFrame([("7",), ("nation_3",), ("NATION_12",), ("nowhere",)], "wanted string")
    hit = (F.col("wanted").try_cast("int") == F.col("n_nationkey")) | (fold(F.col("wanted")) == fold(F.col("n_name")))
    found = F.broadcast(wanted).join(nation, hit, "left")
    return found.groupBy("wanted").agg(F.min("n_nationkey").alias("n_nationkey"))


POINT_LOOKUP = """
SELECT wanted, min(n_nationkey) AS n_nationkey FROM (VALUES ('7'), ('nation_3'), ('NATION_12'), ('nowhere')) w(wanted)
LEFT JOIN nation ON TRY_CAST(wanted AS INT) = n_nationkey OR lower(wanted) = lower(n_name) GROUP BY wanted"""

QUERIES = {
    "browse_filter": (browse_filter, BROWSE_FILTER),
    "page_sorted": (page_sorted, PAGE_SORTED),
    "token_search": (token_search, TOKEN_SEARCH),
    "loose_search_all_tokens": (loose_search_all_tokens, LOOSE_SEARCH),
    "facet_counts": (facet_counts, FACETS),
    "similar_topk": (similar_topk, SIMILAR),
    "quiz_rank": (quiz_rank, QUIZ),
    "first_tier": (first_tier, FIRST_TIER),
    "article_sorted_names": (article_sorted_names, ARTICLE_SORTED),
    "point_lookup": (point_lookup, POINT_LOOKUP),
}
