"""Queries of joins, ordered lists and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relate
from tessera.session import table


def polymorphic_left_join(spark: SparkSession, d: str) -> DataFrame:
    """Events whose target is an order or a customer, by the event's type."""
    events = table(spark, d, "events")
    to_order = F.col("event_type") == "purchase"
    joined = events.join(table(spark, d, "orders"), to_order & (F.col("event_id") == F.col("o_orderkey")), "left").join(
        table(spark, d, "customer"), ~to_order & (F.col("user_id") == F.col("c_custkey")), "left"
    )
    kind = F.when(F.col("o_orderkey").isNotNull(), "order").when(F.col("c_custkey").isNotNull(), "customer").otherwise("none")
    return joined.select("event_id", kind.alias("target"), F.coalesce(F.col("o_orderstatus"), F.col("c_mktsegment")).alias("label"))


POLYMORPHIC = """
SELECT event_id, CASE WHEN o_orderkey IS NOT NULL THEN 'order' WHEN c_custkey IS NOT NULL THEN 'customer' ELSE 'none' END AS target,
  coalesce(o_orderstatus, c_mktsegment) AS label
FROM events LEFT JOIN orders ON event_type = 'purchase' AND event_id = o_orderkey LEFT JOIN customer ON event_type <> 'purchase' AND user_id = c_custkey"""


def anti_stale(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no line of a large quantity holds."""
    seen = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(seen, "p_partkey", "left_anti").select("p_partkey", "p_name")


ANTI = "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45)"


def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "orders").where("o_orderdate >= '2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(late, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


SEMI = "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '2001-01-01')"


def outer_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots of the orders: what was added, removed, changed."""
    orders = table(spark, d, "orders")
    old = orders.where("o_orderkey % 7 <> 0")
    new = orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return relate.diff(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


DIFF = """
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
  WHEN o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND o.o_totalprice IS NOT DISTINCT FROM n.o_totalprice THEN 'same' ELSE 'changed' END AS status
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""


def range_asof_interval(spark: SparkSession, d: str) -> DataFrame:
    """Lines shipped between an order of the customer and the next one."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    joined = relate.in_last_interval(
        orders.select("o_custkey", F.col("o_orderdate").alias("at"), "o_orderkey"), lines.select("o_custkey", F.col("l_shipdate").alias("at")), ["o_custkey"], "at", "o_orderkey"
    )
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.min("at").alias("first_ship"))


ASOF = """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders),
l AS (SELECT l_shipdate, o_custkey AS cust FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*) AS n_lines, min(l_shipdate) AS first_ship FROM o JOIN l ON o_custkey = cust AND l_shipdate >= o_orderdate AND (until IS NULL OR l_shipdate < until)
GROUP BY 1"""


def key_precedence(spark: SparkSession, d: str) -> DataFrame:
    """A part's note by exact name, then by lower-cased first word."""
    part = table(spark, d, "part")
    notes = part.groupBy(F.split("p_name", " ")[0].alias("word")).agg(F.min("p_partkey").alias("note"))
    exact = part.where("p_size = 7").groupBy("p_name").agg(F.min("p_partkey").alias("note")).select(F.col("p_name").alias("word"), "note")
    lookup = notes.unionByName(exact).groupBy("word").agg(F.min("note").alias("note"))
    return relate.first_match(part, [F.col("p_name"), F.split("p_name", " ")[0]], lookup, "word", "note", "note").select("p_partkey", "note")


PRECEDENCE = """
WITH w AS (SELECT split_part(p_name, ' ', 1) AS word, p_partkey FROM part UNION ALL SELECT p_name, p_partkey FROM part WHERE p_size = 7),
k AS (SELECT word, min(p_partkey) AS note FROM w GROUP BY 1)
SELECT p_partkey, coalesce(a.note, b.note) AS note FROM part LEFT JOIN k a ON a.word = p_name LEFT JOIN k b ON b.word = split_part(p_name, ' ', 1)"""


def siblings(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of the same nation, other than itself."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    heads = s.groupBy("s_nationkey").agg(F.count("*").alias("all"), F.min("s_suppkey").alias("one"))
    others = s.join(heads, "s_nationkey").where("s_suppkey <> one").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("two"))
    joined = s.join(heads, "s_nationkey").join(others, "s_nationkey")
    return joined.select("s_suppkey", (F.col("all") - 1).alias("n"), F.when(F.col("one") == F.col("s_suppkey"), F.col("two")).otherwise(F.col("one")).alias("first_sibling"))


SIBLINGS = """SELECT a.s_suppkey, count(*) AS n, min(b.s_suppkey) AS first_sibling FROM supplier a JOIN supplier b
ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY 1"""


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each folded text, whole, and how many share it."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("key"))
    return relate.keep_first(docs, ["key"], ["doc_id"]).select("doc_id", "key", "n_rows")


DEDUPE_FIRST = """SELECT min(doc_id) AS doc_id, sha256(lower(text)) AS key, count(*) AS n_rows FROM documents GROUP BY lower(text)"""


def dedupe_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same by one aggregate: no group of copies comes into one task."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows")).select("doc_id", "key", "n_rows")


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user and type wins."""
    return relate.keep_first(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type", "n_rows")


DEDUPE_LAST = """SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type) AS n_rows FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def renumber_positions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, d, "conversations").where("role <> 'system'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    nth = F.count("*").over(Window.partitionBy("conv_id", "role").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return turns.select("conv_id", "turn", place.alias("place"), nth.alias("nth_of_role"))


RENUMBER = """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place,
  count(*) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS UNBOUNDED PRECEDING) AS nth_of_role FROM conversations WHERE role <> 'system'"""


def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase's value so far, for every event of a user."""
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return relate.carried(table(spark, d, "events"), ["user_id"], "event_id", value, "last_purchase").select("event_id", "last_purchase")


CARRY = """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events"""


def running_max_violation(spark: SparkSession, d: str) -> DataFrame:
    return relate.below_running_max(table(spark, d, "events"), ["user_id"], "event_id", "value").select("event_id", "value", "highest_before")


RUNNING_MAX = """SELECT event_id, value, m AS highest_before FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM events) WHERE value < m"""


def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    return relate.longest_run(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type").isin("view", "click"))


ISLANDS = """
WITH m AS (SELECT user_id, event_type IN ('view', 'click') AS flag, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
i AS (SELECT user_id, flag, n - row_number() OVER (PARTITION BY user_id, flag ORDER BY ts, event_id) AS island FROM m),
r AS (SELECT user_id, flag, island, count(*) AS run FROM i GROUP BY ALL)
SELECT user_id, coalesce(max(run) FILTER (flag), 0) AS longest FROM r GROUP BY 1"""


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Union, intersection and difference of id sets."""
    docs = table(spark, d, "documents")
    a, b = docs.where("n_chars > 2000").select("doc_id"), table(spark, d, "labels").where("quality = 1").select("doc_id")
    legs = {"union": a.union(b).distinct(), "both": a.intersect(b), "only_long": a.subtract(b), "only_good": b.subtract(a)}
    out = None
    for name, leg in legs.items():
        one = leg.select(F.lit(name).alias("part"), "doc_id")
        out = one if out is None else out.unionByName(one)
    return out


SETS = """
WITH a AS (SELECT doc_id FROM documents WHERE n_chars > 2000), b AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT 'union' AS part, doc_id FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'both', doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_long', doc_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_good', doc_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""


def closure(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors over a hierarchy of parts: each part's parent is the one of half its key."""
    edges = table(spark, d, "part").where("p_partkey > 0").select("p_partkey", F.expr("p_partkey div 2").alias("parent"))
    return relate.closure(edges, "p_partkey", "parent").select("child", "ancestor", F.col("depth").cast("int").alias("depth"))


CLOSURE = """
WITH RECURSIVE c(child, ancestor, depth) AS (
  SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_partkey > 0
  UNION ALL SELECT child, ancestor // 2, depth + 1 FROM c WHERE ancestor > 0)
SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM c GROUP BY 1, 2"""

QUERIES = {
    "polymorphic_left_join": (polymorphic_left_join, POLYMORPHIC),
    "anti_stale": (anti_stale, ANTI),
    "semi_exists": (semi_exists, SEMI),
    "outer_diff": (outer_diff, DIFF),
    "range_asof_interval": (range_asof_interval, ASOF),
    "key_precedence": (key_precedence, PRECEDENCE),
    "siblings": (siblings, SIBLINGS),
    "dedupe_first": (dedupe_first, DEDUPE_FIRST),
    "dedupe_whole": (dedupe_whole, DEDUPE_FIRST),
    "dedupe_last": (dedupe_last, DEDUPE_LAST),
    "renumber_positions": (renumber_positions, RENUMBER),
    "carry_forward": (carry_forward, CARRY),
    "running_max_violation": (running_max_violation, RUNNING_MAX),
    "gaps_islands": (gaps_islands, ISLANDS),
    "set_ops": (set_ops, SETS),
    "closure": (closure, CLOSURE),
}
