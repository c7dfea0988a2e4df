"""Queries of ordered lists, elections and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import browse, lists, relate
from tessera.session import table


def loose_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists of a part's values without loose repeats, toggled, moved and merged with another."""
    part = table(spark, d, "part")
    values = F.array("p_brand", F.upper("p_name"), "p_name", F.lit(" "), "p_type", F.lower("p_brand"))
    ids = F.array(F.col("p_partkey"), F.col("p_partkey") % 7, F.lit(3).cast("long"))
    new = F.array(F.lit(3).cast("long"), F.col("p_size").cast("long"))
    show = lambda x: F.array_join(x, "|")
    return part.select(
        "p_partkey", show(lists.loose_distinct(values, 2)).alias("capped"), show(lists.toggled(F.array("p_brand", "p_type"), F.upper("p_type"))).alias("off"),
        show(lists.toggled(F.array("p_brand"), F.col("p_type"))).alias("on"), show(lists.moved(F.array("p_brand", "p_type", "p_name"), F.lit(1), (F.col("p_partkey") % 3 + 1).cast("int"))).alias("moved"),
        show(lists.merged_ids(ids, new, 4, F.col("p_partkey") % 5 == 0)).alias("ids"),
    )


LOOSE = """
WITH p AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN [3, p_size::BIGINT] ELSE [p_partkey, p_partkey % 7, 3, 3, p_size::BIGINT] END AS v FROM part)
SELECT p_partkey, p_brand || '|' || upper(p_name) AS capped, p_brand AS off, p_brand || '|' || p_type AS on,
  CASE p_partkey % 3 WHEN 0 THEN concat_ws('|', p_brand, p_type, p_name) WHEN 1 THEN concat_ws('|', p_type, p_brand, p_name) ELSE concat_ws('|', p_type, p_name, p_brand) END AS moved,
  array_to_string(list_filter(v, lambda x, i: NOT list_contains(v[:i - 1], x))[:4], '|') AS ids FROM p"""


def merged_lists(spark: SparkSession, d: str) -> DataFrame:
    """A user's event types by first time, with those of another list put in behind their neighbours."""
    events = table(spark, d, "events")
    best = events.where("value > 30").groupBy("user_id", "event_type").agg(F.min("event_id").alias("place"))
    other = events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("place"))
    return lists.inserted(best, other, ["user_id"], "event_type", "place")


MERGED = """
WITH b AS (SELECT user_id, event_type, min(event_id) AS anchor FROM events WHERE value > 30 GROUP BY 1, 2), o AS (SELECT user_id, event_type, min(event_id) AS place FROM events GROUP BY 1, 2),
m AS (SELECT o.*, anchor, coalesce(last_value(anchor IGNORE NULLS) OVER (PARTITION BY o.user_id ORDER BY place ROWS UNBOUNDED PRECEDING), 0) AS behind FROM o LEFT JOIN b ON b.user_id = o.user_id AND b.event_type = o.event_type),
u AS (SELECT user_id, event_type, anchor AS behind, 0 AS l, 0 AS a FROM b UNION ALL SELECT user_id, event_type, behind, 1, place FROM m WHERE anchor IS NULL)
SELECT user_id, event_type, l = 1 AS added, row_number() OVER (PARTITION BY user_id ORDER BY behind, l, a, event_type) AS place FROM u"""


def split_lists(spark: SparkSession, d: str) -> DataFrame:
    """Users' events, parted where their first type comes again: how many of each part."""
    runs = lists.split_where_repeated(table(spark, d, "events"), ["user_id"], "event_type", "event_id")
    return runs.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


SPLIT = """
WITH f AS (SELECT user_id, event_id, event_type = first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS again FROM events),
r AS (SELECT user_id, event_id, CAST(sum(again::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f)
SELECT user_id, run, count(*) AS n, min(event_id) AS first_event FROM r GROUP BY 1, 2"""


def unpivot_versions(spark: SparkSession, d: str) -> DataFrame:
    """A nation's customers in two lists: their segments, and balances above zero."""
    c = table(spark, d, "customer").withColumn("balance", F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal"))).withColumn("segment", F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")))
    return lists.unpivoted(c, ["c_nationkey"], ["segment", "balance"], "c_custkey")


UNPIVOT = """
WITH l AS (SELECT c_nationkey, c_custkey, 'segment' AS version, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment END AS item FROM customer
  UNION ALL SELECT c_nationkey, c_custkey, 'balance', CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT)::VARCHAR END FROM customer)
SELECT c_nationkey, version, item, row_number() OVER (PARTITION BY c_nationkey, version ORDER BY c_custkey) AS place FROM l WHERE item IS NOT NULL"""


def grouped_lists(spark: SparkSession, d: str) -> DataFrame:
    """An order's part keys by return flag, in line order, the fourth line's last."""
    lines = table(spark, d, "lineitem").withColumn("at", F.when(F.col("l_linenumber") != 4, F.col("l_linenumber")))
    made = lists.grouped(lines, ["l_orderkey"], "l_returnflag", "at", "l_partkey")
    return made.select("l_orderkey", "l_returnflag", F.array_join("items", ",").alias("items"))


GROUPED = """SELECT l_orderkey, l_returnflag, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber = 4, l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1, 2"""


def year_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """A customer's year from three sources, the oldest that is not excluded; whether they disagree by more than two; its season."""
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.year(F.min("l_shipdate")).alias("shipped"))
    rows = orders.join(lines, "o_orderkey", "left").groupBy("o_custkey").agg(
        F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last"), F.min("shipped").alias("shipped")
    )
    years = F.filter(F.array("first", "last", "shipped"), lambda y: y.isNotNull() & ~y.isin(1992, 1993))
    label = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("–", F.col("first").cast("string"), F.lpad((F.col("last") % 100).cast("string"), 2, "0")))
    return rows.select("o_custkey", F.array_min(years).alias("year"), (F.array_max(years) - F.array_min(years) > 2).alias("conflict"), label.alias("season"))


YEARS = """
WITH l AS (SELECT l_orderkey, year(min(l_shipdate)) AS shipped FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b, min(shipped) AS s FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1),
y AS (SELECT *, list_filter([a, b, s], lambda v: v IS NOT NULL AND v NOT IN (1992, 1993)) AS v FROM r)
SELECT o_custkey, CAST(list_min(v) AS INT) AS year, list_max(v) - list_min(v) > 2 AS conflict, CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || lpad((b % 100)::VARCHAR, 2, '0') END AS season FROM y"""


def preferred_group(spark: SparkSession, d: str) -> DataFrame:
    """The supplier that most of a brand's parts (two at least) share, the smallest of equals; each brand's sets of types and sizes."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = pairs.groupBy("p_brand", "l_suppkey").agg(F.count_distinct("l_partkey").alias("n_parts")).where("n_parts >= 2")
    best = counts.groupBy("p_brand").agg(F.max(F.struct("n_parts", (-F.col("l_suppkey")).alias("s"))).alias("best"))
    sets = table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("types"), F.count_distinct("p_size").alias("n_sizes"))
    joined = sets.join(best, "p_brand", "left")
    return joined.select("p_brand", (-F.col("best.s")).alias("l_suppkey"), "best.n_parts", F.array_join("types", " ").alias("types"), "n_sizes")


PREFERRED = """
WITH c AS (SELECT p_brand, l_suppkey, count(DISTINCT l_partkey) AS n_parts FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
b AS (SELECT * FROM c WHERE n_parts >= 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n_parts DESC, l_suppkey) = 1),
s AS (SELECT p_brand, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) AS types, count(DISTINCT p_size) AS n_sizes FROM part GROUP BY 1)
SELECT s.p_brand, l_suppkey, n_parts, types, n_sizes FROM s LEFT JOIN b ON b.p_brand = s.p_brand"""


def bytes_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Characters of the documents that a source refers to by any of two ways, each counted once; and whether a quota holds."""
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    labelled = table(spark, d, "labels").join(docs, "doc_id")
    refs = labelled.where("quality = 1").select("source", "doc_id", "n_chars").union(docs.where("n_chars < 500").select("source", "doc_id", "n_chars")).distinct()
    used = refs.groupBy("source").agg(F.sum("n_chars").alias("used"), F.count("*").alias("n_files"))
    every = docs.select("source").distinct().join(used, "source", "left")
    return every.select("source", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("n_files", F.lit(0)).alias("n_files"), (F.coalesce("used", F.lit(0)) < 100_000).alias("free"))


BYTES = """
WITH r AS (SELECT source, d.doc_id, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 UNION SELECT source, doc_id, n_chars FROM documents WHERE n_chars < 500),
u AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS used, count(*) AS n_files FROM r GROUP BY 1)
SELECT s.source, coalesce(used, 0) AS used, coalesce(n_files, 0) AS n_files, coalesce(used, 0) < 100000 AS free FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN u ON u.source IS NOT DISTINCT FROM s.source"""


def kept_counts(spark: SparkSession, d: str) -> DataFrame:
    """A customer's stored count of orders against the true one, written only where it differs; sold parts by any of two ways."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    stored = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 20).alias("stored"))
    return stored.join(orders, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("NOT stored <=> n").select("c_custkey", "n")


KEPT = """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) <> c_custkey % 20"""


def dated_order(spark: SparkSession, d: str) -> DataFrame:
    """The first orders by display place, undated ones last, then date and folded name; with a label table's values attached."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    day = F.when(F.col("o_orderkey") % 9 != 0, F.to_date("o_orderdate"))
    order = [(F.col("o_orderkey") % 3).asc(), F.col("day").asc_nulls_last(), F.lower("c_name").asc_nulls_last(), F.col("o_orderkey").asc()]
    first = o.withColumn("day", day).orderBy(*order).limit(60)
    labels = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "").alias("flags"))
    return first.join(labels, "o_orderkey", "left").select("o_orderkey", "day", "c_name", "flags")


DATED = """
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  ORDER BY o_orderkey % 3, day NULLS LAST, lower(c_name) NULLS LAST, o_orderkey LIMIT 60),
l AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1)
SELECT o_orderkey, day, c_name, flags FROM f LEFT JOIN l ON l_orderkey = o_orderkey"""


def fallback_matches(spark: SparkSession, d: str) -> DataFrame:
    """For asked names, the best eight of a first source; a second one's where the first has none good enough."""
    source = F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(2)
    part = table(spark, d, "part").where("p_partkey IS NOT NULL").select("p_partkey", "p_name", "p_brand", "p_size", source.alias("source"))
    asked = part.where("p_partkey % 40 = 0").select(F.col("p_partkey").alias("q"), F.col("p_name").alias("qn"), F.col("p_brand").alias("qb"))
    # of a name and source, eight and the asked one itself can count of a brand, and as many of all others: of these at most nine
    # are the asked one's brand and stand before them
    order = [(F.col("p_size") % 20).asc_nulls_last(), F.col("p_partkey")]
    own = browse.top_by(part, ["p_name", "p_brand", "source"], order, 9)
    others = browse.top_by(own, ["p_name", "source"], order, 18)
    same = F.coalesce(F.col("qb") == F.col("p_brand"), F.lit(False))
    named = F.col("qn") == F.col("p_name")
    found = asked.join(own, named & (F.col("qb") == F.col("p_brand"))).unionByName(asked.join(others, named).where(~same)).where("q <> p_partkey")
    score = (60 + F.when(same, 30).otherwise(0) - F.col("p_size") % 20).cast("int")
    scored = found.select("q", "p_partkey", score.alias("score"), "source")
    good = scored.where("source = 1").groupBy("q").agg((F.max("score") >= 60).alias("good"))
    used = scored.join(good, "q", "left").where("source = 1 OR NOT coalesce(good, false)")
    top = browse.top_by(used, ["q"], [F.desc("score"), F.asc("source"), F.asc("p_partkey")], 8)
    return top.select("q", "p_partkey", "score", "source", F.col("rank").cast("long").alias("rank"))


FALLBACK = """
WITH s AS (SELECT q.p_partkey AS q, p.p_partkey, CAST(60 + CASE WHEN q.p_brand = p.p_brand THEN 30 ELSE 0 END - p.p_size % 20 AS INT) AS score, CAST(CASE WHEN p.p_partkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS source
  FROM part q JOIN part p ON q.p_name = p.p_name AND q.p_partkey <> p.p_partkey WHERE q.p_partkey % 40 = 0),
g AS (SELECT q, max(score) >= 60 AS good FROM s WHERE source = 1 GROUP BY 1)
SELECT s.q, p_partkey, score, source, row_number() OVER (PARTITION BY s.q ORDER BY score DESC, source, p_partkey) AS rank FROM s LEFT JOIN g ON g.q = s.q WHERE source = 1 OR NOT coalesce(good, false)
QUALIFY rank <= 8"""


def resolved_shows(spark: SparkSession, d: str) -> DataFrame:
    """The customer that a supplier most likely is: name key of the nation, points for balance and segment; a tie goes to the
    one with more orders, and to none if that is a tie too."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("asked"))
    c = table(spark, d, "customer")
    votes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("votes"))
    liked = F.coalesce(F.col("c_mktsegment") == "MACHINERY", F.lit(False))
    rank = F.struct(liked.alias("liked"), F.coalesce("votes", F.lit(0)).alias("votes"))
    known = c.join(votes, "c_custkey", "left").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"), rank.alias("rank"), F.col("c_custkey").alias("key"), F.lit(1).cast("long").alias("n"))
    near = relate.best_within(s.select("nation", "asked").distinct(), known, "nation", "asked", "at", 500).withColumnRenamed("top", "near")
    far = relate.best_ranked(known, "nation").withColumnRenamed("top", "far")
    each = s.join(far, "nation").join(near.withColumnsRenamed({"nation": "n_", "asked": "a_"}), (F.col("nation") == F.col("n_")) & (F.col("asked") == F.col("a_")), "left")
    # one that is near has more points than any that is not
    top = F.coalesce("near", "far")
    score = (8 + F.when(F.col("near").isNotNull(), 3).otherwise(0) + F.when(top["rank"]["liked"], 2).otherwise(0)).cast("int")
    placed = each.select("s_suppkey", F.struct(score.alias("score"), top["rank"]["votes"].alias("votes")).alias("rank"), top["n"].alias("n"), top["key"].alias("key"))
    best = relate.best_ranked(placed, "s_suppkey")
    alone = (F.col("top.n") == 1) & (F.col("top.rank.votes") > 0)
    return best.select("s_suppkey", F.when(alone, F.col("top.key")).alias("c_custkey"), F.col("top.rank.score").alias("score"))


RESOLVED = """
WITH v AS (SELECT o_custkey, count(*) AS votes FROM orders GROUP BY 1),
p AS (SELECT s_suppkey, c_custkey, CAST(8 + CASE WHEN abs(s_acctbal - c_acctbal) <= 500 THEN 3 ELSE 0 END + CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 0 END AS INT) AS score, coalesce(votes, 0) AS votes
  FROM supplier JOIN customer ON s_nationkey = c_nationkey LEFT JOIN v ON o_custkey = c_custkey),
r AS (SELECT *, rank() OVER (PARTITION BY s_suppkey ORDER BY score DESC, votes DESC) AS k FROM p)
SELECT s_suppkey, CASE WHEN count(*) = 1 AND max(votes) > 0 THEN min(c_custkey) END AS c_custkey, max(score) AS score FROM r WHERE k = 1 GROUP BY 1"""

QUERIES = {
    "loose_lists": (loose_lists, LOOSE),
    "merged_lists": (merged_lists, MERGED),
    "split_lists": (split_lists, SPLIT),
    "unpivot_versions": (unpivot_versions, UNPIVOT),
    "grouped_lists": (grouped_lists, GROUPED),
    "year_conflicts": (year_conflicts, YEARS),
    "preferred_group": (preferred_group, PREFERRED),
    "bytes_by_source": (bytes_by_source, BYTES),
    "kept_counts": (kept_counts, KEPT),
    "dated_order": (dated_order, DATED),
    "fallback_matches": (fallback_matches, FALLBACK),
    "resolved_shows": (resolved_shows, RESOLVED),
}
