"""Queries of publishing rules over snapshots of orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import publish, relate
from tessera.session import table


def duplicate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Parts of odd keys go into a part of an even key of the same brand, name and type; their lines move with them."""
    part = table(spark, d, "part")
    mapping = publish.absorbed(part.where("p_partkey % 2 = 0"), part.where("p_partkey % 2 = 1"), ["p_brand", "p_name", "p_type"], "p_partkey")
    links = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    moved = publish.moved_links(links, "l_partkey", mapping)
    return moved.groupBy("l_partkey").agg(F.count("*").alias("n_suppliers"))


DUPLICATE_MERGE = """
WITH h AS (SELECT p_brand, p_name, p_type, min(p_partkey) AS head FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL),
m AS (SELECT p_partkey AS id, coalesce(head, p_partkey) AS kept FROM part LEFT JOIN h USING (p_brand, p_name, p_type) WHERE p_partkey % 2 = 1),
l AS (SELECT DISTINCT coalesce(kept, l_partkey) AS l_partkey, l_suppkey FROM lineitem LEFT JOIN m ON id = l_partkey)
SELECT l_partkey, count(*) AS n_suppliers FROM l GROUP BY 1"""


def relink(spark: SparkSession, d: str) -> DataFrame:
    """Customers' links to a supplier of their nation, by policy: manual ones stay, some have none, others take the best."""
    best = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("found"))
    c = table(spark, d, "customer").join(F.broadcast(best), F.col("c_nationkey") == F.col("s_nationkey"), "left")
    policy = F.when(F.col("c_custkey") % 5 == 0, "manual").when(F.col("c_custkey") % 7 == 0, "none").otherwise("auto")
    old = F.when(F.col("c_custkey") % 3 > 0, (F.col("c_custkey") % 10 + 1))
    return publish.relinked(c, "c_custkey", old, policy, F.col("found"))


RELINK = """
WITH b AS (SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1),
l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 10 + 1 END AS old, CASE WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 10 + 1 END
  WHEN c_custkey % 7 = 0 THEN NULL ELSE s_suppkey END AS link FROM customer LEFT JOIN b ON c_nationkey = s_nationkey)
SELECT c_custkey, link FROM l WHERE old IS DISTINCT FROM link"""

_OLD = "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 7 <> 0"
_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 9 <> 0"


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").withColumn("price", F.round("o_totalprice", 2))
    old = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus", "price")
    status = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    return old, orders.where("o_orderkey % 9 <> 0").select("o_orderkey", status.alias("o_orderstatus"), "price")


def sheet_upsert(spark: SparkSession, d: str) -> DataFrame:
    """What a sheet's import does to every order: keys that were deleted, edited rows, stale rows; and their cap."""
    old, new = _snapshots(spark, d)
    dead = new.where("o_orderkey % 13 = 0")
    acted = publish.sheet_actions(old, new, dead, "o_orderkey", ["o_orderstatus", "price"], F.col("o_orderkey") % 17 == 0)
    counts = acted.groupBy("action").agg(F.count("*").alias("n"))
    total = old.agg(publish.most_stale(F.count("*")).alias("most_stale"))
    return counts.join(F.broadcast(total), F.lit(True))


SHEET = f"""
WITH o AS ({_OLD}), n AS ({_NEW}),
j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS k, o.o_orderkey AS a, n.o_orderkey AS b, o.o_orderstatus IS NOT DISTINCT FROM n.o_orderstatus AND o.price IS NOT DISTINCT FROM n.price AS same
  FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey),
c AS (SELECT CASE WHEN b IS NOT NULL AND k % 13 = 0 THEN 'tombstone' WHEN a IS NULL THEN 'insert' WHEN k % 17 = 0 THEN 'keep' WHEN b IS NULL THEN 'stale' WHEN same THEN 'skip' ELSE 'update' END AS action FROM j)
SELECT action, count(*) AS n, (SELECT CAST(greatest(5, floor(count(*) * 0.1)) AS BIGINT) FROM o) AS most_stale FROM c GROUP BY 1"""


def slug_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Added, updated, kept, same and missing rows, with the fields that differ."""
    old, new = _snapshots(spark, d)
    return publish.slug_upsert(old, new, "o_orderkey", ["o_orderstatus", "price"], F.col("o_orderkey") % 17 == 0)


SLUG_UPSERT = f"""
WITH o AS ({_OLD}), n AS ({_NEW}), j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, o.o_orderkey AS a, n.o_orderkey AS b,
  concat_ws(',', CASE WHEN n.o_orderstatus IS DISTINCT FROM o.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN n.price IS DISTINCT FROM o.price THEN 'price' END) AS diff FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT o_orderkey, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'missing' WHEN diff = '' THEN 'same' WHEN o_orderkey % 17 = 0 THEN 'kept' ELSE 'updated' END AS action,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN diff END AS changed FROM j"""


def version_choice(spark: SparkSession, d: str) -> DataFrame:
    """A version for every content that a day's events published."""
    events = table(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("digest", F.sha2(F.concat_ws("|", "event_type", (F.col("user_id") % 5).cast("string")), 256))
    return publish.versions(events, "day", "event_id", "digest")


VERSIONS = """
WITH c AS (SELECT CAST(ts AS DATE) AS day, sha256(event_type || '|' || (user_id % 5)) AS digest, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT day, digest, strftime(day, '%Y-%m-%d') || '.' || row_number() OVER (PARTITION BY day ORDER BY first, digest) AS version FROM c"""


def diff_gate(spark: SparkSession, d: str) -> DataFrame:
    """Orders by status of the first snapshot: how many stay, and which groups shrank by more than a tenth."""
    old, new = _snapshots(spark, d)
    compared = relate.diff(old, new, "o_orderkey", ["o_orderstatus", "price"]).withColumn("group", (F.col("o_orderkey") % 10).cast("long"))
    return publish.gate(compared, "group", 0.9)


GATE = f"""
WITH o AS ({_OLD}), n AS ({_NEW}), j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) % 10 AS g, o.o_orderkey AS a, n.o_orderkey AS b,
  o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.price IS DISTINCT FROM n.price AS differs FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT g AS "group", count(a) AS n_before, count(b) AS n_after, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND differs) AS n_changed, count(b) < 0.9 * count(a) AS flagged FROM j GROUP BY 1"""


def deny_list(spark: SparkSession, d: str) -> DataFrame:
    """Supplier and part pairs of lines that no returned line has."""
    lines = table(spark, d, "lineitem")
    return publish.denied(lines.select("l_partkey", "l_suppkey").distinct(), lines.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"])


DENY = "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)"


def free_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Slugs of a brand's parts, some of which carry a number already: every row's own is free."""
    slug = F.concat(text.slug(F.col("p_name")), F.when(F.col("p_partkey") % 6 == 0, "-2").when(F.col("p_partkey") % 10 == 1, "-4").otherwise(""))
    parts = table(spark, d, "part").select("p_partkey", "p_brand", slug.alias("slug")).withColumn("slug", F.when(F.col("p_partkey") % 6 == 0, F.concat("slug", F.col("p_partkey").cast("string"))).otherwise(F.col("slug")))
    return publish.free_names(parts, ["p_brand"], "slug", "p_partkey").select("p_partkey", "p_brand", F.col("free").alias("slug"))


FREE = r"""
WITH RECURSIVE s AS (SELECT p_partkey, p_brand, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 6 = 0 THEN '-2' || p_partkey WHEN p_partkey % 10 = 1 THEN '-4' ELSE '' END AS slug FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) AS nth FROM s),
g AS (SELECT DISTINCT p_brand, regexp_extract(slug, '^(.*)-([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(slug, '^(.*)-([1-9][0-9]*)$', 2) AS INT) AS n FROM s WHERE regexp_matches(slug, '^(.*)-([1-9][0-9]*)$')),
f(p_partkey, p_brand, slug, nth, now, seen) AS (
  SELECT p_partkey, p_brand, slug, nth, nth, 0 FROM r
  UNION ALL SELECT f.p_partkey, f.p_brand, f.slug, nth, now + 1, x.n FROM f JOIN LATERAL (SELECT min(n) AS n FROM g WHERE g.p_brand = f.p_brand AND g.base = f.slug AND n > f.seen AND n >= 2 AND n <= f.now) x ON x.n IS NOT NULL)
SELECT p_partkey, p_brand, CASE WHEN nth = 1 THEN slug ELSE slug || '-' || max(now) END AS slug FROM f GROUP BY p_partkey, p_brand, slug, nth"""

QUERIES = {
    "duplicate_merge": (duplicate_merge, DUPLICATE_MERGE),
    "relink": (relink, RELINK),
    "sheet_upsert": (sheet_upsert, SHEET),
    "slug_upsert": (slug_upsert, SLUG_UPSERT),
    "version_choice": (version_choice, VERSIONS),
    "diff_gate": (diff_gate, GATE),
    "deny_list": (deny_list, DENY),
    "free_slugs": (free_slugs, FREE),
}
