"""Queries that write documents and sheets and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import relate
from tessera.plans.publish import _NEW, _OLD, _snapshots
from tessera.session import shared_folder, table
from tessera.sources import bigjson, documents, published, sheets

SHOW = "key long, title string, songs array<struct<id: long, status: string, price: double>>"


def _shows(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders as nested rows."""
    song = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("price"))
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_list(song)).alias("songs"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("title")).join(orders, "key")


def document_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents written once as gzipped JSON (a second write of the same content does nothing) and read again."""
    folder, shows = shared_folder(spark, "shows"), _shows(spark, d)
    digest, written = documents.write_if_changed(shows, folder, "key", None)
    again = documents.write_if_changed(shows, folder, "key", digest)
    rows, rejects = documents.read_lines(spark, folder, SHOW)
    songs = rows.select("key", "title", F.explode("songs").alias("s")).groupBy("key", "title").agg(F.count("*").alias("n"), F.max("s.price").alias("most"), F.count_if(F.col("s.status") == "F").alias("n_final"))
    return songs.withColumns({"written": F.lit(written), "again": F.lit(again[1])}).join(F.broadcast(rejects.agg(F.count("*").alias("n_rejects"))), F.lit(True))


ROUND_TRIP = """SELECT c_custkey AS key, c_name AS title, count(*) AS n, round(max(o_totalprice), 2) AS most, count(*) FILTER (o_orderstatus = 'F') AS n_final,
  true AS written, false AS again, 0::BIGINT AS n_rejects FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"""


def split_document(spark: SparkSession, d: str) -> DataFrame:
    """A document of each nation, whose array is parted into texts; each is parsed alone and broken ones are left out."""
    broken = F.when(F.col("c_custkey") % 50 == 0, F.to_json(F.struct(F.lit("no number").alias("key")))).otherwise(F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))))
    docs = table(spark, d, "customer").withColumn("text", broken).groupBy("c_nationkey", F.expr("c_custkey div 500")).agg(F.array_join(F.collect_list("text"), ",").alias("all"))
    docs = docs.select(F.concat(F.lit('{"version":"'), F.col("c_nationkey").cast("string"), F.lit('","shows":['), "all", F.lit("]}")).alias("document"))
    parts = documents.split_elements(docs, "document", "shows", ["version"])
    each = parts.select(F.col("version").cast("int").alias("nation"), F.from_json("element", "key long, segment string").alias("x"))
    return each.groupBy("nation").agg(F.count("*").alias("n_parts"), F.count("x.key").alias("n_read"), F.sum("x.key").alias("keys"), F.count_distinct("x.segment").alias("n_segments"))


SPLIT_DOCUMENT = """SELECT CAST(c_nationkey AS INT) AS nation, count(*) AS n_parts, count(*) FILTER (c_custkey % 50 <> 0) AS n_read, CAST(sum(c_custkey) FILTER (c_custkey % 50 <> 0) AS BIGINT) AS keys,
  count(DISTINCT CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END) AS n_segments FROM customer GROUP BY 1"""


def seed_scan(spark: SparkSession, d: str) -> DataFrame:
    """Seed rows as JSON: invalid ones are skipped, and the first of a slug wins; the table gets columns that it lacks."""
    part = table(spark, d, "part")
    slug = F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.lower("p_type"))
    text = F.when(F.col("p_partkey") % 11 == 0, "{broken").otherwise(F.to_json(F.struct(slug.alias("slug"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))))
    found = documents.seeds(part.select("p_partkey", text.alias("text")), "text", "p_partkey", "slug string, size int, brand string", "slug", (F.col("slug") != "") & F.col("size").between(1, 40))
    return documents.evolved(found, {"brand": "int", "place": "string"}).select("slug", "p_partkey", "size", "brand", "place")


SEEDS = """
WITH s AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || lower(p_type) AS slug, p_size AS size, p_brand AS brand FROM part WHERE p_partkey % 11 <> 0 AND p_size BETWEEN 1 AND 40)
SELECT slug, p_partkey, size, brand, NULL::VARCHAR AS place FROM s QUALIFY row_number() OVER (PARTITION BY slug ORDER BY p_partkey) = 1"""


def sheet_regions(spark: SparkSession, d: str) -> DataFrame:
    """A sheet of each brand with two regions side by side, whose headings stand in some row: both as rows."""
    part = table(spark, d, "part")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + F.length("p_brand") % 3 + 1
    body = part.select("p_brand", at.cast("int").alias("row"), F.array(F.concat(F.lit("  "), "p_name", F.lit(" ")), F.lit(None).cast("string"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ")).alias("cells"))
    head = part.select("p_brand").distinct().select("p_brand", (F.length("p_brand") % 3 + 1).cast("int").alias("row"), F.array(F.lit("Solo "), F.lit(""), F.lit("DUET")).alias("cells"))
    title = head.select("p_brand", F.lit(0).alias("row"), F.array(F.lit("A sheet")).alias("cells"))
    return documents.regions(title.unionByName(head).unionByName(body), "p_brand", "row", "cells", {"solo": "solo", "duet": "duet"})


SHEETS = """
WITH b AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + length(p_brand) % 3 + 1 AS INT) AS row FROM part)
SELECT p_brand, 'solo' AS region, row, p_name AS value FROM b UNION ALL SELECT p_brand, 'duet', row, p_type FROM b WHERE p_size > 25"""


def export_sheets(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one or two lines as two sheets with their lines as columns and lengths as texts, written as CSV and read again."""
    # of lines with one number, the table's first that has a flag: by file and row, however tasks read them
    lines = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_orderkey", "l_linenumber", "l_returnflag", F.struct("_metadata.file_path", "_metadata.row_index").alias("at"))
    flag = lambda n: F.min_by("l_returnflag", F.when((F.col("l_linenumber") == n) & F.col("l_returnflag").isNotNull(), F.col("at")))
    rows = lines.groupBy("l_orderkey").agg(flag(1).alias("first"), flag(2).alias("second")).withColumn("kind", F.when(F.col("second").isNull(), "solo").otherwise("duet"))
    seconds = (F.col("l_orderkey") % 400).cast("int")
    rows = rows.withColumn("length", F.format_string("%d:%02d", F.floor(seconds / 60), seconds % 60))
    folder = shared_folder(spark, "sheets")
    rows.write.partitionBy("kind").option("header", "true").csv(folder)
    back = spark.read.option("header", "true").schema("l_orderkey long, first string, second string, length string, kind string").csv(folder)
    return back.select("kind", "l_orderkey", "first", "second", "length")


EXPORT = """
WITH l AS (SELECT l_orderkey, any_value(l_returnflag) FILTER (l_linenumber = 1) AS first, any_value(l_returnflag) FILTER (l_linenumber = 2) AS second FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
SELECT CASE WHEN second IS NULL THEN 'solo' ELSE 'duet' END AS kind, l_orderkey, first, second, (l_orderkey % 400 // 60) || ':' || lpad((l_orderkey % 400 % 60)::VARCHAR, 2, '0') AS length FROM l"""


def json_page(spark: SparkSession, d: str) -> DataFrame:
    """The first suppliers as JSON rows, with the number of all."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return documents.json_rows(rows, [F.col("name").desc(), F.col("id")], 30)


JSON_PAGE = """SELECT CAST(to_json({'id': s_suppkey, 'name': s_name, 'nation': s_nationkey}) AS VARCHAR) AS row, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_name DESC, s_suppkey LIMIT 30"""


def diff_text(spark: SparkSession, d: str) -> DataFrame:
    """What changed between two snapshots of orders, a text for each group."""
    old, new = _snapshots(spark, d)
    compared = relate.diff(old, new, "o_orderkey", ["o_orderstatus", "price"]).withColumn("group", F.col("o_orderkey") % 10)
    return documents.diff_lines(compared, "group", "o_orderkey", 3)


DIFF_TEXT = f"""
WITH o AS ({_OLD}), n AS ({_NEW}), j AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS k, o.o_orderkey AS a, n.o_orderkey AS b,
  o.o_orderstatus IS DISTINCT FROM n.o_orderstatus OR o.price IS DISTINCT FROM n.price AS differs FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey),
s AS (SELECT k, k % 10 AS g, CASE WHEN a IS NULL THEN '+' WHEN b IS NULL THEN '-' ELSE '~' END AS sign FROM j WHERE a IS NULL OR b IS NULL OR differs),
r AS (SELECT *, row_number() OVER (PARTITION BY g, sign ORDER BY k) AS i, count(*) OVER (PARTITION BY g, sign) AS n FROM s),
l AS (SELECT g, sign || ' ' || string_agg(k::VARCHAR, ' ' ORDER BY k) || CASE WHEN max(n) > 3 THEN ' and ' || (max(n) - 3) || ' more' ELSE '' END AS line FROM r WHERE i <= 3 GROUP BY g, sign)
SELECT g AS "group", string_agg(line, chr(10) ORDER BY line) AS text FROM l GROUP BY 1"""


def side_files(spark: SparkSession, d: str) -> DataFrame:
    """Corrections from a side file that is there and one that is not, over the parts' names."""
    folder = shared_folder(spark, "side")
    part = table(spark, d, "part")
    part.where("p_partkey % 30 = 0").select("p_partkey", F.upper("p_name").alias("name")).write.json(f"{folder}/names")
    names = documents.optional(spark, f"{folder}/names", "p_partkey long, name string")
    none = documents.optional(spark, f"{folder}/brands", "p_partkey long, brand string")
    fixed = part.join(names, "p_partkey", "left").join(none, "p_partkey", "left")
    return fixed.select("p_partkey", F.coalesce("name", "p_name").alias("name"), F.coalesce("brand", "p_brand").alias("brand"))


SIDE = "SELECT p_partkey, CASE WHEN p_partkey % 30 = 0 THEN upper(p_name) ELSE p_name END AS name, p_brand AS brand FROM part"

def large_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents, written as large JSON documents of up to 5,000 each, and read back element by element by many tasks."""
    docs = table(spark, d, "documents")
    path = shared_folder(spark, "large")
    each = docs.select(F.floor(F.col("doc_id") / 5_000).alias("volume"), F.col("doc_id").alias("at"), F.to_json(F.struct("doc_id", "text", F.array("lang", "source").alias("tags"))).alias("element"))
    bigjson.write_documents(each, path, "volume", "documents", "v1")
    found = bigjson.array_elements(spark, path, "documents")
    row = F.from_json("element", "doc_id long, text string, tags array<string>")
    volume = F.regexp_extract("path", "group=([0-9]+)/", 1).cast("long")
    versions = bigjson.head(spark, path, "version string").select("path", "version")
    # texts are digested before anything is joined, so that none is shuffled
    read = found.select("path", "place", row.alias("r")).select("path", "place", "r.doc_id", F.md5("r.text").alias("text_md5"), F.array_join("r.tags", "/", "-").alias("tags"))
    return read.join(versions, "path").select(volume.alias("volume"), "place", "version", "doc_id", "text_md5", "tags")


LARGE = """
SELECT doc_id // 5000 AS volume, row_number() OVER (PARTITION BY doc_id // 5000 ORDER BY doc_id) - 1 AS place, 'v1' AS version, doc_id, md5(text) AS text_md5,
  coalesce(lang, '-') || '/' || coalesce(source, '-') AS tags FROM documents"""

def _published(spark: SparkSession, d: str) -> published.Published:
    """Snapshots of orders, published one after the other: one, the same in another order, one that lost too much, one with rows
    that are gone, changed or new, one with a key twice, and one in which those that were gone are back."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = orders.where("o_orderkey % 7 <> 0")
    changed = F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus"))
    second = orders.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", changed)
    made = published.Published(spark, shared_folder(spark, "published"), "o_orderkey")
    for snapshot in (first, first.orderBy(F.desc("o_totalprice")), first.where("o_orderkey % 3 = 0"), second, second.unionByName(second.where("o_orderkey % 100 = 1")), orders.where("o_orderkey % 13 <> 0")):
        made.publish(snapshot, ["o_orderstatus", "o_totalprice"], F.col("o_totalprice") > 250_000)
    return made


def published_orders(spark: SparkSession, d: str) -> DataFrame:
    """What is published in the end: ids that stay, and rows that were retired."""
    return _published(spark, d).current()


def publish_log(spark: SparkSession, d: str) -> DataFrame:
    """What each publishing did."""
    return _published(spark, d).log().drop("digest")


#: The three snapshots that are written, merged one after the other.
_PUBLISHED = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders),
v1 AS (SELECT k, s, p, row_number() OVER (ORDER BY k) AS id, false AS retired FROM o WHERE k % 7 <> 0),
n2 AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'X' ELSE s END AS s, p FROM o WHERE k % 5 <> 0),
i2 AS (SELECT k, row_number() OVER (ORDER BY k) + (SELECT max(id) FROM v1) AS id FROM n2 ANTI JOIN v1 USING (k)),
v2 AS (SELECT k, n2.s, n2.p, coalesce(v1.id, i2.id) AS id, false AS retired FROM n2 LEFT JOIN v1 USING (k) LEFT JOIN i2 USING (k)
  UNION ALL SELECT k, s, p, id, true FROM v1 ANTI JOIN n2 USING (k) WHERE p > 250000),
n3 AS (SELECT * FROM o WHERE k % 13 <> 0),
i3 AS (SELECT k, row_number() OVER (ORDER BY k) + (SELECT max(id) FROM (SELECT id FROM v1 UNION ALL SELECT id FROM i2)) AS id FROM n3 ANTI JOIN v2 USING (k)),
v3 AS (SELECT k, n3.s, n3.p, coalesce(v2.id, i3.id) AS id, false AS retired FROM n3 LEFT JOIN v2 USING (k) LEFT JOIN i3 USING (k)
  UNION ALL SELECT k, s, p, id, true FROM v2 ANTI JOIN n3 USING (k) WHERE p > 250000)"""
PUBLISHED = f"{_PUBLISHED} SELECT k AS o_orderkey, s AS o_orderstatus, p AS o_totalprice, id, retired FROM v3"


def _step(old: str, new: str, n: int, version: int) -> str:
    same = "a.s IS NOT DISTINCT FROM b.s AND a.p IS NOT DISTINCT FROM b.p"
    return f"""SELECT {n}::INT AS step, 'written' AS outcome, '' AS reasons, {version}::INT AS version, (count(*) FILTER (b.k IS NOT NULL OR a.p > 250000))::BIGINT AS n,
  count(*) FILTER (b.k IS NOT NULL AND (a.k IS NULL OR a.retired)) AS inserted, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND NOT a.retired AND NOT ({same})) AS updated,
  count(*) FILTER (b.k IS NULL AND a.p > 250000 AND NOT a.retired) AS retired, count(*) FILTER (b.k IS NULL AND NOT coalesce(a.p > 250000, false)) AS deleted
  FROM {old} a FULL JOIN {new} b ON a.k = b.k"""


PUBLISH_LOG = f"""{_PUBLISHED}, v0 AS (SELECT * FROM v1 LIMIT 0)
{_step("v0", "v1", 0, 0)} UNION ALL {_step("v1", "n2", 3, 1)} UNION ALL {_step("v2", "n3", 5, 2)}
UNION ALL SELECT unnest([1, 2, 4])::INT, unnest(['unchanged', 'refused', 'refused']), unnest(['', 'shrunk', 'repeated-key']), NULL, 0, 0, 0, 0, 0"""

def sheet_files(spark: SparkSession, d: str) -> DataFrame:
    """Workbooks of two sheets, made of a hundred parts each, and read again: regions below headings that stand anywhere in the
    first rows."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    sheet = F.when(k % 3 == 0, "Duets").otherwise("Solos")
    cells = F.array(F.when(k % 5 == 0, F.lit(None)).otherwise(F.lit("x")), F.concat(F.lit("  "), "p_name", F.lit(" & <co>")), F.col("p_brand"), F.when(k % 4 == 0, F.lit(" ")).otherwise(F.col("p_type")))
    rows = part.select(F.floor(k / 100).alias("book"), sheet.alias("sheet"), (k % 100 + 10).alias("at"), cells.alias("cells"))
    heading = F.explode(F.array(*(F.struct(F.lit(s).alias("sheet"), F.lit(at).cast("long").alias("at"), cells_.alias("cells")) for s in ("Duets", "Solos") for at, cells_ in (
        (0, F.array(F.lit("Title page"), F.col("book").cast("string"))), (1, F.array(F.lit(None), F.lit(" Title "), F.lit("SHOW"), F.lit("Kind")))
    ))))
    heads = rows.select("book").distinct().select("book", heading.alias("h")).select("book", "h.*")
    read = sheets.grids(sheets.workbooks(rows.unionByName(heads), "book")).withColumn("name", F.concat_ws("/", "path", "sheet"))
    found = documents.regions(read, "name", "row", "cells", {"title": "title", "show": "show", "kind": "kind"})
    return found.groupBy("name", "region").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "row", "value"))), "|")).alias("digest"))


SHEET_FILES = r"""
WITH p AS (SELECT p_partkey // 100 || CASE WHEN p_partkey % 3 = 0 THEN '/Duets' ELSE '/Solos' END AS name, p_name || ' & <co>' AS title, p_brand AS brand, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS kind,
  row_number() OVER (PARTITION BY p_partkey // 100, p_partkey % 3 = 0 ORDER BY p_partkey) + 1 AS row FROM part),
r AS (SELECT name, row, unnest([{'region': 'title', 'value': title}, {'region': 'show', 'value': brand}, {'region': 'kind', 'value': kind}]) AS x FROM p)
SELECT name, x.region AS region, count(*) AS n, md5(string_agg(row || ':' || x.value, '|' ORDER BY row || ':' || x.value)) AS digest FROM r WHERE x.value IS NOT NULL GROUP BY 1, 2"""

QUERIES = {
    "sheet_files": (sheet_files, SHEET_FILES),
    "published_orders": (published_orders, PUBLISHED),
    "publish_log": (publish_log, PUBLISH_LOG),
    "large_documents": (large_documents, LARGE),
    "document_round_trip": (document_round_trip, ROUND_TRIP),
    "split_document": (split_document, SPLIT_DOCUMENT),
    "seed_scan": (seed_scan, SEEDS),
    "sheet_regions": (sheet_regions, SHEETS),
    "export_sheets": (export_sheets, EXPORT),
    "json_page": (json_page, JSON_PAGE),
    "diff_text": (diff_text, DIFF_TEXT),
    "side_files": (side_files, SIDE),
}
