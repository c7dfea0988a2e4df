"""Nested JSON documents, sheets and seed files as sources; guarded documents, exports and reviews as sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is read as one JSON document; larger ones must come as lines.
MOST_BYTES = 64 << 20


def evolved(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with every missing column of (name: type), as nulls; those that are there stay as they are."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files below a path, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_lines(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines, gzip or plain. Raises if a file is larger than most_bytes; a broken line is a reject; a blank
    one is neither."""
    largest = file_sizes(spark, path).agg(F.max("length")).first()[0]
    if largest is not None and largest > most_bytes:
        raise ValueError(f"a file of {largest} bytes, more than {most_bytes}")
    raw = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    parsed = raw.select("value", F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("row"))
    return parsed.where("row._broken IS NULL").select("row.*").drop("_broken"), parsed.where("row._broken IS NOT NULL").select("value")


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a path, or none where there is no such path."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def split_elements(documents: DataFrame, text: str, field: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, place, element): each element of an array field as JSON text of its own, so that each is parsed alone."""
    kept = ", ".join(f"{k} string" for k in keep)
    parsed = documents.select(F.from_json(text, f"{kept}{', ' if keep else ''}{field} array<string>").alias("d"))
    return parsed.select(*(f"d.{k}" for k in keep), F.posexplode(f"d.{field}").alias("place", "element"))


def cell(x: Column) -> Column:
    """A cell's text: blanks single, none is null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


def regions(grid: DataFrame, sheet: str, row: str, cells: str, headers: dict[str, str], most_rows: int = 10) -> DataFrame:
    """(sheet, region, row, value) from a grid of (sheet, row, cells array): headers names the heading of each region's
    column. The heading row is the first of the sheet's first rows that has all; each region's column is read below it."""
    titles = F.transform(cells, lambda c: F.lower(F.trim(c)))
    has_all = F.lit(True)
    for heading in headers.values():
        has_all = has_all & F.array_contains(titles, heading)
    found = grid.where((F.col(row) < most_rows) & has_all).groupBy(sheet).agg(F.min_by(F.struct(row, titles.alias("titles")), row).alias("head"))
    below = grid.join(found, sheet).where(F.col(row) > F.col(f"head.{row}"))
    place = lambda h: F.array_position(F.col("head.titles"), h).cast("int")
    each = F.array(*(F.struct(F.lit(r).alias("region"), cell(F.try_element_at(cells, place(h))).alias("value")) for r, h in headers.items()))
    return below.select(sheet, row, F.explode(each).alias("x")).select(sheet, "x.region", row, "x.value").where("value IS NOT NULL")


def seeds(rows: DataFrame, text: str, order: str, schema: str, key: str, valid: Column) -> DataFrame:
    """The valid rows of JSON texts, the first of each key in order; others are left out."""
    parsed = rows.select(order, F.from_json(text, schema).alias("s")).select(order, "s.*").where(F.coalesce(valid, F.lit(False)))
    first = parsed.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("first"))
    return first.select("first.*")


def write_if_changed(df: DataFrame, folder: str, key: str, digest: str | None) -> tuple[str, bool]:
    """Write df as gzipped JSON lines unless its content's digest is the one given; (digest, whether it was written).
    The digest does not depend on the rows' order or partitions."""
    line = F.to_json(F.struct(*df.columns))
    state = df.agg(F.count("*"), F.sum(F.xxhash64(line).cast("decimal(38,0)")), F.max(key)).first()
    now = ":".join(map(str, state))
    if now != digest:
        df.write.mode("overwrite").option("compression", "gzip").json(folder)
    return now, now != digest


def json_rows(df: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """(row, total): a page of rows as JSON, with the number of all."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(most).select(F.to_json(F.struct(*df.columns)).alias("row")).join(F.broadcast(total), F.lit(True))


def diff_lines(compared: DataFrame, group: str, item: str, most: int = 5) -> DataFrame:
    """(group, text): what was added (+), removed (-) and changed (~) in each group, the first names of each, counted on."""
    sign = F.when(F.col("status") == "added", "+").when(F.col("status") == "removed", "-").otherwise("~")
    changed = compared.where("status <> 'same'").withColumn("sign", sign)
    counts = changed.groupBy(group, "sign").agg(F.count("*").alias("n"))
    from tessera.operators.browse import top_by

    named = top_by(changed, [group, "sign"], [F.col(item)], most).groupBy(group, "sign").agg(F.array_join(F.array_sort(F.collect_list(item)), " ").alias("names"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    lines = named.join(counts, [group, "sign"]).withColumn("line", F.concat("sign", F.lit(" "), "names", more))
    return lines.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("text"))
