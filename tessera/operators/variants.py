"""JSON texts of any shape as variants: typed errors, and what stands at which path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch

# Keys that no document may have at any depth.
FORBIDDEN = ["__proto__", "constructor", "prototype"]


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def parsed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, value, error): the variant of each JSON text; error: missing for none, or for blanks alone, invalid for what is no
    JSON, else null."""
    value = F.try_parse_json(text)
    error = F.when(F.coalesce(F.trim(F.col(text)), F.lit("")) == "", "missing").when(value.isNull(), "invalid")
    return docs.select(key, F.when(error.isNull(), value).alias("value"), error.alias("error"))


def walked(docs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, name, value): everything inside of each variant, level by level: path like $.a[0]."b c", name the last key, null
    in a list. A level is one pass over the containers of the level above; there are as many as the deepest text has."""
    spark = docs.sparkSession
    level = docs.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.lit("$").alias("path"), F.col(value).alias("value"))
    found = spark.createDataFrame([], f"key {docs.schema[key].dataType.simpleString()}, path string, name string, value variant")
    while True:
        containers = level.where(_kind(F.col("value")).isin("OBJECT", "ARRAY"))
        inner = containers.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()).withColumnsRenamed({"key": "name", "value": "inner"}))
        plain = F.col("name").rlike(r"^[A-Za-z_]\w*$")
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("."), "name")).otherwise(
            F.concat(F.lit('."'), F.replace("name", F.lit('"'), F.lit('\\"')), F.lit('"'))
        )
        made = scratch(inner.select("key", F.concat("path", step).alias("path"), "name", F.col("inner").alias("value")), "walked")
        if made.isEmpty():
            return found.withColumnRenamed("key", key)
        found = found.unionByName(made)
        level = made.select("key", "path", "value")


def checked(docs: DataFrame, key: str, text: str, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """(key, error, paths) of every document: missing, invalid or forbidden, and where its forbidden keys stand, in order; null
    and none for a good one. A key inside a forbidden one's value is told too. Repeated keys of docs give rows that repeat."""
    each = scratch(parsed(docs, key, text), "parsed")
    bad = walked(each.where("error IS NULL"), key, "value").where(F.col("name").isin(*forbidden)).select(F.col(key), "path").distinct()
    paths = bad.groupBy(key).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    joined = each.join(paths, key, "left")
    return joined.select(key, F.coalesce("error", F.when(F.col("paths").isNotNull(), "forbidden")).alias("error"), F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))
