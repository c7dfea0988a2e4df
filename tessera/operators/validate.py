"""Submitted rows: each field's value, cleaned, and what is wrong with it, the first thing of each field."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.functions.text import clean, fold

TRUE, FALSE = ["true", "1", "yes", "y"], ["false", "0", "no", "n"]


@dataclass(frozen=True)
class Field:
    """A field's clean value, and its error: null for none."""

    name: str
    value: Column
    error: Column


def _given(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) != ""


def _lines(x: Column) -> Column:
    """Text of several lines: blanks at the ends of lines go, no more than one line is empty, empty is null."""
    x = F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[\x00-\x09\x0b-\x1f\x7f]", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"[ ]*\n[ ]*", "\n"), r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(F.regexp_replace(x, " {2,}", " "), r"^\s+|\s+$", ""), F.lit(""))


def text(name: str, x: Column, label: str, required: bool = False, least: int = 1, most: int = 200, lines: bool = False) -> Field:
    value = _lines(x) if lines else clean(x)
    n = F.length(value)
    error = F.when(value.isNull(), F.lit(f"{label} is required") if required else F.lit(None).cast("string")).when(n < least, f"{label} must be at least {least} characters")
    return Field(name, value, error.when(n > most, f"{label} must be at most {most} characters"))


def integer(name: str, x: Column, label: str, low: int | None = None, high: int | None = None, required: bool = False) -> Field:
    """A whole number written as text. One that no long can hold is out of range."""
    whole = F.trim(x).rlike(r"^-?\d+$")
    n = F.trim(x).try_cast("decimal(38,0)")
    out = F.lit(False)
    if low is not None:
        out = out | (n < low)
    if high is not None:
        out = out | (n > high)
    out = out | n.isNull() | n.cast("decimal(38,0)").try_cast("long").isNull()
    bound = "must be between " + f"{low} and {high}" if high is not None else f"must be at least {low}"
    error = F.when(~_given(x), F.lit(f"{label} is required") if required else F.lit(None).cast("string")).when(~whole, f"{label} must be a whole number").when(out, f"{label} {bound}")
    return Field(name, F.when(error.isNull() & _given(x), n.try_cast("long")), error)


def flag(name: str, x: Column, label: str, default: bool = False) -> Field:
    word = F.lower(F.trim(x))
    value = F.when(~_given(x), default).when(word.isin(TRUE), True).when(word.isin(FALSE), False)
    return Field(name, F.coalesce(value, F.lit(default)), F.when(value.isNull(), f"{label} must be yes or no"))


def one_of(name: str, x: Column, label: str, allowed: Sequence[str], required: bool = False) -> Field:
    """One of some values, in whatever case."""
    known = F.create_map(*(F.lit(v) for a in allowed for v in (a.lower(), a)))
    value = F.try_element_at(known, F.lower(F.trim(x)))
    error = F.when(~_given(x), F.lit(f"{label} is required") if required else F.lit(None).cast("string")).when(value.isNull(), f"{label} must be one of: {', '.join(allowed)}")
    return Field(name, value, error)


def length(name: str, x: Column, label: str) -> Field:
    """m:ss as seconds."""
    shape = F.trim(x).rlike(r"^\d{1,2}:[0-5]\d$")
    value = scalar.parse_length(x)
    error = F.when(~_given(x), F.lit(None).cast("string")).when(~shape, f"{label} must look like m:ss (e.g. 3:25)").when(value.isNull(), f"{label} must be between 0:01 and 59:59")
    return Field(name, F.when(shape, value), error)


def https_url(name: str, x: Column, label: str, hosts: Sequence[str] = (), most: int = 500) -> Field:
    """An address; of these hosts, or hosts below them, alone."""
    url = F.trim(x)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    good = url.rlike(r"^https://[^\s/?#@\\]+(?:[/?#]\S*)?$") & host.isNotNull()
    allowed = F.lit(not hosts)
    for h in hosts:
        allowed = allowed | (host == h) | F.endswith(host, F.lit(f".{h}"))
    error = F.when(~_given(x), F.lit(None).cast("string")).when(F.length(url) > most, f"{label} must be at most {most} characters").when(
        ~F.coalesce(good, F.lit(False)), f"{label} must be a full https:// address"
    )
    return Field(name, F.when(error.isNull() & allowed & _given(x), url), error.when(~allowed, f"{label} must be of {' or '.join(hosts) or 'any host'}"))


def rule(name: str, wrong: Column, message: str) -> Field:
    """A condition over several columns, told under a field's name. A null is no error."""
    return Field(name, F.lit(None), F.when(F.coalesce(wrong, F.lit(False)), message))


def validated(rows: DataFrame, fields: Sequence[Field], kept: Sequence[str]) -> DataFrame:
    """kept columns, a column for each field's value, and errors: a map from field to its first error, empty for a good row. All is
    one pass; a value whose field has an error is kept, cleaned as far as it can be."""
    values: dict[str, Column] = {}
    found: dict[str, Column] = {}
    for f in fields:
        values.setdefault(f.name, f.value)
        found[f.name] = F.coalesce(found[f.name], f.error) if f.name in found else f.error
    each = F.array(*(F.struct(F.lit(n).alias("key"), e.cast("string").alias("value")) for n, e in found.items()))
    errors = F.map_from_entries(F.filter(each, lambda e: e["value"].isNotNull()))
    columns = [v.alias(n) for n, v in values.items() if n not in _only_rules(fields)]
    return rows.select(*kept, *columns, errors.alias("errors"))


def _only_rules(fields: Sequence[Field]) -> set[str]:
    """Names that stand for rules alone, and have no value."""
    seen: dict[str, bool] = {}
    for f in fields:
        seen[f.name] = seen.get(f.name, True) and f.value._jc.toString() == "NULL"
    return {n for n, only in seen.items() if only}


def first_spelling(rows: DataFrame, column: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """rows with each value of a column spelled as the first of its fold: known spellings (value, in order `at`) before rows' own."""
    key = fold(F.col(column))
    own = rows.where(F.col(column).isNotNull()).select(key.alias("__fold"), F.lit(1).alias("rank"), F.col(order).cast("long").alias("at"), F.col(column).alias("value"))
    if known is not None:
        own = own.unionByName(known.select(fold(F.col("value")).alias("__fold"), F.lit(0).alias("rank"), F.col("at").cast("long"), "value"))
    first = own.groupBy("__fold").agg(F.min_by("value", F.struct("rank", "at", "value")).alias("__value"))
    return rows.withColumn("__fold", key).join(first, "__fold", "left").withColumn(column, F.col("__value")).drop("__fold", "__value")
