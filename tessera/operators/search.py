"""Ranked full-text search without an index: BM25 over weighted columns, tiers, highlights."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold, folded, tokens
from tessera.operators.browse import all_of
from tessera.session import scratch

K1, B = 1.2, 0.75
# Words that are left out of a query that has others (fixed values).
COMMON = ["the", "an", "of", "and", "to", "in", "on", "for", "at", "with", "is", "it", "me", "my", "you", "be", "we"]


def analysed(query: str, most: int = 8) -> list[str]:
    """Distinct tokens of a query: no single letters, no common words where others are left."""
    import re

    if len(query.strip()[:200]) < 2:
        return []
    each = list(dict.fromkeys(re.findall(r"[^\W_]+", folded(query.strip()[:200]))))[:most]
    found = [t for t in each if len(t) > 1]
    return [t for t in found if t not in COMMON] or found


def ranked_first(ranked: DataFrame, others: DataFrame, doc: str) -> DataFrame:
    """(doc, score): ranked hits, and others that are not among them, without a score."""
    return ranked.select(doc, "score").unionByName(others.join(ranked, doc, "left_anti").select(doc, F.lit(None).cast("double").alias("score")))


def scan_bm25(docs: DataFrame, doc: str, fields: dict[str, tuple[Column, float]], query: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """(doc, kept columns, score) by BM25 over weighted fields, as an index gives it, without one: one scan counts each document's tokens and weighted
    hits, and only these numbers are written and read for the totals."""
    listed = docs.select(doc, *kept, *(tokens(c).alias(f"_{n}") for n, (c, _) in fields.items()))
    hits = lambda t: sum((F.size(F.filter(f"_{n}", lambda x: F.startswith(x, F.lit(t)))) * w for n, (_, w) in fields.items()), F.lit(0.0))
    length = sum((F.size(f"_{n}") for n in fields), F.lit(0))
    each = scratch(listed.select(doc, *kept, length.alias("length"), F.array(*(hits(t) for t in query)).alias("wtf")), "hits")
    holding = [F.count_if(F.col("wtf")[i] > 0).alias(f"df{i}") for i in range(len(query))]
    totals = each.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *holding)
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    score = F.lit(0.0)
    for i in range(len(query)):
        wtf, df = F.col("wtf")[i], F.col(f"df{i}")
        score = score + F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)) * wtf * (K1 + 1) / (wtf + norm)
    found = each.where(F.forall("wtf", lambda x: x > 0)).join(F.broadcast(totals), F.lit(True))
    return found.select(doc, *kept, score.alias("score"))


def tier(title: Column, query: str, query_words: Sequence[str]) -> Column:
    """3 exact, 2 begins so, 1 all words in the title, 0 elsewhere."""
    folded, wanted = fold(title), fold(F.lit(query))
    some_word_begins = lambda token: F.exists(tokens(title), lambda w: F.startswith(w, F.lit(token)))
    begins = all_of([some_word_begins(t) for t in query_words])
    return F.when(folded == wanted, 3).when(F.startswith(folded, wanted), 2).when(begins, 1).otherwise(0)


def highlights(text: Column, query: str) -> Column:
    """Ranges [start, end) of the text that a query hits: the whole query, else its tokens at word starts; merged."""
    return F.pandas_udf(_ranges(query), "array<struct<start:int,end:int>>")(text)


def _ranges(query: str):
    import re
    import unicodedata

    def folded(text: str) -> tuple[str, list[int]]:
        out, place = [], []
        for i, char in enumerate(text):
            for c in unicodedata.normalize("NFD", char.lower()):
                if not unicodedata.combining(c):
                    out.append("'" if c in "‘’ʼ" else c)
                    place.append(i)
        return "".join(out), place

    whole = folded(query.strip())[0]

    def one(text: str | None) -> list[dict] | None:
        if text is None or not whole:
            return None if text is None else []
        plain, place = folded(text)
        spans = [m.span() for m in re.finditer(re.escape(whole), plain)]
        if not spans:
            spans = sorted(m.span() for t in set(whole.split()) for m in re.finditer(rf"(?<![^\W_]){re.escape(t)}", plain))
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [{"start": place[a], "end": place[b - 1] + 1} for a, b in merged]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run
