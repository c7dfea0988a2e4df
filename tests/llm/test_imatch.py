import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import imatch


def by_hand(rows):
    rows = sorted((d, t or "") for d, t in rows)
    out = []
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def test_edits_follow_the_next_document(spark):
    rows = [(k * 97 % 1009 - 300, f"text {k} é😀 " * (k % 5)) for k in range(80)] + [(5000, None), (1 << 40, "far away text"), (-(1 << 35), "x")]
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == by_hand(rows)


def test_equal_texts_repeats_and_odd_rows(spark):
    rows = [(i, f"common word{i % 9} other{i % 4} rare{i}") for i in range(40)] + [(50, "common word1"), (51, "common word1"), (51, "common word1"), (60, ""), (61, None), (62, "w " * 20000)]
    docs = spark.createDataFrame([(d, t, 1, "t") for d, t in [*rows, (None, "lost")]], "doc_id long, text string, block int, term string")
    got = imatch.fingerprints(docs, 0.05, 0.5).collect()
    assert len(got) == len(rows)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert prints[50] == prints[51] and prints[60] == prints[61] and len(prints[51]) == 1
    next_of = {r.doc_id: r.near_next for r in got}
    assert next_of[50] == 1.0 and next_of[60] == 1.0
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    alone = imatch.fingerprints(spark.createDataFrame([(7, "only one text here")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"only one text only").hexdigest()


def test_likeness_tells_edits_from_strangers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = imatch.fingerprints(docs).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("w")).first()
    assert r.e > 0.4 and r.n < 0.1 and r.w > 0.9


@pytest.mark.parametrize("a,b,want", [("xaa", "xaa", 1.0), ("xaa", "xab", 0.0), ("xaa", "a.-:-.-", 0.0)])
def test_whole_text_prints(spark, a, b, want):
    assert spark.range(1).select(imatch.likeness(F.lit(a), F.lit(b)).alias("l")).first().l == want
