import math

import numpy as np
import pytest

from tessera.llm import ann


def brute(rows, every, k):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        usable.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q, vs in usable.items():
        if q % every == 0:
            best = {}
            for i, ws in usable.items():
                if i != q:
                    d = [float(np.sqrt(((w - v) ** 2).sum())) for v in vs for w in ws if len(v) == len(w)]
                    if d:
                        best[i] = min(d)
            out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    want, got = brute(rows, 100, 10), answers(ann.search(df))
    assert set(got) == set(want)
    vectors = {i: np.array(v) for i, v in rows}
    hits = 0
    for q, found in got.items():
        assert len(found) == 10
        hits += len({i for _, i in found} & {i for _, i in want[q]})
        assert all(s == pytest.approx(np.sqrt(((vectors[q] - vectors[i]) ** 2).sum()), abs=1e-12) for s, i in found)
    assert hits / (10 * len(want)) >= 0.9
    verified = [r.verified for r in ann.search(df).select("query_id", "verified").distinct().collect()]
    assert sum(verified) / len(verified) < 0.25 * len(rows)


@pytest.mark.parametrize("batch", [7, 10_000])
def test_blocks_find_the_same(spark, monkeypatch, batch):
    """Vectors and queries of a block come in one frame or in many."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    monkeypatch.setattr(ann, "BLOCK", 90)
    got, want = answers(ann.search(df, every=20)), brute(rows, 20, 10)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want) and all(len(found) == 10 for found in got.values())
    hits = sum(len({i for _, i in found} & {i for _, i in want[q]}) for q, found in got.items())
    assert hits / (10 * len(want)) >= 0.9


def test_windows_count_each_vector_once():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((300, 8))
    directions = ann.projections(8, 20)
    index = ann.SortedProjections(vectors, directions)
    image = rng.standard_normal(8) @ directions
    windows = index.windows(image)
    for half in (0.1, 0.5, 0.5, 2.0, 100.0):
        want = (np.abs(vectors @ directions - image) <= half).sum(1)
        assert (windows.widen(half) == want).all()


def test_ties_copies_odd_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (9, []), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, "l", 0) for i, v in rows], "vec_id long, embedding array<float>, dim string, block int")
    assert answers(ann.search(df, every=1, k=3)) == {q: a for q, a in brute(rows, 1, 3).items() if a}
    many = [(i, [0.5, 0.5]) for i in range(40)] + [(100 + i, [1.0 * i, 0.0]) for i in range(1, 9)]
    df = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    assert answers(ann.search(df, every=10, k=5)) == brute(many, 10, 5)
    assert ann.search(df.limit(0)).count() == 0


def test_repeated_near_ids_take_one_place(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(200)]
    same = [(200, [x + 0.01 for x in rows[0][1]])] * 30
    moved = [(201 + j, [x + 0.001 * i for x in rows[100 * j][1]]) for j in range(2) for i in range(1, 31)]
    rows += same + moved
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(ann.search(df, every=100, k=5)), brute(rows, 100, 5)
    assert all(len({i for _, i in a}) == 5 for a in got.values())
    assert {q: [i for _, i in a] for q, a in got.items()} == {q: [i for _, i in a] for q, a in want.items()}
