import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = []
    for d, w in sorted(words.items()):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_sliding_min():
    v = np.random.default_rng(0).integers(0, 1000, 200)
    for w in (1, 2, 3, 25, 26, 200, 201):
        assert substring.sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(200 - w + 1)]


def synthetic(seed, window):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rng.randrange(window - 3, 3 * window))] for k in range(4)]
    rows = []
    for d in range(30):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(0, 2 * window))]
            text += rng.choice(passages) if rng.random() < 0.7 else ["again"] * rng.randrange(0, 2 * window)
        rows.append((3 * d + 1, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [(200 + d, rows[rng.randrange(30)][1]) for d in range(6)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window", [(1, 50), (2, 8), (3, 7)])
def test_against_brute_force(spark, seed, window):
    rows = synthetic(seed, window)
    df = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert got(df) == brute(rows, window)


def test_longer_levels_and_texts(spark):
    rng = random.Random(9)
    shared = [f"s{i}" for i in range(70)]
    rows = [(d, " ".join([f"a{d}_{i}" for i in range(rng.randrange(5, 30))] + shared[: n] + ["end"])) for d, n in ((1, 70), (2, 70), (3, 20), (4, 9))]
    df = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10, longest=1000, texts_too=True)
    found = {r.doc_id: r for r in df.collect()}
    assert {d: r.longest for d, r in found.items()} == {1: 40, 2: 40, 3: 20, 4: 0}
    assert got(df) == brute(rows, 10)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found.values())


def test_doubling_goes_on_until_nothing_survives(spark):
    shared = [f"s{i}" for i in range(440)]
    rows = [(d, " ".join([f"a{d}_{i}" for i in range(9 * d)] + shared[:n] + [f"b{d}"])) for d, n in ((1, 440), (2, 420), (3, 199), (4, 60), (5, 49))]
    df = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.longest for r in df.collect()} == {1: 400, 2: 400, 3: 100, 4: 50, 5: 0}
    assert got(df) == brute(rows, 50)


def test_copies_share_their_longest_level(spark):
    text = " ".join(f"w{i}" for i in range(45))
    df = substring.remove_repeats(spark.createDataFrame([(1, text), (2, text), (3, "w1 w2")], "doc_id long, text string"), 10, longest=1000)
    assert {r.doc_id: (r.n_removed, r.longest) for r in df.collect()} == {1: (0, 40), 2: (45, 40), 3: (0, 0)}


def test_nulls_empty_repeated_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + "\nx"), (6, "short")]
    docs = spark.createDataFrame([(d, t, 1, "h") for d, t in [*rows, (5, long + "\nx"), (None, long)]], "doc_id long, text string, row int, hashes string")
    assert got(substring.remove_repeats(docs)) == brute(rows, 50)
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(substring.remove_repeats(docs)) == brute(rows, 50)
