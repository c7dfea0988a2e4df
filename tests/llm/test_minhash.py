import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash, words
from tessera.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=5, percent=75):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        seen = {}
        for g in s:
            for o in where[g]:
                if o < d:
                    seen[o] = seen.get(o, 0) + 1
        for o, c in seen.items():
            if 100 * c >= percent * (len(s) + len(sets[o]) - c):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_words_and_sequences_match_plain_splitting():
    texts = ["", " ", "A b\tC\x0bd\re\nf", "x", "é  É", "a b c d e f g", "\x1c a b", "A b\tc d e"]
    hashes, bounds = words.word_hashes(texts, lower=True)
    lengths = np.diff(bounds).tolist()
    assert lengths == [len(WORD.findall(t)) for t in texts]
    sets = words.shingle_sets(texts, 5)
    assert [len(s) for s in sets] == [0, 0, 2, 1, 1, 3, 1, 1]
    assert sets[7][0] in sets[2]  # the same words in other white space and case
    assert not set(sets[7].tolist()) & set(sets[5].tolist()[1:])


def test_min_max_estimates_similarity_without_bias():
    rng = np.random.default_rng(1)
    guesses = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (300, 50, 50))
        s = minhash.min_max([np.concatenate([common, a]), np.concatenate([common, b])], 64)
        guesses.append((s[0] == s[1]).mean())
    assert abs(np.mean(guesses) - 0.75) < 0.02


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def synthetic(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 60, 200]))
        for _ in range(rng.randrange(1, 9)):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((d, " ".join(text)))
            d += rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = synthetic(seed)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_chain_of_links_that_the_smallest_member_does_not_see(spark):
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(9):  # each 8 words further from the first
        rows.append((k, " ".join([f"x{k}_{i}" if i < 0 else base[i] if i >= 8 * k else f"y{i}" for i in range(100)])))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_nulls_blank_short_repeated_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "two one"), (7, "a b c d e"), (7, "a b c d e"), (9, "A B C D E")]
    docs = spark.createDataFrame([(d, t, "x", 1, 2, 3) for d, t in rows] + [(None, "a b c d e", "x", 1, 2, 3)], "doc_id long, text string, id string, k1 int, key int, component_id int")
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    assert docs.where(F.col("text").isNull()).count() == 0
