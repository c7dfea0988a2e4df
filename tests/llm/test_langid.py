import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid
from tessera.llm.lattice import SPACE, pieces
from tessera.llm.tokenfile import public_vocabulary

VOCABULARY = public_vocabulary("piece_bpe_32k.model")


def small_model():
    table = {"a": (0.2, 0.1), "b": (0.1, 0.3), "ab": (0.3, 0.05), "ba": (0.05, 0.2), SPACE: (0.1, 0.1), SPACE + "a": (0.25, 0.25)}
    return ["x", "y"], table


def spelled(table, text, lang):
    """Sum over all ways to cut the text."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        p = 1.0
        for part in parts:
            p *= table[part][lang] if part in table else langid._FLOOR if len(part) == 1 else 0.0
        total += p
    return total


def test_forward_sums_all_segmentations():
    model = small_model()
    texts = [SPACE + w for w in ("ab", "abba", "babab", "aca", "", "日a")]
    got = langid.Sums(model)(texts)
    for text, row in zip(texts, got):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(spelled(model[1], text, k)))


def test_words_of_any_length_are_summed_whole():
    """By the sum's recursion over a word of one letter: s(n) = s(n-1) p(a) + s(n-2) p(aa)."""
    p, q, n = (0.1, 0.01), (0.02, 0.03), 3_000
    model = ["x", "y"], {"a": p, "aa": q, SPACE: (0.5, 0.5)}
    got = langid.Sums(model)([SPACE + "a" * n, SPACE + "a" * 80])
    for k in range(2):
        logs = [0.0, math.log(p[k])]
        for _ in range(n - 1):
            one, two = logs[-1] + math.log(p[k]), logs[-2] + math.log(q[k])
            logs.append(max(one, two) + math.log1p(math.exp(-abs(one - two))))
        assert got[0][k] == pytest.approx(math.log(0.5) + logs[n]) and got[1][k] == pytest.approx(math.log(0.5) + logs[80])
    table = {"a": (0.1, 0.1), "b": (0.1, 0.1), "ab": (0.0001, 0.2), SPACE: (0.1, 0.1)}
    assert [x for x, _ in langid.Scorer((["x", "y"], table))(["ab" * 400, "日本語" * 50])] == ["y", "x"]


def test_expected_counts_are_posterior_means():
    model = small_model()
    out = dict(zip(model[1], langid.Sums(model).expected([SPACE + "ab"], np.array([[3.0, 1.0]]))))
    ways = [[SPACE, "a", "b"], [SPACE, "ab"], [SPACE + "a", "b"]]
    for k, n in enumerate((3.0, 1.0)):
        weights = [math.prod(model[1][p][k] for p in w) for w in ways]
        for piece in model[1]:
            want = n * sum(x * w.count(piece) for x, w in zip(weights, ways)) / sum(weights)
            assert out[piece][k] == pytest.approx(want)


def test_batches_do_not_matter():
    model = small_model()
    texts = ["ab ba", "", "1 2", "abab b", "b b b a"]
    whole, small = langid.Scorer(model)(texts), langid.Scorer(model, most_known=1)
    assert [small([t])[0][0] for t in texts] == [x for x, _ in whole]
    assert [x for x, _ in whole][1:3] == ["und", "und"]


def test_held_out_accuracy_and_contract(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    got = langid.identify(docs, VOCABULARY).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95


def test_odd_rows(spark):
    rows = [(i, "der und die ist nicht das mit", "de") for i in range(12)] + [(i, "the and of that with this", "en") for i in range(12, 24)]
    rows += [(50, None, "de"), (51, "", "en"), (52, "123 !?", "en"), (53, "das ist nicht die", None), (53, "das ist nicht die", None), (None, "the", "en"), (54, "THE THIS " * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(docs, VOCABULARY).collect() if r.doc_id >= 50)
    assert got == [(50, "und"), (51, "und"), (52, "und"), (53, "de"), (53, "de"), (54, "en")]
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string")), VOCABULARY).collect()} == {"und"}
    assert langid.identify(docs.limit(0), VOCABULARY).count() == 0
