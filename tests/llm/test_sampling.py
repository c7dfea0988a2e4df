import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import sampling
from tessera.llm.lattice import SPACE, lattice, pieces, spellings
from tessera.llm.tokenfile import public_vocabulary

VOCABULARY = public_vocabulary("piece_bpe_32k.model")
TEXTS = [
    "hello world", "a", "  two  spaces \n\n x ", "é ß ü ▁ lit ▁▁x", "日本語 😀", "", " ", "ab", "<s> </s> <unk>", "tab\tand\r\n", "x" * 400, "▁",
    "word, word. (word)",
]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces(VOCABULARY, 0.5)


def ids(sample):
    return tuple(np.frombuffer(sample["ids"], "<u4").tolist())


def whole(vocabulary, text):
    """All spellings of a short text with their probabilities."""
    parts = [spellings(lattice(vocabulary, 1, w)) for w in text.split(" ")]
    return {tuple(itertools.chain.from_iterable(p for p, _ in c)): math.exp(sum(q for _, q in c)) for c in itertools.product(*parts)}


def test_distinct_exact_and_seeded(vocabulary):
    draw = sampling.Sampler(vocabulary)
    rows = list(enumerate(TEXTS))
    got = draw(rows, 4, 7)
    for n, text in rows:
        own = [s for s in got if s["doc_id"] == n]
        assert own and len({ids(s) for s in own}) == len(own)
        assert all(vocabulary.decoded(list(ids(s))) == text for s in own)
        assert [s["perturbed"] for s in own] == sorted((s["perturbed"] for s in own), reverse=True)
        assert all(0 <= s["inclusion"] <= 1 for s in own)
    alone = [s for r in rows for s in sampling.Sampler(vocabulary)([r], 4, 7)]
    assert [(s["doc_id"], s["sample"], ids(s)) for s in alone] == [(s["doc_id"], s["sample"], ids(s)) for s in got]
    assert [ids(s) for s in draw(rows, 4, 8)] != [ids(s) for s in got]


def test_log_probabilities_and_exhaustion(vocabulary):
    draw = sampling.Sampler(vocabulary)
    for text in ("ab", "to be", "in"):
        every = whole(vocabulary, text)
        assert sum(every.values()) == pytest.approx(1)
        got = draw([(1, text)], len(every) + 5, 0)
        assert {ids(s) for s in got} == set(every)
        for s in got:
            assert math.exp(s["log_prob"]) == pytest.approx(every[ids(s)], rel=1e-6)
        assert got[-1]["inclusion"] == 1.0


def test_frequencies_without_replacement(vocabulary):
    every = whole(vocabulary, "tion is")
    n = 6000
    got = sampling.Sampler(vocabulary)([(i, "tion is") for i in range(n)], 2, 1)
    first, second = (Counter(ids(s) for s in got if s["sample"] == k) for k in (1, 2))
    for spelling, p in sorted(every.items(), key=lambda x: -x[1])[:4]:
        q = sum(o * p / (1 - o) for s, o in every.items() if s != spelling)
        assert first[spelling] / n == pytest.approx(p, abs=4 * math.sqrt(p / n))
        assert second[spelling] / n == pytest.approx(q, abs=4 * math.sqrt(q / n))
    # inverse inclusion weights estimate sums over all segmentations: here of 1
    weights = [math.exp(s["log_prob"]) / s["inclusion"] for s in got]
    assert sum(weights) / n == pytest.approx(1, abs=0.05)


def test_cuts_keep_the_lattice(vocabulary):
    for word in (SPACE + "thea,", SPACE + "x(y)z", SPACE * 3 + "to"):
        segments, first = sampling.cut(sampling.trie(vocabulary), ["x", word, SPACE])
        assert first.tolist()[:2] == [0, 1]
        parts = segments[1 : first[2]]
        assert "".join(parts) == word
        lattices = sampling.Lattices(vocabulary)
        lattices.rows(["other words", "first"])
        held = lattices.rows([word.replace(SPACE, " ")[1:]])[0]
        assert len(held) == len(parts)
        product = [spellings(lattices.lattice(int(i))) for i in held]
        spaces = len(word) - len(word.lstrip(SPACE))
        want = dict(spellings(lattice(vocabulary, spaces, word[spaces:])))
        joined = {tuple(itertools.chain.from_iterable(p for p, _ in c)): sum(q for _, q in c) for c in itertools.product(*product)}
        assert set(joined) == set(want) and all(joined[s] == pytest.approx(want[s]) for s in want)


def test_what_is_kept_does_not_matter(vocabulary):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("theaino ré,.日"), 80)) for _ in range(60)] + TEXTS
    rows = list(enumerate(texts))
    whole = sampling.Sampler(vocabulary)(rows, 3, 1)
    small = sampling.Sampler(vocabulary)
    small.lattices.most_steps = 500
    again = [s for r in reversed(rows) for s in small([r], 3, 1)]
    key = lambda s: (s["doc_id"], s["sample"])
    assert sorted(whole, key=key) == sorted(again, key=key)
    assert small.lattices.steps.size < 20_000


def test_clashing_hashes_change_nothing(vocabulary, monkeypatch):
    rows = list(enumerate(TEXTS))
    want = sampling.Sampler(vocabulary)(rows, 2, 1)

    def clash(*_):
        raise sampling.Clash

    monkeypatch.setattr(sampling, "told_apart", clash)
    assert sampling.Sampler(vocabulary)(rows, 2, 1) == want


def test_one_value_at_a_time():
    for state in (0, 1, 2**64 - 1, 12345678901234567890):
        for step in (0, 1, 7):
            assert sampling._uniform_one(state, step) == float(sampling.uniform(np.full(1, state, np.uint64), step)[0])


def test_frame(spark):
    rows = [(1, "to be or not"), (1, "to be or not"), (2, None), (None, "x"), (3, "é " * 3000)]
    docs = spark.createDataFrame([(d, t, 5, "z") for d, t in rows], "doc_id long, text string, sample int, ids string")
    got = sampling.sample_segmentations(docs, VOCABULARY, k=3)
    found = got.collect()
    count = Counter(r.doc_id for r in found)
    assert count == {1: 6, 2: 1, 3: 3}
    assert [(r.n_pieces, r.ids) for r in found if r.doc_id == 2] == [(0, bytearray())]
    back = {(r.doc_id, r.text) for r in sampling.decode_segmentations(got, VOCABULARY).collect()}
    assert back == {(1, "to be or not"), (2, ""), (3, "é " * 3000)}
    assert sampling.sample_segmentations(docs.limit(0), VOCABULARY).count() == 0
    assert {(r.doc_id, r.text) for r in sampling.sample_segmentations(docs, VOCABULARY, k=3, decoded=True).collect()} == back
    again = {(r.doc_id, r.text_crc32) for r in sampling.digests(sampling.decode_segmentations(got, VOCABULARY)).collect()}
    assert again == {(d, zlib.crc32(t.encode())) for d, t in back}
