import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from tessera.llm import tokenfile as tf

VOCABULARY = tf.public_vocabulary("byte_bpe_50k.json")


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 9, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    assert (tf.from_planes(tf.to_planes(ids, kind), n) == ids).all()


def test_piecewise_encoding_equals_whole_encoding():
    texts = [
        "", " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "a \n b", "a\n b", "a\n\n  b", "x\t y", "it's  we'll 'd", "é ß  ü",
        "　 a  b", "<|endoftext|> end <|endoftext|>", "12 34  56", "!!! ??", "a\x1c b\x1f  c", "日本 語  です", "\r\n \r\n x",
        "\u0085 next", "tab\t\tspace \t x", "emoji 😀  😀", "a" * 5000, "ab " * 3000,
    ]
    coder = tf.Encoder(VOCABULARY)
    for most in (250_000, 3, 3):
        coder.most_known = most
        got = [np.frombuffer(x, "<u4").tolist() for x in coder(texts)]
        assert got == plain(texts)


def test_random_texts_in_batches():
    rng = np.random.default_rng(12)
    parts = [*"abcéßñ日１2.,!?'\"-$%&_`", "the", "ing", "word", "'s", "'ll", " ", " ", " ", "  ", "\n", "\t", "\u0345", "\u00aa", "\u01c5", "\u024f", "\u0250"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 60))) for _ in range(4_000)]
    coder = tf.Encoder(VOCABULARY, most_known=500)
    got = [x for at in range(0, len(texts), 300) for x in coder(texts[at : at + 300])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == plain(texts)


def expected(rows):
    out, start = [], 0
    rows = sorted(((d, t or "") for d, t in rows if d is not None))
    for (d, _), ids in zip(rows, plain([t for _, t in rows])):
        ids = [*ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out)


@pytest.mark.parametrize("kind,block", [("byte", 16), ("bit", 50), ("byte", 65536)])
def test_file_round_trip(spark, tmp_path, kind, block):
    rows = [(5, "five is here " * 9), (1, None), (3, ""), (3, "three"), (3, "three"), (None, "lost"), (-7, "long " * 500), (9, "é ß  x")]
    docs = spark.createDataFrame([Row(doc_id=d, text=t, part="p", ids=1, chunk=None) for d, t in rows], "doc_id long, text string, part string, ids int, chunk string")
    folder = str(tmp_path / "tokens")
    tf.write_tokens(docs, folder, VOCABULARY, block=block, kind=kind, parts=3)
    got = tf.read_tokens(spark, folder)
    want = expected(rows)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got.collect())
    index = spark.read.parquet(f"{folder}/index").orderBy("start").collect()
    at = 0
    for r in index:
        assert r.start == at and r.n_ids <= block
        at += r.n_ids
    assert at == sum(w[2] for w in want) and sum(r.n_docs for r in index) == len(want)
    whole = b"".join(bytes(r.ids) for r in sorted(got.collect(), key=lambda r: r.start))
    for a, b in ((0, at), (3, 9), (at - 5, at + 100), (7, 7), (at, at + 1), (block - 1, 2 * block + 1)):
        pieces = sorted((r.start, bytes(r.ids)) for r in tf.read_range(spark, folder, a, b).collect())
        assert b"".join(p for _, p in pieces) == whole[4 * a : 4 * b] and all(p for _, p in pieces)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    tf.write_tokens(docs, str(tmp_path / "t"), VOCABULARY)
    assert tf.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_spelled_special_tokens_get_the_librarys_ids():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    parts = ["<|endoftext|>", " ", "  ", "\n", "\t", "word", "'s", "é", "<|endof", "12"]
    texts = ["a<|endoftext|>b", " <|endoftext|> ", "<|endoftext|>"]
    texts += ["".join(parts[i] for i in rng.integers(0, len(parts), 14)) for _ in range(2_000)]
    library = Tokenizer.from_file(VOCABULARY)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tf.encoder(VOCABULARY)(texts)] == want
    assert 50256 in want[0]


def test_clashing_hashes_change_nothing(monkeypatch):
    texts = ["one two, two", "", "three  é"]

    def clash(*_):
        raise tf.Clash

    monkeypatch.setattr(tf, "told_apart", clash)
    assert [np.frombuffer(x, "<u4").tolist() for x in tf.Encoder(VOCABULARY)(texts)] == plain(texts)
