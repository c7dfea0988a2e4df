import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """(root, siblings of each node level by level as (before, after))."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k - k % fanout : k - k % fanout + fanout]
            ways[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return nodes[0], ways


def brute(rows, fanout):
    sources = {}
    for i, source, lang, n, text in rows:
        sources.setdefault(source, []).append((i is not None, i or 0, leaf(i, source, lang, n, text), (i, source, lang, n, text)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])], fanout) for s in names}
    root, over = tree([trees[s][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for (*_, own, (i, _, lang, n, text)), way in zip(sorted(sources[s]), trees[s][1]):
            ways = way + over[k]
            now = own
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
                now = leaf(i, s, lang, n, text.translate(str.maketrans(UPPER, LOWER)))
            for before, after in ways:
                now = H(before, now, after)
            out.append((i, own, trees[s][0], root, H(*(a + b for a, b in ways)), now, now == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, at int"


def proved(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return [tuple(r) for r in merkle.manifest(df, **options).collect()]


def some_rows():
    rng = random.Random(12)
    rows = []
    for i in rng.sample(range(10_000), 170):
        source = rng.choice(["hot", "hot", "hot", None, "", "b", "é", "B"])
        rows.append((i, source, rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["Some Text", "plain", None, "", "ÄBC é", "X" * 50_000])))
    return rows + [(None, "hot", None, None, None), (None, "alone", "x", 1, "A")] + rows[:3] + [rows[0][:4] + ("Other",), (2**60 + 1, "hot", "en", 1, "Big")]


@pytest.mark.parametrize("fanout,height", [(2, 1), (2, 3), (3, 2), (16, 3)])
def test_equals_brute_force(spark, fanout, height):
    rows = some_rows()
    assert sorted(proved(spark, rows, fanout=fanout, height=height), key=repr) == sorted(brute(rows, fanout), key=repr)


def test_one_row_and_none(spark):
    rows = [(5, "s", "en", 1, "A")]
    assert proved(spark, rows) == brute(rows, 16)
    assert proved(spark, rows)[0][1] == proved(spark, rows)[0][3]
    assert proved(spark, []) == []


def test_proofs_fold_to_the_root(spark):
    rows = some_rows()[:40]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    for r in merkle.manifest(df, 2, 2, with_proof=True).collect():
        assert merkle.fold(r.leaf, r.before, r.after) == r.root
        assert merkle.digest("".join(a + b for a, b in zip(r.before, r.after))) == r.proof_sha256
