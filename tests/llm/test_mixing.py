import itertools

import numpy as np
import pytest

from tessera.llm import mixing


def brute_rake(mass, targets, rounds=200):
    w = mass.astype(float).copy()
    for _ in range(rounds):
        for axis, t in enumerate(targets):
            other = tuple(a for a in range(3) if a != axis)
            sums = w.sum(other)
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * np.where(sums > 0, t / np.where(sums > 0, sums, 1), 0).reshape(shape)
    return w


def test_rake_meets_targets_as_brute_force(spark):
    rng = np.random.default_rng(2)
    mass = rng.integers(0, 50, (4, 3, 2))
    names = [[f"{d}{i}" for i in range(n)] for d, n in zip("slt", mass.shape)]
    cells = spark.createDataFrame([(*k, int(mass[i])) for k, i in zip(itertools.product(*names), np.ndindex(mass.shape))], "source string, lang string, topic string, mass long")
    targets = [rng.dirichlet(np.ones(n) * 5) for n in mass.shape]
    frames = {d: spark.createDataFrame(list(zip(names[i], targets[i].tolist())), "value string, share double") for i, d in enumerate(mixing.DIMENSIONS)}
    raked, residual = mixing.rake(cells, frames)
    assert residual <= mixing.TOLERANCE
    got = {(r.source, r.lang, r.topic): r.weight for r in raked.collect()}
    want = brute_rake(mass, targets)
    for k, i in zip(itertools.product(*names), np.ndindex(mass.shape)):
        assert got.get(k, 0.0) == pytest.approx(want[i], abs=1e-8)

    done = mixing.calibrated(raked, 0.4).collect()
    assert sum(r.mass * r.probability for r in done) == pytest.approx(0.4 * mass.sum())
    free = [r.probability / (r.weight / r.mass) for r in done if r.probability < 1]
    assert max(free) == pytest.approx(min(free))
    assert all(r.weight / r.mass * free[0] >= 1 - 1e-9 for r in done if r.probability == 1)


def test_contradicting_targets_tell_so(spark):
    cells = spark.createDataFrame([("a", "x", 5), ("b", "y", 5)], "source string, lang string, mass long")
    frame = lambda rows: spark.createDataFrame(rows, "value string, share double")
    _, residual = mixing.rake(cells, {"source": frame([("a", 0.9), ("b", 0.1)]), "lang": frame([("x", 0.5), ("y", 0.5)])}, rounds=4)
    assert residual > 0.1


def test_odd_rows(spark):
    rows = [(i, "word " * (i % 7 + 1), "en" if i % 3 else "fr", f"s{i % 2}") for i in range(60)]
    rows += [(100, None, "en", "s0"), (101, "", None, None), (102, "mit license", None, "s9"), (103, "word " * 30000, "en", None), (103, "word " * 30000, "en", None), (None, "word", "en", "s0")]
    docs = spark.createDataFrame([(*r, 1.5, True) for r in rows], "doc_id long, text string, lang string, source string, probability double, kept boolean")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[100].probability == by[101].probability == 0 and not by[100].kept and by[101].source == mixing.MISSING
    assert by[102].topic == "legal" and by[103].n_tokens == 30000
    assert not by[None].kept
    assert len({r.kept for r in out if r.doc_id == 103}) == 1
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0
