import random

from tessera.operators import relate


def test_closure_of_graphs_with_circles(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7), (None, 3), (3, None)]
    want = {}
    for start in {a for a, _ in edges if a is not None}:
        front, depth, seen = {b for a, b in edges if a == start and b is not None}, 1, {}
        while front - set(seen):
            seen |= {n: depth for n in front - set(seen)}
            front, depth = {b for a, b in edges if a in front and b is not None}, depth + 1
        want |= {(start, n): d for n, d in seen.items()}
    found = relate.closure(spark.createDataFrame(edges + edges[:5], "c long, p long"), "c", "p")
    assert {(r.child, r.ancestor): r.depth for r in found.collect()} == want
    assert relate.closure(spark.createDataFrame([], "c long, p long"), "c", "p").count() == 0


def test_closure_of_a_hub_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(relate, "ROWS", 40)
    edges = [(i, 1000) for i in range(150)] + [(1000 + i, 1001 + i) for i in range(9)] + [(7, 1004), (1009, 1003), (None, 3), (3, None)]
    want, up = {}, {}
    for c, p in edges:
        if c is not None and p is not None:
            up.setdefault(c, set()).add(p)
    for start in up:
        depth, at = 1, up[start]
        while at:
            for x in at:
                want.setdefault((start, x), depth)
            at = {y for x in at for y in up.get(x, ()) if (start, y) not in want}
            depth += 1
    got = relate.closure(spark.createDataFrame(edges, "c long, p long"), "c", "p")
    assert {(r.child, r.ancestor): r.depth for r in got.collect()} == want
