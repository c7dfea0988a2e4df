import random
import re
from itertools import permutations

from tessera.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = " ".join(f"word{i}" for i in range(220))


def failed(text):
    words = WORD.findall(text)
    return [
        len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)),
    ]


def brute(docs, labels):
    good, toxic = ({i for i, *flags in labels if flags[k] == 1} for k in (0, 1))
    rows = []
    for i, text, source in docs:
        text = text or ""
        again = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        rows.append((source or "", [*failed(text), again], i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        by_order = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                k = ord(letter) - 65
                gone = [r for r in left if r[1][k]]
                fails = [r for r in mine if r[1][k]]
                left = [r for r in left if not r[1][k]]
                by_order[order, step] = [
                    len(left), len(gone), len(fails) - len(gone), sum(sum(r[1]) == 1 for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (order, step), v in by_order.items():
            shapley = sum(x[1] for (o, s), x in by_order.items() if o[s - 1] == order[step - 1])
            out[part, order, step] = [*v, shapley]
    return out


def audited(spark, docs, labels):
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, source string, mask string, quality int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = audit.audit(df, marks).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(got) == len(rows)
    return got


def test_equals_brute_force(spark):
    rng = random.Random(11)
    texts = [PLAIN, PLAIN.upper(), PLAIN + " #", "a " * 250, "a b " * 120 + "$", "", None, "é" * 49 + "A", "é" * 50 + "A", "x\x0by\tz\x1fw", PLAIN + " " + PLAIN, "Ä " * 300]
    docs = [(i, rng.choice(texts), rng.choice(["s", "", None, "t"])) for i in range(120)]
    docs += [(5, docs[5][1], docs[5][2]), (7, PLAIN, "s"), (None, PLAIN, "s"), (None, PLAIN, "u"), (-3, "", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, PLAIN, "s")], []) == brute([(1, PLAIN, "s")], [])


def test_intervals_cover_each_order_once():
    for mask in range(1, 32):
        steps = {}
        for step in range(1, 6):
            n = 0
            for rank in range(120):
                n += sum(sign for m, s, r, sign in audit.interval_ends() if (m, s, r) == (mask, step, rank)) if mask in (1, 9, 31) else 0
                steps.setdefault(rank, []).append(n)
        if mask in (1, 9, 31):
            failing = {"ABCDE"[b] for b in range(5) if mask >> b & 1}
            for rank, order in enumerate(audit.ORDERS):
                assert steps[rank] == [int(s == min(order.index(f) for f in failing)) for s in range(5)]
