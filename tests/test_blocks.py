import random

import pytest

from tessera.operators import blocks


def read(text):
    return [(i["block"], i["label"], i["act"], i["title"]) for i in blocks.items_of(text)]


CASES = {
    "": [],
    "no list": [],
    "*\n* \n#": [],
    "* a\n* b": [(0, None, None, "a"), (0, None, None, "b")],
    "; Act I\n* a\n; Act II\n* b": [(0, None, 1, "a"), (0, None, 2, "b")],
    "Act 1\n* a\nSecond Act:\n# b": [(0, None, 1, "a"), (0, None, 2, "b")],
    "* Act One\n* a\n* Act Two\n* b": [(0, None, 1, "a"), (0, None, 2, "b")],
    "; Act I\n* a\n; Act II\n* b\n; Act I\n* c": [(0, None, 1, "a"), (0, None, 2, "b"), (1, None, 1, "c")],
    "; Act I\n* a\n; Chicago\n; Act I\n* c": [(0, None, 1, "a"), (1, "Chicago", 1, "c")],
    "; Act II\n; Act I\n* a": [(0, None, 1, "a")],
    "; 2004 tour\n; Original cast\n* a\n; Notes\n* gone\n== More ==\n* b": [(1, "Original cast", None, "a"), (1, "Original cast", None, "b")],
    "== Songs ==\n* a\n=== Notes ===\n* gone\n==== Deep ====\n* gone\n=== More ===\n* b": [(0, None, None, "a"), (0, None, None, "b")],
    "== History ==\n* gone\n=== Act I ===\n* gone\n; Act I\n* a": [(0, None, 1, "a")],
    "* group:\n** a\n** b\n* c:\n* d": [(0, None, None, "a"), (0, None, None, "b"), (0, None, None, "c:"), (0, None, None, "d")],
    "'''London'''\n* a\n; Scene 3\n* b\n; Disc 1\n* c": [(0, "London", None, t) for t in "abc"],
    "* a\r\n*b\n  # c": [(0, None, None, "a"), (0, None, None, "b"), (0, None, None, "c")],
    "=\n==\n=== ===\n* a\n;\n''''''\n* b": [(0, None, None, "a"), (0, None, None, "b")],
    "; Act 99999999999999999999\n* a": [(0, None, 999999999, "a")],
}


@pytest.mark.parametrize("text", CASES)
def test_lists(text):
    assert read(text) == CASES[text]


ITEMS = {
    '1. "All of It" – Ann, Bo and Company': ("All of It", ["Ann", "Bo"], True, False, False),
    "a-b (with - dash) -- Kim & Kim": ("a-b (with - dash)", ["Kim"], False, False, False),
    '"One – Two" (Reprise) – Ann': ("One – Two", ["Ann"], False, False, True),
    "Overture – Orchestra": ("Overture", [], False, True, False),
    "''Slow'' <b>Song</b> [reprise 2]": ("Slow Song", [], False, False, True),
    "No. 4b) Title – Full Company": ("Title", [], True, False, False),
    "Reprise": None,
    "– Ann": ("– Ann", [], False, False, False),
    '""': None,
}


@pytest.mark.parametrize("text", ITEMS)
def test_items(text):
    made = blocks.item_of(text)
    assert (made and tuple(made[k] for k in ("title", "singers", "ensemble", "instrumental", "reprise"))) == ITEMS[text]


def brute(text):
    """Each document by itself: lists, scores and the choice, in plain loops."""
    lists = {}
    for i in blocks.items_of(text):
        lists.setdefault(i["block"], []).append(i)
    out = {}
    for block, its in lists.items():
        label = its[0]["label"] or ""
        if len(its) < 3:
            continue
        low = label.lower()
        sung = sum(bool(i["singers"] or i["ensemble"]) for i in its)
        told = sum(bool(i["singers"] or i["ensemble"] or i["instrumental"]) for i in its)
        recording = "album" in low or "studio" in low
        score = -1000 * ("film" in low) + 300 * ("current" in low) + 100 * (low.startswith("broadway")) - 50 * ("off-broadway" in low) - 150 * recording - 30 * ("revival" in low)
        score += (0 if recording else int(told * 200 / len(its) + 0.5)) + min(len(its), 40)
        out[block] = (sung * 2 >= len(its) and not recording, score, -block, label, len(its), told)
    best = max(out.values(), default=None)
    return {(b, v[3] or None, v[4], v[5], v[1], v == best) for b, v in out.items()}


def test_scores_and_choice(spark):
    rng = random.Random(6)
    lines = ["* a – Ann", "* b", "# c - Company", "* Overture", "* a (Reprise)", "** d", "; Act I", "; Act II", "; Broadway", "; off-broadway", "; current version", "; film",
             "; 1999 revival", "; studio album tour", "; Notes", "== Songs ==", "=== Changes ===", "prose", "", "; Other", "* group:", "* e – Bo, Ann"]
    texts = ["\n".join(rng.choices(lines, weights=[6] * 6 + [1] * 16, k=rng.randrange(60))) for _ in range(150)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "id long, text string, block int")
    items = blocks.listed_items(docs, "id", "text")
    lists = blocks.scored_lists(items, "id")
    got = {i: set() for i in range(len(texts))}
    for r in lists.collect():
        got[r.id].add((r.block, r.label, r.n, r.n_told, r.score, r.chosen))
    assert got == {i: brute(t or "") for i, t in enumerate(texts)}
    chosen = {}
    for r in blocks.chosen_items(items, lists, "id").orderBy("id", "place").collect():
        chosen.setdefault(r.id, []).append((r.place, r.title, r.instrumental, r.reprise))
    for i, t in enumerate(texts):
        best = [b for b, *_, c in got[i] if c]
        its = [x for x in blocks.items_of(t or "") if x["block"] in best]
        silent, seen, want = {x["title"].lower() for x in its if x["instrumental"] and not x["reprise"]}, set(), []
        for x in its:
            if x["reprise"] or x["title"].lower() not in seen:
                want.append((len(want) + 1, x["title"], x["instrumental"] or x["reprise"] and x["title"].lower() in silent and not x["singers"] and not x["ensemble"], x["reprise"]))
            if not x["reprise"]:
                seen.add(x["title"].lower())
        assert chosen.get(i, []) == want
