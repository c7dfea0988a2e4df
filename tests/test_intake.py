import random

from pyspark.sql import functions as F

from tessera.functions import albums, labels
from tessera.operators import suggest, validate


def test_leads_of_albums(spark):
    rows = {
        ("Spamalot (Original Broadway Cast)", "spamalot"): True, ("Monty Python's Spamalot: Live", "spamalot"): True, ("Disney's The Lion King", "lion king"): True,
        ("Not Spamalot", "spamalot"): False, ("The Great Comet", "comet"): False, ("", "x"): False, ("x", ""): False, ("A Chorus Line (1975)", "chorus line"): True,
        ("Hamilton - An American Musical", "hamilton"): True, ("Wicked the Broadway Musical", "wicked"): True, ("Wicked Nights", "wicked"): False, ("Wicked The Musical", "wicked"): True, (None, "x"): False,
    }
    df = spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "name string, wanted string, want boolean")
    got = df.select("name", "wanted", "want", albums.leads_to(albums.lead(F.col("name")), F.array("wanted")).alias("got")).collect()
    assert [(r.name, r.wanted) for r in got if r.got != r.want] == []


def test_every_unwanted_word(spark):
    words = [w.replace("lullab(?:y|ies)", "lullabies").replace("remix(?:es)?", "remix").replace("s?", "").replace("?", "") for w in albums.BAD_WORDS + albums.FOREIGN_WORDS]
    df = spark.createDataFrame([(f"Show ({w})", None) for w in words] + [("Show", f"The {w} Company") for w in words], "name string, artist string")
    assert df.where(~albums.unwanted(F.col("name"), F.col("artist"))).count() == 0
    fine = spark.createDataFrame([("Show", None), (None, "Cast"), ("Discovering Berliner", "Pianos")], "name string, artist string")
    assert fine.where(albums.unwanted(F.col("name"), F.col("artist"))).count() == 0


def test_films_and_names_alone(spark):
    df = spark.createDataFrame([("Show (Motion Picture)", True), ("Show (Motion Picture)", False), ("Show (Motion Picture)", None), ("Show", True)], "name string, film boolean")
    got = df.select(albums.classified(F.col("name"), F.lit(None), F.array(F.lit("show")), F.col("film"), any_name=True).alias("c")).collect()
    assert [r.c and (r.c.tier, r.c["rank"]) for r in got] == [(62, 62), None, None, (55, 55)]


def test_fields_of_submitted_rows(spark):
    rows = [
        (1, " a​\tb ", "12", "yes", "https://x.example.org/a"), (2, None, None, None, None), (3, "é" * 6, "007", "N", "https://example.org.evil.com/"), (4, " ", "9" * 40, "2", "javascript:x"),
        (5, "x", "-3", " TRUE ", "https://a@example.org/"), (6, "abcde", "12.0", "no", "https://" + "x" * 600 + ".example.org/"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, t string, n string, f string, u string, errors string")
    fields = [
        validate.text("t", F.col("t"), "T", required=True, least=2, most=5), validate.integer("n", F.col("n"), "N", 0), validate.flag("f", F.col("f"), "F"),
        validate.https_url("u", F.col("u"), "U", ["example.org"]), validate.rule("t", F.col("id") == 4, "second"), validate.rule("row", F.col("id") > 5, "late"),
    ]
    got = {r.id: (r.t, r.n, r.f, r.u, r.errors) for r in validate.validated(df, fields, ["id"]).collect()}
    assert got == {
        1: ("a b", 12, True, "https://x.example.org/a", {}),
        2: (None, None, False, None, {"t": "T is required"}),
        3: ("é" * 6, 7, False, None, {"t": "T must be at most 5 characters", "u": "U must be of example.org"}),
        4: (None, None, False, None, {"t": "T is required", "n": "N must be at least 0", "f": "F must be yes or no", "u": "U must be a full https:// address"}),
        5: ("x", None, True, None, {"t": "T must be at least 2 characters", "n": "N must be at least 0", "u": "U must be a full https:// address"}),
        6: ("abcde", None, False, None, {"n": "N must be a whole number", "u": "U must be at most 500 characters", "row": "late"}),
    }
    known = spark.createDataFrame([(0, "Abc"), (1, "ABC")], "at long, value string")
    spelled = spark.createDataFrame([(1, "ábc"), (2, "Zed"), (3, "zéd"), (4, None)], "id long, v string")
    assert {r.id: r.v for r in validate.first_spelling(spelled, "v", "id", known).collect()} == {1: "Abc", 2: "Zed", 3: "Zed", 4: None}


def test_votes_equal_a_plain_count(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", None]), rng.choice([True, False, None]), rng.choice(["drama", "a comedy drama", ""])) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, g string, v string, f boolean, t string")
    want, flags = {}, {}
    for k, g, _, _, t in rows:
        votes = [(w, i) for i, h, w, *_ in rows if g is not None and h == g and w is not None]
        seen = {w: min(i for x, i in votes if x == w) for w, _ in votes}
        others = [w for w, i in votes if i != k]
        order = sorted(set(others), key=lambda w: (-others.count(w), seen[w]))
        low = [v for p, v in (("comed", "Comedy"), ("drama", "Drama")) if p in t]
        note = f"{others.count(order[0])} of {len(others)} say {order[0]}" if len(order) > 1 else None
        want[k] = (order[0], "medium", order[1:], note) if order else (low[0], "low", low[1:], None) if low else None
        ours = [x for i, h, _, x, _ in rows if g is not None and h == g and x is not None and i != k]
        yes = sum(ours)
        flags[k] = (yes > 0 and 2 * yes >= len(ours), 0 < yes < len(ours)) if ours else None
    got = suggest.voted(df, "k", "g", "v", "k", [("comed", "Comedy"), ("drama|traged", "Drama")], "t").collect()
    assert {r.k: r.suggestion and tuple(r.suggestion) for r in got} == want
    assert {r.k: r.suggestion and (r.suggestion.value, r.suggestion.disputed) for r in suggest.flagged(df, "k", "g", "f").collect()} == flags


def test_readings_of_titles(spark):
    df = spark.createDataFrame([("One (Two Three)",), ("One (Reprise)",), ("One (Two)",), ("(Two Three)",), ("One (a b) x",)], "t string")
    assert [r[0] for r in df.select(suggest.title_alternatives(F.col("t"))).collect()] == [["Two Three", "One"], [], [], [], []]
    marks = spark.createDataFrame([([], False), (["a"], False), (["a"], True), (["a", "b", "c"], False), (None, True)], "s array<string>, e boolean")
    assert [r[0] for r in marks.select(suggest.parts_confidence(F.col("s"), F.col("e"))).collect()] == ["low", "high", "medium", "medium", "low"]


def test_draws_equal_a_plain_generator(spark):
    def plain(seed, turn):
        a = seed % 2**32
        for _ in range(turn):
            a = (a + 0x6D2B79F5) % 2**32
            t = (a ^ (a >> 15)) * (a | 1) % 2**32
            t ^= (t + (t ^ (t >> 7)) * (t | 61)) % 2**32
            out = (t ^ (t >> 14)) / 2**32
        return out

    seeds = [0, 1, 2**32 - 1, 123456789, 2**40 + 7]
    df = spark.createDataFrame([(s,) for s in seeds], "s long")
    for turn in (1, 2, 100):
        assert [r[0] for r in df.select(labels.seeded_draw(F.col("s"), turn)).collect()] == [plain(s, turn) for s in seeds]


def test_shown_texts(spark):
    cases = {
        "One. Two! Three? Four.": ("One. Two! Three?", "OT"), "": ("", "?"), None: ("", "?"), "The Éa of x": ("The Éa of x", "EX"), "A long sentence of many words. B.": ("A long sentence of", "LS"),
        "no end but quite long here": ("no end but quite l…", "NE"), "the of": ("the of", "TO"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.s, r.i) for r in df.select("t", labels.shortened(F.col("t"), 19).alias("s"), labels.initials(F.col("t")).alias("i")).collect()}
    assert {t: g[0] for t, g in got.items()} == {t: c[0] for t, c in cases.items()}
    assert {t: g[1] for t, g in got.items()} == {t: c[1] for t, c in cases.items()}
