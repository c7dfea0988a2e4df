import pytest

from tessera import plans
from tessera.operators import cast

CAST = [
    'Alonzo "Stinky" Goodhue', "Heather Chandler", "Heather Duke", "Kevin Gnapoor", "Curly McLain", "Clifford Bradshaw", "Young Ben", "Benjamin Stone", "Mrs. Ida Bogen",
    "Dr. Pomatter", "Tom Hawkins", "Major Eric Fenton", "Count Carl-Magnus Malcolm", "The Mayor of Whoville", "Madame Giry", "Meg Giry", "Mayzie La Bird", "Cecil B. DeMille",
    "Juliet Capulet", "Baby Frances Gumm", "Daryl Van Horne", "Moses' Son", "J. Jonah Jameson", "Audrey II", 'Jack "J.D." Dean', "Doctor Faustus", "Élodie Roux",
]
MENTIONS = [
    ("Heather Chandler", "Heather Chandler", "exact"), ("the heather chandler", "Heather Chandler", "exact"), ("Dr. Faustus", "Doctor Faustus", "exact"),
    ("Mayzie LaBird", "Mayzie La Bird", "exact"), ("Elodie Roux", "Élodie Roux", "exact"), ("The Mayor", "The Mayor of Whoville", "title"), ("H. Chandler", "Heather Chandler", "initial"),
    ("J.D.", 'Jack "J.D." Dean', "nickname"), ("Alonzo P. Goodhue", 'Alonzo "Stinky" Goodhue', "first_last"), ("Stinky Goodhue", 'Alonzo "Stinky" Goodhue', "first_last"),
    ("Cecil B. DeMile", "Cecil B. DeMille", "typo"), ("Carl-Magnus", "Count Carl-Magnus Malcolm", "first_names"), ("Major Fenton", "Major Eric Fenton", "rank"),
    ("Mr. Hawkins", "Tom Hawkins", "address"), ("Mrs. Bogen", "Mrs. Ida Bogen", "rank"), ("Dr. Jim Pomatter", "Dr. Pomatter", "rank"), ("Kevin G", "Kevin Gnapoor", "surname_initial"),
    ("Curly", "Curly McLain", "word"), ("Capulet", "Juliet Capulet", "word"), ("Baby", "Baby Frances Gumm", "age"), ("Giry", "Madame Giry", "bare_word"),
    ("Cliff", "Clifford Bradshaw", "short"), ("Benjamin", "Benjamin Stone", "word"), ("Darryl", "Daryl Van Horne", "near"), ("Jamesson", "J. Jonah Jameson", "near_last"),
    ("Van Horne", "Daryl Van Horne", "part"), ("Heather", None, None), ("Lord Capulet", None, None), ("Mr. Giry", "Meg Giry", "address"), ("Moses", None, None), ("Nobody", None, None), ("Louise", None, None), ("...", None, None),
    ("", None, None), ("Young", None, None),
]


def people(spark, names, scope="s"):
    return spark.createDataFrame([(scope, i, n, n.upper()) for i, n in enumerate(names)], "play string, at long, name string, told string")


def resolved(spark, mentions, names, **options):
    df = spark.createDataFrame([("s", m) for m in mentions] + [("other", "Curly"), (None, "Curly"), ("s", None)], "play string, mention string")
    rows = cast.resolved_mentions(df, people(spark, names), "play", "mention", "at", "name", **options).collect()
    assert [(r.character, r.rule) for r in rows if r.scope == "other"] == [(None, None)] and all(r.scope for r in rows)
    return {r.token: (r.character, r.rule) for r in rows if r.scope == "s"}


def test_each_rule_and_none(spark):
    got = resolved(spark, [m for m, *_ in MENTIONS] * 2, CAST + CAST[:3])
    assert got == {m: (who, rule) for m, who, rule in MENTIONS}
    assert {rule for *_, rule in MENTIONS if rule} == set(cast.RULES) - {"first_word"}


def test_several_hits_are_none(spark):
    names = ["Ann Lee", "Bo Lee", "Ann Marie Lee", "Lee Ito", "Captain Kim Ito", "Captain Bo Ito", "Old Ann"]
    got = resolved(spark, ["Lee", "Captain Ito", "Ann", "A. Lee", "Ann Q. Lee", "Ann Le", "Kim", "Mr. Ito"], names)
    assert got == {
        "Lee": ("Lee Ito", "first_word"), "Captain Ito": (None, None), "Ann": (None, None), "A. Lee": (None, None), "Ann Q. Lee": (None, None), "Ann Le": (None, None),
        "Kim": ("Captain Kim Ito", "word"), "Mr. Ito": (None, None),
    }


def test_other_names_report_their_character(spark):
    got = resolved(spark, ["Goodhue"], CAST, character="told")
    assert got == {"Goodhue": ('ALONZO "STINKY" GOODHUE', "word")}


@pytest.mark.parametrize(
    "names,want",
    [
        (["Diana", "Diana Goodman"], {"Diana": "Diana Goodman"}),
        (["Eliza Hamilton", "Eliza Schuyler Hamilton"], {"Eliza Hamilton": "Eliza Schuyler Hamilton"}),
        (["Doctor Who Is", "Dr. Who Is", "The Engineer", "Engineer"], {"Dr. Who Is": "Doctor Who Is", "Engineer": "The Engineer"}),
        (["General Cartwright", "General Matilda B. Cartwright"], {"General Cartwright": "General Matilda B. Cartwright"}),
        (["Cee Cee Bloom", 'Cecelia Carol "Cee Cee" Bloom', "Cee Cee"], {"Cee Cee Bloom": 'Cecelia Carol "Cee Cee" Bloom', "Cee Cee": None}),
        (["Soliquisto", "The Great Soliquisto"], {"Soliquisto": "The Great Soliquisto"}),
        (["Audrey", "Audrey II"], {}), (["Harry", "Harry Jr."], {}), (["Ti Moune", "Little Ti Moune"], {}),
        (["Ann", "Ann Lee", "Ann Ito"], {}),  # two targets
        (["Ann", "Ann Lee", "Ann Rose Lee", "Ann"], {"Ann": None, "Ann Lee": "Ann Rose Lee"}),
        (["Mayzie La Bird", "Mayzie LaBird"], {"Mayzie LaBird": "Mayzie La Bird"}),
        (["A", "A B", "A B C", "A B C D", "X"], {"A B C": "A B C D"}),
        (["Bo", "Bo X", "Bo X Y II", "Bo X Y"], {}),
        (["", "...", "é"], {"": None, "...": None}),
    ],
)
def test_variants(spark, names, want):
    got = {r.name: r.canonical for r in cast.merged_variants(people(spark, names), "play", "at", "name").collect()}
    if names[0] == "Ann" and len(names) == 4 or names[0] in ("A", "Bo", "Cee Cee Bloom"):
        assert got == chained(names)
    else:
        kept = {n: want.get(n, n) for n in names}
        assert got == {n: c for n, c in kept.items() if c}


def chained(names):
    """Plain words only: a name goes into the one longer name that it begins or ends alike, and on."""
    def targets(c):
        w = c.replace('"', "").split()
        found = set()
        for d in set(names) - {c}:
            v = d.replace('"', "").split()
            tail = v[len(w) :]
            if f'"{c}"' in d or f'"{" ".join(w[:-1])}"' in d and w[-1] == v[-1]:
                found.add(d)
            elif len(v) > len(w) and v[0] == w[0] and not (v[: len(w)] == w and all(x == "II" for x in tail)) and (v[: len(w)] == w or len(w) > 1 and v[-1] == w[-1]):
                found.add(d)
        return found

    def end(c):
        t = targets(c)
        return end(t.pop()) if len(t) == 1 else c

    return {n: end(n) for n in names}


def test_names_are_folded_once(spark):
    names = [(None, 1, "Ann"), ("s", 2, None), ("s", 3, "Ann"), ("s", 4, "Ann Lee"), ("t", 5, "Ann"), ("t", 6, "...")]
    df = cast.merged_variants(spark.createDataFrame(names, "play string, at long, name string"), "play", "at", "name")
    assert sorted(map(tuple, df.collect())) == [("s", "Ann", "Ann Lee"), ("s", "Ann Lee", "Ann Lee"), ("t", "Ann", "Ann")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "regexp_replace(" not in plan


def test_names_are_made_where_rows_are_dealt_out(spark, monkeypatch):
    written = []
    scratch = cast.scratch
    monkeypatch.setattr(cast, "scratch", lambda df, name: written.append(df) or scratch(df, name))
    plans.QUERIES["name_variants"][0](spark, "/root/testdata/sf0.001")
    lines = written[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (dealt,) = (i for i, line in enumerate(lines) if "Repartition" in line)
    assert any("initcap(" in line for line in lines[:dealt]) and not any("initcap(" in line for line in lines[dealt:])
