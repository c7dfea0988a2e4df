import random
import re

import pytest

from tessera.llm import license as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = []
    for table, kind in ((lic.BASE, "base"), (lic.NOTICES, "notice")):
        for phrase, label in table.items():
            p = phrase.split()
            found += [(kind, label, i) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


TEXTS = [
    None, "", "MIT license", "mit-LICENSE mit license", "The MIT License\nand Apache/License, general public  license", "permit license",
    "mit licensed", "é mit license", "émit license", "mit license", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3",
]


@pytest.mark.parametrize("text", TEXTS)
def test_places_match_brute_force(text):
    n, found = lic.places(text or "")
    assert (n, sorted(found)) == brute(text)


def test_random_texts():
    rng = random.Random(4)
    parts = ["MIT", "mit", "License", "license", "apache", "general", "public", "gnu", "version", "3", "2", "0", "é", "x_y", "licensed", "under", "the"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice([" ", "\n", ", ", "-", ".", " "]) for _ in range(rng.randrange(40)))
        n, found = lic.places(text)
        assert (n, sorted(found)) == brute(text)


@pytest.mark.parametrize(
    "expression,ok,named",
    [
        ("MIT", True, {"mit"}),
        ("MIT OR GPL-3.0-only", True, {"mit", "gpl-3.0-only"}),
        ("MIT AND GPL-3.0-only", False, {"mit", "gpl-3.0-only"}),
        ("MIT AND GPL-2.0 OR ISC", True, {"mit", "gpl-2.0", "isc"}),
        ("MIT AND (GPL-2.0 OR ISC)", True, {"mit", "gpl-2.0", "isc"}),
        ("(GPL-2.0)", False, {"gpl-2.0"}),
        ("Apache-2.0 WITH LLVM-exception AND MIT", True, {"apache-2.0 with llvm-exception", "mit"}),
        ("GPL-2.0 WITH Classpath-exception-2.0", False, {"gpl-2.0 with classpath-exception-2.0"}),
    ],
)
def test_expressions(expression, ok, named):
    assert lic.evaluate(expression) == (ok, named)


@pytest.mark.parametrize("expression", ["", "AND", "MIT AND", "MIT ISC", "(MIT", "MIT)", "()", "OR MIT", "MIT OR AND ISC"])
def test_bad_expressions(expression):
    with pytest.raises(lic.BadExpression):
        lic.postfix(expression)


def test_tags_and_summary(spark):
    rows = [
        (1, "SPDX-License-Identifier: MIT OR Apache-2.0\ncode"), (2, None), (3, "mit license x mit license"), (4, "SPDX-License-Identifier: (broken"),
        (4, "SPDX-License-Identifier: (broken"), (None, "mit license"), (5, "word " * 20000 + "apache license"),
    ]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, labels string, n_words int")
    got = {r.doc_id: r for r in lic.summary(lic.scan(docs)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert (got[1].labels, got[1].permissive_tag, got[1].score, got[1].n_base) == ("apache-2.0,mit", True, 1.0, 0)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].base_labels, got[3].score) == (2, 0, 3, "mit", 0.6)
    assert got[4].labels == ""
    assert (got[5].first_word, got[5].n_words) == (20000, 20002)
    assert lic.scan(docs.limit(0)).count() == 0


TAGGED = "SPDX-License-Identifier: "


@pytest.mark.parametrize(
    "text,want",
    [
        (TAGGED + "MIT OR Apache-2.0 -->", [("permissive", "apache-2.0", 0), ("permissive", "mit", 0)]),
        (TAGGED + "MIT OR GPL-2.0+ see the file", [("permissive", "gpl-2.0+", 0), ("permissive", "mit", 0)]),
        (TAGGED + "(MIT AND GPL-2.0). More prose (here)", [("restricted", "gpl-2.0", 0), ("restricted", "mit", 0)]),
        (f"a {TAGGED}MIT b {TAGGED}GPL-2.0 c", [("permissive", "mit", 1), ("restricted", "gpl-2.0", 6)]),
        (f"{TAGGED}MIT OR {TAGGED}ISC", [("permissive", "mit", 0), ("permissive", "isc", 5)]),
        (f"an SPDX license identifier is x{TAGGED}ISC or é{TAGGED}ISC, then {TAGGED}MIT", [("permissive", "mit", 15)]),
        (TAGGED + "MIT AND (GPL-2.0", [("restricted", "mit", 0)]),
        (TAGGED + "MIT AND\nISC", [("restricted", "mit", 0)]),
        (TAGGED + "MIT\nISC", [("permissive", "mit", 0)]),
        (TAGGED + "(broken", []),
        (TAGGED + "banana", []),
        (TAGGED + "MIT and this file is", [("permissive", "mit", 0)]),
        (TAGGED + "MIT or later", [("permissive", "mit", 0)]),
        (TAGGED + "MIT with no warranty", [("permissive", "mit", 0)]),
        (TAGGED + "MIT AND Foo-1.0", [("restricted", "mit", 0)]),
        (TAGGED + "MIT AND LicenseRef-Own", [("restricted", "licenseref-own", 0), ("restricted", "mit", 0)]),
        (TAGGED + "0BSD OR BSL-1.0.", [("permissive", "0bsd", 0), ("permissive", "bsl-1.0", 0)]),
        (TAGGED + "GPL-2.0-or-later WITH GCC-exception-3.1 OR MIT x", [("permissive", "gpl-2.0-or-later with gcc-exception-3.1", 0), ("permissive", "mit", 0)]),
        (TAGGED + "MIT WITH Unknown-thing", [("permissive", "mit", 0)]),
        (TAGGED + "CC-BY-NC-SA-2.5", [("restricted", "cc-by-nc-sa-2.5", 0)]),
        (TAGGED + "--> MIT", []),
        (TAGGED + "MIT OR (GPL-2.0 AND", [("permissive", "mit", 0)]),
    ],
)
def test_tags_by_position(text, want):
    assert lic.places(text)[1] == want


@pytest.mark.parametrize("n", [100, 20_000])
def test_long_expressions(n):
    names = [f"licenseref-{i:05d}" for i in range(n)]
    text = f"{TAGGED}{' AND '.join(names)} OR MIT -->"
    assert len(text) > 1_000 and lic.places(text)[1] == [("permissive", x, 0) for x in [*names, "mit"]]
