import random
import re

import pytest

from tessera.llm import secretscan as scan


def brute(text, rules=scan.RULES):
    found = []
    for k, rule in enumerate(rules):
        for m in re.finditer(f"({rule.head})({rule.value})", text or ""):
            if m.end(0) - m.end(1) >= rule.least:
                found.append((m.start(), m.end(), k))
    return sorted(found, key=lambda s: (s[0], s[2]))


PARTS = [
    "token", "secret", "PassWord", "passwd", "api_key", "APIkey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "0123456789abcdef", "AKIA", "ABCD1234", "ghp_",
    "x" * 20, "AIza", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "sk_live_", "é", "ſ", "K", "\n", "f" * 31, "f", "", "AK", "AKI", "😀", "-",
]


@pytest.mark.parametrize("piece,lane", [(1 << 20, 256), (1_000, 7), (64, 1)])
def test_equals_the_regexes(monkeypatch, piece, lane):
    monkeypatch.setattr(scan, "_PIECE", piece)
    monkeypatch.setattr(scan, "_LEAST_LANE", lane)
    rng = random.Random(piece)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(1_500)]
    assert scan.matches([t.encode() for t in texts]) == [brute(t) for t in texts]


def test_taken_matches_hide_what_they_hold():
    assert scan.matches([b"token=secret:abcdefgh"]) == [[]]
    assert scan.matches([b"token==abcdefg"]) == [brute("token==abcdefg")] == [[(0, 14, 0)]]
    assert scan.matches([b"token=abcdefg"]) == [[]]
    assert scan.matches([]) == [] and scan.matches([b"", b""]) == [[], []]


@pytest.mark.parametrize("text", ["f" * 1_000_000, "token=" * 200_000, "AKIA" * 250_000, "-----BEGIN " + "A " * 300_000, "token" + " " * 500_000 + "=abcdefgh", "é" * 300_000])
def test_very_long_texts(text):
    assert scan.matches([b"x", text.encode(), b"token=abcdefgh"]) == [[], brute(text), [(0, 14, 0)]]


def test_own_rules_and_bad_patterns():
    rules = (scan.Rule("one", "a(?:b|c?d){2,3}e"), scan.Rule("two", r"x\x41\.+"), scan.Rule("three", "(?i:k)[0-9]{2}"))
    for text in ("abde acdcdde abbbbe", "xA.. xA", "k12K34 k1"):
        assert scan.matches([text.encode()], rules) == [brute(text, rules)]
    for bad in ("a.b", "a(b", "a)b", "é", "(?=a)"):
        with pytest.raises(ValueError):
            scan._Reader(bad).tree()


def test_automaton_is_minimal():
    dfa = scan.compiled([scan._Reader(p).tree() for p in ("ab|cb|(?:ab)", "[a]b")], anywhere=False)
    # the first state, after a, after c, an end of both rules, an end of the first alone, none left
    assert len(dfa.accepts) == 6 and sorted(dfa.accepts.tolist()) == [0, 0, 0, 0, 1, 3]


def test_frames(spark):
    rows = [(1, "é token: 'abcdefgh12'"), (2, None), (3, ""), (4, "AKIA" + "A" * 12), (4, "AKIA" + "A" * 12), (None, "token=abcdefgh"), (5, "w " * 50_000 + "0" * 32)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, spans int, kind string")
    got = sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in scan.summary(scan.scan(docs)).collect())
    assert got == [
        (1, 1, 0, 0, "assign:2:20"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 0, 1, 0, "access:0:16"), (4, 0, 1, 0, "access:0:16"), (5, 0, 0, 1, "hex:100000:100032"),
    ]
    assert scan.scan(docs.limit(0)).count() == 0
