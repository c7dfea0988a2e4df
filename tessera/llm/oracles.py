"""SQL twins, in DuckDB's dialect, of the queries that SQL can express. Tokenizers, fitted models, projections and
expression parsers (operators 1, 2, 4, 7 and 10) are tested against brute force instead."""

from __future__ import annotations

from tessera.llm import imatch, mixing, pii, secretscan
from tessera.llm.substring import WINDOW

#: Words of the two deduplication queries.
_WORD = r"[^\x20\x09-\x0D]+"
#: Secrets as the SQL twin of operator 3 has them: up to 128 characters, up to three blanks round the sign. The query has
#: no such limits; both give the same where no secret goes beyond them.
_SECRET = r"\b(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,128}[\"']?"
_EMAIL = pii.EMAIL.removesuffix("+")
_PATTERN = pii.PATTERN.replace(pii.SECRET, _SECRET).replace(pii.EMAIL, _EMAIL)
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) t(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""

#: Lengths of the SQL twin's levels: no given text has more words than the last.
_LEVELS = [WINDOW * 2**k for k in range(10)]


def _op9() -> str:
    """Each level's windows are pairs of the level before that both repeat, hashed by the two hashes."""
    levels, longest = "", " UNION ALL ".join(f"SELECT doc_id, {n} AS level FROM h{n}" for n in _LEVELS)
    for half, n in zip(_LEVELS, _LEVELS[1:]):
        levels += f"""
v{n} AS (SELECT a.doc_id, a.i, md5(a.g || b.g) AS g FROM h{half} a JOIN h{half} b ON a.doc_id = b.doc_id AND b.i = a.i + {half}),
f{n} AS (SELECT g, min(doc_id) AS first, max(doc_id) AS last FROM v{n} GROUP BY 1),
h{n} AS (SELECT doc_id, i, g FROM v{n} JOIN f{n} USING (g) WHERE first < last),"""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS g FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) t(i)),
f AS (SELECT g, min(doc_id) AS first, max(doc_id) AS last FROM v GROUP BY 1),
h{WINDOW} AS (SELECT doc_id, i, g, first < doc_id AS gone FROM v JOIN f USING (g) WHERE first < last),{levels}
z AS (SELECT doc_id, max(level) AS longest FROM ({longest}) GROUP BY 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM h{WINDOW}, range({WINDOW}) r(k) WHERE gone),
x AS (SELECT doc_id, ws[i] AS word, i FROM w, unnest(range(1, len(ws) + 1)) t(i)),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept FROM x ANTI JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(longest, 0) AS longest
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN z ON z.doc_id = w.doc_id"""


def _op6() -> str:
    """The fingerprints: every rate and subset as one expression over a document's sorted terms."""
    subset = lambda j, s: f"list_transform(list_filter(f, lambda t: t.level >= {j} AND t.subset = {s}), lambda t: t.term)"
    hashed = lambda j, s: f"CASE WHEN len({subset(j, s)}) = 0 THEN '-' ELSE substr(md5(array_to_string({subset(j, s)}, ' ')), 1, 6) END"
    rates = [" || '.' || ".join(hashed(j, s) for s in range(imatch.SUBSETS)) for j in range(imatch.RATES)]
    printed = " || ':' || ".join(rates)

    def like(a: str, b: str) -> str:
        def rate(j: int) -> str:
            x, y = (f"string_split(string_split({c}, ':')[{j + 1}], '.')" for c in (a, b))
            pairs = f"list_filter(list_zip({x}, {y}), lambda p: p[1] <> '-' OR p[2] <> '-')"
            enough = 1 if j == 0 else imatch.ENOUGH
            return f"CASE WHEN len({pairs}) >= {enough} THEN len(list_filter({pairs}, lambda p: p[1] = p[2])) / len({pairs}) END"

        best = f"coalesce(greatest({', '.join(rate(j) for j in range(imatch.RATES))}), 0)"
        return f"CASE WHEN starts_with({a}, 'x') OR starts_with({b}, 'x') THEN CAST({a} = {b} AS INT)::DOUBLE ELSE {best}::DOUBLE END"

    terms = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"
    level = " + ".join(f"(v < {2 ** (32 - 2 * j)})::INT" for j in range(1, imatch.RATES))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS after FROM d),
b AS (SELECT *, substr(text, 1, n - n // 4) || substr(after, 1, n // 4) AS edited FROM o),
c AS (SELECT term, count(*) AS df FROM (SELECT unnest({terms.format("text")}) AS term FROM d) GROUP BY 1),
h AS (SELECT term, ('0x' || substr(md5(term), 1, 8))::BIGINT AS u, ('0x' || substr(md5(term), 9, 8))::BIGINT AS v FROM c, (SELECT count(*) AS total FROM d)
  WHERE df >= greatest(2.0, {imatch.LEAST_SHARE} * total) AND df <= {imatch.MOST_SHARE} * total),
x AS (SELECT term, (u % {imatch.SUBSETS})::INT AS subset, ({level})::INT AS level FROM h),
e AS (SELECT DISTINCT doc_id, 0 AS version, unnest({terms.format("text")}) AS term FROM b UNION ALL SELECT DISTINCT doc_id, 1, unnest({terms.format("edited")}) FROM b),
l AS (SELECT doc_id, version, list({{'term': term, 'subset': subset, 'level': level}} ORDER BY term) AS f FROM e JOIN x USING (term) GROUP BY 1, 2),
p AS (SELECT doc_id, version, {printed} AS fp FROM l),
q AS (SELECT b.doc_id, n, edited, coalesce(p0.fp, 'x' || md5(text)) AS f0, coalesce(p1.fp, 'x' || md5(edited)) AS f1 FROM b
  LEFT JOIN p p0 ON p0.doc_id = b.doc_id AND p0.version = 0 LEFT JOIN p p1 ON p1.doc_id = b.doc_id AND p1.version = 1),
z AS (SELECT *, coalesce(lead(f0) OVER (ORDER BY doc_id), first_value(f0) OVER (ORDER BY doc_id)) AS f2 FROM q)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, f0 AS fingerprint, f1 AS edited_fingerprint, {like("f0", "f1")} AS near_edited, {like("f0", "f2")} AS near_next FROM z"""


def _op5() -> str:
    """Proportional fitting as a recursive table of cells, and the scale with capped cells by prefix sums."""
    topic = f"CASE WHEN text IS NULL OR text = '' THEN '{mixing.MISSING}' " + " ".join(
        f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in mixing.TOPICS
    )
    target = lambda d: (
        f"t_{d} AS (SELECT {d} AS value, pow(sum(mass), {mixing.POWERS[d]}) / sum(pow(sum(mass), {mixing.POWERS[d]})) OVER () AS share FROM c GROUP BY 1)"
    )
    step = "SELECT i, source, lang, topic, mass, weight FROM r"
    for d in mixing.DIMENSIONS:
        step = f"SELECT i, source, lang, topic, mass, weight * share / sum(weight) OVER (PARTITION BY {d}) AS weight FROM ({step}) JOIN t_{d} ON {d} = value"
    off = " UNION ALL ".join(f"SELECT sum(weight) / any_value(share) - 1 AS off FROM k JOIN t_{d} ON {d} = value GROUP BY {d}" for d in mixing.DIMENSIONS)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '{mixing.MISSING}') AS source, coalesce(lang, '{mixing.MISSING}') AS lang,
    {topic} WHEN length(text) < {mixing.SHORT} THEN 'short' ELSE 'prose' END AS topic, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_tokens FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{", ".join(target(d) for d in mixing.DIMENSIONS)},
r(i, source, lang, topic, mass, weight) AS (SELECT 0, source, lang, topic, mass, mass FROM c UNION ALL SELECT i + 1, source, lang, topic, mass, weight FROM ({step}) WHERE i < {mixing.MOST_ROUNDS}),
k AS (SELECT *, weight / mass AS rate FROM r WHERE i = {mixing.MOST_ROUNDS}),
o AS (SELECT *, coalesce(sum(mass) OVER before, 0) AS mass_before, coalesce(sum(weight) OVER before, 0) AS weight_before, sum(mass) OVER () AS mass_all, sum(weight) OVER () AS weight_all
  FROM k WINDOW before AS (ORDER BY rate DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT scale FROM (SELECT *, ({mixing.BUDGET} * mass_all - mass_before) / (weight_all - weight_before) AS scale FROM o) WHERE scale * rate < 1 ORDER BY rate DESC, source, lang, topic LIMIT 1),
p AS (SELECT source, lang, topic, least(1.0, rate * scale) AS probability FROM k, s),
z AS (SELECT coalesce(round(max(abs(off)), 6), 0)::DOUBLE AS residual FROM ({off}))
SELECT doc_id, source, lang, topic, n_tokens, round(CASE WHEN n_tokens > 0 THEN probability ELSE 0 END, 6) AS probability,
  coalesce(n_tokens > 0 AND ('0x' || substr(md5('mix|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < probability, false) AS kept, residual
FROM d LEFT JOIN p USING (source, lang, topic), z"""


def _op3() -> str:
    """Matches as rows, the Feistel rounds as nested selects, and the text put together again."""
    q = lambda p: p.replace("'", "''")
    whole = lambda p: f"regexp_full_match(old, '{q(p)}')"
    digits = "regexp_replace(old, '[^0-9]', '', 'g')"
    luhn = lambda b: (
        f"((10 - list_sum(list_transform(range(1, length({b}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN "
        f"(substr({b}, length({b}) - i + 1, 1)::INT * 2) - CASE WHEN substr({b}, length({b}) - i + 1, 1)::INT > 4 THEN 9 ELSE 0 END "
        f"ELSE substr({b}, length({b}) - i + 1, 1)::INT END)) % 10) % 10)::INT::VARCHAR"
    )
    day = "try_strptime(substr(old, 1, 4) || '-' || substr(old, 6, 2) || '-' || substr(old, 9, 2), '%Y-%m-%d')::DATE"
    start = "make_date((substr(old, 1, 4)::INT // 400) * 400, 1, 1)"
    area, line = "substr(d, -10, 3)::BIGINT", "substr(d, -7, 7)::BIGINT"
    valid = f"({area} >= 200 AND {line} >= 2000000)"
    octet = lambda k: f"TRY_CAST(string_split(old, '.')[{k}] AS BIGINT)"
    pair = {
        "card": (f"substr(d, 2, (length(d) - 2) // 2)", "substr(d, 2 + (length(d) - 2) // 2, length(d) - 2 - (length(d) - 2) // 2)", "pow(10, (length(d) - 2) // 2)", "pow(10, length(d) - 2 - (length(d) - 2) // 2)"),
        "phone": (f"{area} - CASE WHEN {area} < 200 THEN 0 ELSE 200 END", f"{line} - CASE WHEN {valid} THEN 2000000 ELSE 0 END", f"CASE WHEN {area} < 200 THEN 200 ELSE 800 END", f"CASE WHEN {area} < 200 THEN 10000000 WHEN {valid} THEN 8000000 ELSE 2000000 END"),
        "address": (f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536", "65536"),
        "social": ("substr(old, 1, 3)::BIGINT - CASE WHEN substr(old, 1, 3)::BIGINT > 666 THEN 2 ELSE 1 END", "(substr(old, 5, 2)::BIGINT - 1) * 9999 + substr(old, 8, 4)::BIGINT - 1", "898", str(99 * 9999)),
        "date": (f"({day} - {start}) // 773", f"({day} - {start}) % 773", "189", "773"),
    }
    part = lambda n: "CASE kind " + " ".join(f"WHEN '{k}' THEN ({v[n]})::BIGINT" for k, v in pair.items()) + " END"
    rounds = f"SELECT *, {part(0)} AS l, {part(1)} AS r, {part(2)} AS a, {part(3)} AS b FROM m2"
    for i in range(pii.ROUNDS):
        side, other, modulus = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        salt = f"('0x' || substr(md5('{pii.KEY}|' || kind || '|{i}|' || a || '|' || b || '|' || {other}), 1, 12))::BIGINT"
        rounds = f"SELECT * REPLACE (({side} + {salt}) % {modulus} AS {side}) FROM ({rounds})"
    pad = lambda x, n: f"lpad(({x})::VARCHAR, {n}, '0')"
    body = f"substr(d, 1, 1) || {pad('l', '((length(d) - 2) // 2)::INT')} || {pad('r', '(length(d) - 2 - (length(d) - 2) // 2)::INT')}"
    fresh = f"CASE kind WHEN 'card' THEN {body} WHEN 'phone' THEN substr(d, 1, length(d) - 10) || {pad(f'l + CASE WHEN {area} < 200 THEN 0 ELSE 200 END', 3)} || {pad(f'r + CASE WHEN {valid} THEN 2000000 ELSE 0 END', 7)} END"
    placed = (
        "array_to_string(list_transform(range(1, length(old) + 1), lambda i: CASE WHEN regexp_matches(substr(old, i, 1), '[0-9]') "
        "THEN substr(new, length(regexp_replace(substr(old, 1, i), '[^0-9]', '', 'g')), 1) ELSE substr(old, i, 1) END), '')"
    )
    value = "regexp_extract(old, '([A-Za-z0-9+/_-]{8,128})[\"'']?$', 1)"
    quote = "regexp_extract(old, '([\"'']?)$', 1)"
    long = " || ".join(f"md5('{pii.KEY}|secret|{i}|' || {value})" for i in range(4))
    made = f"""CASE kind WHEN 'email' THEN 'user-' || substr(md5('{pii.KEY}|email|' || lower(old)), 1, 12) || '@example.invalid'
  WHEN 'secret' THEN substr(old, 1, length(old) - length({value}) - length({quote})) || substr({long}, 1, length({value})) || {quote}
  WHEN 'card' THEN {placed} WHEN 'phone' THEN {placed}
  WHEN 'address' THEN (l // 256) || '.' || (l % 256) || '.' || (r // 256) || '.' || (r % 256)
  WHEN 'social' THEN {pad("l + CASE WHEN l >= 665 THEN 2 ELSE 1 END", 3)} || '-' || {pad("r // 9999 + 1", 2)} || '-' || {pad("r % 9999 + 1", 4)}
  WHEN 'date' THEN replace(({start} + (l * 773 + r)::INT)::DATE::VARCHAR, '-', substr(old, 5, 1)) ELSE old END"""
    kind = f"""CASE WHEN {whole(_SECRET)} THEN 'secret' WHEN {whole(_EMAIL)} THEN 'email'
  WHEN {whole(pii.DATE)} THEN CASE WHEN {day} IS NOT NULL AND substr(old, 5, 1) = substr(old, 8, 1) AND substr(old, 1, 4)::INT >= 400 THEN 'date' END
  WHEN {whole(pii.SOCIAL)} THEN CASE WHEN substr(old, 1, 3)::INT BETWEEN 1 AND 899 AND substr(old, 1, 3)::INT <> 666 AND substr(old, 5, 2)::INT > 0 AND substr(old, 8, 4)::INT > 0 THEN 'social' END
  WHEN {whole(pii.PHONE)} THEN 'phone' WHEN {whole(pii.ADDRESS)} THEN CASE WHEN greatest({", ".join(octet(k) for k in (1, 2, 3, 4))}) <= 255 THEN 'address' END
  WHEN {luhn("substr(d, 1, length(d) - 1)")} = substr(d, -1, 1) THEN 'card' END"""
    counts = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)
    tally = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)
    return f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{q(_PATTERN)}') AS olds, string_split_regex(text, '{q(_PATTERN)}') AS parts FROM documents WHERE regexp_matches(text, '{pii.NEEDED}')),
m1 AS (SELECT doc_id, i, olds[i] AS old, regexp_replace(olds[i], '[^0-9]', '', 'g') AS d FROM t, unnest(range(1, len(olds) + 1)) u(i)),
m2 AS (SELECT *, {kind} AS kind FROM m1),
f AS (SELECT *, {fresh} AS fresh FROM ({rounds})),
g AS (SELECT *, CASE WHEN kind = 'card' THEN fresh || {luhn("fresh")} ELSE fresh END AS new FROM f),
n AS (SELECT doc_id, i, kind, {made} AS made FROM g),
a AS (SELECT doc_id, list(made ORDER BY i) AS news, count(kind) AS n_found, {tally} FROM n GROUP BY 1)
SELECT s.doc_id, CASE WHEN n_found > 0 THEN array_to_string(list_transform(range(1, len(news) + 1), lambda i: parts[i] || news[i]), '') || parts[len(news) + 1] ELSE s.text END AS text,
  coalesce(n_found, 0) AS n_found, {counts} FROM documents s LEFT JOIN t ON t.doc_id = s.doc_id LEFT JOIN a ON a.doc_id = s.doc_id"""


def _op11() -> str:
    """All documents under all orders, one by one."""
    letters = "(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)"
    return f"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws,
  coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS again FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
  regexp_matches(t, '[#$%&*|]'), again] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM w LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {letters} a, {letters} b, {letters} c, {letters} d, {letters} e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
g AS (SELECT *, list_position(list_transform(string_split(filter_order, ''), lambda c: fails[ascii(c) - 64]), true) AS gone FROM f, o),
s AS (SELECT part, filter_order, step::INT AS step, filter_order[step] AS letter, coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone < step AND fails[ascii(filter_order[step]) - 64]), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (gone = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (gone = step AND toxic), 0)::BIGINT AS toxic_lost
  FROM g, range(1, 6) r(step) GROUP BY ALL)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM s"""


#: Levels of the SQL twin of operator 12, in a source's tree and over the sources: no given table needs more.
_SOURCE_LEVELS, _UPPER_LEVELS = 5, 3


def _op12() -> str:
    """Level by level: nodes, runs of sixteen, and every document's fold and siblings so far. The checksum is taken bit by bit."""
    field = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    head = " || ".join(field(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))
    changed = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda b, i: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))"
    codes = "list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, x: {bits}), 4294967295::UBIGINT)"
    first = "row_number() OVER (PARTITION BY {} ORDER BY {}) - 1 AS pos, count(*) OVER (PARTITION BY {}) AS size"
    sql = f"""
WITH l AS (SELECT doc_id, '=' || source AS named, sha256({head} || {field("text")}) AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN sha256({head} || {field(changed)}) END AS changed FROM documents),
t0 AS (SELECT row_number() OVER () AS id, doc_id, coalesce(named, '') AS tree, leaf, leaf AS node, coalesce(changed, leaf) AS fold, '' AS proof,
  {first.format("coalesce(named, '')", "doc_id NULLS FIRST, leaf", "coalesce(named, '')")} FROM l),
d0 AS (SELECT id, tree, pos, fold, proof FROM t0)"""

    def climbed(prefix: str, levels: int, names: str) -> str:
        out = ""
        for k in range(levels):
            a, b = f"{prefix}{k}", f"{prefix}{k + 1}"
            out += f""",
g{a} AS (SELECT tree, pos // 16 AS pos, size, list(node ORDER BY pos) AS run FROM {names}{k} GROUP BY tree, pos // 16, size),
{names}{k + 1} AS (SELECT tree, pos, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS node, (size + 15) // 16 AS size FROM g{a}),
{b} AS (SELECT id, d.tree, d.pos // 16 AS pos, CASE WHEN size > 1 THEN sha256(array_to_string(run[:d.pos % 16], '') || fold || array_to_string(run[d.pos % 16 + 2:], '')) ELSE fold END AS fold,
  proof || CASE WHEN size > 1 THEN array_to_string(run[:d.pos % 16], '') || array_to_string(run[d.pos % 16 + 2:], '') ELSE '' END AS proof
  FROM {a} d JOIN g{a} g ON g.tree = d.tree AND g.pos = d.pos // 16)"""
        return out

    sql += climbed("d", _SOURCE_LEVELS, "t")
    sql += f""",
u0 AS (SELECT '' AS tree, tree AS named, node, {first.format("1", "tree", "1")} FROM t{_SOURCE_LEVELS}),
e0 AS (SELECT id, '' AS tree, u0.pos, fold, proof FROM d{_SOURCE_LEVELS} d JOIN u0 ON u0.named = d.tree)"""
    sql += climbed("e", _UPPER_LEVELS, "u")
    return f"""{sql}
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(e.proof) AS proof_sha256, e.fold AS folded_root, e.fold = r.node AS verified
FROM t0 JOIN e{_UPPER_LEVELS} e USING (id) JOIN t{_SOURCE_LEVELS} s ON s.tree = t0.tree, u{_UPPER_LEVELS} r"""


def _op13() -> str:
    """Each rule's matches by position: what stands between them parts the text."""
    found = []
    for k, rule in enumerate(secretscan.RULES):
        pattern = (rule.head + rule.value).replace("'", "''")
        head = rule.head.replace("'", "''")
        # a value starts where its head, which it doesn't begin like, ends
        size = f"length(regexp_replace(m, '^({head})', ''))" if head else "length(m)"
        found.append(f"""
SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, begin, begin + length(m) AS stop FROM (
  SELECT doc_id, ms[i] AS m, list_sum(list_transform(ps[:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0)::BIGINT AS begin
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')), unnest(range(1, len(ms) + 1)) u(i))
WHERE {size} >= {rule.least}""")
    base = [r.kind for r in secretscan.BASE]
    line = lambda spans: f"coalesce(string_agg(kind || ':' || begin || ':' || stop, ',' ORDER BY begin, k){spans}, '')"
    only = f" FILTER (k < {len(base)})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(found)}),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)}, {line(only)} AS based, {line("")} AS spans FROM s GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in base)}, sha256(coalesce(based, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op3_pii_pseudonyms": _op3(),
    "op5_raked_mixing": _op5(),
    "op6_imatch_fingerprints": _op6(),
    "op8_minhash_dedup": OP8,
    "op9_substring_dedup": _op9(),
    "op11_filter_audit": _op11(),
    "op12_merkle_manifest": _op12(),
    "op13_secret_scan": _op13(),
}
