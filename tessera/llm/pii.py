"""Keyed pseudonyms for personal data, in DataFrame functions only.

Numbers and dates keep their format: a validated value is encoded as a pair of numbers of fixed moduli, permuted
by a Feistel network keyed by md5, and decoded, so equal values get equal pseudonyms in every document and
different values different ones. Names in e-mail addresses and secrets get keyed digests of a fixed shape.

Each text is parted by one pattern; what stood between the matches is kept as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The key is read from this setting of the session. Where it is unset, as in tests, KEY takes its place: whoever knows
#: it can undo the numbers.
KEY_SETTING, KEY = "spark.tessera.pii.key", "tessera"

# The alternatives of the pattern, in this order. Java recurses once a turn of a repeated group unless it is possessive: a
# mail address of thousands of labels would end the executor. The SQL twin has a plain group there.
SECRET = r"\b(?i:password|passwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{8,}[\"']?"
EMAIL = r"\b[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++"
PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\b\d{3}[ .-])\d{3}[ .-]\d{4}\b"
CARD = r"\b(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})\b"
ADDRESS = r"\b\d{1,3}(?:\.\d{1,3}){3}\b"
SOCIAL = r"\b\d{3}-\d{2}-\d{4}\b"
DATE = r"\b\d{4}[-/.]\d{2}[-/.]\d{2}\b"
PATTERN = "|".join([SECRET, EMAIL, DATE, SOCIAL, PHONE, ADDRESS, CARD])
#: Texts without one of these can't match.
NEEDED = r"[0-9@=:]"
#: Days of 400 Gregorian years, 189 * 773; dates are permuted within their 400 years.
DAYS = 146_097

KINDS = ["secret", "email", "date", "social", "phone", "address", "card"]


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def number(m: Column, start: int, length: int) -> Column:
    return F.substring(m, start, length).cast("long")


def keyed(key: str, *parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """struct(l, r): a permutation of pairs below (a, b). Even rounds add a digest of the right half to the left one,
    odd rounds of the left to the right; every round can be undone, so the whole is one to one."""

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        salt = F.conv(F.substring(keyed(key, kind, i, a, b, other), 1, 12), 16, 10).cast("long")
        return F.struct(
            F.when(even, (s["l"] + salt) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + salt) % b).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def placed(shape: Column, new: Column) -> Column:
    """shape with its digits replaced by those of new, one by one."""

    def char(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        n = F.length(digits(F.substring(shape, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(new, n, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), char), "")


def padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def _doubled_sum(d: Column) -> Column:
    """The Luhn sum of digits to which a check digit is still to be added."""

    def one(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), one), F.lit(0), lambda t, x: t + x)


def luhn_digit(body: Column) -> Column:
    return ((10 - _doubled_sum(body) % 10) % 10).cast("string")


def is_card(m: Column) -> Column:
    d = digits(m)
    return luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1)


def card(m: Column, key: str) -> Column:
    """The first digit stays, the others but the last are permuted, the last is the check digit."""
    d = digits(m)
    n = F.length(d) - 2
    short = F.floor(n / 2).cast("int")
    pair = feistel(
        F.substring(d, F.lit(2), short).cast("long"), F.substring(d, short + 2, n - short).cast("long"),
        F.pow(F.lit(10.0), short).cast("long"), F.pow(F.lit(10.0), n - short).cast("long"), key, "card",
    )
    made = lambda p: F.concat(F.substring(d, 1, 1), padded(p["l"], short), padded(p["r"], n - short))
    return _with(pair, lambda p: placed(m, F.concat(made(p), luhn_digit(made(p)))))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def phone(m: Column, key: str) -> Column:
    """The last ten digits. Valid numbers, of area and exchange from 200, are permuted among themselves; so are those of a
    lower area, and those of a lower exchange alone: the whole is one to one."""
    d = digits(m)
    ten = F.substring(d, -10, 10)
    area, line = number(ten, 1, 3), number(ten, 4, 7)
    valid = (area >= 200) & (line >= 2_000_000)
    a, b = F.when(area < 200, 200).otherwise(800), F.when(area < 200, 10_000_000).when(valid, 8_000_000).otherwise(2_000_000)
    low_a, low_b = F.when(area < 200, 0).otherwise(200), F.when(valid, 2_000_000).otherwise(0)
    kind = "phone"
    pair = feistel(area - low_a, line - low_b, a, b, key, kind)
    country = F.substring(d, F.lit(1), F.length(d) - 10)
    return _with(pair, lambda p: placed(m, F.concat(country, padded(p["l"] + low_a, 3), padded(p["r"] + low_b, 7))))


def address(m: Column, key: str) -> Column:
    o = lambda k: F.split(m, "[.]")[k].cast("long")
    pair = feistel(o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65_536), F.lit(65_536), key, "address")
    half = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return _with(pair, lambda p: F.concat_ws(".", *half(p["l"]), *half(p["r"])))


def is_address(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda o: o.cast("int") <= 255)


def is_social(m: Column) -> Column:
    area, group, serial = number(m, 1, 3), number(m, 5, 2), number(m, 8, 4)
    return area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)


def social(m: Column, key: str) -> Column:
    area = number(m, 1, 3)
    rank = area - F.when(area > 666, 2).otherwise(1)
    pair = feistel(rank, (number(m, 5, 2) - 1) * 9_999 + number(m, 8, 4) - 1, F.lit(898), F.lit(99 * 9_999), key, "social")
    return _with(
        pair,
        lambda p: F.concat_ws(
            "-",
            padded(p["l"] + F.when(p["l"] >= 665, 2).otherwise(1), 3),
            padded(F.floor(p["r"] / 9_999) + 1, 2),
            padded(p["r"] % 9_999 + 1, 4),
        ),
    )


def _date(m: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.substring(m, 1, 4), F.substring(m, 6, 2), F.substring(m, 9, 2)), "yyyy-MM-dd")


def is_date(m: Column) -> Column:
    return _date(m).isNotNull() & (F.substring(m, 5, 1) == F.substring(m, 8, 1)) & (number(m, 1, 4) >= 400)


def date(m: Column, key: str) -> Column:
    first = F.floor(number(m, 1, 4) / 400) * 400
    start = F.make_date(first.cast("int"), F.lit(1), F.lit(1))
    day = F.datediff(_date(m), start)
    pair = feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, "date")
    sep = F.substring(m, 5, 1)
    return _with(pair, lambda p: F.regexp_replace(F.date_add(start, (p["l"] * 773 + p["r"]).cast("int")).cast("string"), "-", sep))


def email(m: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(keyed(key, "email", F.lower(m)), 1, 12), F.lit("@example.invalid"))


def secret(m: Column, key: str) -> Column:
    """What names the secret stays; the secret becomes a digest of its length, however long it is.

    From the fifth piece of 32 characters on, a digest of the secret takes its place, so that the work is in
    proportion to its length.
    """
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_-]{8,})[\"']?$", 1)
    quote = F.regexp_extract(m, r"([\"']?)$", 1)

    def made(v: Column, short: Column) -> Column:
        piece = lambda i: keyed(key, "secret", i, F.when(i < 4, v).otherwise(short))
        long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(v) / 32).cast("int")), piece), "")
        head = F.substring(m, F.lit(1), F.length(m) - F.length(v) - F.length(quote))
        return F.concat(head, F.substring(long, F.lit(1), F.length(v)), quote)

    return _with(value, lambda v: _with(F.sha2(v, 256), lambda short: made(v, short)))


def kind_of(m: Column) -> Column:
    """The kind of a match, null if it doesn't validate."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(whole(SECRET), "secret")
        .when(whole(EMAIL), "email")
        .when(whole(DATE), F.when(is_date(m), "date"))
        .when(whole(SOCIAL), F.when(is_social(m), "social"))
        .when(whole(PHONE), "phone")
        .when(whole(ADDRESS), F.when(is_address(m), "address"))
        .when(is_card(m), "card")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    makers = {"secret": secret, "email": email, "date": date, "social": social, "phone": phone, "address": address, "card": card}
    out = F.when(F.lit(False), m)
    for name, make in makers.items():
        out = out.when(kind == name, make(m, key))
    return out.otherwise(m)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text", kinds: str | None = None) -> DataFrame:
    """docs with pseudonyms in column; all other columns and rows stay, n_chars (where there is one) is kept in step.

    A null text stays null; an empty one, or one without personal data, as it is. What looks like a number or
    date and doesn't validate stays. Repeated rows change alike. kinds: also add a column of this name, an array of
    the kinds replaced, in order. key: by default that of the session. No column of docs is lost, whatever its name.
    """
    key = key or key_of(docs.sparkSession)
    text = F.col(column)
    matches = F.transform(
        F.when(text.rlike(NEEDED), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")),
        lambda m: F.struct(m.alias("old"), kind_of(m).alias("kind")),
    )
    found, between, new = (f"{name}_{uuid.uuid4().hex}" for name in ("found", "between", "new"))
    marked = docs.withColumn(found, matches)
    some = F.exists(found, lambda f: f["kind"].isNotNull())
    renewed = F.transform(found, lambda f: pseudonym(f["old"], f["kind"], key))
    marked = marked.withColumn(new, F.when(some, renewed)).withColumn(between, F.when(some, F.split(text, PATTERN, -1)))
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(between, 1, F.size(new)), F.col(new), lambda b, n: F.concat(b, n)), ""), F.element_at(between, -1)
    )
    out = marked.withColumn(column, F.when(some, joined).otherwise(text))
    if "n_chars" in docs.columns and column == "text":
        out = out.withColumn("n_chars", F.when(some, F.length(column).cast("long")).otherwise(F.col("n_chars")))
    if kinds:
        out = out.withColumn(kinds, F.filter(F.transform(found, lambda f: f["kind"]), lambda k: k.isNotNull()))
    return out.drop(found, between, new)


def report(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and a count of each kind."""
    made = pseudonymise(docs.select("doc_id", "text"), key, kinds="kinds")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long")
    found = F.coalesce("kinds", F.array().cast("array<string>"))
    return made.withColumn("kinds", found).select(
        "doc_id", "text", F.size("kinds").cast("long").alias("n_found"), *(count(k).alias(f"n_{k}") for k in KINDS)
    )
