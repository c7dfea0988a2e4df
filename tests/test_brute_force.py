"""Queries that SQL can't express, against plain versions of them."""

import html as markup
import re
import unicodedata
from datetime import timedelta

from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import scalar, titles
from tessera.operators import markup as pages
from tessera.sources import documents

SF = "/root/testdata/sf0.001"


def run(spark, name):
    return plans.QUERIES[name][0](spark, SF).collect()


def rows(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*columns).collect()]


def test_highlight_ranges(spark):
    want = set()
    for item, text in rows(spark, "benchmark", "item_id", "text"):
        plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
        assert len(plain) == len(text)
        spans = [m.span() for m in re.finditer("the tion", plain)] or [m.span() for m in re.finditer(r"(?<![^\W_])(?:the|tion)", plain)]
        covered = sorted({i for a, b in spans for i in range(a, b)})
        starts = [i for i in covered if i - 1 not in covered]
        ends = [i + 1 for i in covered if i + 1 not in covered]
        want |= {(item, a, b) for a, b in zip(starts, ends)}
    assert {(r.item_id, r.start, r.end) for r in run(spark, "highlight_ranges")} == want


def test_html_sections(spark):
    want = []
    for page, html in rows(spark, "pages", "page_id", "html"):
        found = list(re.finditer(r"(?i)<h([1-6])[^>]*>(.*?)</h\1>", html, re.S))
        want += [(page, n, int(m[1]), markup.unescape(re.sub(r"<[^>]*>", " ", m[2])).strip()) for n, m in enumerate(found)]
    assert sorted((r.page_id, r.place, r.level, r.title) for r in run(spark, "html_sections")) == sorted(want)


def test_stable_pick(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return h

    want = {(k, fnv(f"2024-01-01:{n}"), fnv(f"2024-01-01:{n}") % 25) for k, n in rows(spark, "nation", "n_nationkey", "n_name")}
    assert {(r.n_nationkey, r.hash, r.pick) for r in run(spark, "stable_pick")} == want


def test_token_bucket(spark):
    want, held = set(), {}
    for user, event, at in sorted(rows(spark, "events", "user_id", "event_id", "ts"), key=lambda r: (r[0], r[2], r[1])):
        tokens, last = held.get(user, (3.0, at))
        tokens = min(3.0, tokens + (at - last) / timedelta(minutes=1) / 600)
        want.add((user, event, tokens >= 1))
        held[user] = (tokens - (tokens >= 1), at)
    assert {(r.user_id, r.event_id, r.allowed) for r in run(spark, "token_bucket")} == want


def test_relative_time_at_its_edges(spark):
    seconds = [0, 44, 45, 89, 90, 3_569, 3_570, 3_599, 3_600, 5_399, 5_400, 84_599, 84_600, 86_400, 172_800, 604_800, 1_209_600, 2_591_999, 2_592_000, -50]
    want = [
        "just now", "just now", "1 min ago", "1 min ago", "2 min ago", "59 min ago", "1 hour ago", "1 hour ago", "1 hour ago", "1 hour ago", "2 hours ago", "23 hours ago",
        "yesterday", "yesterday", "2 days ago", "1 week ago", "2 weeks ago", "4 weeks ago", "Mar 1, 2024", "just now",
    ]
    now = F.to_timestamp(F.lit("2024-03-31 00:00:00"))
    df = spark.createDataFrame(list(enumerate(seconds)), "i int, s int").withColumn("then", F.timestamp_seconds(F.unix_timestamp(now) - F.col("s")))
    assert [r.ago for r in df.select("i", scalar.relative_time(F.col("then"), now).alias("ago")).orderBy("i").collect()] == want


def test_sections_of_texts_that_begin_with_a_heading(spark):
    texts = ["<h1>A</h1>x<h2>B</h2>y", "z<H3 class='q'>C</H3>", "", "no heading", "<h1>D</h1>", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, html string")
    got = sorted(tuple(r) for r in pages.sections(df, "k", "html").collect())
    assert got == [(0, 0, 1, "A", "x"), (0, 1, 2, "B", "y"), (1, 0, 3, "C", ""), (4, 0, 1, "D", "")]


def test_blank_lines_are_no_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \nbroken\n{"a": null}\n')
    rows_, rejects = documents.read_lines(spark, str(tmp_path / "x.jsonl"), "a long")
    assert sorted(str(r.a) for r in rows_.collect()) == ["1", "None"] and [r.value for r in rejects.collect()] == ["broken"]


def test_every_suspect_word_loses_25(spark):
    words = (
        "demo,instrumental,karaoke,underscore,playoff,play off,remix,acoustic,radio edit,pop version,dialogue,alternate,alt take,extended,ringtone,commentary,"
        "interview,backing,accompaniment,track by track,exit music,bows,curtain call,utterance,spoken,single version,end credit,end credits,end title,"
        "credits version,intro,outro,introduction,segue,underscoring,playout,play out"
    ).split(",")
    # equal without blanks, so 96, less 25 where the track alone has the word as such
    df = spark.createDataFrame([(w, f"Song Title {w}", f"Song Title{w}", f"Song Title ({w})") for w in words], "w string, track string, title string, bare string")
    level = lambda a, b: titles.ladder_level(titles.ladder_keys(F.col(a)), titles.ladder_keys(F.col(b)))
    got = df.select("w", level("track", "title").alias("near"), level("bare", "track").alias("both")).collect()
    assert {r.w: (r.near, r.both) for r in got} == {w: (71, 100) for w in words}
