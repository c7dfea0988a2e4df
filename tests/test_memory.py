import datetime

from pyspark.sql import functions as F

from tessera.streaming import memory, state


def test_answers_are_kept_by_kind(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [
        (1, 1, at(0), True), (1, 2, at(99), False), (1, 3, at(100), False), (1, 4, at(104), True), (1, 5, at(105), True), (2, 6, at(0), None), (2, 7, at(5), True), (2, 8, at(5), False),
        (None, 9, at(0), True), (1, 10, None, True),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, e long, t timestamp, ok boolean, answer string")
    got = {(r.k, r.e): (r.asked, r.answer) for r in memory.remembered(df, "k", "t", "ok", "e", 100, 5).collect()}
    assert got == {
        (1, 1): (True, True), (1, 2): (False, True), (1, 3): (True, False), (1, 4): (False, False), (1, 5): (True, True), (2, 6): (True, False), (2, 7): (True, True), (2, 8): (False, True),
    }
    assert memory.remembered(df.limit(0), "k", "t", "ok", "e").count() == 0


def test_clocks_with_many_laps(spark):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    acts = ["lap", "toggle", "start", "lap", "pause", "pause", "lap", "toggle", None, "x", *["lap"] * 40, "reset", "lap", "toggle", "toggle", "lap", "start"]
    df = spark.createDataFrame([(1, i, at(i), a) for i, a in enumerate(acts)] + [(2, 0, at(0), "start"), (2, 1, at(0), "lap"), (2, 2, at(1), "lap")], "k long, e long, t timestamp, a string")
    got = {(r.k, r.e): (r.running, r.elapsed, r.laps) for r in state.clocks(df, "k", "t", "e", F.col("a")).collect()}
    for key in (1, 2):
        running, elapsed, laps, before = False, 0, 0, None
        for r in sorted((r for r in df.collect() if r.k == key), key=lambda r: r.e):
            if running:
                elapsed += (r.t - before) // datetime.timedelta(microseconds=1)
            before = r.t
            running = {"start": True, "pause": False, "reset": False, "toggle": not running}.get(r.a, running)
            if r.a == "reset":
                elapsed = laps = 0
            if r.a == "lap" and elapsed:
                laps = min(30, laps + 1)
            assert got[key, r.e] == (running, elapsed, laps)
