"""Keyed state over event streams: limits, caps and crossings. Late rows beyond the watermark are dropped: streams
here have event time, which is an addition of this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, key: str, at: str, width: str, lateness: str | None = None) -> DataFrame:
    """Events by key and clock-aligned window; for streams give a lateness."""
    if lateness:
        events = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    counted = events.groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n")


def rolling_count(events: DataFrame, key: str, at: str, seconds: int, tie: str) -> DataFrame:
    """Attempts of the same key in the seconds before each event, itself left out."""
    span = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return events.withColumn("before", F.count(tie).over(span))


def crossings(events: DataFrame, key: str, at: str, value: str, limits: list[float], tie: str) -> DataFrame:
    """Events whose value goes over a limit that the key's event before was not over."""
    order = Window.partitionBy(key).orderBy(at, tie)
    zone = sum((F.when(F.col(value) > limit, 1).otherwise(0) for limit in limits), F.lit(0))
    marked = events.withColumn("zone", zone).withColumn("zone_before", F.lag("zone").over(order))
    return marked.where(F.col("zone") > F.col("zone_before"))


def first_hit_windows(events: DataFrame, key: str, at: str, seconds: int, limit: int, tie: str) -> DataFrame:
    """key, tie, window_start, nth, allowed: windows that open at a key's first hit, not by the clock."""

    def opened() -> Callable[[int], tuple]:
        start, n = None, 0

        def hit(time: int) -> tuple:
            nonlocal start, n
            if start is None or time - start >= seconds * 1_000_000:
                start, n = time, 0
            n += 1
            return start, n, n <= limit

        return hit

    return folded(events, key, at, tie, opened, "window_start timestamp, nth int, allowed boolean")


def token_bucket(events: DataFrame, key: str, at: str, per_minute: float, burst: float, tie: str) -> DataFrame:
    """key, tie, tokens (before the event), allowed: a bucket that refills steadily up to burst."""

    def filled() -> Callable[[int], tuple]:
        tokens, last = burst, None

        def take(time: int) -> tuple:
            nonlocal tokens, last
            if last is not None:
                tokens = min(burst, tokens + (time - last) / 1e6 * per_minute / 60)
            last = time
            before, tokens = tokens, tokens - (tokens >= 1)
            return round(before, 6), before >= 1

        return take

    return folded(events, key, at, tie, filled, "tokens double, allowed boolean")


def folded(events: DataFrame, key: str, at: str, tie: str, make: Callable[[], Callable[..., tuple]], schema: str, more: Sequence[str] = ()) -> DataFrame:
    """key, tie and what a key's own function gives for each of its events, in time order: it gets the time in microseconds, and
    the values of `more`. make() begins a key.

    Spark sorts the events; a task walks through frames of bounded size, and holds of a key what its function does. Events
    without a key, time or tie take no part.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    times = [c.strip().split(" ")[0] for c in schema.split(",") if c.strip().endswith(" timestamp")]

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step = object(), None
        for frame in frames:
            out = []
            micros = frame[at].astype("datetime64[us]").astype("int64").tolist()
            for k, *values in zip(frame[key].tolist(), micros, *(frame[c].tolist() for c in more)):
                if k != now:
                    now, step = k, make()
                out.append(step(*values))
            made = pd.DataFrame(out, columns=names)
            for c in times:
                made[c] = pd.to_datetime(made[c], unit="us")
            yield pd.concat([frame[[key, tie]].reset_index(drop=True), made], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    whole = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {schema}"
    return events.select(key, at, tie, *more).dropna(subset=[key, at, tie]).repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(over, whole)


#: Most laps that a clock keeps between two resets.
MOST_LAPS = 30


def clocks(events: DataFrame, key: str, at: str, tie: str, action: Column) -> DataFrame:
    """(key, tie, running, elapsed, laps) after each event of pausable clocks, a clock for each key; elapsed in microseconds.

    action: start, pause, toggle, lap or reset; anything else, and null, changes nothing. A clock that runs gains the time
    between events. A lap counts once some time has been gained since the last reset, running or not, up to MOST_LAPS. What a
    toggle does depends on all before it, but only on how many there were since the last start, pause or reset: so all is
    running sums over one order of each key's events, and no state is kept by hand.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    named = events.select(key, at, tie, action.alias("action")).withColumn("action", F.coalesce("action", F.lit("")))
    sets, resets = F.col("action").isin("start", "pause", "reset"), F.col("action") == "reset"
    count = lambda hit: F.sum(F.when(hit, 1).otherwise(0))
    told = named.withColumns({
        "last_set": F.last(F.when(sets, F.col("action")), ignorenulls=True).over(so_far), "set_no": count(sets).over(so_far), "turn": count(resets).over(so_far),
    })
    toggles = count(F.col("action") == "toggle").over(Window.partitionBy(key, "set_no").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    running = told.withColumn("running", F.coalesce(F.col("last_set") == "start", F.lit(False)) != (toggles % 2 == 1))
    now = F.unix_micros(F.col(at).cast("timestamp"))
    gained = F.when(F.lag("running").over(order) & ~resets, now - F.lag(now).over(order)).otherwise(0)
    in_turn = Window.partitionBy(key, "turn").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    timed = running.withColumn("gained", gained).withColumn("elapsed", F.sum("gained").over(in_turn))
    laps = F.least(count((F.col("action") == "lap") & (F.col("elapsed") > 0)).over(in_turn), F.lit(MOST_LAPS))
    return timed.select(key, tie, "running", "elapsed", laps.cast("int").alias("laps"))


def first_seen(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("first_seen"))


def once(stream: DataFrame, key: list[str], at: str, lateness: str) -> DataFrame:
    """One event of each key within the lateness; in a batch, one of each key."""
    if stream.isStreaming:
        return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def alive(rows: DataFrame, expires: str, now: Column) -> DataFrame:
    return rows.where(F.col(expires) > now)
