"""What was asked lately, by key: an answer is remembered for a time that depends on the answer, over batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.state import folded

#: Seconds for which an answer is kept, by whether something was found: a week, or two minutes after a failure.
FOUND, FAILED = 7 * 86_400, 120


class _Memory:
    """One key's memory: when the last answer was got, and for how long it holds."""

    def __init__(self, held: tuple[int, int, bool] | None, seconds: Callable[[bool], int]) -> None:
        self.held, self.seconds = held, seconds

    def ask(self, at: int, found: bool) -> tuple[bool, bool]:
        """(whether it has to be asked, the answer) at a time in microseconds; found: what asking would give."""
        if self.held and at - self.held[0] < self.held[1] * 1_000_000:
            return False, self.held[2]
        self.held = at, self.seconds(found), found
        return True, found


def _seconds(found: int, failed: int) -> Callable[[bool], int]:
    return lambda ok: found if ok else failed


def remembered(events: DataFrame, key: str, at: str, found: str, tie: str, keep: int = FOUND, keep_failed: int = FAILED) -> DataFrame:
    """(key, tie, asked, answer) of events in time order: whether each had to be asked, or what was remembered.

    found: a boolean column, what asking would have given; null counts as a failure. keep: seconds for which a found answer
    holds, keep_failed: a failure. An answer that is exactly as old as that is asked again. Events of one time follow `tie`; those
    without a key, time or tie take no part.
    """
    seconds = _seconds(keep, keep_failed)
    return folded(events.na.fill(False, [found]), key, at, tie, lambda: _Memory(None, seconds).ask, "asked boolean, answer boolean", [found])


class _Processor(StatefulProcessor):
    """The same by keyed state: what is remembered goes by a timer once the watermark has passed it."""

    def __init__(self, at: str, found: str, tie: str, keep: int, keep_failed: int) -> None:
        self.names, self.keep = (at, found, tie), (keep, keep_failed)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("memory", "at long, seconds int, found boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        at, found, tie = self.names
        before = self.state.get()
        memory = _Memory(before and tuple(before), _seconds(*self.keep))
        batch = pd.concat(list(rows)).sort_values([at, tie])
        # as numbers, whatever zone the frame has
        times = batch[at].dt.tz_localize(None) if batch[at].dt.tz else batch[at]
        times = times.astype("datetime64[us]").astype("int64")
        out = [(key[0], t, *memory.ask(int(when), bool(ok))) for t, when, ok in zip(batch[tie], times, batch[found])]
        if memory.held != (before and tuple(before)):
            ends = lambda held: held[0] // 1_000 + held[1] * 1_000
            if before:  # what is remembered has the one timer, which takes it away
                self.handle.deleteTimer(ends(before))
            self.state.update(memory.held)
            self.handle.registerTimer(ends(memory.held))
        yield pd.DataFrame(out, columns=["key", "tie", "asked", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, ANN001
        self.state.clear()
        yield pd.DataFrame({"key": [], "tie": [], "asked": [], "answer": []}).astype({"key": "int64", "tie": "int64", "asked": "bool", "answer": "bool"})

    def close(self) -> None:
        pass


#: The store that timers and keyed state need; a stream's query runs with it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def remembered_stream(stream: DataFrame, key: str, at: str, found: str, tie: str, lateness: str, keep: int = FOUND, keep_failed: int = FAILED) -> DataFrame:
    """(key, tie, asked, answer) of a stream, as remembered() gives them where no event comes after one that is later.

    The session must have the state store that STORE names. A key's events of one micro-batch are ordered in its task; bound
    them by the source's limits a trigger. Events later than the watermark are dropped.
    """
    known = stream.dropna(subset=[key, at, tie]).na.fill(False, [found]).select(key, at, found, tie).withWatermark(at, lateness)
    processor = _Processor(at, found, tie, keep, keep_failed)
    made = known.groupBy(key).transformWithStateInPandas(processor, "key long, tie long, asked boolean, answer boolean", "append", "eventTime")
    return made.withColumnsRenamed({"key": key, "tie": tie})
