"""The status automaton on a stream whose days may come out of order: state, event-time timers and a watermark."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The state store that list states and timers need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86_400_000


class Streaks(StatefulProcessor):
    """Days of a series wait in a list until the watermark has passed them; then they are taken in order of date."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "day int, risk_score double")
        self.run = handle.getValueState("run", "day int, streak int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        told = self.run.get()[0] if self.run.exists() else None
        for row in rows:
            day = (row["date"] - _EPOCH).days
            if told is None or day > told:  # else its place in the order is already told
                self.waiting.appendValue((day, row["risk_score"]))
                self.handle.registerTimer(day * _DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() // _DAY_MS
        rows = list(self.waiting.get())
        due = dict(r for r in rows if r[0] <= passed)  # of a day's rows the last that came
        if not due:
            return
        rest = [r for r in rows if r[0] > passed]
        self.waiting.put(rest) if rest else self.waiting.clear()
        streak = self.run.get()[1] if self.run.exists() else 0
        for day in sorted(due):
            over = due[day] is not None and due[day] >= self.threshold
            streak = streak + 1 if over else 0
            yield Row(series=key[0], date=_EPOCH + dt.timedelta(days=day), risk_score=due[day], streak=streak, status="WARNING" if over else "NORMAL")
        self.run.update((max(due), streak))


def ordered_streaks(scores: DataFrame, threshold: float, late: str = "7 days") -> DataFrame:
    """(series, date, risk_score, streak, status) of rows (series, date, risk_score), in order of date however they come: a day
    is told when the watermark has passed it, and a row that comes later than that is dropped. Of several rows of a day the
    last that came counts; a null score is below the threshold and rows without a date or series go. The session's state store
    is set to STATE_STORE, which list states and timers need."""
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = scores.where("date is not null and series is not null").withColumn("ts", F.timestamp_seconds(F.unix_date("date").cast("long") * 86_400)).withWatermark("ts", late)
    return rows.groupBy("series").transformWithState(Streaks(threshold), "series string, date date, risk_score double, streak int, status string", "append", "EventTime")
