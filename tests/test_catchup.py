"""Catching up on days, with failures."""

import datetime as dt

from pyspark.sql import functions as F

from shockwire.operators import checks, windows
from shockwire.sources import score_table, sinks
from shockwire.streaming import catchup

DAY = dt.date(2024, 3, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_halving_finds_the_days_that_fail():
    calls = []

    def work(days):
        calls.append(list(days))
        if bad & set(days):
            raise ValueError(f"bad {sorted(bad & set(days))}\nmore")

    bad = {3, 10, 11}
    errors = catchup.in_batches(list(range(64)), work, 64)
    assert set(errors) == bad and all(e.startswith("ValueError: bad [") and "more" not in e for e in errors.values())
    done = [d for c in calls for d in c if not bad & set(c)]
    assert sorted(done) == sorted(set(range(64)) - bad) and done == sorted(done) and len(calls) < 25


class Store:
    """Collected, tagged and scored days in Parquet; tagging raises for the days in `broken`."""

    def __init__(self, spark, path):
        self.spark, self.path, self.broken, self.no_score, self.tagging_calls = spark, f"file://{path}", set(), set(), []
        rows = [(day(n), f"t{n}-{k}", ["x"] * (k + 1)) for n in range(6) for k in range(3) if n != 4]
        self.raw = spark.createDataFrame(rows, "date date, title string, properties array<string>")
        sinks.write_days(self.raw.where(F.col("date") == day(0)), f"{self.path}/tagged")

    def tagged(self):
        return self.spark.read.schema(self.raw.schema).parquet(f"{self.path}/tagged")

    def scores(self):
        return score_table.read(self.spark, f"{self.path}/scores")

    def tag(self, days):
        self.tagging_calls.append(days)
        broken = [d.isoformat() for d in self.broken]
        fail = F.udf(lambda d: 1 / 0 if d.isoformat() in broken else True, "boolean")
        sinks.write_days(self.raw.where(F.col("date").isin(days)).where(fail("date")), f"{self.path}/tagged")

    def score(self, days):
        if self.no_score & set(days):
            raise RuntimeError("no model")
        rows = self.tagged()
        params = self.spark.createDataFrame([("x", 3, 2.0, 1.0)], "property_id string, optimal_window int, ctrl_freq_mean double, weight double")
        top = self.spark.createDataFrame([(5.0,)], "top double")
        score_table.backfill(f"{self.path}/scores", windows.daily_counts(rows), windows.daily_articles(rows), self.spark.createDataFrame([(d,) for d in days], "date date"), params, top)

    def run(self, start, end):
        board = checks.status_board(self.raw, self.tagged(), self.scores(), str(start), str(end))
        return {r.date: (r.tagging, r.scoring, r.status, r.error and r.error.split(":")[0]) for r in catchup.catch_up(board, self.tag, self.tagged, self.score, self.scores, 18.52).collect()}


def test_a_failing_day_does_not_stop_the_others(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.broken = {day(2)}
    got = store.run(day(0), day(3))  # day 0 is tagged; of 1, 2, 3 the second fails
    assert got == {day(0): ("present", "done", "NORMAL", None), day(1): ("done", "done", "WARNING", None), day(2): ("failed", "-", None, "PythonException"), day(3): ("done", "done", "WARNING", None)}
    store.broken, store.tagging_calls = set(), []
    again = store.run(day(0), day(3))
    assert store.tagging_calls == [[day(2)]] and again == {day(2): ("done", "done", "WARNING", None)}
    assert store.run(day(0), day(3)) == {}
    assert {r.date for r in store.scores().collect()} == {day(n) for n in range(4)}


def test_scores_fail_by_day_too(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.no_score = {day(1)}
    got = store.run(day(0), day(5))  # day 4 was never collected
    assert got[day(1)] == ("done", "failed", None, "RuntimeError") and day(4) not in got
    assert {d for d, r in got.items() if r[1] == "done"} == {day(0), day(2), day(3), day(5)}
    store.no_score, store.tagging_calls = set(), []
    assert store.run(day(0), day(5)) == {day(1): ("present", "done", "WARNING", None)} and store.tagging_calls == []


def test_days_without_articles(spark, tmp_path):
    store = Store(spark, tmp_path)
    board = spark.createDataFrame([(day(4), "needs_tag"), (day(9), "missing"), (day(1), "done")], "date date, status string")
    got = catchup.catch_up(board, store.tag, store.tagged, store.score, store.scores, 1.0).collect()
    assert [tuple(r) for r in got] == [(day(4), "no articles", "-", None, None, None)]
    assert catchup.catch_up(board.limit(0), store.tag, store.tagged, store.score, store.scores, 1.0).count() == 0
