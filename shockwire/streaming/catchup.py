"""Q16: catching up on days that lack tags or scores.

The work list comes from what is there (collected files, tagged days, scored days), so a rerun takes up what an earlier one left.
Days are worked in ascending order, many in one Spark job. A job that fails is halved until the day it fails at stands alone: that
day gets the error, the others go on, at a cost of a few jobs a failure and not a job a day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days of one job at most.
BATCH = 3660
REPORT = "date date, tagging string, scoring string, risk_score double, status string, error string"


def halving(days: list[dt.date], work: Callable[[list[dt.date]], None]) -> dict[dt.date, str]:
    """Runs work on the days, in order, and on halves of those it raises for; the error of each day that fails alone."""
    try:
        work(days)
    except Exception as e:  # noqa: BLE001  any error of a day is the day's
        if len(days) == 1:
            return {days[0]: f"{type(e).__name__}: {str(e).strip().splitlines()[0][:300] if str(e).strip() else ''}"}
        middle = len(days) // 2
        return halving(days[:middle], work) | halving(days[middle:], work)
    return {}


def in_batches(days: list[dt.date], work: Callable[[list[dt.date]], None], size: int = BATCH) -> dict[dt.date, str]:
    errors: dict[dt.date, str] = {}
    for at in range(0, len(days), size):
        errors |= halving(days[at : at + size], work)
    return errors


def catch_up(
    board: DataFrame, tag: Callable[[list[dt.date]], None], tagged: Callable[[], DataFrame], score: Callable[[list[dt.date]], None], scores: Callable[[], DataFrame], threshold: float
) -> DataFrame:
    """Tags the days of the board (date, status as in `checks.status_board`) that need it, then scores these and those that
    need a score; returns REPORT, a row a day of work, by date.

    tag and score write their days' tables and may raise; tagged and scores read the tables again: date, and date with
    risk_score. A day whose tags fail is not scored, nor one that has no tagged rows after tagging."""
    spark: SparkSession = board.sparkSession
    due = {r["date"]: r["status"] for r in board.where(F.col("status").isin("needs_tag", "needs_score")).select("date", "status").collect()}  # days of a span
    needs_tag = sorted(d for d, s in due.items() if s == "needs_tag")
    tag_errors = in_batches(needs_tag, tag)
    there = _held(tagged(), [d for d in needs_tag if d not in tag_errors])
    needs_score = sorted([d for d, s in due.items() if s == "needs_score"] + list(there))
    score_errors = in_batches(needs_score, score)
    found = {r["date"]: r["risk_score"] for r in _of(scores(), [d for d in needs_score if d not in score_errors]).select("date", "risk_score").collect()} if needs_score else {}
    rows = []
    for d in sorted(due):
        tagging = "present" if due[d] == "needs_score" else "failed" if d in tag_errors else "done" if d in there else "no articles"
        scoring = "-" if d not in needs_score else "failed" if d in score_errors else "done" if d in found else "no score"
        risk = found.get(d)
        rows.append((d, tagging, scoring, risk, None if risk is None else "WARNING" if risk >= threshold else "NORMAL", tag_errors.get(d) or score_errors.get(d)))
    return spark.createDataFrame(rows, REPORT)


def _of(table: DataFrame, days: list[dt.date]) -> DataFrame:
    return table.where(F.col("date").isin(days))


def _held(table: DataFrame, days: list[dt.date]) -> set[dt.date]:
    return {r[0] for r in _of(table, days).select("date").distinct().collect()} if days else set()
