"""Data-quality checks: each is one aggregate that gives an issue row or none; a report is their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ISSUE = "stage string, severity string, check string, message string, value double"


def _issue(measured: DataFrame, stage: str, check: str, value: Column, severity: Column, message: str) -> DataFrame:
    """A row where severity is not null."""
    return measured.select(F.lit(stage).alias("stage"), severity.alias("severity"), F.lit(check).alias("check"), F.lit(message).alias("message"), value.cast("double").alias("value")).where("severity is not null")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_prices(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Q2 to Q7 on (date, close)."""
    before = F.lag("date").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    rows = prices.withColumn("gap", F.datediff("date", before))
    bad = F.col("close").isNull() | F.isnan("close")
    m = rows.agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("date")).alias("repeats"),
        F.sum(F.when(F.col("gap") > 5, 1).otherwise(0)).alias("gaps"), F.sum(F.when(bad, 1).otherwise(0)).alias("missing"), F.sum(F.when(~bad & (F.col("close") <= 0), 1).otherwise(0)).alias("nonpositive"),
    )
    late, early = F.datediff("lo", F.lit(start).cast("date")), F.datediff(F.lit(end).cast("date"), "hi")
    share = F.col("missing") / F.greatest("n", F.lit(1))
    warn = lambda c: F.when(c, "WARNING")
    p = "prices"
    return _union([
        _issue(m, p, "starts_late", late, warn(late > 30), "the series starts more than 30 days late"),
        _issue(m, p, "ends_early", early, warn(early > 7), "the series ends more than 7 days early"),
        _issue(m, p, "trading_gaps", F.col("gaps"), warn(F.col("gaps") > 0), "gaps of more than 5 days"),
        _issue(m, p, "missing_close", F.col("missing"), F.when(share > 0.01, "CRITICAL").when(F.col("missing") > 0, "WARNING"), "days without a close"),
        _issue(m, p, "repeated_dates", F.col("repeats"), warn(F.col("repeats") > 0), "dates that stand more than once"),
        _issue(m, p, "nonpositive_close", F.col("nonpositive"), F.when(F.col("nonpositive") > 0, "CRITICAL"), "closes of 0 or less"),
        _issue(m, p, "few_rows", F.col("n"), F.when(F.col("n") < 200, "CRITICAL"), "fewer than 200 days"),
    ])


def check_shocks(shocks: DataFrame, prices: DataFrame) -> DataFrame:
    """Q8, Q9 on (date, ret)."""
    n = prices.agg(F.count(F.lit(1)).alias("days"))
    m = shocks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("ret") <= -0.2, 1).otherwise(0)).alias("deep")).crossJoin(n)
    share = F.col("n") / F.greatest("days", F.lit(1))
    return _union([
        _issue(m, "shocks", "count", F.col("n"), F.when((F.col("n") == 0) | (share > 0.3), "CRITICAL").when(share < 0.005, "WARNING"), "none, too many or very few shock days"),
        _issue(m, "shocks", "deep_falls", F.coalesce("deep", F.lit(0)), F.when(F.col("deep") > 0, "WARNING"), "falls of 20 per cent or more"),
    ])


def check_events(events: DataFrame, controls: DataFrame, ratio: int = 3) -> DataFrame:
    """Q10 to Q12."""
    e = events.agg(F.count(F.lit(1)).alias("n"), F.max("duration_days").alias("longest"))
    m = e.crossJoin(controls.agg(F.count(F.lit(1)).alias("c")))
    n, c = F.col("n"), F.col("c")
    return _union([
        _issue(m, "events", "count", n, F.when(n == 0, "CRITICAL").when(n < 3, "WARNING"), "no or few events"),
        _issue(m, "events", "duration", F.col("longest"), F.when(F.col("longest") > 365, "WARNING"), "an event of more than a year"),
        _issue(m, "events", "controls", c, F.when(c == 0, "CRITICAL").when(c < n * ratio, "WARNING"), "no or too few controls"),
    ])


def stale_outputs(spark: SparkSession, present: dict[str, bool]) -> DataFrame:
    """Q1: an INFO row for outputs that exist already, by name."""
    return spark.createDataFrame([("outputs", "INFO", name, "an earlier output exists and will be replaced", 1.0) for name, there in sorted(present.items()) if there], ISSUE)


def passed(report: DataFrame) -> DataFrame:
    """Q13: whether there is no CRITICAL issue, and counts."""
    n = lambda s: F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s.lower())
    return report.agg(n("CRITICAL"), n("WARNING"), n("INFO")).na.fill(0).withColumn("passed", F.col("critical") == 0)


def require(report: DataFrame) -> None:
    """Q13: raises with the CRITICAL issues."""
    critical = report.where("severity = 'CRITICAL'").limit(20).collect()
    if critical:
        raise ValueError("; ".join(f"{r['stage']}.{r['check']}: {r['message']} ({r['value']:g})" for r in critical))


def status_board(raw: DataFrame, tagged: DataFrame, scored: DataFrame, start: str, end: str) -> DataFrame:
    """For each day of a span whether it is missing, needs tags, needs a score, or is done. Inputs: date."""
    days = raw.sparkSession.sql(f"select explode(sequence(date'{start}', date'{end}')) as date")
    mark = lambda df, name: df.select("date").distinct().withColumn(name, F.lit(True))
    rows = days.join(mark(raw, "r"), "date", "left").join(mark(tagged, "t"), "date", "left").join(mark(scored, "s"), "date", "left")
    return rows.select("date", F.when(F.col("s"), "done").when(F.col("t"), "needs_score").when(F.col("r"), "needs_tag").otherwise("missing").alias("status"))
