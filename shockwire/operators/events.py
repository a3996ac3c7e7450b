"""Shock events in a price series, and calm control dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shockwire.config import DEFAULT


def all_rows() -> WindowSpec:
    """A window over a whole price series: one row a trading day, small however large the corpus is."""
    return Window.partitionBy(F.lit(0))


def returns(prices: DataFrame) -> DataFrame:
    """(date, close, ret), day over day; a missing close is carried forward first."""
    by_date = all_rows().orderBy("date")
    filled = prices.withColumn("close", F.last("close", ignorenulls=True).over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("close").over(by_date)
    return filled.withColumn("ret", F.when(before != 0, F.col("close") / before - 1))


def shock_days(prices: DataFrame, threshold: float = DEFAULT.shock_threshold) -> DataFrame:
    return returns(prices).where(F.col("ret") <= threshold)


def sessions(days: DataFrame, gap: int | str = DEFAULT.cluster_gap_days, within: list[str] | None = None) -> DataFrame:
    """Adds event_id; a day belongs to the event before it while at most `gap` calendar days (a number, or a column)
    lie between it and the day before. within: columns that keep several sweeps apart."""
    keys = within or []
    w = Window.partitionBy(*keys, F.lit(0)).orderBy("date")
    limit = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    before = F.lag("date").over(w)
    starts = F.when(before.isNull() | (F.datediff("date", before) > limit), 1).otherwise(0)
    return days.withColumn("_start", starts).withColumn("event_id", F.sum("_start").over(w).cast("int")).drop("_start")


def event_table(clustered: DataFrame, prices: DataFrame, within: list[str] | None = None) -> DataFrame:
    """First and last shock, duration, count, and the deepest fall of closes in the event's days against
    the last close before it (per cent; null without an earlier close)."""
    keys = [*(within or []), "event_id"]
    spans = clustered.groupBy(*keys).agg(F.min("date").alias("first_shock_date"), F.max("date").alias("last_shock_date"), F.count(F.lit(1)).cast("int").alias("shock_count"))
    prior = prices.withColumn("prior_close", F.lag("close").over(all_rows().orderBy("date"))).select(F.col("date").alias("_first"), "prior_close")
    lows = prices.select(F.col("date").alias("_day"), "close")
    days = spans.select(*keys, F.explode(F.sequence("first_shock_date", "last_shock_date")).alias("_day"))
    low = days.join(lows, "_day").groupBy(*keys).agg(F.min("close").alias("low"))
    out = spans.join(prior, F.col("first_shock_date") == F.col("_first"), "left").join(low, keys, "left")
    fall = F.when(F.col("prior_close") > 0, (F.col("low") / F.col("prior_close") - 1) * 100)
    duration = (F.datediff("last_shock_date", "first_shock_date") + 1).alias("duration_days")
    return out.select(*keys, "first_shock_date", "last_shock_date", duration, "shock_count", F.round(fall, 2).alias("max_cumulative_drop"))


def gap_sweep(days: DataFrame, prices: DataFrame, gaps: range = range(3, 15)) -> DataFrame:
    """A10: events, durations, counts and falls for each gap. One pass: the gaps are a column."""
    swept = days.select("date").withColumn("gap_days", F.explode(F.array(*map(F.lit, gaps))))
    table = event_table(sessions(swept, "gap_days", ["gap_days"]), prices, ["gap_days"])
    drop = F.col("max_cumulative_drop")
    return table.groupBy("gap_days").agg(
        F.count(F.lit(1)).alias("n_events"), F.avg("duration_days").alias("avg_duration"), F.percentile("duration_days", F.lit(0.5)).alias("median_duration"), F.avg("shock_count").alias("avg_shock_count"),
        F.avg(drop).alias("avg_cumulative_drop"), F.percentile(drop, F.lit(0.5)).alias("median_cumulative_drop"), F.min(drop).alias("min_cumulative_drop"), F.min(drop).alias("max_cumulative_drop_val"),
    )


def excluded_days(events: DataFrame, days: int = DEFAULT.control_exclusion_days) -> DataFrame:
    """Every calendar day within `days` of an event's first shock."""
    return events.select(F.explode(F.sequence(F.date_sub("first_shock_date", days), F.date_add("first_shock_date", days))).alias("date")).distinct()


def control_candidates(prices: DataFrame, events: DataFrame, days: int = DEFAULT.control_exclusion_days) -> DataFrame:
    """Trading days outside every exclusion zone."""
    return prices.select("date").distinct().join(excluded_days(events, days), "date", "left_anti")


def control_dates(prices: DataFrame, events: DataFrame, days: int = DEFAULT.control_exclusion_days, ratio: int = DEFAULT.control_ratio, seed: str = DEFAULT.seed) -> DataFrame:
    """`ratio` candidates an event, by the order of a seeded hash (all where there are too few), numbered by date."""
    picked = control_candidates(prices, events, days).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("date").cast("string")))).limit(events.count() * ratio)
    return picked.select(F.row_number().over(all_rows().orderBy("date")).alias("control_id"), "date")


def reference_dates(events: DataFrame, controls: DataFrame) -> DataFrame:
    """Events and controls as one frame: ref_id, kind, label, ref_date."""
    one = events.select(F.concat(F.lit("event_"), F.col("event_id").cast("string")).alias("ref_id"), F.lit("event").alias("kind"), F.lit(1).alias("label"), F.col("first_shock_date").alias("ref_date"))
    two = controls.select(F.concat(F.lit("control_"), F.col("control_id").cast("string")).alias("ref_id"), F.lit("control").alias("kind"), F.lit(0).alias("label"), F.col("date").alias("ref_date"))
    return one.unionByName(two)
