"""Property-ratio profiles of past events, and the events nearest to a day's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.operators.windows import property_windows


def profiles(daily: DataFrame, events: DataFrame, params: DataFrame, longest: int, offsets: tuple[int, ...] = (0, 7, 14, 21)) -> DataFrame:
    """(event_id, days_before, property_id, ratio) for every property of the model, 0 where a window lacks it."""
    grid = events.select("event_id", F.explode(F.array(*map(F.lit, offsets))).alias("days_before"), "first_shock_date")
    grid = grid.withColumn("ref_id", F.concat_ws("_", "event_id", "days_before")).withColumn("ref_date", F.date_sub("first_shock_date", F.col("days_before")))
    freq = property_windows(daily, grid, params, longest)
    every = grid.select("ref_id", "event_id", "days_before").crossJoin(params.select("property_id", "ctrl_freq_mean"))  # events x offsets x properties
    ratio = F.when(F.col("ctrl_freq_mean") > 0, F.coalesce("freq", F.lit(0)) / F.when(F.col("ctrl_freq_mean") > 0, F.col("ctrl_freq_mean"))).otherwise(0.0)
    return every.join(freq, ["ref_id", "property_id"], "left").select("event_id", "days_before", "property_id", ratio.alias("ratio"))


def nearest(profile: DataFrame, current: DataFrame, top: int = 20) -> DataFrame:
    """Cosine of the current (property_id, ratio) with every event profile, best first; 0 for zero profiles."""
    mine = current.select("property_id", F.col("ratio").alias("now"))
    norm = F.sqrt(F.sum(F.col("now") * F.col("now")).over(Window.partitionBy(F.lit(0))))
    joined = profile.join(mine.withColumn("length", norm), "property_id")
    sums = joined.groupBy("event_id", "days_before").agg(F.sum(F.col("ratio") * F.col("now")).alias("dot"), F.sqrt(F.sum(F.col("ratio") * F.col("ratio"))).alias("own"), F.max("length").alias("length"))
    scale = F.col("own") * F.col("length")
    found = sums.select("event_id", "days_before", F.round(F.when(scale > 0, F.col("dot") / F.when(scale > 0, scale)).otherwise(0.0), 6).alias("similarity"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "event_id", "days_before"))).where(F.col("rank") <= top)


def best_per_event(matches: DataFrame) -> DataFrame:
    """Each event's best match."""
    w = Window.partitionBy("event_id").orderBy(F.desc("similarity"), "days_before")
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
