"""Alert levels and weighted-excess scores of reference dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.config import DEFAULT
from shockwire.operators.windows import property_windows, range_sums


def alert_level(n: Column, levels: tuple[int, int, int] = DEFAULT.alert_levels) -> Column:
    """M8: 0 to 3 by the number of significant properties present."""
    one, two, three = levels
    return F.when(n >= three, 3).when(n >= two, 2).when(n >= one, 1).otherwise(0)


def weights(significant: DataFrame) -> DataFrame:
    """M9: adds weight, -log10 of the adjusted p as a share of the largest."""
    strength = -F.log10(F.greatest("p_adjusted", F.lit(1e-300)))
    top = F.max("_s").over(Window.partitionBy(F.lit(0)))
    return significant.withColumn("_s", strength).withColumn("weight", F.when(top > 0, F.col("_s") / F.when(top > 0, top)).otherwise(0.0)).drop("_s")


def contributions(freq: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ratio to the control mean and weight x positive excess for each (reference, property)."""
    ratio = F.when((F.col("freq") > 0) & (F.col("ctrl_freq_mean") > 0), F.col("freq") / F.when(F.col("ctrl_freq_mean") > 0, F.col("ctrl_freq_mean"))).otherwise(0.0)
    return freq.join(params, "property_id").withColumn("ratio", ratio).withColumn("contribution", F.col("weight") * F.greatest(F.col("ratio") - 1, F.lit(0.0)))


def calibrated(raw: DataFrame) -> DataFrame:
    """risk_score, the raw score against the largest of any event, 100 at most."""
    top = F.max(F.when(F.col("label") == 1, F.col("raw_score"))).over(Window.partitionBy(F.lit(0)))
    return raw.withColumn("risk_score", F.when(top > 0, F.round(F.least(F.lit(100.0), F.col("raw_score") * 100 / F.when(top > 0, top)), 2)).otherwise(0.0)).withColumn("raw_score", F.round("raw_score", 4))


def score_references(daily: DataFrame, refs: DataFrame, params: DataFrame, longest: int) -> DataFrame:
    """ref_id, label, ref_date, raw_score, risk_score of every reference date."""
    sums = contributions(property_windows(daily, refs, params, longest), params).groupBy("ref_id").agg(F.sum("contribution").alias("raw_score"))
    return calibrated(refs.select("ref_id", "label", "ref_date").join(sums, "ref_id", "left").withColumn("raw_score", F.coalesce("raw_score", F.lit(0.0))))


def details(contributed: DataFrame) -> DataFrame:
    """One map a reference date: property -> (ratio, contribution)."""
    entry = F.struct(F.col("property_id"), F.struct(F.round("ratio", 4).alias("ratio"), F.round("contribution", 4).alias("contribution")))
    return contributed.groupBy("ref_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("details"))


def top_contributors(contributed: DataFrame, n: int = 3) -> DataFrame:
    """The n largest contributions of each reference date with ratio > 0."""
    w = Window.partitionBy("ref_id").orderBy(F.desc("contribution"), "property_id")
    return contributed.where("ratio > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def correct_coverage(freq: DataFrame, held: DataFrame, rule: str = "always") -> DataFrame:
    """Counts of windows with missing days, scaled up and truncated: `always`, `below_0_8` (of days) or `none`."""
    short = (F.col("actual_days") > 0) & (F.col("actual_days") < F.col("window_days"))
    if rule == "below_0_8":
        short = short & (F.col("actual_days") / F.col("window_days") < 0.8)
    if rule == "none":
        short = F.lit(False)
    scaled = (F.col("freq") * F.col("window_days").cast("double") / F.when(F.col("actual_days") > 0, F.col("actual_days"))).cast("long")
    return freq.join(held, ["ref_id", "window_days"]).withColumn("freq", F.when(short, scaled).otherwise(F.col("freq")))


def offset_scores(daily: DataFrame, events: DataFrame, params: DataFrame, longest: int, offsets: tuple[int, ...] = DEFAULT.offsets) -> DataFrame:
    """Raw scores on the days before each event's first shock: event_id, days_before, raw_score."""
    grid = events.select("event_id", F.explode(F.array(*map(F.lit, offsets))).alias("days_before"), "first_shock_date")
    grid = grid.withColumn("ref_id", F.concat_ws("_", "event_id", "days_before")).withColumn("ref_date", F.date_sub("first_shock_date", F.col("days_before"))).withColumn("label", F.lit(1))
    sums = contributions(property_windows(daily, grid, params, longest), params).groupBy("ref_id").agg(F.sum("contribution").alias("raw_score"))
    return grid.join(sums, "ref_id", "left").select("event_id", "days_before", F.round(F.coalesce("raw_score", F.lit(0.0)), 4).alias("raw_score"))


def empirical_max(references: DataFrame) -> DataFrame:
    """One row, top: the largest raw score (4 digits) of an event among scored references (label, raw_score); null without events."""
    return references.where("label = 1").agg(F.max(F.round("raw_score", 4)).alias("top"))


def daily_batch(daily: DataFrame, articles_per_day: DataFrame, days: DataFrame, params: DataFrame, top: DataFrame, rule: str = "below_0_8", unscaled: float = 0.0) -> DataFrame:
    """raw_score and risk_score (0 to 100 against top, see `empirical_max`; `unscaled` without it) of every trading day of days (date),
    counts corrected for missing days. Each property's sums over its own window come from running sums (`windows.range_sums`)."""
    refs = days.select(F.col("date").alias("ref_date")).where("ref_date is not null").distinct()
    used = params.select("property_id", F.col("optimal_window").cast("int").alias("window_days"))
    asked = refs.join(used)  # the grid of the result's own terms: days x properties of the model
    freq = range_sums(daily.join(used.select("property_id"), "property_id", "left_semi"), asked, ["property_id"], ["cnt"]).withColumnRenamed("cnt", "freq")
    held = range_sums(articles_per_day.select("date", F.lit(1).alias("actual_days")), refs.join(used.select("window_days").distinct()), [], ["actual_days"])
    freq = freq.where("freq > 0").withColumn("ref_id", F.col("ref_date")).drop("ref_date")
    sums = contributions(correct_coverage(freq, held.withColumnRenamed("ref_date", "ref_id"), rule), params).groupBy("ref_id").agg(F.sum("contribution").alias("raw_score"))
    raw = refs.join(sums, F.col("ref_id") == F.col("ref_date"), "left").withColumn("raw_score", F.coalesce("raw_score", F.lit(0.0)))
    risk = F.when(F.col("top") > 0, F.round(F.least(F.lit(100.0), F.col("raw_score") * 100 / F.when(F.col("top") > 0, F.col("top"))), 2)).otherwise(float(unscaled))
    return raw.join(F.broadcast(top)).select(F.col("ref_date").alias("date"), F.round("raw_score", 4).alias("raw_score"), risk.alias("risk_score"))  # top is one row
