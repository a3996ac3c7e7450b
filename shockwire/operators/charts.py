"""The data behind charts, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.operators.evaluator import focus, streak


def p_heatmap(tests: DataFrame, windows: tuple[int, ...], p: str = "p_value") -> DataFrame:
    """-log10 of p (1e-300 at least) by property and window."""
    strength = F.min(-F.log10(F.greatest(F.col(p), F.lit(1e-300))))
    wide = tests.groupBy("property_id").pivot("window_days", list(windows)).agg(strength)
    return wide.select("property_id", *[F.col(str(w)).alias(f"w{w}") for w in windows])


def dual_axis(merged: DataFrame, left: str, right: str, flat: float = 0.0) -> DataFrame:
    """Two monthly series, each as it is and on 0..1 of its own range (`flat` where all its values are equal; null stays null)."""
    every = Window.partitionBy(F.lit(0))

    def unit(c: str):
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        return F.when(hi > lo, (F.col(c) - lo) / F.when(hi > lo, hi - lo)).when(F.col(c).isNotNull(), F.lit(float(flat)))

    return merged.select("year_month", left, right, unit(left).alias(f"{left}_unit"), unit(right).alias(f"{right}_unit"))


def lag_profile(correlations: DataFrame) -> DataFrame:
    """Correlations by lag with the largest in absolute value marked (the shortest lag of equals)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("correlation")), "lag")
    return correlations.withColumn("is_best", F.row_number().over(w) == 1)


def timeline(scores: DataFrame, threshold: float) -> DataFrame:
    """Days with their status and a trailing mean of seven rows."""
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-6, 0)
    return scores.select("date", "risk_score", F.when(F.col("risk_score") >= threshold, "WARNING").otherwise("NORMAL").alias("status"), F.avg("risk_score").over(w).alias("mean_7"))


def status_panel(scores: DataFrame, details: DataFrame, threshold: float, top: int = 6) -> DataFrame:
    """One row: the latest day (date, risk_score, status), its run of warning days, the peak and its first day, active (> 1.0)
    and extreme (> 1.5) properties of that day, and its `top` contributors, largest first. scores: date, risk_score;
    details: date, property_id, ratio, contribution."""
    run = streak(scores, threshold).select("date", "risk_score", "streak_days")
    peak = scores.agg(F.min(F.struct((-F.col("risk_score")).alias("s"), "date")).alias("p")).select((-F.col("p.s")).alias("peak_score"), F.col("p.date").alias("peak_date"))
    of_day = details.join(F.broadcast(run.select("date")), "date", "left_semi")  # a row a property
    count = lambda least: F.sum(F.when(F.col("ratio") > least, 1).otherwise(0))
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("contribution")).alias("c"), "property_id", "ratio"))), 1, top)
    told = of_day.agg(F.coalesce(count(1.0), F.lit(0)).alias("n_active"), F.coalesce(count(1.5), F.lit(0)).alias("n_extreme"), F.transform(first, lambda x: F.struct(x["property_id"].alias("property_id"), x["ratio"].alias("ratio"))).alias("top"))
    one = run.where("date is not null").join(F.broadcast(peak)).join(F.broadcast(told))
    return one.select("date", "risk_score", F.when(F.col("risk_score") >= threshold, "WARNING").otherwise("NORMAL").alias("status"), "streak_days", "peak_score", "peak_date", "n_active", "n_extreme", "top")


def peak_pattern(scores: DataFrame, threshold: float) -> DataFrame:
    """Days from a week before the first warning on: date, risk_score, is_warning, is_peak (the first day of the largest score) and
    phase: normal (before the first warning), rise (to the peak), fall. No rows without a warning."""
    warned = scores.agg(F.min(F.when(F.col("risk_score") >= threshold, F.col("date"))).alias("first")).where("first is not null")
    rows = focus(scores, threshold).join(F.broadcast(warned))
    last = F.max(F.when(F.col("phase") == "until_peak", F.col("date"))).over(Window.partitionBy(F.lit(0)))  # the days in focus
    phase = F.when(F.col("date") < F.col("first"), "normal").when(F.col("phase") == "until_peak", "rise").otherwise("fall")
    return rows.select("date", "risk_score", (F.col("risk_score") >= threshold).alias("is_warning"), (F.col("date") == last).alias("is_peak"), phase.alias("phase"))
