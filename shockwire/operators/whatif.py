"""What a score would be, and what it would take: on (date, property_id, ratio) of a model's properties.

params: property_id, weight; raw = sum of weight x positive excess, score = raw x 100 / empirical_max, 100 at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _score(raw: Column, empirical_max: float) -> Column:
    return F.least(F.lit(100.0), raw * 100 / empirical_max)


def score(ratios: DataFrame, params: DataFrame, empirical_max: float, *keys: str) -> DataFrame:
    """The score of each key's ratios."""
    raw = F.sum(F.col("weight") * F.greatest(F.col("ratio") - 1, F.lit(0.0)))
    return ratios.join(params, "property_id").groupBy(*keys).agg(F.round(_score(raw, empirical_max), 6).alias("score"))


def scaled(ratios: DataFrame, params: DataFrame, empirical_max: float, percents: range = range(10, 301, 10)) -> DataFrame:
    """The score when all ratios are scaled."""
    each = ratios.withColumn("percent", F.explode(F.array(*map(F.lit, percents)))).withColumn("ratio", F.col("ratio") * F.col("percent") / 100)
    return score(each, params, empirical_max, "percent")


def waterfall(before: DataFrame, after: DataFrame, params: DataFrame) -> DataFrame:
    """By property, the change of contribution between two days, the largest first."""
    part = lambda df, name: df.join(params, "property_id").select("property_id", (F.col("weight") * F.greatest(F.col("ratio") - 1, F.lit(0.0))).alias(name))
    both = part(before, "a").join(part(after, "b"), "property_id", "full")
    return both.select("property_id", F.round(F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0)), 6).alias("change"))


def tornado(ratios: DataFrame, params: DataFrame, empirical_max: float, percent: float = 20.0) -> DataFrame:
    """I4: the score's change when one ratio at a time goes up and down."""
    rows = ratios.join(params, "property_id")
    part = lambda r: F.col("weight") * F.greatest(r - 1, F.lit(0.0))
    total = F.sum(part(F.col("ratio"))).over(Window.partitionBy(F.lit(0)))
    moved = lambda f: F.round(_score(total - part(F.col("ratio")) + part(F.col("ratio") * f), empirical_max) - _score(total, empirical_max), 6)
    return rows.select("property_id", moved(1 - percent / 100).alias("down"), moved(1 + percent / 100).alias("up"))


def response(ratios: DataFrame, params: DataFrame, empirical_max: float, property_id: str, top: float = 3.0, points: int = 100) -> DataFrame:
    """The score as one ratio runs from 0 to `top`."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    each = ratios.withColumn("step", F.explode(steps)).withColumn("ratio", F.when(F.col("property_id") == property_id, F.col("step") * top / (points - 1)).otherwise(F.col("ratio")))
    return score(each, params, empirical_max, "step")


def ratio_needed(ratios: DataFrame, params: DataFrame, empirical_max: float, threshold: float) -> DataFrame:
    """For each property, the ratio at which the score would be exactly the threshold, the others standing (null where
    no ratio reaches it or weight is 0)."""
    rows = ratios.join(params, "property_id")
    part = F.col("weight") * F.greatest(F.col("ratio") - 1, F.lit(0.0))
    others = F.sum(part).over(Window.partitionBy(F.lit(0))) - part
    need = threshold * empirical_max / 100 - others
    return rows.select("property_id", F.round(F.when((need >= 0) & (F.col("weight") > 0), need / F.when(F.col("weight") > 0, F.col("weight")) + 1), 6).alias("ratio_needed"))


def least_cover(ratios: DataFrame, params: DataFrame, empirical_max: float, threshold: float) -> DataFrame:
    """The fewest properties, by contribution, that must fall back to 1 for the score to leave the threshold."""
    part = F.col("weight") * F.greatest(F.col("ratio") - 1, F.lit(0.0))
    rows = ratios.join(params, "property_id").select("property_id", part.alias("contribution"))
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.desc("contribution"), "property_id")
    excess = F.sum("contribution").over(every) - threshold * empirical_max / 100
    ranked = rows.withColumns({"excess": excess, "before": F.coalesce(F.sum("contribution").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "rank": F.row_number().over(order)})
    return ranked.where("excess > 0 and before < excess and contribution > 0").select("property_id", F.round("contribution", 6).alias("contribution"), "rank")


def compare_dates(ratios: DataFrame, dates: list[str]) -> DataFrame:
    """I8: ratios of up to five days side by side."""
    return ratios.where(F.col("date").cast("string").isin(dates)).groupBy("property_id").pivot("date_text" if "date_text" in ratios.columns else "date", dates).agg(F.first("ratio"))


def movers(ratios: DataFrame, least: float = 0.01) -> DataFrame:
    """By day and property, rising or falling against the day before by more than `least`."""
    w = Window.partitionBy("property_id").orderBy("date")
    change = F.round(F.col("ratio") - F.lag("ratio").over(w), 6)
    return ratios.withColumn("change", change).where(F.abs("change") > least).select("date", "property_id", "change", F.when(F.col("change") > 0, "rising").otherwise("falling").alias("direction"))
