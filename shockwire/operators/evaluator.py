"""Recent behaviour of properties: rates, dynamics and how pairs move together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.functions.aggregates import pearson


def daily_rates(counts: DataFrame, articles: DataFrame) -> DataFrame:
    """(date, property_id, rate): per cent of a day's articles with the property, two digits."""
    return counts.join(articles, "date").select("date", "property_id", F.round(100 * F.col("cnt") / F.col("n_articles"), 2).alias("rate"))


def tag_density(articles: DataFrame, levels: tuple[int, ...] = (7, 10, 15)) -> DataFrame:
    """By day, per cent of articles with at least so many tags; unreadable rows are in the denominator."""
    size = F.coalesce(F.when(F.col("properties").isNotNull(), F.size("properties")), F.lit(0))
    return articles.groupBy("date").agg(*[F.round(F.avg(F.when(size >= k, 100.0).otherwise(0.0)), 2).alias(f"pct_{k}plus") for k in levels])


def dense_rates(rates: DataFrame) -> DataFrame:
    """rates on every (date, property) of the table, 0 where missing. Days x properties, not articles."""
    return rates.select("date").distinct().crossJoin(rates.select("property_id").distinct()).join(rates, ["date", "property_id"], "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))


def dynamics(rates: DataFrame, least: float = 0.5) -> DataFrame:
    """By property: trend (last of three days against the first, 15 per cent; unknown below three days), velocity (mean
    of the last three changes), spike (last change above 0.3 of the mean); properties that never reach `least` go. A table
    of one day gives no rows."""
    w = Window.partitionBy("property_id").orderBy("date")
    rows = dense_rates(rates).withColumns({"change": F.col("rate") - F.lag("rate").over(w), "back": F.row_number().over(Window.partitionBy("property_id").orderBy(F.desc("date")))})
    at = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    out = rows.groupBy("property_id").agg(F.max("rate").alias("top"), F.count(F.lit(1)).alias("days"), F.avg("rate").alias("mean"), at("rate", 1).alias("last"), at("rate", 3).alias("third"), F.avg(F.when(F.col("back") <= 3, F.col("change"))).alias("velocity"), at("change", 1).alias("jump"))
    trend = F.when(F.col("third").isNull(), "unknown").when(F.col("last") > F.col("third") * 1.15, "rising").when(F.col("last") < F.col("third") * 0.85, "falling").otherwise("stable")
    spike = F.coalesce(F.when(F.col("mean") > 0, F.abs("jump") / F.when(F.col("mean") > 0, F.col("mean")) > 0.3), F.lit(False))
    return out.where((F.col("top") >= least) & (F.col("days") > 1)).select("property_id", "last", "mean", trend.alias("trend"), F.round("velocity", 3).alias("velocity"), spike.alias("spike"))


def pair_correlations(rates: DataFrame, top: int = 30) -> DataFrame:
    """The strongest correlations of two properties' rates over the days; each unordered pair once."""
    rows = dense_rates(rates)
    a, b = rows.select("date", F.col("property_id").alias("a"), F.col("rate").alias("x")), rows.select("date", F.col("property_id").alias("b"), F.col("rate").alias("y"))
    pairs = a.join(b, "date").where("a < b").groupBy("a", "b").agg(pearson("x", "y").alias("r"))
    return pairs.where(F.col("r").isNotNull()).withColumn("r", F.round("r", 6)).orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def active(details: DataFrame, above: float = 1.0) -> DataFrame:
    """The entries of a details map (property -> ratio, contribution) whose ratio is above a level, and their number."""
    kept = F.map_filter("details", lambda _, v: v["ratio"] > above)
    return details.withColumn("active", kept).withColumn("n_active", F.size(kept))


def last_days(df: DataFrame, n: int) -> DataFrame:
    """The last n days' rows, in order."""
    return df.orderBy(F.desc("date")).limit(n).orderBy("date")


def streak(scores: DataFrame, threshold: float) -> DataFrame:
    """The latest day, its score, the change from the day before, and how many days in a row stand at or above the threshold."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    calm = F.when(F.col("risk_score") < threshold, F.col("date"))
    rows = scores.withColumns({"last_calm": F.max(calm).over(Window.partitionBy(F.lit(0))), "change": F.round(F.col("risk_score") - F.lag("risk_score").over(w), 6)})
    return rows.agg(F.max("date").alias("date"), F.max_by("risk_score", "date").alias("risk_score"), F.max_by("change", "date").alias("change"), F.sum(F.when(F.col("last_calm").isNull() | (F.col("date") > F.col("last_calm")), 1).otherwise(0)).alias("streak_days"))


def focus(scores: DataFrame, threshold: float, before: int = 7, fallback: int = 30) -> DataFrame:
    """Days from `before` days before the first warning on (without one: the last `fallback`), each marked before
    or after the peak (the first day of the largest score)."""
    every = Window.partitionBy(F.lit(0))
    first = F.min(F.when(F.col("risk_score") >= threshold, F.col("date"))).over(every)
    rows = scores.withColumns({"_first": first, "_n": F.row_number().over(every.orderBy(F.desc("date")))})
    rows = rows.where(F.when(F.col("_first").isNotNull(), F.col("date") >= F.date_sub("_first", before)).otherwise(F.col("_n") <= fallback))
    peak = F.min(F.struct((-F.col("risk_score")).alias("s"), "date")).over(every)["date"]
    return rows.select("date", "risk_score", F.when(F.col("date") <= peak, "until_peak").otherwise("after_peak").alias("phase"))
