"""B11's cache: an append-only table of daily scores that is brought up to date by scoring only what is absent or stale.

Under the table's path, `scores` holds one folder a run with the days scored in it, and `inputs` the prints of the days' counts
as the run saw them. A day's score is its newest row. A day is due when the table lacks it for this model, or when a day in its
longest window has counts of another print than at its last run. Scores are written before prints: a run that fails in between
is repeated, and repeating it gives the same rows. Nothing is rewritten, so readers see a complete older table meanwhile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockwire.operators.scoring import daily_batch
from shockwire.operators.windows import range_sums
from shockwire.sources.files import exists
from shockwire.sources.shared import cut

_SCORES = "date date, raw_score double, risk_score double, model string"
_INPUTS = "date date, print long"


def _newest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest row of each date (and model) in the runs under path."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, run long")
    rows = spark.read.schema(f"{schema}, run long").parquet(path)
    keys = [c for c in rows.columns if c in ("date", "model")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "run").alias("r")).select(*keys, "r.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """date, raw_score, risk_score, model, run: each day's newest score."""
    rows = _newest(spark, f"{path}/scores", _SCORES)
    return rows.groupBy("date").agg(F.max_by(F.struct("raw_score", "risk_score", "model", "run"), "run").alias("r")).select("date", "r.*")


def day_prints(daily: DataFrame, articles_per_day: DataFrame) -> DataFrame:
    """date, print: one number of a day's counts by property and of its articles."""
    counts = daily.groupBy("date").agg(F.expr("bit_xor(xxhash64(property_id, cnt))").alias("p"))
    return counts.join(articles_per_day, "date", "full_outer").select("date", F.xxhash64("p", "n_articles").alias("print"))


def model_print(params: DataFrame, top: DataFrame, rule: str, unscaled: float = 0.0) -> str:
    """What tells models apart: parameters, empirical maximum, coverage rule and the score without a maximum, where that is not 0."""
    of = params.select(F.xxhash64("property_id", "optimal_window", "ctrl_freq_mean", "weight").alias("h")).agg(F.expr("bit_xor(h)").alias("h"))
    row = of.join(F.broadcast(top)).first()
    return f"{row['h']}-{row['top']}-{rule}" + (f"-{unscaled:g}" if unscaled else "")


def backfill(path: str, daily: DataFrame, articles_per_day: DataFrame, days: DataFrame, params: DataFrame, top: DataFrame, rule: str = "below_0_8", unscaled: float = 0.0) -> int:
    """Scores what is due among days (date) and appends it; returns how many days that were. Inputs as in `daily_batch`."""
    spark = days.sparkSession
    longest = params.agg(F.max("optimal_window").alias("w")).first()["w"] or 0
    model = model_print(params, top, rule, unscaled)
    scored, seen = _newest(spark, f"{path}/scores", _SCORES), _newest(spark, f"{path}/inputs", _INPUTS)
    prints = day_prints(daily, articles_per_day)
    both = prints.join(seen.select("date", F.col("print").alias("before")), "date", "full_outer")
    changed = cut(both.where(~F.col("print").eqNullSafe(F.col("before"))).select("date", "print"))  # what follows uses it three times
    known = scored.where(F.col("model") == model).select("date")
    asked = known.select(F.col("date").alias("ref_date"), F.lit(longest).cast("int").alias("window_days"))
    stale = range_sums(changed.select("date", F.lit(1).alias("n")), asked, [], ["n"]).where("n > 0").select(F.col("ref_date").alias("date"))
    due = cut(days.select("date").where("date is not null").distinct().join(known.join(stale, "date", "left_anti"), "date", "left_anti"))
    span = due.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    run = max((r[0] for name in ("scores", "inputs") if exists(spark, f"{path}/{name}") for r in [spark.read.schema("run long").parquet(f"{path}/{name}").agg(F.max("run")).first()] if r[0] is not None), default=0) + 1
    if span["n"]:
        inside = F.col("date").between(F.date_sub(F.lit(span["lo"]), longest), F.lit(span["hi"]))
        rows = daily_batch(daily.where(inside), articles_per_day.where(inside), due, params, top, rule, unscaled)
        rows.withColumn("model", F.lit(model)).coalesce(1).write.parquet(f"{path}/scores/run={run}")  # a row a day
    if not changed.isEmpty():
        changed.coalesce(1).write.parquet(f"{path}/inputs/run={run}")
    return span["n"]
