"""How well scores and levels tell events from controls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockwire.config import DEFAULT
from shockwire.operators.scan import Running, scan
from shockwire.operators.stats import auc, best_f1, roc


def time_split(scored: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows up to the cutoff, and after it. Rows without a date are in neither."""
    return scored.where(F.col("date") <= F.lit(cutoff).cast("date")), scored.where(F.col("date") > F.lit(cutoff).cast("date"))


def confusion(predicted: DataFrame, *keys: str) -> DataFrame:
    """Tp, fp, fn, tn, precision, recall, fpr, f1 of (label, predicted), by keys; 0 where a denominator is 0."""
    y, p = F.col("label") == 1, F.col("predicted") == 1
    n = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    counts = predicted.groupBy(*keys).agg(n(y & p, "tp"), n(~y & p, "fp"), n(y & ~p, "fn"), n(~y & ~p, "tn"))
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def alert_levels(scored: DataFrame) -> DataFrame:
    """The confusion of `level >= k` for k = 1, 2, 3, best F1 first (the lowest level of equals)."""
    each = scored.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("predicted", (F.col("level") >= F.col("k")).cast("int"))
    return confusion(each, "k").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f1"), "k")))


def ensembles(scored: DataFrame, one: Column, two: Column) -> DataFrame:
    """The confusion of both predictions together (and) and of either (or)."""
    rules = F.array(F.struct(F.lit("and").alias("rule"), (one & two).cast("int").alias("predicted")), F.struct(F.lit("or").alias("rule"), (one | two).cast("int").alias("predicted")))
    return confusion(scored.select("label", F.explode(rules).alias("r")).select("label", "r.*"), "rule")


def lead_times(warnings: DataFrame, events: DataFrame, ranges: int | None = None) -> DataFrame:
    """For each warning date the next event on or after it, and the days to it (null without one). Both sides are
    laid in one order by date and the next event is a scan from its end, so no pair of the two is made."""
    none = F.lit(None).cast("date")
    both = warnings.select("date", none.alias("event"), F.lit(True).alias("asked")).unionByName(events.select("date", F.col("date").alias("event"), F.lit(False).alias("asked")))
    found = scan(both, "date", {"next_event": Running("min", "event", after=True)}, ranges=ranges).where("asked")
    return found.select("date", F.when(F.col("date").isNotNull(), F.col("next_event")).alias("next_event")).withColumn("lead_days", F.datediff("next_event", "date"))


def lead_summary(leads: DataFrame) -> DataFrame:
    """Mean, median, least and greatest lead, and how many warnings there are and have an event after them."""
    d = F.col("lead_days")
    return leads.agg(F.avg(d).alias("mean_lead"), F.percentile(d, F.lit(0.5)).alias("median_lead"), F.min(d).alias("min_lead"), F.max(d).alias("max_lead"), F.count(F.lit(1)).alias("n_warnings"), F.count(d).alias("n_with_future"))


def detection_by_lead(scores: DataFrame, threshold: float = DEFAULT.warning_threshold) -> DataFrame:
    """By lead day of (event_id, lead_days, risk_score): detections, their share, mean and median score."""
    hit = F.when(F.col("risk_score") >= threshold, 1).otherwise(0)
    return scores.groupBy("lead_days").agg(F.sum(hit).alias("detected"), F.count(F.lit(1)).alias("n"), F.avg(hit).alias("rate"), F.avg("risk_score").alias("mean_score"), F.percentile("risk_score", F.lit(0.5)).alias("median_score"))


def score_summary(scored: DataFrame, threshold: float = DEFAULT.warning_threshold) -> DataFrame:
    """By label: count, mean, median, greatest score and how many reach the threshold."""
    s = F.col("score")
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_score"), F.percentile(s, F.lit(0.5)).alias("median_score"), F.max(s).alias("max_score"), F.sum(F.when(s >= threshold, 1).otherwise(0)).alias("n_warning"))


def histogram(scored: DataFrame, bins: int = 40, top: float = 100.0) -> DataFrame:
    """Rows by label and equal bin of 0..top; the top itself is in the last bin."""
    at = F.least(F.floor(F.col("score") * bins / top), F.lit(bins - 1)).cast("int")
    return scored.groupBy("label", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentile_rank(scored: DataFrame, score: float) -> DataFrame:
    """Per cent of scores at or below `score`, over all rows, events and controls."""
    under = F.when(F.col("score") <= score, 100.0).otherwise(0.0)
    side = lambda k: F.avg(F.when(F.col("label") == k, under))
    return scored.agg(F.round(F.avg(under), 2).alias("overall"), F.round(side(1), 2).alias("event"), F.round(side(0), 2).alias("control"))


def validation_report(scored: DataFrame, events: DataFrame, cutoff: str) -> DataFrame:
    """K9: the rows of the validation report: section, model (A: alert level, B: score, and, or), measure, value.

    scored: date, label, level, score of reference dates; events: date. Model A warns from the level, model B from the score that
    is best by F1 on the dates up to the cutoff; both are then held against the later ones. Lead times are those of the
    later warnings."""
    train, test = time_split(scored, cutoff)
    levels = alert_levels(train)
    chosen = levels.where("rank = 1").select("k").join(F.broadcast(best_f1(roc(train)).select("threshold")))  # one row
    part = F.when(F.col("date") <= F.lit(cutoff).cast("date"), "train").otherwise("test")
    a, b = F.col("level") >= F.col("k"), F.col("score") >= F.col("threshold")
    rules = F.array(*[F.struct(F.lit(m).alias("model"), c.cast("int").alias("predicted")) for m, c in (("A", a), ("B", b), ("and", a & b), ("or", a | b))])
    marked = scored.where("date is not null").join(F.broadcast(chosen)).select("date", "label", part.alias("section"), F.explode(rules).alias("r")).select("date", "label", "section", "r.*")

    def long(df: DataFrame, *measures: str) -> DataFrame:
        each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        return df.select("section", "model", F.explode(each).alias("x")).select("section", "model", "x.*")

    def leads(model: str) -> DataFrame:
        warned = marked.where((F.col("model") == model) & (F.col("section") == "test") & (F.col("predicted") == 1)).select("date")
        return long(lead_summary(lead_times(warned, events)).select("*", F.lit("lead time").alias("section"), F.lit(model).alias("model")), "mean_lead", "median_lead", "min_lead", "max_lead", "n_warnings", "n_with_future")

    sizes = marked.where("model = 'A'").groupBy("section").agg(F.count(F.lit(1)).alias("rows")).withColumn("model", F.lit("all"))
    areas = [auc(rows).select(F.lit(name).alias("section"), F.lit("B").alias("model"), "auc") for name, rows in (("train", train), ("test", test))]
    parts = [
        long(sizes, "rows"), long(levels.select(F.lit("alert level").alias("section"), F.col("k").cast("string").alias("model"), "*"), "precision", "recall", "f1", "fpr"),
        long(chosen.select(F.lit("chosen").alias("section"), F.lit("A").alias("model"), F.col("k").alias("alert_level")), "alert_level"), long(chosen.select(F.lit("chosen").alias("section"), F.lit("B").alias("model"), "threshold"), "threshold"),
        long(confusion(marked, "section", "model"), "precision", "recall", "f1", "fpr", "tp", "fp", "fn", "tn"), *[long(x, "auc") for x in areas], leads("A"), leads("B"),
    ]
    return reduce(DataFrame.unionByName, parts)
