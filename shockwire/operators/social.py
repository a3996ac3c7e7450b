"""Monthly roll-ups of scores, and how they move with monthly indicators."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from shockwire.config import DEFAULT
from shockwire.functions.adf import adf_pvalue
from shockwire.functions.aggregates import pearson
from shockwire.functions.special import f_tail, student_two_sided, t_two_sided

def by_month() -> WindowSpec:
    """A window over a whole monthly series: a few hundred rows."""
    return Window.partitionBy(F.lit(0)).orderBy("year_month")


def monthly(scores: DataFrame, threshold: float = DEFAULT.warning_threshold) -> DataFrame:
    """(date, risk_score) to year_month, mean, max, deviation (0 for one day), days, warning days."""
    s = F.col("risk_score")
    return scores.groupBy(F.date_format("date", "yyyy-MM").alias("year_month")).agg(F.avg(s).alias("risk_mean"), F.max(s).alias("risk_max"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("risk_std"), F.count(F.lit(1)).alias("n_days"), F.sum(F.when(s >= threshold, 1).otherwise(0)).alias("warning_days"))


def merge(months: DataFrame, indicators: dict[str, DataFrame]) -> DataFrame:
    """Months with a column for each indicator (year_month, value), null where it has no value."""
    return reduce(lambda df, item: df.join(item[1].select("year_month", F.col("value").alias(item[0])), "year_month", "left"), indicators.items(), months)


def parse_statistics(raw: DataFrame) -> DataFrame:
    """(period, value) texts of a statistics service to (year_month, value): short periods and non-numbers go, commas
    go, values of one month are added."""
    number = F.expr("try_cast(replace(trim(value), ',', '') AS double)")
    month = F.concat(F.substring("period", 1, 4), F.lit("-"), F.substring("period", 5, 2))
    return raw.where(F.length("period") >= 6).select(month.alias("year_month"), number.alias("value")).where(F.col("value").isNotNull()).groupBy("year_month").agg(F.sum("value").alias("value"))


def rolling_correlation(merged: DataFrame, x: str, y: str, window: int = DEFAULT.rolling_window, lag: int = 0) -> DataFrame:
    """Pearson r of the last `window` months, y moved back by lag rows; months before a full window go."""
    common = merged.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_y", F.lead(y, lag).over(by_month()) if lag else F.col(y)).where("_y is not null")
    w = by_month().rowsBetween(-(window - 1), 0)
    out = common.withColumn("rolling_corr", F.when(F.count("_y").over(w) == window, pearson(x, "_y", w)))
    return out.where(F.col("rolling_corr").isNotNull()).select("year_month", F.round("rolling_corr", 4).alias("rolling_corr"))


def rolling_summary(rolling: DataFrame) -> DataFrame:
    """Share of positive windows, of windows above 0.3, and the mean."""
    r = F.col("rolling_corr")
    return rolling.agg((100 * F.avg(F.when(r > 0, 1.0).otherwise(0.0))).alias("positive_pct"), (100 * F.avg(F.when(r > 0.3, 1.0).otherwise(0.0))).alias("strong_pct"), F.avg(r).alias("mean_corr"))


def lagged(merged: DataFrame, x: str, y: str, max_lag: int = DEFAULT.max_lag) -> DataFrame:
    """R and n of x with y `lag` rows later, among months that have both; a lag needs n - 5 rows to move over."""
    common = merged.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.row_number().over(by_month()).alias("rn"), F.col(x).alias("x"), F.col(y).alias("y"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("n"))
    left = common.where("n >= 10").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).where("lag < n - 5").select("lag", "x", (F.col("rn") + F.col("lag")).alias("at"))
    pairs = left.join(common.select(F.col("rn").alias("at"), "y"), "at")
    return pairs.groupBy("lag").agg(pearson("x", "y").alias("correlation"), F.count(F.lit(1)).alias("n_obs")).where("n_obs >= 5")


def cross_correlation(merged: DataFrame, x: str, y: str, max_lag: int = DEFAULT.max_lag, alpha: float = DEFAULT.alpha) -> DataFrame:
    """lagged() with two-sided p (Student's t) and Bonferroni-adjusted p."""
    found = lagged(merged, x, y, max_lag)
    r, n = F.col("correlation"), F.col("n_obs")
    t = r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300)))
    tests = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    out = found.withColumn("_t", t).withColumn("_df", (n - 2).cast("double")).withColumn("p_value", t_two_sided("_t", "_df")).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * tests))
    return out.drop("_t", "_df").withColumn("significant", F.col("p_adjusted") < alpha)


def best_lag(correlations: DataFrame, *keys: str) -> DataFrame:
    """The lag of the largest absolute correlation, the shortest of equals."""
    w = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc(F.abs("correlation")), "lag")
    return correlations.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lag_features(merged: DataFrame, lags: dict[str, int]) -> DataFrame:
    """For each column its value `lag` rows before, and changes on 1 and 12 rows in per cent."""
    change = lambda c, k: F.try_divide(F.col(c) - F.lag(c, k).over(by_month()), F.lag(c, k).over(by_month())) * 100
    out = {}
    for c, k in lags.items():
        out |= {f"{c}_lag": F.lag(c, k).over(by_month()) if k else F.col(c), f"{c}_mom": change(c, 1), f"{c}_yoy": change(c, 12)}
    return merged.withColumns(out)


def line(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, r, r2, n and the standard error of the slope."""
    a, b = F.col(x), F.col(y)
    base = rows.where(a.isNotNull() & b.isNotNull()).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), pearson(x, y).alias("r"), F.regr_r2(b, a).alias("r2"), F.count(F.lit(1)).alias("n"), F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy"))
    return base.select("slope", "intercept", "r", "r2", "n", F.sqrt(F.try_divide((1 - F.col("r2")) * F.col("syy"), F.col("sxx") * (F.col("n") - 2))).alias("slope_se"))


def ols(rows: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Coefficients, R2, adjusted R2, mean absolute error and the 95 % half-width of residuals. Products are summed
    on Spark; the small normal equations are solved here."""
    known = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*xs, y]])).withColumn("_one", F.lit(1.0))
    cols = ["_one", *xs, y]
    got = known.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]).first()
    if got is None or got["p0_0"] is None:
        return rows.sparkSession.createDataFrame([], "name string, value double")
    gram = np.array([[got[f"p{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))], dtype=float)
    beta = np.linalg.lstsq(gram[:-1, :-1], gram[:-1, -1], rcond=None)[0]
    fit: Column = reduce(lambda a, b: a + b, [F.col(c) * float(k) for c, k in zip(cols, beta, strict=False)])
    n, k = gram[0, 0], len(xs)
    e = known.select((F.col(y) - fit).alias("e")).agg(F.sum(F.col("e") * F.col("e")).alias("ss"), F.avg(F.abs("e")).alias("mae"), F.stddev_pop("e").alias("sd")).first()
    total = gram[-1, -1] - gram[0, -1] ** 2 / n
    r2 = 1 - e["ss"] / total if total > 0 else 0.0
    values = [("intercept", beta[0]), *zip(xs, beta[1:], strict=True), ("r2", r2), ("adjusted_r2", 1 - (1 - r2) * (n - 1) / (n - k - 1) if n > k + 1 else 0.0), ("mae", e["mae"]), ("half_width_95", 1.96 * e["sd"]), ("n", n)]
    return rows.sparkSession.createDataFrame([(a, float(b)) for a, b in values], "name string, value double")


def long_pairs(merged: DataFrame, metrics: list[str], indicators: list[str]) -> DataFrame:
    """(risk_metric, social_indicator, year_month, x, y) for every pair that has both values."""
    pairs = F.array(*[F.struct(F.lit(m).alias("risk_metric"), F.lit(i).alias("social_indicator"), F.col(m).cast("double").alias("x"), F.col(i).cast("double").alias("y")) for m in metrics for i in indicators])
    return merged.select("year_month", F.explode(pairs).alias("p")).select("p.risk_metric", "p.social_indicator", "year_month", "p.x", "p.y").where("x is not null and y is not null")


def sweep(merged: DataFrame, metrics: list[str], indicators: list[str], max_lag: int = DEFAULT.max_lag) -> DataFrame:
    """Cross-correlations of every pair in one job: (risk_metric, social_indicator, lag, correlation, n_obs)."""
    keys = ["risk_metric", "social_indicator"]
    w = Window.partitionBy(*keys)
    rows = long_pairs(merged, metrics, indicators).withColumns({"rn": F.row_number().over(w.orderBy("year_month")), "n": F.count(F.lit(1)).over(w)}).where("n >= 10")
    left = rows.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).where("lag < n - 5").select(*keys, "lag", "x", (F.col("rn") + F.col("lag")).alias("at"))
    pairs = left.join(rows.select(*keys, F.col("rn").alias("at"), "y"), [*keys, "at"])
    return pairs.groupBy(*keys, "lag").agg(pearson("x", "y").alias("correlation"), F.count(F.lit(1)).alias("n_obs")).where("n_obs >= 5")


def granger(merged: DataFrame, metrics: list[str], indicators: list[str], max_lag: int = 6, alpha: float = DEFAULT.alpha) -> DataFrame:
    """X11: does the metric's past improve the indicator's forecast? Each series is differenced once if its augmented
    Dickey-Fuller p exceeds 0.05; F tests of lags 1..max_lag. Pairs are tasks of their own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year_month")
        names = (pdf["risk_metric"].iloc[0], pdf["social_indicator"].iloc[0])
        x, y, out = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), []
        columns = ["risk_metric", "social_indicator", "lag", "f_statistic", "p_value", "significant", "cause_diffed", "effect_diffed"]
        if len(x) < max_lag + 10:
            return pd.DataFrame(out, columns=columns)
        diffed = [adf_pvalue(v, 6) > 0.05 for v in (x, y)]
        # differenced or not, both series keep the same months
        x, y = (np.diff(v) if d else v[1 if any(diffed) else 0 :] for v, d in zip((x, y), diffed, strict=True))
        if len(x) < max_lag + 5:
            return pd.DataFrame(out, columns=columns)
        for lag in range(1, max_lag + 1):
            target = y[lag:]
            past = lambda v: [v[lag - k : len(v) - k] for k in range(1, lag + 1)]  # noqa: E731,B023
            short = np.column_stack([np.ones(len(target)), *past(y)])
            full = np.column_stack([short, *past(x)])
            ssr = [float(((target - m @ np.linalg.lstsq(m, target, rcond=None)[0]) ** 2).sum()) for m in (short, full)]
            df = len(target) - full.shape[1]
            f = (ssr[0] - ssr[1]) / lag / (ssr[1] / df) if df > 0 and ssr[1] > 0 else 0.0
            p = f_tail(f, lag, df) if df > 0 else 1.0
            out.append((*names, lag, round(f, 4), p, p < alpha, *diffed))
        return pd.DataFrame(out, columns=columns)

    schema = "risk_metric string, social_indicator string, lag int, f_statistic double, p_value double, significant boolean, cause_diffed boolean, effect_diffed boolean"
    return long_pairs(merged, metrics, indicators).groupBy("risk_metric", "social_indicator").applyInPandas(run, schema)


def crisis_means(merged: DataFrame, crises: DataFrame, y: str, lag: int = 0) -> DataFrame:
    """For each crisis (name, year_month): mean of y over the 6 rows before it, over rows lag .. lag + 6 after, and over
    the row itself and its neighbours."""
    numbered = merged.select("year_month", F.col(y).alias("y"), F.row_number().over(by_month()).alias("rn"))
    at = crises.join(numbered.select("year_month", F.col("rn").alias("at")), "year_month")
    near = at.withColumn("rn", F.explode(F.sequence(F.col("at") - 6, F.col("at") + max(6 + lag, 1)))).join(numbered.select("rn", "y"), "rn")
    d = F.col("rn") - F.col("at")
    mean = lambda lo, hi, name: F.avg(F.when(d.between(lo, hi), F.col("y"))).alias(name)
    return near.groupBy("name").agg(mean(-6, -1, "pre_mean"), mean(lag, lag + 6, "post_mean"), mean(-1, 1, "peak_mean"))


def pearson_p(r: float, n: int) -> float:
    """X10 for one pair, on the driver."""
    return student_two_sided(r * ((n - 2) / max(1 - r * r, 1e-300)) ** 0.5, n - 2)
