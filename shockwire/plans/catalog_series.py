"""Queries on monthly series, strategies, recent behaviour, what-if questions, data quality, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shockwire.operators import backtest, checks, evaluator, scoring, social, whatif, windows
from shockwire.plans import catalog_events as base
from shockwire.plans import standins as s
from shockwire.plans.catalog_events import rounded
from shockwire.registry import query
from shockwire.sources import files, footers, sinks

MON = f"{s.SCORES}, mon AS (SELECT strftime(date, '%Y-%m') AS year_month, avg(risk_score) AS risk_mean, max(risk_score) AS risk_max, coalesce(stddev_samp(risk_score), 0) AS risk_std, count(*) AS n_days, sum(CASE WHEN risk_score >= 60 THEN 1 ELSE 0 END)::BIGINT AS warning_days FROM scores GROUP BY 1), {s.MONTHLY}, merged AS (SELECT mon.*, value AS returned FROM mon LEFT JOIN series USING (year_month))"


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return social.monthly(s.daily_scores(spark, d), 60)


def merged(spark: SparkSession, d: str) -> DataFrame:
    return social.merge(monthly(spark, d), {"returned": s.monthly_series(spark, d)})


def six(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("A8_monthly", f"WITH {MON} SELECT year_month, round(risk_mean, 6) AS risk_mean, risk_max, round(risk_std, 6) AS risk_std, n_days, warning_days FROM mon")
def _(spark, d):
    return six(monthly(spark, d))


@query("J2_merge", f"WITH {MON} SELECT year_month, round(risk_mean, 6) AS risk_mean, warning_days, returned FROM merged")
def _(spark, d):
    return six(merged(spark, d).select("year_month", "risk_mean", "warning_days", "returned"))


@query("S14_parse_statistics", "WITH r AS (SELECT strftime(o_orderdate, '%Y%m%d') AS period, CASE WHEN o_orderkey % 5 = 0 THEN '-' WHEN o_orderkey % 5 = 1 THEN '' ELSE '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') END AS value FROM orders) SELECT substr(period, 1, 4) || '-' || substr(period, 5, 2) AS year_month, sum(try_cast(replace(value, ',', '') AS DOUBLE)) AS value FROM r WHERE try_cast(replace(value, ',', '') AS DOUBLE) IS NOT NULL GROUP BY 1")
def _(spark, d):
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, "-").when(k % 5 == 1, "").otherwise(F.concat(F.lit("1,"), F.lpad((k % 1000).cast("string"), 3, "0")))
    return social.parse_statistics(s.read(spark, d, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("period"), value.alias("value")))


ROLL = f"{MON}, c AS (SELECT year_month, risk_mean AS x, returned AS y FROM merged WHERE returned IS NOT NULL), r AS (SELECT year_month, count(*) OVER w AS n, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy, corr(x, y) OVER w AS r FROM c WINDOW w AS (ORDER BY year_month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), roll AS (SELECT year_month, round(r, 4) AS rolling_corr FROM r WHERE n = 12 AND sx > 0 AND sy > 0)"


@query("W3_rolling_correlation", f"WITH {ROLL} SELECT * FROM roll")
def _(spark, d):
    return social.rolling_correlation(merged(spark, d), "risk_mean", "returned")


@query("A22_rolling_summary", f"WITH {ROLL} SELECT round(100 * avg(CASE WHEN rolling_corr > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive_pct, round(100 * avg(CASE WHEN rolling_corr > 0.3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS strong_pct, round(avg(rolling_corr), 6) AS mean_corr FROM roll")
def _(spark, d):
    return six(social.rolling_summary(social.rolling_correlation(merged(spark, d), "risk_mean", "returned")))


LAG = f"{MON}, c AS (SELECT row_number() OVER (ORDER BY year_month) AS rn, count(*) OVER () AS n, risk_mean AS x, returned AS y FROM merged WHERE returned IS NOT NULL), lg AS (SELECT lag_::INT AS lag, corr(a.x, b.y) AS r, count(*) AS n_obs FROM c a CROSS JOIN range(0, 13) AS l(lag_) JOIN c b ON b.rn = a.rn + lag_ WHERE lag_ < a.n - 5 AND a.n >= 10 GROUP BY 1)"


@query("W4_lagged_correlation", f"WITH {LAG} SELECT lag, round(r, 6) AS correlation, n_obs FROM lg WHERE n_obs >= 5")
def _(spark, d):
    return six(social.lagged(merged(spark, d), "risk_mean", "returned"))


@query("W5_best_lag", f"WITH {LAG} SELECT lag, round(r, 6) AS correlation FROM lg WHERE n_obs >= 5 ORDER BY abs(r) DESC, lag LIMIT 1")
def _(spark, d):
    return six(social.best_lag(social.lagged(merged(spark, d), "risk_mean", "returned")).select("lag", "correlation"))


#: Student's t of whole degrees of freedom has a finite sum in the angle th.
STUDENT = f"""{LAG}, th AS (SELECT lag, r, n_obs, n_obs - 2 AS v, atan(abs(r) / sqrt(greatest(1 - r * r, 1e-300))) AS th, count(*) OVER () AS m FROM lg WHERE n_obs >= 5),
tp AS (SELECT *, greatest(0, 1 - CASE WHEN v % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, v // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) * pow(cos(th), 2 * j)))
  ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1))), 0)) END) AS p FROM th)"""


@query("X10_cross_correlation", f"WITH {STUDENT} SELECT lag, round(r, 6) AS correlation, n_obs, round(p, 6) AS p_value, round(least(1.0::DOUBLE, p * m), 6) AS p_adjusted, least(1.0::DOUBLE, p * m) < 0.05 AS significant FROM tp")
def _(spark, d):
    return six(social.cross_correlation(merged(spark, d), "risk_mean", "returned"))


@query("M25_sweep", f"WITH {MON}, lp AS (SELECT m AS risk_metric, 'returned' AS social_indicator, year_month, CASE m WHEN 'risk_mean' THEN risk_mean WHEN 'risk_max' THEN risk_max ELSE warning_days END AS x, returned AS y FROM merged, (VALUES ('risk_mean'), ('risk_max'), ('warning_days')) AS v(m) WHERE returned IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY risk_metric ORDER BY year_month) AS rn, count(*) OVER (PARTITION BY risk_metric) AS n FROM lp) SELECT a.risk_metric, a.social_indicator, lag_::INT AS lag, CASE WHEN stddev_pop(a.x) > 0 AND stddev_pop(b.y) > 0 THEN round(corr(a.x, b.y), 6) END AS correlation, count(*) AS n_obs FROM c a CROSS JOIN range(0, 13) AS l(lag_) JOIN c b ON b.rn = a.rn + lag_ AND a.risk_metric = b.risk_metric WHERE lag_ < a.n - 5 AND a.n >= 10 GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def _(spark, d):
    return six(social.sweep(merged(spark, d), ["risk_mean", "risk_max", "warning_days"], ["returned"]))


@query("X11_granger")
def _(spark, d):
    return six(social.granger(merged(spark, d), ["risk_mean", "risk_max", "warning_days"], ["returned"]))


@query("W6_lag_features", f"WITH {MON} SELECT year_month, round(lag(risk_mean, 3) OVER (ORDER BY year_month), 6) AS risk_mean_lag, round((risk_mean - lag(risk_mean) OVER (ORDER BY year_month)) / lag(risk_mean) OVER (ORDER BY year_month) * 100, 6) AS risk_mean_mom, round((risk_mean - lag(risk_mean, 12) OVER (ORDER BY year_month)) / lag(risk_mean, 12) OVER (ORDER BY year_month) * 100, 6) AS risk_mean_yoy FROM merged")
def _(spark, d):
    return six(social.lag_features(merged(spark, d), {"risk_mean": 3}).select("year_month", "risk_mean_lag", "risk_mean_mom", "risk_mean_yoy"))


@query("X12_line", f"WITH {MON}, a AS (SELECT regr_slope(returned, risk_mean) AS slope, regr_intercept(returned, risk_mean) AS intercept, corr(risk_mean, returned) AS r, regr_r2(returned, risk_mean) AS r2, count(*) AS n, regr_sxx(returned, risk_mean) AS sxx, regr_syy(returned, risk_mean) AS syy FROM merged WHERE returned IS NOT NULL) SELECT round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, round(r2, 6) AS r2, n, round(sqrt((1 - r2) * syy / sxx / (n - 2)), 6) AS slope_se FROM a")
def _(spark, d):
    return six(social.line(merged(spark, d), "risk_mean", "returned")).withColumn("intercept", F.round("intercept", 4))


@query("X13_ols")
def _(spark, d):
    rows = social.lag_features(merged(spark, d), {"risk_mean": 1, "risk_max": 2}).select("risk_mean_lag", "risk_max_lag", F.col("warning_days").cast("double").alias("warning_days"), "returned")
    return six(social.ols(rows, ["risk_mean_lag", "risk_max_lag", "warning_days"], "returned"))


@query("A24_crisis_means", f"WITH {MON}, n AS (SELECT year_month, returned AS y, row_number() OVER (ORDER BY year_month) AS rn FROM merged), k AS (SELECT 'first' AS name, rn AS at_ FROM n WHERE year_month = '1997-06' UNION ALL SELECT 'second', rn FROM n WHERE year_month = '1996-02') SELECT name, round(avg(y) FILTER (rn - at_ BETWEEN -6 AND -1), 6) AS pre_mean, round(avg(y) FILTER (rn - at_ BETWEEN 2 AND 8), 6) AS post_mean, round(avg(y) FILTER (rn - at_ BETWEEN -1 AND 1), 6) AS peak_mean FROM k JOIN n ON rn BETWEEN at_ - 6 AND at_ + 8 GROUP BY 1")
def _(spark, d):
    crises = spark.createDataFrame([("first", "1997-06"), ("second", "1996-02")], "name string, year_month string")
    return six(social.crisis_means(merged(spark, d), crises, "returned", 2))


JOINED = f"{s.PRICES}, {s.SCORES}, bt AS (SELECT date, close, risk_score, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM prices JOIN scores USING (date))"
BT = f"""{JOINED}, st AS (SELECT 'hold' AS strategy, date, risk_score, greatest(-0.0517391, least(0.0517391, coalesce(ret, 0))) AS ret, 1.0::DOUBLE AS position FROM bt UNION ALL SELECT 'risk_off', date, risk_score, greatest(-0.0517391, least(0.0517391, coalesce(ret, 0))), CASE WHEN risk_score < 45 THEN 1.0 ELSE 0.0 END FROM bt),
ch AS (SELECT *, coalesce(lag(position) OVER w, 0) AS pp, lag(date) OVER w AS pd FROM st WINDOW w AS (PARTITION BY strategy ORDER BY date)),
eq AS (SELECT strategy, date, position, pp, pd, 1000000.0::DOUBLE * exp(sum(ln(CASE WHEN pp <> position THEN 1 - 0.00015::DOUBLE ELSE 1 END * CASE WHEN position > 0 AND pd IS NOT NULL THEN greatest(1 + ret, 0) ELSE 1 END)) OVER (PARTITION BY strategy ORDER BY date)) AS asset FROM ch),
dr AS (SELECT *, asset / max(asset) OVER (PARTITION BY strategy ORDER BY date) - 1 AS drawdown FROM eq)"""


def days(spark: SparkSession, d: str) -> DataFrame:
    return backtest.joined(s.prices(spark, d), s.daily_scores(spark, d))


def assets(spark: SparkSession, d: str) -> DataFrame:
    """Returns cut to 5.17391 per cent a day (no round number, whose products would end in rounding ties): the stand-in prices are noise."""
    calm = days(spark, d).withColumn("ret", F.greatest(F.lit(-0.0517391), F.least(F.lit(0.0517391), F.coalesce("ret", F.lit(0.0)))))
    return backtest.equity(backtest.positions(calm, {"hold": backtest.buy_and_hold(), "risk_off": backtest.risk_off(45)}))


@query("J1_price_and_score", f"WITH {JOINED} SELECT date, close, risk_score, round(ret, 6) AS ret FROM bt")
def _(spark, d):
    return days(spark, d).select("date", "close", "risk_score", F.round("ret", 6).alias("ret"))


@query("B1_B2_B8_equity", f"WITH {BT} SELECT strategy, date, position, round(asset, 2) AS asset FROM eq")
def _(spark, d):
    return assets(spark, d).select("strategy", "date", "position", F.round("asset", 2).alias("asset"))


@query("W7_drawdowns", f"WITH {BT} SELECT strategy, date, round(drawdown, 6) AS drawdown FROM dr")
def _(spark, d):
    return backtest.drawdowns(assets(spark, d)).select("strategy", "date", F.round("drawdown", 6).alias("drawdown"))


TURNS = f"""{BT}, tu AS (SELECT *, CASE WHEN pd IS NULL OR position = pp THEN 0 WHEN position > pp THEN 1 ELSE -1 END AS turn FROM dr),
sl AS (SELECT *, min(CASE WHEN turn = -1 THEN date END) OVER (PARTITION BY strategy ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS exit_date FROM tu),
rt AS (SELECT b.*, e.asset > b.asset AS won FROM sl b LEFT JOIN tu e ON e.strategy = b.strategy AND e.date = b.exit_date)"""


@query("B10_metrics", f"WITH {TURNS}, r AS (SELECT *, asset / lag(asset) OVER (PARTITION BY strategy ORDER BY date) - 1 AS daily FROM rt), m AS (SELECT strategy, max_by(asset, date) AS b, max(date) - min(date) AS n, min(drawdown) * 100 AS mdd, avg(daily) AS mu, stddev_samp(daily) AS sd, sum(abs(turn))::BIGINT AS trades, coalesce(100.0::DOUBLE * count(*) FILTER (turn = 1 AND won) / nullif(count(*) FILTER (turn = 1 AND exit_date IS NOT NULL), 0), 0) AS wins FROM r GROUP BY 1) SELECT strategy, round(b, 2) AS final_asset, round((b / 1000000.0::DOUBLE - 1) * 100, 4) AS total_return_pct, round((pow(b / 1000000.0::DOUBLE, 1 / (n / 365.25::DOUBLE)) - 1) * 100, 4) AS cagr_pct, round(mdd, 4) AS mdd_pct, round((mu * 252 - 0.03) / (sd * sqrt(252)), 4) AS sharpe, trades AS n_trades, round(wins, 4) AS win_rate_pct FROM m")
def _(spark, d):
    m = backtest.metrics(assets(spark, d))
    return m.select("strategy", F.round("final_asset", 2).alias("final_asset"), *[F.round(c, 4).alias(c) for c in ("total_return_pct", "cagr_pct", "mdd_pct", "sharpe")], "n_trades", F.round("win_rate_pct", 4).alias("win_rate_pct"))


@query("W18_round_trips", f"WITH {TURNS} SELECT strategy, date AS entry_date, exit_date, won FROM rt WHERE turn = 1")
def _(spark, d):
    return backtest.round_trips(assets(spark, d))


@query("A19_B12_yearly_returns", f"WITH {BT} SELECT strategy, year(date)::INT AS year, round((max_by(asset, date) / min_by(asset, date) - 1) * 100, 4) AS return_pct FROM eq GROUP BY 1, 2")
def _(spark, d):
    return backtest.yearly_returns(assets(spark, d)).withColumn("return_pct", F.round("return_pct", 4))


@query("B12_rebased", f"WITH {BT} SELECT strategy, date, round(asset / first_value(asset) OVER (PARTITION BY strategy ORDER BY date) * 100, 4) AS \"index\" FROM eq WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def _(spark, d):
    return backtest.rebased(assets(spark, d), "1996-01-01", "1996-12-31").withColumn("index", F.round("index", 4))


#: Rows numbered by date with half the score, and a fold over them: the state after row rn follows from the one before.
NUMBERED = f"{JOINED}, d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY date) AS rn, date, close, risk_score / 2 AS x, greatest(-0.0517391, least(0.0517391, coalesce(ret, 0))) AS ret FROM bt)"
STATES = f"""{NUMBERED}, f AS (
SELECT 0::BIGINT AS rn, 0.0::DOUBLE AS peak, 0 AS dip_left, 0 AS dip, 0 AS left60, 0 AS in60, 0 AS left30, 0 AS in30, 0 AS phase, 0.0::DOUBLE AS top, 0 AS long_left, 0 AS turn
UNION ALL SELECT d.rn,
 CASE WHEN dip_left = 1 OR (dip_left = 0 AND greatest(peak, x) > 5 AND x <= greatest(peak, x) * 0.5) THEN x ELSE greatest(peak, x) END,
 CASE WHEN dip_left > 0 THEN dip_left - 1 WHEN greatest(peak, x) > 5 AND x <= greatest(peak, x) * 0.5 THEN 29 ELSE 0 END,
 CASE WHEN dip_left > 0 OR (greatest(peak, x) > 5 AND x <= greatest(peak, x) * 0.5) THEN 1 ELSE 0 END,
 CASE WHEN left60 > 0 THEN left60 - 1 WHEN x >= 18.52 THEN 59 ELSE 0 END, CASE WHEN left60 > 0 OR x >= 18.52 THEN 1 ELSE 0 END,
 CASE WHEN left30 > 0 THEN left30 - 1 WHEN x >= 18.52 THEN 29 ELSE 0 END, CASE WHEN left30 > 0 OR x >= 18.52 THEN 1 ELSE 0 END,
 CASE phase WHEN 0 THEN CASE WHEN x >= 18.52 THEN 1 ELSE 0 END WHEN 1 THEN CASE WHEN x <= greatest(top, x) * 0.5 THEN 2 ELSE 1 END ELSE CASE WHEN long_left <= 1 THEN 0 ELSE 2 END END,
 CASE phase WHEN 0 THEN x WHEN 1 THEN greatest(top, x) ELSE top END, CASE WHEN phase = 1 THEN 60 ELSE long_left - 1 END,
 CASE phase WHEN 0 THEN CASE WHEN x >= 18.52 THEN -2 ELSE 0 END WHEN 1 THEN -2 ELSE 2 END
FROM f JOIN d ON d.rn = f.rn + 1), g AS (SELECT date, x, f.* FROM f JOIN d USING (rn))"""
POSITIONS = [
    ("buy_and_hold", "1", "1"), ("risk_off_18", "x < 18.52", "1"), ("risk_off_10", "x < 10", "1"), ("buy_the_dip", "dip", "1"), ("dip_2x", "dip", "1 + dip"), ("contrarian_2x_60", "in60", "1 + in60"), ("hold_with_dip", "1", "1 + dip"),
    ("inverse_1x_30", "in30", "1 - 2 * in30"), ("inverse_2x_30", "in30", "1 - 3 * in30"), ("inverse_2x_60", "in60", "1 - 3 * in60"), ("inverse_then_leverage", "turn <> 0", "CASE WHEN turn = 0 THEN 1 ELSE turn END"),
]


@query("B3_B6_positions", f"WITH RECURSIVE {STATES} " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, date, ({p})::INT::DOUBLE AS position, ({q})::DOUBLE AS leverage FROM g" for n, p, q in POSITIONS))
def _(spark, d):
    scaled = days(spark, d).withColumn("risk_score", F.col("risk_score") / 2)
    return backtest.positions(scaled, backtest.STRATEGIES).select("strategy", "date", "position", "leverage")


DCA = f"""{NUMBERED}, plans AS (SELECT * FROM (VALUES ('dca_4', 4, 0.05::DOUBLE, 18.52::DOUBLE, 60), ('dca_5', 5, 0.03::DOUBLE, 10.0::DOUBLE, 90)) AS v(strategy, n, step, limit_, hold)), f AS (
SELECT strategy, 0::BIGINT AS rn, 0 AS parts, 0.0::DOUBLE AS last_, 0 AS left_, 1000000.0::DOUBLE AS cash, 0.0::DOUBLE AS part, 0.0::DOUBLE AS invested, '' AS signal, 0 AS inside FROM plans
UNION ALL SELECT strategy, rn, CASE signal WHEN 'entry' THEN 1 WHEN 'add' THEN parts + 1 WHEN 'exit' THEN 0 ELSE parts END, CASE WHEN signal IN ('entry', 'add') THEN close ELSE last_ END, CASE signal WHEN 'entry' THEN hold ELSE left_ - 1 END,
 CASE signal WHEN 'exit' THEN cash + invested * (1 - 0.00015::DOUBLE) ELSE cash - spent * (1 + 0.00015::DOUBLE) END, CASE signal WHEN 'entry' THEN cash / n ELSE part END,
 CASE signal WHEN 'exit' THEN 0 ELSE (invested + spent) * CASE WHEN rn > 1 THEN 1 + ret * 2 ELSE 1 END END, signal, inside
FROM (SELECT *, CASE signal WHEN 'entry' THEN cash / n WHEN 'add' THEN greatest(0, least(part, cash / (1 + 0.00015::DOUBLE))) ELSE 0 END AS spent FROM (
 SELECT f.* EXCLUDE (rn, signal, inside), d.rn, d.close, d.ret, plans.n, plans.hold, CASE WHEN parts > 0 OR x >= limit_ THEN 1 ELSE 0 END AS inside,
  CASE WHEN parts = 0 THEN CASE WHEN x >= limit_ THEN 'entry' ELSE '' END WHEN left_ <= 1 THEN 'exit' WHEN parts < n AND close <= last_ * (1 - step) THEN 'add' ELSE '' END AS signal
 FROM f JOIN d ON d.rn = f.rn + 1 JOIN plans USING (strategy))))"""


@query("B7_B9_dca", f"WITH RECURSIVE {DCA} SELECT strategy, date, signal, inside::DOUBLE AS position, round(cash, 2) AS cash, round(invested, 2) AS invested, round(cash + invested, 2) AS asset FROM f JOIN d USING (rn)")
def _(spark, d):
    calm = days(spark, d).withColumn("ret", F.greatest(F.lit(-0.0517391), F.least(F.lit(0.0517391), F.coalesce("ret", F.lit(0.0))))).withColumn("risk_score", F.col("risk_score") / 2)
    return backtest.dca(calm).select("strategy", "date", "signal", "position", *[F.round(c, 2).alias(c) for c in ("cash", "invested", "asset")])


RATES = f"{s.DAILY}, rates AS (SELECT date, property_id, round(100 * cnt::DOUBLE / n_articles, 2) AS rate FROM daily JOIN per_day USING (date)), g AS (SELECT * FROM (SELECT DISTINCT date FROM rates), (SELECT DISTINCT property_id FROM rates)), dense AS (SELECT g.date, g.property_id, coalesce(rate, 0) AS rate FROM g LEFT JOIN rates USING (date, property_id))"


def rates(spark: SparkSession, d: str) -> DataFrame:
    return evaluator.daily_rates(base.daily(spark, d), windows.daily_articles(s.tagged(spark, d)))


@query("A6_daily_rates", f"WITH {RATES} SELECT * FROM rates")
def _(spark, d):
    return rates(spark, d)


@query("A7_tag_density", f"WITH {s.TAGGED}, x AS (SELECT date, coalesce(len(properties), 0) AS n FROM tagged) SELECT date, round(avg(CASE WHEN n >= 1 THEN 100.0::DOUBLE ELSE 0 END), 2) AS pct_1plus, round(avg(CASE WHEN n >= 3 THEN 100.0::DOUBLE ELSE 0 END), 2) AS pct_3plus FROM x GROUP BY 1")
def _(spark, d):
    return evaluator.tag_density(s.tagged(spark, d), (1, 3))


@query("W10_dynamics", f"WITH {RATES}, r AS (SELECT *, rate - lag(rate) OVER (PARTITION BY property_id ORDER BY date) AS change, row_number() OVER (PARTITION BY property_id ORDER BY date DESC) AS back FROM dense), a AS (SELECT property_id, max(rate) AS top, avg(rate) AS mean, max(rate) FILTER (back = 1) AS last_, max(rate) FILTER (back = 3) AS third, avg(change) FILTER (back <= 3) AS velocity, max(change) FILTER (back = 1) AS jump FROM r GROUP BY 1) SELECT property_id, last_ AS last, round(mean, 6) AS mean, CASE WHEN third IS NULL THEN 'unknown' WHEN last_ > third * 1.15 THEN 'rising' WHEN last_ < third * 0.85 THEN 'falling' ELSE 'stable' END AS trend, round(velocity, 3) AS velocity, coalesce(abs(jump) / nullif(mean, 0) > 0.3, false) AS spike FROM a WHERE top >= 0.5")
def _(spark, d):
    return evaluator.dynamics(rates(spark, d)).withColumn("mean", F.round("mean", 6))


@query("J15_T5_pair_correlations", f"WITH {RATES}, p AS (SELECT a.property_id AS a, b.property_id AS b, CASE WHEN stddev_pop(a.rate) > 0 AND stddev_pop(b.rate) > 0 THEN round(corr(a.rate, b.rate), 6) END AS r FROM dense a JOIN dense b ON a.date = b.date AND a.property_id < b.property_id GROUP BY 1, 2) SELECT * FROM p WHERE r IS NOT NULL ORDER BY abs(r) DESC, a, b LIMIT 30")
def _(spark, d):
    return evaluator.pair_correlations(rates(spark, d))


@query("W8_W9_streak", f"WITH {s.SCORES}, x AS (SELECT *, round(risk_score - lag(risk_score) OVER (ORDER BY date), 6) AS change, max(CASE WHEN risk_score < 20 THEN date END) OVER () AS calm FROM scores) SELECT max(date) AS date, max_by(risk_score, date) AS risk_score, max_by(change, date) AS change, sum(CASE WHEN calm IS NULL OR date > calm THEN 1 ELSE 0 END)::BIGINT AS streak_days FROM x")
def _(spark, d):
    return evaluator.streak(s.daily_scores(spark, d), 20)


@query("P12_W14_focus", f"WITH {s.SCORES}, x AS (SELECT *, min(CASE WHEN risk_score >= 90 THEN date END) OVER () AS f, row_number() OVER (ORDER BY date DESC) AS n FROM scores), y AS (SELECT date, risk_score FROM x WHERE CASE WHEN f IS NOT NULL THEN date >= f - 7 ELSE n <= 30 END), p AS (SELECT date AS peak FROM y ORDER BY risk_score DESC, date LIMIT 1) SELECT date, risk_score, CASE WHEN date <= peak THEN 'until_peak' ELSE 'after_peak' END AS phase FROM y, p")
def _(spark, d):
    return evaluator.focus(s.daily_scores(spark, d), 90)


@query("T1_T8_last_days", f"WITH {s.SCORES} SELECT * FROM scores ORDER BY date DESC LIMIT 30")
def _(spark, d):
    return evaluator.last_days(s.daily_scores(spark, d), 30)


@query("T7_worst_falls", f"WITH {s.RETURNS} SELECT date, round(ret, 8) AS ret FROM returns WHERE ret IS NOT NULL ORDER BY returns.ret, date LIMIT 15")
def _(spark, d):
    from shockwire.operators.events import returns

    return returns(s.prices(spark, d)).where("ret is not null").orderBy("ret", "date").limit(15).select("date", F.round("ret", 8).alias("ret"))


@query("A23_pivot", f"WITH {base.CONT} SELECT property_id, round(max(be_freq_mean) FILTER (window_days = 7), 8) AS w7, round(max(be_freq_mean) FILTER (window_days = 14), 8) AS w14, round(max(be_freq_mean) FILTER (window_days = 30), 8) AS w30 FROM cont GROUP BY 1")
def _(spark, d):
    from shockwire.operators.stats import contingency

    wide = contingency(base.dense(spark, d)).groupBy("property_id").pivot("window_days", list(s.WINDOWS)).agg(F.max("be_freq_mean"))
    return rounded(wide.select("property_id", *[F.col(str(w)).alias(f"w{w}") for w in s.WINDOWS]))


@query("S22_I9_active", f"WITH {base.SCORE}, c AS (SELECT ref_id, round(freq / ctrl_freq_mean, 4) AS ratio FROM pf JOIN params USING (property_id)) SELECT ref_id, sum(CASE WHEN ratio > 1.1 THEN 1 ELSE 0 END)::INT AS n_active FROM c GROUP BY 1")
def _(spark, d):
    found = scoring.contributions(windows.property_windows(base.daily(spark, d), base.refs(spark, d), base.params(spark, d), max(s.WINDOWS)), base.params(spark, d))
    return evaluator.active(scoring.details(found), 1.1).select("ref_id", "n_active")


@query("P13_wide_details", f"WITH {base.SCORE}, c AS (SELECT ref_id, property_id, round(freq / ctrl_freq_mean, 4) AS ratio, round(weight * greatest(freq / ctrl_freq_mean - 1, 0), 4) AS contribution FROM pf JOIN params USING (property_id)) SELECT r.ref_id, coalesce(max(ratio) FILTER (property_id = 'RF'), 0) AS rf_ratio, coalesce(max(contribution) FILTER (property_id = 'RF'), 0) AS rf_contrib, coalesce(max(ratio) FILTER (property_id = 'D3'), 0) AS d3_ratio FROM c r GROUP BY 1")
def _(spark, d):
    found = scoring.contributions(windows.property_windows(base.daily(spark, d), base.refs(spark, d), base.params(spark, d), max(s.WINDOWS)), base.params(spark, d))
    text = scoring.details(found).select("ref_id", F.to_json("details").alias("json")).withColumn("m", F.from_json("json", "map<string,struct<ratio:double,contribution:double>>"))
    get = lambda p, f: F.coalesce(F.try_element_at("m", F.lit(p))[f], F.lit(0.0))
    return text.select("ref_id", get("RF", "ratio").alias("rf_ratio"), get("RF", "contribution").alias("rf_contrib"), get("D3", "ratio").alias("d3_ratio"))


WHAT = f"{s.DAILY}, pw AS (SELECT property_id, 1.0::DOUBLE / (1 + ascii(substr(property_id, 2, 1)) % 5) AS weight FROM (SELECT DISTINCT property_id FROM daily)), ra AS (SELECT date, property_id, cnt / 6.0::DOUBLE AS ratio FROM daily), one AS (SELECT property_id, ratio, weight, weight * greatest(ratio - 1, 0) AS part FROM ra JOIN pw USING (property_id) WHERE date = DATE '1995-03-10')"


def what(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    daily = base.daily(spark, d)
    params = daily.select("property_id").distinct().withColumn("weight", 1.0 / (1 + F.ascii(F.substring("property_id", 2, 1)) % 5))
    return daily.select("date", "property_id", (F.col("cnt") / 6.0).alias("ratio")), params


def one_day(spark: SparkSession, d: str, day: str = "1995-03-10") -> tuple[DataFrame, DataFrame]:
    ratios, params = what(spark, d)
    return ratios.where(F.col("date") == F.lit(day).cast("date")).drop("date"), params


@query("I1_score", f"WITH {WHAT} SELECT date, round(least(100, sum(weight * greatest(ratio - 1, 0)) * 100 / 30), 6) AS score FROM ra JOIN pw USING (property_id) GROUP BY 1")
def _(spark, d):
    return whatif.score(*what(spark, d), 30.0, "date")


@query("I2_scaled", f"WITH {WHAT} SELECT p::INT AS percent, round(least(100, sum(weight * greatest(ratio * p / 100 - 1, 0)) * 100 / 30), 6) AS score FROM one, range(10, 301, 10) AS r(p) GROUP BY 1")
def _(spark, d):
    return whatif.scaled(*one_day(spark, d), 30.0)


@query("I3_waterfall", f"WITH {WHAT}, a AS (SELECT property_id, weight * greatest(ratio - 1, 0) AS a FROM ra JOIN pw USING (property_id) WHERE date = DATE '1995-03-09') SELECT property_id, round(coalesce(part, 0) - coalesce(a, 0), 6) AS change FROM one FULL JOIN a USING (property_id)")
def _(spark, d):
    now, params = one_day(spark, d)
    return whatif.waterfall(one_day(spark, d, "1995-03-09")[0], now, params)


@query("I4_tornado", f"WITH {WHAT}, t AS (SELECT *, sum(part) OVER () AS total FROM one) SELECT property_id, round(least(100, (total - part + weight * greatest(ratio * 0.8 - 1, 0)) * 100 / 30) - least(100, total * 100 / 30), 6) AS down, round(least(100, (total - part + weight * greatest(ratio * 1.2 - 1, 0)) * 100 / 30) - least(100, total * 100 / 30), 6) AS up FROM t")
def _(spark, d):
    return whatif.tornado(*one_day(spark, d), 30.0)


@query("I5_response", f"WITH {WHAT} SELECT k::INT AS step, round(least(100, sum(weight * greatest(CASE WHEN property_id = 'RF' THEN k * 3.0::DOUBLE / 99 ELSE ratio END - 1, 0)) * 100 / 30), 6) AS score FROM one, range(0, 100) AS r(k) GROUP BY 1")
def _(spark, d):
    return whatif.response(*one_day(spark, d), 30.0, "RF")


@query("I6_ratio_needed", f"WITH {WHAT}, t AS (SELECT *, 18.52 * 30 / 100 - (sum(part) OVER () - part) AS need FROM one) SELECT property_id, CASE WHEN need >= 0 AND weight > 0 THEN round(need / weight + 1, 6) END AS ratio_needed FROM t")
def _(spark, d):
    return whatif.ratio_needed(*one_day(spark, d), 30.0, 18.52)


@query("I7_T9_least_cover", f"WITH {WHAT}, t AS (SELECT property_id, part, sum(part) OVER () - 0.1852::DOUBLE * 2 AS excess, sum(part) OVER (ORDER BY part DESC, property_id) - part AS before, row_number() OVER (ORDER BY part DESC, property_id)::INT AS rank FROM one) SELECT property_id, round(part, 6) AS contribution, rank FROM t WHERE excess > 0 AND before < excess - 1e-12 AND part > 0")
def _(spark, d):
    return whatif.least_cover(*one_day(spark, d), 2.0, 18.52)


@query("I8_compare_dates", f"WITH {WHAT} SELECT property_id, max(ratio) FILTER (date = DATE '1995-03-09') AS d1, max(ratio) FILTER (date = DATE '1995-03-10') AS d2 FROM ra WHERE date IN (DATE '1995-03-09', DATE '1995-03-10') GROUP BY 1")
def _(spark, d):
    pair = ["1995-03-09", "1995-03-10"]
    wide = whatif.compare_dates(what(spark, d)[0].withColumn("date_text", F.col("date").cast("string")), pair)
    return wide.select("property_id", F.col(pair[0]).alias("d1"), F.col(pair[1]).alias("d2"))


@query("I10_movers", f"WITH {WHAT}, c AS (SELECT date, property_id, round(ratio - lag(ratio) OVER (PARTITION BY property_id ORDER BY date), 6) AS change FROM ra) SELECT date, property_id, change, CASE WHEN change > 0 THEN 'rising' ELSE 'falling' END AS direction FROM c WHERE abs(change) > 0.01")
def _(spark, d):
    return whatif.movers(what(spark, d)[0])


@query("Q2_Q7_prices", f"WITH {s.PRICES}, g AS (SELECT *, date - lag(date) OVER (ORDER BY date) AS gap FROM prices), m AS (SELECT min(date) AS lo, max(date) AS hi, count(*) AS n, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) AS gaps FROM g) SELECT 'prices' AS stage, 'WARNING' AS severity, 'starts_late' AS \"check\", 'the series starts more than 30 days late' AS message, (lo - DATE '1990-01-01')::DOUBLE AS value FROM m WHERE lo - DATE '1990-01-01' > 30 UNION ALL SELECT 'prices', 'WARNING', 'ends_early', 'the series ends more than 7 days early', (DATE '2000-01-01' - hi)::DOUBLE FROM m WHERE DATE '2000-01-01' - hi > 7 UNION ALL SELECT 'prices', 'WARNING', 'trading_gaps', 'gaps of more than 5 days', gaps::DOUBLE FROM m WHERE gaps > 0 UNION ALL SELECT 'prices', 'CRITICAL', 'few_rows', 'fewer than 200 days', n::DOUBLE FROM m WHERE n < 200")
def _(spark, d):
    return checks.check_prices(s.prices(spark, d), "1990-01-01", "2000-01-01")


@query("Q8_Q9_shocks", f"WITH {s.SHOCKS}, m AS (SELECT (SELECT count(*) FROM shocks) AS n, (SELECT count(*) FROM shocks WHERE ret <= -0.2) AS deep, (SELECT count(*) FROM prices) AS days) SELECT 'shocks' AS stage, CASE WHEN n = 0 OR n > 0.3 * days THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'count' AS \"check\", 'none, too many or very few shock days' AS message, n::DOUBLE AS value FROM m WHERE n = 0 OR n > 0.3 * days OR n < 0.005 * days UNION ALL SELECT 'shocks', 'WARNING', 'deep_falls', 'falls of 20 per cent or more', deep::DOUBLE FROM m WHERE deep > 0")
def _(spark, d):
    from shockwire.operators.events import shock_days

    p = s.prices(spark, d)
    return checks.check_shocks(shock_days(p, s.SHOCK), p)


@query("Q10_Q13_events", f"WITH {s.CONTROLS}, m AS (SELECT (SELECT count(*) FROM events_) AS n, (SELECT max(duration_days) FROM events_) AS l, (SELECT count(*) FROM controls) AS c) SELECT 'events' AS stage, CASE WHEN c = 0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'controls' AS \"check\", 'no or too few controls' AS message, c::DOUBLE AS value FROM m WHERE c = 0 OR c < 3 * n UNION ALL SELECT 'events', CASE WHEN n = 0 THEN 'CRITICAL' ELSE 'WARNING' END, 'count', 'no or few events', n::DOUBLE FROM m WHERE n < 3 UNION ALL SELECT 'events', 'WARNING', 'duration', 'an event of more than a year', l::DOUBLE FROM m WHERE l > 365")
def _(spark, d):
    from shockwire.operators.events import control_dates

    e = base.event_table(spark, d)
    return checks.check_events(e, control_dates(s.prices(spark, d), e, s.EXCLUSION))


@query("Q14_Q15_status_board", "WITH d AS (SELECT unnest(range(DATE '1998-01-01', DATE '1998-12-31' + 1, INTERVAL 1 DAY))::DATE AS date), r AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem), t AS (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1), o AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderstatus = 'P') SELECT date, CASE WHEN date IN (SELECT date FROM o) THEN 'done' WHEN date IN (SELECT date FROM t) THEN 'needs_score' WHEN date IN (SELECT date FROM r) THEN 'needs_tag' ELSE 'missing' END AS status FROM d")
def _(spark, d):
    items, orders = s.read(spark, d, "lineitem").withColumn("date", F.to_date("l_shipdate")), s.read(spark, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    return checks.status_board(items, items.where("l_returnflag = 'N' and l_linenumber = 1"), orders.where("o_orderstatus = 'P'"), "1998-01-01", "1998-12-31")


@query("S8_S10_date_range", "SELECT min(l_shipdate::DATE) AS first_date, max(l_shipdate::DATE) AS last_date, count(DISTINCT l_shipdate::DATE) AS n_dates FROM lineitem")
def _(spark, d):
    return files.date_range(s.tagged(spark, d))


@query("S8_S9_footer_range", "SELECT min(l_shipdate::DATE) AS first_date, max(l_shipdate::DATE) AS last_date FROM lineitem")
def _(spark, d):
    return footers.date_range(spark, f"{d}/lineitem.parquet", "l_shipdate")


@query("S10_tail_dates")
def _(spark, d):
    return footers.tail_dates(spark, f"{d}/lineitem.parquet", "l_shipdate")


def span_of(spark: SparkSession, d: str) -> Row:
    return footers.date_range(spark, f"{d}/orders.parquet", "o_orderdate").first()


@query("S20_months", "WITH b AS (SELECT min(o_orderdate::DATE) AS lo, max(o_orderdate::DATE) AS hi FROM orders) SELECT strftime(m, '%Y-%m') AS year_month, greatest(m::DATE, lo) AS first_day, least(last_day(m), hi) AS last_day FROM (SELECT unnest(range(date_trunc('month', lo)::DATE, hi + 1, INTERVAL 1 MONTH)) AS m, lo, hi FROM b)")
def _(spark, d):
    """The months that the orders span."""
    span = span_of(spark, d)
    return files.months(spark, span["first_date"], span["last_date"])


@query("S21_days", "SELECT unnest(range(lo, hi + 1, INTERVAL 1 DAY))::DATE AS date FROM (SELECT min(o_orderdate::DATE) AS lo, max(o_orderdate::DATE) AS hi FROM orders)")
def _(spark, d):
    """The days that the orders span."""
    span = span_of(spark, d)
    return files.days(spark, span["first_date"], span["last_date"])


@query("S6_date_scan", f"WITH {s.TAGGED} SELECT article_id, date FROM tagged WHERE date BETWEEN DATE '1995-01-01' AND DATE '1995-01-31'")
def _(spark, d):
    return s.tagged(spark, d).select("article_id", "date").where("date between date'1995-01-01' and date'1995-01-31'")


@query("J11_untagged", f"WITH {s.TAGGED} SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderdate::DATE NOT IN (SELECT date FROM tagged WHERE len(properties) > 0)")
def _(spark, d):
    done = s.tagged(spark, d).where(F.size("properties") > 0).select("date").distinct()
    return s.prices(spark, d).select("date").join(done, "date", "left_anti")


@query("K5_upsert", f"WITH {s.SCORES}, n AS (SELECT date, 50.0::DOUBLE AS risk_score FROM scores WHERE day(date) = 1) SELECT * FROM scores WHERE date NOT IN (SELECT date FROM n) UNION ALL SELECT * FROM n")
def _(spark, d):
    old = s.daily_scores(spark, d)
    return sinks.upsert(old, old.where("day(date) = 1").withColumn("risk_score", F.lit(50.0)), "date")


@query("K6_insert_missing", f"WITH {s.SCORES} SELECT date, risk_score FROM scores WHERE year(date) < 1995 UNION ALL SELECT date, risk_score + 1 FROM scores WHERE year(date) >= 1995")
def _(spark, d):
    every = s.daily_scores(spark, d)
    late = every.withColumn("risk_score", F.col("risk_score") + 1)
    return sinks.insert_missing(every.where("year(date) < 1995"), late.unionByName(late.withColumn("risk_score", F.lit(-1.0))), "date")


@query("K7_json_rows", f"WITH {s.EVENTS} SELECT '{{\"event_id\":' || event_id || ',\"shock_count\":' || shock_count || '}}' AS json FROM events_")
def _(spark, d):
    return sinks.to_json_rows(base.event_table(spark, d).select("event_id", "shock_count"))
