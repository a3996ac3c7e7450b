"""Position strategies driven by the score, and what they would have earned.

A strategy is a scan over a few thousand ordered days; scans run side by side, one group a strategy, and the whole of a
series is one group by nature.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockwire.config import DEFAULT
from shockwire.operators.scan import Running, scan

Fold = Callable[[np.ndarray], tuple[list[float], list[float]]]


def joined(prices: DataFrame, scores: DataFrame) -> DataFrame:
    """Date, close, risk_score and the day's return (null on the first day)."""
    both = prices.join(scores, "date").withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0)))
    before = F.lag("close").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    return both.withColumn("ret", F.when(before != 0, F.col("close") / before - 1))


def buy_and_hold() -> Fold:
    """B1."""
    return lambda s: ([1.0] * len(s), [1.0] * len(s))


def risk_off(threshold: float) -> Fold:
    """B2: in the market while the score stays below the threshold."""
    return lambda s: ([1.0 if x < threshold else 0.0 for x in s], [1.0] * len(s))


def buy_the_dip(least_peak: float = 5.0, fall: float = 0.5, hold: int = 30, leverage: float = 1.0) -> Fold:
    """Enter when the score has fallen by `fall` from a peak above least_peak, for `hold` rows. Entry and the last row
    held start a new peak at their own score."""

    def fold(s: np.ndarray) -> tuple[list[float], list[float]]:
        peak, left, held = 0.0, 0, []
        for x in s:
            peak = max(peak, x)
            enters = not left and peak > least_peak and x <= peak * (1 - fall)
            held.append(bool(left) or enters)
            left = left - 1 if left else hold - 1 if enters else 0
            if enters or (held[-1] and not left):
                peak = x
        return [float(h) for h in held], [leverage if h else 1.0 for h in held]

    return fold


def contrarian(threshold: float, hold: int, leverage: float) -> Fold:
    """Enter at a score of the threshold or more, for `hold` rows, with a leverage (negative: short), which is 1 outside."""

    def fold(s: np.ndarray) -> tuple[list[float], list[float]]:
        left, held = 0, []
        for x in s:
            if left == 0 and x >= threshold:
                left = hold
            held.append(left > 0)
            left = max(0, left - 1)
        return [float(h) for h in held], [leverage if h else 1.0 for h in held]

    return fold


def inverse_then_leverage(threshold: float, hold: int = 60, leverage: float = 2.0, fall: float = 0.5) -> Fold:
    """Short until the score has fallen by `fall` from its peak since entry, long for the `hold` rows after that one."""

    def fold(s: np.ndarray) -> tuple[list[float], list[float]]:
        phase, peak, left, phases = "out", 0.0, 0, []
        for x in s:
            if phase == "out" and x >= threshold:
                phase, peak = "short", x
                phases.append(phase)
                continue
            phases.append(phase)
            if phase == "short":
                peak = max(peak, x)
                if peak > 0 and x <= peak * (1 - fall):
                    phase, left = "long", hold
            elif phase == "long":
                left -= 1
                phase = "long" if left > 0 else "out"
        return [float(q != "out") for q in phases], [{"out": 1.0, "short": -leverage, "long": leverage}[q] for q in phases]

    return fold


def hold_with_dip(least_peak: float = 5.0, fall: float = 0.5, hold: int = 30, leverage: float = 2.0) -> Fold:
    """Always in the market, levered during what buy_the_dip would hold."""
    dip = buy_the_dip(least_peak, fall, hold, leverage)
    return lambda s: ([1.0] * len(s), dip(s)[1])


#: The strategies compared, by name.
STRATEGIES: dict[str, Fold] = {
    "buy_and_hold": buy_and_hold(), "risk_off_18": risk_off(18.52), "risk_off_10": risk_off(10.0), "buy_the_dip": buy_the_dip(), "dip_2x": buy_the_dip(leverage=2.0),
    "contrarian_2x_60": contrarian(18.52, 60, 2.0), "hold_with_dip": hold_with_dip(), "inverse_1x_30": contrarian(18.52, 30, -1.0), "inverse_2x_30": contrarian(18.52, 30, -2.0), "inverse_2x_60": contrarian(18.52, 60, -2.0),
    "inverse_then_leverage": inverse_then_leverage(18.52),
}


@dataclass(frozen=True)
class Tranches:
    """Buying in n parts: at the threshold, then at each further fall of `step` in the close; all is sold after `hold` rows."""

    n: int = 4
    step: float = 0.05
    threshold: float = 18.52
    hold: int = 60
    leverage: float = 2.0

    def signals(self, s: np.ndarray, close: np.ndarray) -> tuple[list[str], list[float]]:
        """entry, add, exit or nothing for each row, and the position. A row that is the last one exits, whatever its fall."""
        parts, last, left, out, inside = 0, 0.0, 0, [], []
        for x, c in zip(s, close, strict=True):
            signal = ""
            inside.append(1.0 if parts or x >= self.threshold else 0.0)
            if parts:
                left -= 1
                if left <= 0:
                    signal, parts = "exit", 0
                elif parts < self.n and c <= last * (1 - self.step):
                    signal, parts, last = "add", parts + 1, c
            elif inside[-1]:
                signal, parts, last, left = "entry", 1, c, self.hold
            out.append(signal)
        return out, inside


TRANCHES = {"dca_4": Tranches(), "dca_5": Tranches(n=5, step=0.03, threshold=10.0, hold=90)}


def positions(days: DataFrame, strategies: dict[str, Fold] = STRATEGIES) -> DataFrame:
    """(strategy, date, close, ret, position, leverage), one group a strategy."""
    named = days.select("date", "close", "risk_score", "ret").withColumn("strategy", F.explode(F.array(*map(F.lit, strategies))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        pdf["position"], pdf["leverage"] = strategies[pdf["strategy"].iloc[0]](pdf["risk_score"].to_numpy(float))
        return pdf[["strategy", "date", "close", "ret", "position", "leverage"]]

    return named.groupBy("strategy").applyInPandas(run, "strategy string, date date, close double, ret double, position double, leverage double")


def equity(placed: DataFrame, seed: float = 1_000_000.0, commission: float = DEFAULT.commission) -> DataFrame:
    """Adds asset: the day's return times leverage while in the market (0 at least), less a commission on each change.

    The first day earns nothing. A factor of 0 ends a path for good; before that the product is exp(sum(ln))."""
    w = Window.partitionBy("strategy").orderBy("date")
    changed = (F.coalesce(F.lag("position").over(w), F.lit(0.0)) != F.col("position")) | ((F.col("position") > 0) & (F.lag("leverage").over(w) != F.col("leverage")))
    grown = F.when((F.col("position") > 0) & F.lag("date").over(w).isNotNull(), F.greatest(1 + F.coalesce("ret", F.lit(0.0)) * F.col("leverage"), F.lit(0.0))).otherwise(1.0)
    factor = F.when(changed, 1 - commission).otherwise(1.0) * grown
    rows = placed.withColumn("factor", factor)
    dead = F.max(F.when(F.col("factor") <= 0, 1).otherwise(0)).over(w)
    growth = F.exp(F.sum(F.when(F.col("factor") > 0, F.ln(F.when(F.col("factor") > 0, F.col("factor")))).otherwise(0.0)).over(w))
    return rows.withColumn("asset", F.when(dead == 1, 0.0).otherwise(seed * growth)).drop("factor")


def dca(days: DataFrame, plans: dict[str, Tranches] = TRANCHES, seed: float = 1_000_000.0, commission: float = DEFAULT.commission) -> DataFrame:
    """(strategy, date, signal, position, leverage, cash, invested, asset) of buying in parts, one group a plan. A
    part is 1/n of the cash at entry, the commission comes on top of it, and what is invested earns the day's levered
    return after the day's signal, but for the first day."""
    named = days.select("date", "close", "risk_score", "ret").withColumn("strategy", F.explode(F.array(*map(F.lit, plans))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        plan = plans[pdf["strategy"].iloc[0]]
        signals, inside = plan.signals(pdf["risk_score"].to_numpy(float), pdf["close"].to_numpy(float))
        cash, invested, part, rows = seed, 0.0, 0.0, []
        for k, (signal, ret) in enumerate(zip(signals, pdf["ret"].fillna(0.0), strict=True)):
            if signal == "exit":
                cash, invested = cash + invested * (1 - commission), 0.0
            elif signal:
                part = cash / plan.n if signal == "entry" else part
                spent = part if signal == "entry" else max(0.0, min(part, cash / (1 + commission)))
                cash, invested = cash - spent * (1 + commission), invested + spent
            if k and invested > 0:
                invested *= 1 + ret * plan.leverage
            rows.append((signal, inside[k], plan.leverage if inside[k] else 1.0, cash, invested, cash + invested))
        pdf[["signal", "position", "leverage", "cash", "invested", "asset"]] = rows
        return pdf[["strategy", "date", "signal", "position", "leverage", "cash", "invested", "asset"]]

    return named.groupBy("strategy").applyInPandas(run, "strategy string, date date, signal string, position double, leverage double, cash double, invested double, asset double")


def drawdowns(assets: DataFrame, ranges: int | None = 1) -> DataFrame:
    """Adds the running maximum and the fall below it. A strategy's days are one window unless `ranges` cuts a long series
    into several (None: by its rows)."""
    top = F.col("peak")
    rows = scan(assets.drop("peak", "drawdown"), "date", {"peak": Running("max", "asset")}, ("strategy",), ranges)
    return rows.withColumn("drawdown", F.when(top > 0, F.col("asset") / F.when(top > 0, top) - 1).otherwise(0.0))


def turns(placed: DataFrame) -> DataFrame:
    """Adds turn: 1 where a position is taken after a day without, -1 where it is left; the first day is no turn."""
    before = F.lag("position").over(Window.partitionBy("strategy").orderBy("date"))
    return placed.withColumn("turn", F.when(before.isNull() | (F.col("position") == before), 0).when(F.col("position") > before, 1).otherwise(-1))


def metrics(assets: DataFrame, seed: float = 1_000_000.0, risk_free: float = 0.03) -> DataFrame:
    """By strategy: final asset, total and yearly return on the seed, deepest fall, Sharpe ratio, trades (buys and
    sells), and the share of buys that the next sell ends with a larger asset, of those it ends."""
    w = Window.partitionBy("strategy").orderBy("date")
    rows = turns(drawdowns(assets)).withColumn("daily", F.try_divide(F.col("asset"), F.lag("asset").over(w)) - 1)
    sold = F.first(F.when(F.col("turn") == -1, F.col("asset")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("won", F.when(F.col("turn") == 1, F.when(sold > F.col("asset"), 100.0).when(sold.isNotNull(), 0.0)))
    out = rows.groupBy("strategy").agg(F.max_by("asset", "date").alias("final_asset"), F.datediff(F.max("date"), F.min("date")).alias("days"), (F.min("drawdown") * 100).alias("mdd_pct"), F.avg("daily").alias("m"), F.stddev_samp("daily").alias("sd"), F.sum(F.abs("turn")).alias("n_trades"), F.coalesce(F.avg("won"), F.lit(0.0)).alias("win_rate_pct"))
    years = F.col("days") / 365.25
    growth = F.col("final_asset") / seed
    return out.select(
        "strategy", "final_asset", ((growth - 1) * 100).alias("total_return_pct"), F.when(years <= 0, 0.0).when(growth > 0, (F.pow(growth, 1 / F.when(years > 0, years)) - 1) * 100).otherwise(-100.0).alias("cagr_pct"), "mdd_pct",
        F.when(F.col("sd") > 0, (F.col("m") * 252 - risk_free) / (F.when(F.col("sd") > 0, F.col("sd")) * F.sqrt(F.lit(252.0)))).otherwise(0.0).alias("sharpe"), "n_trades", "win_rate_pct",
    )


def round_trips(assets: DataFrame) -> DataFrame:
    """Each buy's date with the next sell's, and whether the asset grew between them (both null while open)."""
    w = Window.partitionBy("strategy").orderBy("date")
    found = turns(assets).where("turn != 0").withColumns({"exit_date": F.lead("date").over(w), "sold": F.lead("asset").over(w)})
    return found.where("turn = 1").select("strategy", F.col("date").alias("entry_date"), "exit_date", (F.col("sold") > F.col("asset")).alias("won"))


def yearly_returns(assets: DataFrame) -> DataFrame:
    """By strategy and year: last asset over the first, in per cent."""
    by = assets.groupBy("strategy", F.year("date").alias("year")).agg(F.min_by("asset", "date").alias("a"), F.max_by("asset", "date").alias("b"))
    return by.select("strategy", "year", F.when(F.col("a") > 0, (F.col("b") / F.when(F.col("a") > 0, F.col("a")) - 1) * 100).alias("return_pct"))


def rebased(assets: DataFrame, start: str, end: str) -> DataFrame:
    """Assets of a span, 100 on its first day."""
    inside = assets.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = F.first_value("asset").over(Window.partitionBy("strategy").orderBy("date"))
    return inside.select("strategy", "date", F.when(first > 0, F.col("asset") / F.when(first > 0, first) * 100).alias("index"))
