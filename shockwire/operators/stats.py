"""Tests of properties between events and controls, and correlations."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shockwire.config import DEFAULT
from shockwire.functions.special import chi2_tail, fisher_greater, normal_tail
from shockwire.operators.scan import Running, scan


def dense_frequencies(freq: DataFrame, refs: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(ref_id, label, window_days, property_id, freq), zero where a reference date lacks a property. The grid is of
    aggregates (references x windows x properties) and does not grow with the articles."""
    properties = freq.select("property_id").distinct()
    grid = refs.select("ref_id", "label", F.explode(F.array(*map(F.lit, windows))).alias("window_days")).crossJoin(properties)
    return grid.join(freq, ["ref_id", "window_days", "property_id"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def contingency(dense: DataFrame) -> DataFrame:
    """A4, A5: presence counts, totals, rates and mean frequencies of events and controls by property and window."""
    out = []
    for side, label in (("be", 1), ("ctrl", 0)):
        mine = F.col("label") == label
        present, total = F.sum(F.when(mine & (F.col("freq") > 0), 1).otherwise(0)), F.sum(F.when(mine, 1).otherwise(0))
        out += [present.alias(f"{side}_present"), total.alias(f"{side}_total"), F.try_divide(present, total).alias(f"{side}_rate"), F.avg(F.when(mine, F.col("freq"))).alias(f"{side}_freq_mean")]
    return dense.groupBy("property_id", "window_days").agg(*out)


def cohens_h(p: Column, q: Column) -> Column:
    """X4."""
    return 2 * (F.asin(F.sqrt(p)) - F.asin(F.sqrt(q)))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Infinite where the denominator is 0."""
    return F.when(b * c != 0, a * d / F.when(b * c != 0, b * c)).otherwise(F.lit(float("inf")))


def presence_tests(table: DataFrame, least: int = DEFAULT.min_cell) -> DataFrame:
    """Chi-squared with continuity correction where every cell and expectation reaches `least`, else Fisher's
    exact test, both one-sided (p = 1 where events do not have the higher rate under chi-squared)."""
    a, c = F.col("be_present"), F.col("ctrl_present")
    b, d = F.col("be_total") - a, F.col("ctrl_total") - c
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    expected = F.least((a + b) * (a + c), (a + b) * (b + d), (c + d) * (a + c), (c + d) * (b + d)) / n
    usable = (margins > 0) & (F.least(a, b, c, d) >= least) & (expected >= least)
    shift = F.abs(a * d - b * c) - F.least(F.abs(a * d - b * c), n / 2.0)
    chi2 = F.when(usable, n * shift * shift / F.when(margins > 0, margins))
    out = table.withColumns({"test_type": F.when(usable, "chi2").otherwise("fisher"), "statistic": chi2, "odds_ratio": odds_ratio(a, b, c, d), "effect_size": cohens_h(F.col("be_rate"), F.col("ctrl_rate"))})
    return out.withColumns({"_a": a, "_b": b, "_c": c, "_d": d}).withColumn("p_value", F.when(usable, F.when(F.col("be_rate") <= F.col("ctrl_rate"), 1.0).otherwise(chi2_tail("statistic"))).otherwise(fisher_greater("_a", "_b", "_c", "_d"))).drop("_a", "_b", "_c", "_d")


def mann_whitney(dense: DataFrame) -> DataFrame:
    """U of events over controls, its tie-corrected deviation and z with continuity correction, by property and
    window. Mean ranks come from rank and tie counts."""
    w = Window.partitionBy("property_id", "window_days")
    ties = F.count(F.lit(1)).over(Window.partitionBy("property_id", "window_days", "freq"))
    ranked = dense.withColumns({"rank": F.rank().over(w.orderBy("freq")) + (ties - 1) / 2.0, "tie_part": (ties * ties - 1).cast("double")})
    event = F.col("label") == 1
    sums = ranked.groupBy("property_id", "window_days").agg(
        F.sum(F.when(event, F.col("rank"))).alias("r"), F.sum(F.when(event, 1).otherwise(0)).alias("n1"), F.sum(F.when(event, 0).otherwise(1)).alias("n2"), F.sum("tie_part").alias("ties"), F.max("freq").alias("top")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return sums.select("property_id", "window_days", "n1", "n2", u.alias("u"), sigma.alias("sigma"), F.when(sigma > 0, (u - n1 * n2 / 2 - 0.5) / F.when(sigma > 0, sigma)).alias("z"), "top", "ties")


#: Up to this size of the smaller sample, and without ties, the Mann-Whitney p is exact.
EXACT = 8


@lru_cache(maxsize=64)
def _u_tail(n1: int, n2: int) -> np.ndarray:
    """P(U >= u) for u = 0 .. n1 n2 over all orders of two samples without ties, by the number of subsets with each sum. It is
    the same with the samples exchanged."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for rank in range(n1 + n2):  # the k-th element taken beats rank - k of the other sample
        for k in range(min(rank, n1 - 1), -1, -1):
            beaten = rank - k
            if beaten <= n2:
                ways[k + 1, beaten:] += ways[k, : ways.shape[1] - beaten]
    return ways[n1][::-1].cumsum()[::-1] / ways[n1].sum()


@F.pandas_udf(DoubleType())
def u_tail(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """The exact one-sided p of U without ties; null where U is."""
    return pd.Series([None if x != x else float(_u_tail(*sorted((int(a), int(b))))[int(round(x))]) for x, a, b in zip(u, n1, n2, strict=True)], dtype=float)


def frequency_tests(dense: DataFrame) -> DataFrame:
    """X5 with its one-sided p: 1 where all frequencies are 0 (or alike), exact for small samples without ties."""
    found = mann_whitney(dense)
    small = (F.least("n1", "n2") <= EXACT) & (F.least("n1", "n2") > 0) & (F.col("ties") == 0)
    rows = found.withColumn("_u", F.when(small, F.col("u"))).withColumn("_exact", u_tail("_u", "n1", "n2"))  # one pass: null where it does not apply
    rough = F.when(F.col("z").isNull(), 1.0).otherwise(normal_tail("z"))
    return rows.withColumn("p_value", F.when(F.col("top") == 0, 1.0).when(F.col("_u").isNotNull(), F.col("_exact")).otherwise(rough)).drop("ties", "_u", "_exact")


def bh_adjust(tests: DataFrame, p: str = "p_value", within: list[str] | None = None, *ties: str) -> DataFrame:
    """Adds p_adjusted, Benjamini-Hochberg over each group."""
    keys = within or []
    w = Window.partitionBy(*keys, F.lit(0))
    by = [p, *ties]
    rank, m = F.row_number().over(w.orderBy(*by)), F.count(F.lit(1)).over(w)
    raw = tests.withColumn("_raw", F.col(p) * m / rank)
    later = w.orderBy(*[F.desc(c) for c in by]).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("p_adjusted", F.least(F.lit(1.0), F.min("_raw").over(later))).drop("_raw")


def significant(tests: DataFrame, alpha: float = DEFAULT.alpha, effect: float = DEFAULT.min_effect) -> DataFrame:
    """The rule of presence rows or of frequency rows, by analysis_type."""
    presence = (F.col("be_rate") > F.col("ctrl_rate")) & (F.abs("effect_size") >= effect)
    frequency = F.col("be_freq_mean") > F.col("ctrl_freq_mean")
    return tests.withColumn("significant", (F.col("p_adjusted") < alpha) & F.when(F.col("analysis_type") == "presence", presence).otherwise(frequency))


def saturated(tests: DataFrame) -> DataFrame:
    """Keeps frequency rows if every presence row has both rates at 1, else presence rows."""
    w = Window.partitionBy(F.lit(0))
    full = F.min(F.when(F.col("analysis_type") == "presence", F.when((F.col("be_rate") == 1) & (F.col("ctrl_rate") == 1), 1).otherwise(0))).over(w)
    return tests.withColumn("_full", full).where(F.col("analysis_type") == F.when(F.col("_full") == 1, "frequency").otherwise("presence")).drop("_full")


def best_windows(tests: DataFrame) -> DataFrame:
    """Each property's row with the smallest adjusted p, then p, then window."""
    w = Window.partitionBy("property_id").orderBy("p_adjusted", "p_value", "window_days")
    return tests.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumnRenamed("window_days", "optimal_window")


def basket_counts(baskets: DataFrame, sets: DataFrame) -> DataFrame:
    """items, n: how many of baskets (items) hold all items of each of sets (items), where any does. Each item's baskets are bitmaps
    of 32,768 rows; a set's count is that of the bits which its items' bitmaps share, so no basket meets a set."""
    rows = baskets.select("items", (F.monotonically_increasing_id() + 1).alias("row")).select("row", F.explode(F.array_distinct("items")).alias("item"))
    bitmaps = rows.groupBy("item", F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    shared = sets.select("items", F.explode("items").alias("item")).join(bitmaps, "item").groupBy("items", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("held"))
    return shared.where(F.col("held") == F.size("items")).groupBy("items").agg(F.sum(F.bitmap_count("bits")).alias("n")).where("n > 0")


def association_rules(baskets: DataFrame, controls: DataFrame, support: float = DEFAULT.min_support, confidence: float = DEFAULT.min_confidence, lift: float = DEFAULT.min_lift) -> DataFrame:
    """Rules of any consequent size from frequent itemsets of baskets (items array), with the itemset's support among
    control baskets. Itemsets are sorted arrays; all their splits are made in place."""
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(baskets)
    n = baskets.count()
    sets = model.freqItemsets.select(F.sort_array("items").alias("items"), (F.col("freq") / F.lit(n)).alias("support"))
    # each split of an itemset is a bit mask of the items on its left
    pairs = sets.where(F.size("items") > 1).withColumn("mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - 2)))
    side = lambda bit: F.expr(f"filter(items, (x, i) -> getbit(mask, i) = {bit})")
    rules = pairs.select("items", "support", side(1).alias("antecedents"), side(0).alias("consequents"))
    known = lambda name: sets.select(F.col("items").alias(name), F.col("support").alias(f"{name}_support"))
    rules = rules.join(known("antecedents"), "antecedents").join(known("consequents"), "consequents")
    rules = rules.withColumn("confidence", F.col("support") / F.col("antecedents_support")).withColumn("lift", F.col("confidence") / F.col("consequents_support"))
    rules = rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    among = basket_counts(controls, rules.select("items").distinct())
    total = controls.count() or 1
    return rules.join(among, "items", "left").select("antecedents", "consequents", "support", "confidence", "lift", (F.coalesce("n", F.lit(0)) / F.lit(total)).alias("ctrl_support"))


def _by_score(scored: DataFrame, ranges: int | None) -> DataFrame:
    """score, p and n (positives and all rows at the score), p_to and n_to (of those at or above it)."""
    by = scored.groupBy("score").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
    return scan(by, "score", {"p_to": Running("sum", "p", after=True), "n_to": Running("sum", "n", after=True)}, ranges=ranges)


def roc(scored: DataFrame, ranges: int | None = None) -> DataFrame:
    """By distinct score from above: threshold, tp, fp, precision, recall, fpr. Distinct scores may be as many as rows:
    their running counts are a prefix scan over `ranges` ranges."""
    rows = _by_score(scored, ranges)
    whole = scored.agg(F.sum("label").alias("pos"), (F.count(F.lit(1)) - F.sum("label")).alias("neg"))  # one row
    tp, seen = F.col("p_to"), F.col("n_to")
    return rows.join(F.broadcast(whole)).select(F.col("score").alias("threshold"), tp.alias("tp"), (seen - tp).alias("fp"), (tp / seen).alias("precision"), F.try_divide(tp, F.col("pos")).alias("recall"), F.try_divide(seen - tp, F.col("neg")).alias("fpr"))


def auc(scored: DataFrame, ranges: int | None = None) -> DataFrame:
    """The area under the curve; 0 where a class is absent. Rows are counted by distinct score first: a negative loses
    to the positives above it and ties with those at its score."""
    rows = _by_score(scored, ranges).withColumn("negatives", F.col("n") - F.col("p"))
    won = rows.withColumn("won", F.col("negatives") * (F.col("p_to") - F.col("p") / 2.0))
    pairs = F.sum("p").cast("double") * F.sum("negatives")
    return won.agg(F.when(pairs > 0, F.sum("won") / F.when(pairs > 0, pairs)).otherwise(0.0).alias("auc"))


def best_f1(curve: DataFrame) -> DataFrame:
    """The threshold of the largest F1, the lowest of equals."""
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-10)
    return curve.withColumn("f1", f1).orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "precision", "recall", "f1")
