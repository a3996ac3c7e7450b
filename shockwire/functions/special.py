"""Tail probabilities that Spark lacks, as Arrow-batched functions over columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz's method)."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # the fraction 1 + k1 / (1 + k2 / (1 + ...)), whose inverse scales the front factor
    tiny = 1e-300
    f = c = 1.0
    d = 0.0
    for i in range(1, 400):
        m = i // 2
        k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + k * d) or tiny)
        c = (1.0 + k / c) or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front / f


def student_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def hypergeometric_tail(a: int, b: int, c: int, d: int) -> float:
    """P(X >= a) for the 2x2 table a b / c d with its margins fixed."""
    row, col, n = a + b, a + c, a + b + c + d
    choose = lambda p, q: math.lgamma(p + 1) - math.lgamma(q + 1) - math.lgamma(p - q + 1)
    total = choose(n, col)
    terms = [choose(row, k) + choose(n - row, col - k) - total for k in range(a, min(row, col) + 1) if col - k <= n - row]
    return min(1.0, math.fsum(map(math.exp, terms)))


def _over(f):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """P(Z >= z)."""
    return z.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2))).astype("float64")


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P(X >= x) of chi-squared with one degree of freedom."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(max(v, 0.0) / 2))).astype("float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _over(student_two_sided)(t, df)


@F.pandas_udf(DoubleType())
def fisher_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _over(lambda *x: hypergeometric_tail(*map(int, x)))(a, b, c, d)
