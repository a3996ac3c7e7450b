"""The augmented Dickey-Fuller test with a constant: lag by AIC, p-value by MacKinnon's (1994) response surface."""

from __future__ import annotations

import math

import numpy as np

# Coefficients of MacKinnon (1994), one series, constant.
_TAU_MAX, _TAU_MIN, _TAU_STAR = 2.74, -18.83, -1.61
_SMALL = (2.1659, 1.4412, 0.038269)
_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def _p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    z = sum(c * tau**k for k, c in enumerate(_SMALL if tau <= _TAU_STAR else _LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _fit(d: np.ndarray, level: np.ndarray, lags: int, start: int) -> tuple[float, float]:
    """tau of the level and AIC, over the rows from `start` on."""
    y = d[start:]
    x = np.column_stack([level[start:], np.ones(len(y)), *[d[start - k : len(d) - k] for k in range(1, lags + 1)]])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    ssr, n, k = float(rest @ rest), *x.shape
    if n <= k or ssr <= 0:
        return 0.0, math.inf
    se = math.sqrt(ssr / (n - k) * np.linalg.pinv(x.T @ x)[0, 0])
    return float(beta[0] / se) if se > 0 else 0.0, n * math.log(ssr / n) + 2 * k


def adf_pvalue(series: np.ndarray, max_lag: int) -> float:
    """The p-value of a unit root; 1 for a constant series."""
    v = np.asarray(series, float)
    if len(v) < max_lag + 6 or np.ptp(v) == 0:
        return 1.0
    d, level = np.diff(v), v[:-1]
    best = min(range(max_lag + 1), key=lambda k: _fit(d, level, k, max_lag)[1])
    return _p(_fit(d, level, best, best)[0])
