"""Scalar rules of the domain, as column expressions; distributions as Arrow functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

NORMAL = NormalDist()
EULER_GAMMA = 0.5772156649015329


def simple_return(x: Column, before: Column) -> Column:
    return F.when(before > 0, x / before - 1)


def cost(notional: Column, rate: Column | float) -> Column:
    return F.abs(notional) * rate


def quantities(capital: Column, fraction: Column, beta: Column, price_a: Column, price_b: Column) -> tuple[Column, Column]:
    """Unsigned quantities of both legs: a share of the capital in A, |beta| times its notional in B. A hedge ratio that is
    zero or undefined raises: the trade would have one leg."""
    a = capital * fraction / price_a
    hedged = F.when(F.abs(beta) > 0, F.abs(beta)).otherwise(F.raise_error(F.lit("a trade's hedge ratio must be finite and not zero")).cast("double"))
    return a, hedged * a * price_a / price_b


def annualised(final: Column, initial: Column, bars: Column, per_year: Column | float) -> Column:
    return F.when(final <= 0, F.lit(-1.0)).otherwise(F.pow(final / initial, per_year / bars) - 1)


def calmar(annual: Column, drawdown: Column) -> Column:
    return F.when(F.abs(drawdown) < 1e-12, F.lit(0.0)).otherwise(annual / F.abs(drawdown))


def half_life(slope: Column) -> Column:
    """Bars to halve a deviation; null where there is no mean reversion."""
    return F.when((slope < 0) & (slope > -1), -F.lit(math.log(2)) / F.log(1 + slope))


def vr_label(vr: Column) -> Column:
    return F.when(vr.isNull(), "undefined").when(vr < 0.95, "mean-reverting").when(vr > 1.05, "trending").otherwise("random walk")


def sharpe_error(sharpe: float, n: int, skewness: float = 0.0, kurtosis: float = 3.0) -> float:
    """Standard error of a per-bar Sharpe ratio with skewed, heavy-tailed returns."""
    if n < 2:
        return math.inf
    return math.sqrt(max(1e-12, (1 - skewness * sharpe + (kurtosis - 1) / 4 * sharpe**2) / (n - 1)))


def expected_best_sharpe(trials: int, n: int, per_year: float = 252.0) -> float:
    """Annual Sharpe that the best of so many tries without skill shows in the mean."""
    if trials < 2:
        return 0.0
    best = (1 - EULER_GAMMA) * NORMAL.inv_cdf(1 - 1 / trials) + EULER_GAMMA * NORMAL.inv_cdf(1 - 1 / (trials * math.e))
    return math.sqrt(per_year / n) * best


def deflated_sharpe(observed: float, trials: int, n: int, per_year: float = 252.0, skewness: float = 0.0, kurtosis: float = 3.0) -> dict:
    luck = expected_best_sharpe(trials, n, per_year)
    error = sharpe_error(observed / math.sqrt(per_year), n, skewness, kurtosis)
    statistic = (observed - luck) / math.sqrt(per_year) / error
    return {"observed": observed, "expected_best": luck, "excess": observed - luck, "statistic": statistic, "p_value": 1 - NORMAL.cdf(statistic), "survives": observed > luck}


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # terms of the fraction 1 / (1 + d1 / (1 + d2 / ...)), evaluated from the far end
    value = 1.0
    for k in range(200, 0, -1):
        m = k // 2
        top = -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1)) if k % 2 else m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + top * x / value
    return front / value


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if np.isfinite(a) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def expected_best(trials: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([expected_best_sharpe(int(a), int(b)) for a, b in zip(trials, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """One-sided, upper."""
    return z.map(lambda v: None if pd.isna(v) else NORMAL.cdf(-v)).astype("float64")


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided."""
    return z.map(lambda v: None if pd.isna(v) else 2 * (1 - NORMAL.cdf(abs(v)))).astype("float64")
