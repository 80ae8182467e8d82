"""Hedge ratio by a random-walk regression filter.

A run of steps, seen from the state before it, is a conditional Gaussian: five small arrays that can be put together
like the steps themselves, in any grouping (after Sarkka and Garcia-Fernandez 2021). So a long series is cut into
segments: each is reduced to such an element, elements are carried through in order, a row for each segment, and
each segment is then filtered step by step from the state that it starts with.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ConfigError
from ..functions.windows import zscore
from ..sources.pairs import log_prices

STATES = "pair_id string, idx bigint, alpha double, beta double, prediction double, innovation double, innovation_variance double"
WARMUP = 10


@dataclass(frozen=True)
class Filter:
    """Variances of observation and state, and the start."""

    observation: float = 1e-3
    state: float = 1e-5
    alpha: float = 0.0
    beta: float = 1.0
    start: float = 1.0

    def __post_init__(self) -> None:
        if not all(map(math.isfinite, (self.observation, self.state, self.alpha, self.beta, self.start))):
            raise ConfigError("filter parameters must be finite")
        if self.observation <= 0 or self.state < 0 or self.start <= 0:
            raise ConfigError("observation and start variance must be positive, state variance not negative")

    @property
    def signal_to_noise(self) -> float:
        return self.state / self.observation

    @property
    def memory(self) -> float:
        """Bars over which an observation counts, about."""
        return math.inf if self.state <= 0 else 1 / math.sqrt(self.signal_to_noise)

    @classmethod
    def of_memory(cls, bars: float, observation: float = 1e-3) -> Filter:
        return cls(observation=observation, state=observation / bars**2)


#: Bars of a series that one task filters.
SEGMENT = 8192


def filtered(log_a: np.ndarray, log_b: np.ndarray, f: Filter, start: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """alpha, beta, prediction, innovation and its variance after each bar; ``start`` is mean and covariance before the first."""
    x, p = start or (np.array([f.alpha, f.beta]), np.eye(2) * f.start)
    out = np.empty((len(log_a), 5))
    drift = np.eye(2) * f.state
    for t, (y, b) in enumerate(zip(log_a, log_b, strict=True)):
        h = np.array([1.0, b])
        p = p + drift
        seen = h @ x
        spread = p @ h
        var = max(h @ spread + f.observation, 1e-15)
        gain = spread / var
        x = x + gain * (y - seen)
        p = p - np.outer(gain, spread)
        p[0, 0], p[1, 1] = max(p[0, 0], 0.0), max(p[1, 1], 0.0)
        p[1, 0] = p[0, 1]
        out[t] = x[0], x[1], seen, y - seen, var
    return out


#: Transition, offset and covariance of the state after a run given the one before; information vector and matrix that the
#: run's observations hold about the one before. Arrays over runs.
Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def steps(log_a: np.ndarray, log_b: np.ndarray, f: Filter) -> Element:
    """An element for each bar."""
    h = np.stack([np.ones_like(log_b), log_b], axis=1)
    var = f.state * (h * h).sum(axis=1) + f.observation
    gain = f.state * h / var[:, None]
    keep = np.eye(2) - gain[:, :, None] * h[:, None, :]
    return keep, gain * log_a[:, None], f.state * keep, h * (log_a / var)[:, None], h[:, :, None] * h[:, None, :] / var[:, None, None]


def joined(first: Element, then: Element) -> Element:
    """Runs that follow each other as one."""
    a1, b1, c1, e1, j1 = first
    a2, b2, c2, e2, j2 = then
    flip = lambda m: m.swapaxes(-1, -2)
    times = lambda m, v: (m @ v[..., None])[..., 0]
    mixed = a2 @ np.linalg.inv(np.eye(2) + c1 @ j2)
    back = flip(a1) @ np.linalg.inv(np.eye(2) + j2 @ c1)
    return mixed @ a1, times(mixed, b1 + times(c1, e2)) + b2, mixed @ c1 @ flip(a2) + c2, times(back, e2 - times(j2, b1)) + e1, back @ j2 @ a1 + j1


def reduced(elements: Element) -> Element:
    """One element for all, by pairs of neighbours."""
    while (n := len(elements[0])) > 1:
        even = tuple(x[: n // 2 * 2 : 2] for x in elements), tuple(x[1 : n // 2 * 2 : 2] for x in elements)
        elements = tuple(np.concatenate([x, y[n // 2 * 2 :]]) for x, y in zip(joined(*even), elements, strict=True))
    return tuple(x[0] for x in elements)


ELEMENTS = "pair_id string, part bigint, numbers array<double>"


def kalman(bars: DataFrame, f: Filter, segment: int = SEGMENT) -> DataFrame:
    """Filtered states of every bar; no task holds more bars than a segment has."""

    def reduce(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        numbers = np.concatenate([x.ravel() for x in reduced(steps(group.log_a.to_numpy(), group.log_b.to_numpy(), f))])
        return pd.DataFrame({"pair_id": [key[0]], "part": [key[1]], "numbers": [numbers]})

    def starts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        """Mean and covariance that each segment starts with."""
        nothing = np.zeros(2), np.zeros((2, 2))
        state: Element = (np.zeros((2, 2)), np.array([f.alpha, f.beta]), np.eye(2) * f.start, *nothing)
        out = []
        for part, numbers in group.sort_values("part")[["part", "numbers"]].itertuples(index=False):
            out.append((key[0], part, np.concatenate([state[1], state[2].ravel()])))
            x = np.asarray(numbers)
            state = joined(state, (x[:4].reshape(2, 2), x[4:6], x[6:10].reshape(2, 2), x[10:12], x[12:].reshape(2, 2)))
        return pd.DataFrame(out, columns=["pair_id", "part", "numbers"])

    def run(key: tuple, group: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        x = np.asarray(start.numbers.iloc[0])
        got = filtered(group.log_a.to_numpy(), group.log_b.to_numpy(), f, (x[:2], (x[2:].reshape(2, 2) + x[2:].reshape(2, 2).T) / 2))
        out = pd.DataFrame(got, columns=["alpha", "beta", "prediction", "innovation", "innovation_variance"])
        out.insert(0, "pair_id", group.pair_id.to_numpy())
        out.insert(1, "idx", group.idx.to_numpy())
        return out

    rows = log_prices(bars).select("pair_id", "idx", "log_a", "log_b", F.floor(F.col("idx") / segment).cast("long").alias("part"))
    entered = rows.groupBy("pair_id", "part").applyInPandas(reduce, ELEMENTS).groupBy("pair_id").applyInPandas(starts, ELEMENTS)
    return rows.groupBy("pair_id", "part").cogroup(entered.groupBy("pair_id", "part")).applyInPandas(run, STATES)


def kalman_signals(bars: DataFrame, f: Filter, zscore_window: int) -> DataFrame:
    """Like signals(), from the filter: spread of the filtered state from bar WARMUP on, z with the bar's own spread, once
    more spreads than the window are there. Fills use the hedge ratio of the bar before, as everywhere here."""
    rows = log_prices(bars).join(kalman(bars, f), ["pair_id", "idx"])
    rows = rows.withColumn("spread", F.when(F.col("idx") >= WARMUP, F.col("log_a") - F.col("alpha") - F.col("beta") * F.col("log_b")))
    late = rows.where(F.col("idx") >= WARMUP).withColumn("z", F.when(F.col("idx") >= WARMUP + zscore_window, zscore("spread", zscore_window)))
    return rows.join(late.select("pair_id", "idx", "z"), ["pair_id", "idx"], "left")


def lcg_normals(seed: int, n: int) -> np.ndarray:
    """n normals of a 30-bit linear congruence and the Box-Muller rule, two draws each."""
    # fixed values: multiplier, increment and modulus of the generator
    multiplier, increment, mask = 1103515245, 12345, 0x3FFFFFFF
    state, draws = seed & mask, np.empty(2 * n)
    for k in range(2 * n):
        state = (multiplier * state + increment) & mask
        draws[k] = state / (mask + 1)
    return np.sqrt(-2 * np.log(np.maximum(draws[::2], 1e-12))) * np.cos(2 * np.pi * draws[1::2])


def rmse_gain(seed: int, n: int = 1500, window: int = 60, first: int = 100, f: Filter | None = None) -> tuple[float, float]:
    """Root mean squared errors of the hedge ratio, rolling regression and filter, as the true one drifts from 1 to 1.6."""
    g = lcg_normals(seed, 2 * n)
    truth = 1.0 + 0.6 * np.arange(n) / n
    phi = math.exp(-math.log(2) / 15)
    trend = np.cumsum(0.01 * g[::2])
    shocks, spread = 0.03 * math.sqrt(1 - phi * phi) * g[1::2], np.empty(n)
    level = 0.0
    for t in range(n):
        level = phi * level + shocks[t]
        spread[t] = level
    log_a, log_b = math.log(100) + truth * trend + spread, math.log(50) + trend
    a, b = (np.lib.stride_tricks.sliding_window_view(x, window) for x in (log_a, log_b))
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    ols = np.full(n, np.nan)
    ols[window - 1 :] = (a * b).sum(axis=1) / (b * b).sum(axis=1)
    kf = filtered(log_a, log_b, f or Filter())[:, 1]
    at = slice(first, n)
    rms = lambda x: float(np.sqrt(np.nanmean((x[at] - truth[at]) ** 2)))
    return rms(ols), rms(kf)


def rmse_experiment(spark, seeds: int = 30) -> DataFrame:
    """One row per seed: errors and the gain in percent; a task each."""
    table = spark.range(seeds).select((F.col("id") * 137 + 1000).alias("seed"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(s), *rmse_gain(int(s))) for s in group.seed]
        return pd.DataFrame([(s, o, k, (1 - k / o) * 100) for s, o, k in rows], columns=["seed", "rmse_ols", "rmse_kalman", "gain_pct"])

    return table.groupBy("seed").applyInPandas(run, "seed long, rmse_ols double, rmse_kalman double, gain_pct double")


def nearest_rank(df: DataFrame, column: str, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Quantiles by floor of the index, not interpolated; nulls are left out. Counts per value are summed before any are put in order."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    n = counts.agg(F.sum("n")).first()[0]
    wanted = df.sparkSession.createDataFrame([(s, None if n is None else math.floor(s * (n - 1))) for s in shares], "share double, place long")
    # ranges of values, in order; only their sums meet. A fixed number, as ranges that are put together would change their numbers
    ranged = counts.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column).withColumn("_range", F.spark_partition_id())
    before = ranged.groupBy("_range").agg(F.sum("n").alias("_n")).select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    upto = F.sum("n").over(Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_upto", upto).join(F.broadcast(before), "_range").withColumn("_last", F.col("_before") + F.col("_upto"))
    held = placed.join(F.broadcast(wanted), (F.col("place") < F.col("_last")) & (F.col("place") >= F.col("_last") - F.col("n")))
    return wanted.join(held.select("share", F.col(column).alias("value")), "share", "left").select("share", "value")
