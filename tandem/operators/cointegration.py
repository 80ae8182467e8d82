"""Tests of pairs: correlations, regression, half-life, unit roots, cointegration; screening of a universe."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_life
from ..sources.pairs import LEAST_DATES, joined, log_prices, outcomes

#: MacKinnon's response surfaces for the constant case, per number of series:
#: (least and largest statistic they hold for, switch point, coefficients below it, coefficients above it).
MACKINNON = {
    1: (-18.83, 2.74, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (-16.18, 0.92, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
#: Johansen's trace test, no cointegration, two series, 95 %.
TRACE_95 = 15.4943
LEAST_BARS = 30


def mackinnon_p(tau: float, series: int) -> float:
    """0 below the surface's range and 1 above it, where the polynomials turn back."""
    least, most, switch, small, large = MACKINNON[series]
    if tau != tau or tau < least or tau > most:
        return tau if tau != tau else float(tau > most)
    poly = small if tau <= switch else large
    return NormalDist().cdf(sum(c * tau**k for k, c in enumerate(poly)))


def least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, residuals and (X'X)^-1."""
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ (x.T @ y)
    return b, y - x @ b, inverse


def adf(y: np.ndarray, constant: bool = True) -> tuple[float, int]:
    """Dickey-Fuller t statistic, lags chosen by Akaike's criterion over one common sample."""
    dy, n = np.diff(y), len(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

    def design(lags: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(first, len(dy))
        cols = [y[rows], *(dy[rows - k] for k in range(1, lags + 1))]
        return np.column_stack(cols + ([np.ones(len(rows))] if constant else [])), dy[rows]

    def akaike(lags: int) -> float:
        x, d = design(lags, most)
        e = least_squares(x, d)[1]
        return len(d) * np.log(e @ e / len(d)) + 2 * x.shape[1]

    lags = min(range(most + 1), key=akaike)
    x, d = design(lags, lags)
    b, e, inverse = least_squares(x, d)
    return float(b[0] / np.sqrt(e @ e / (len(d) - x.shape[1]) * inverse[0, 0])), lags


def engle_granger(log_a: np.ndarray, log_b: np.ndarray) -> tuple[float, float, float]:
    """(statistic, p value, hedge ratio)."""
    x = np.column_stack([np.ones(len(log_b)), log_b])
    b, e, _ = least_squares(x, log_a)
    tau = adf(e, constant=False)[0]
    return tau, mackinnon_p(tau, 2), float(b[1])


def engle_granger_p(log_a: np.ndarray, log_b: np.ndarray) -> tuple[float, float]:
    """(p value, hedge ratio)."""
    return engle_granger(log_a, log_b)[1:]


def johansen_trace(log_a: np.ndarray, log_b: np.ndarray) -> float:
    """Trace statistic for no cointegration; constant, one lagged difference."""
    y = np.column_stack([log_a, log_b])
    dy = np.diff(y, axis=0)
    centre = lambda v: v - v.mean(axis=0)
    now, past, level = centre(dy[1:]), centre(dy[:-1]), centre(y[1:-1])
    r0 = now - past @ np.linalg.lstsq(past, now, rcond=None)[0]
    r1 = level - past @ np.linalg.lstsq(past, level, rcond=None)[0]
    n = len(r0)
    s00, s01, s11 = r0.T @ r0 / n, r0.T @ r1 / n, r1.T @ r1 / n
    roots = np.linalg.eigvals(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)).real
    return float(-n * np.log1p(-np.clip(roots, 0, 1 - 1e-12)).sum())


TESTS = "pair_id string, n_obs long, eg_pvalue double, adf_pvalue double, johansen_trace double"


def tests(bars: DataFrame) -> DataFrame:
    """Engle-Granger, Dickey-Fuller on the residual, Johansen; a task per pair. Pairs too short or flat have nulls."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        a, b = group.log_a.to_numpy(), group.log_b.to_numpy()
        row = [group.pair_id.iloc[0], len(a), None, None, None]
        if len(a) >= LEAST_BARS and min(a.std(), b.std()) >= 1e-12:
            p, _ = engle_granger_p(a, b)
            e = least_squares(np.column_stack([np.ones(len(b)), b]), a)[1]
            row[2:] = p, mackinnon_p(adf(e)[0], 1), johansen_trace(a, b)
        return pd.DataFrame([row], columns=[c.split()[0] for c in TESTS.split(", ")])

    return log_prices(bars).select("pair_id", "idx", "log_a", "log_b").groupBy("pair_id").applyInPandas(run, TESTS)


def correlations(bars: DataFrame) -> DataFrame:
    """Of log levels and of log returns."""
    w = Window.partitionBy("pair_id").orderBy("idx")
    rows = log_prices(bars)
    rows = rows.withColumns({"ra": F.col("log_a") - F.lag("log_a").over(w), "rb": F.col("log_b") - F.lag("log_b").over(w)})
    pearson = lambda x, y: F.when(F.sqrt(F.var_pop(x) * F.var_pop(y)) > 1e-15, F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return rows.groupBy("pair_id").agg(F.count("*").alias("n_obs"), pearson("log_a", "log_b").alias("level_corr"), pearson("ra", "rb").alias("return_corr"))


def full_ols(bars: DataFrame) -> DataFrame:
    return log_prices(bars).groupBy("pair_id").agg(F.regr_intercept("log_a", "log_b").alias("alpha"), F.regr_slope("log_a", "log_b").alias("beta"))


def residuals(bars: DataFrame) -> DataFrame:
    rows = log_prices(bars)
    return rows.join(full_ols(bars), "pair_id").select("pair_id", "idx", (F.col("log_a") - F.col("alpha") - F.col("beta") * F.col("log_b")).alias("spread"))


def half_lives(rows: DataFrame, *keys: str) -> DataFrame:
    """Half-life of ``spread`` per key from the slope of its change on its last value; null without mean reversion."""
    w = Window.partitionBy(*keys).orderBy("idx")
    moved = rows.withColumn("last", F.lag("spread").over(w)).withColumn("change", F.col("spread") - F.col("last"))
    slopes = moved.groupBy(*keys).agg(F.regr_slope("change", "last").alias("slope"), F.count("last").alias("n"))
    found = F.when(F.col("n") >= 2, half_life(F.col("slope")))
    return slopes.select(*keys, "slope", found.alias("half_life"), found.isNotNull().alias("is_mean_reverting"))


def analyse(bars: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per pair with everything, and whether it's cointegrated and tradeable."""
    out = correlations(bars).drop("n_obs").join(full_ols(bars), "pair_id").join(half_lives(residuals(bars), "pair_id"), "pair_id").join(tests(bars), "pair_id")
    joint = (F.col("eg_pvalue") < alpha) & (F.col("johansen_trace") > TRACE_95)
    return out.withColumns({"is_cointegrated": F.coalesce(joint, F.lit(False))}).withColumn("is_tradeable", F.col("is_cointegrated") & F.coalesce(F.col("half_life").between(1, 120), F.lit(False)))


#: Assets and days of a block of returns.
SIDE, DAYS = 128, 512
BLOCK = "block int, days long, names array<string>, rets binary"
SUMS = "x int, y int, names_x array<string>, names_y array<string>, sums binary"


def blocked(moves: DataFrame, side: int = SIDE, days: int = DAYS) -> DataFrame:
    """Returns (asset, idx, ret) as matrices of some assets by some days, undefined where an asset has none."""
    assets = moves.select("asset").distinct()
    blocks = max(1, -(-assets.count() // side))
    placed = assets.withColumn("block", F.pmod(F.xxhash64("asset"), F.lit(blocks)).cast("int"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy("asset")) - 1
    # every block knows all its assets, so that its matrices fit together whoever traded on a day
    names = placed.groupBy("block").agg(F.sort_array(F.collect_list("asset")).alias("names"))
    rows = moves.join(placed.withColumn("slot", slot), "asset").select("block", F.floor(F.col("idx") / days).cast("long").alias("days"), "slot", F.pmod("idx", F.lit(days)).cast("int").alias("day"), "ret")

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        matrix = np.full((int(group.slot.max()) + 1, days), np.nan)
        matrix[group.slot.to_numpy(), group.day.to_numpy()] = group.ret.to_numpy()
        return pd.DataFrame({"block": [key[0]], "days": [key[1]], "rets": [matrix.tobytes()]})

    packed = rows.groupBy("block", "days").applyInPandas(pack, "block int, days long, rets binary")
    return packed.join(names, "block").select("block", "days", "names", "rets")


def correlation_matrix(universe: DataFrame, least: float = 0.0, side: int = SIDE, days: int = DAYS) -> DataFrame:
    """Correlation of log returns of all pairs of assets, a before b, over the days on which both have one; undefined where either is
    flat. With ``least`` only pairs that correlate so much, by size, leave the blocks.

    Every two blocks of assets meet once for each block of days and are multiplied as matrices, with and without squares, and with
    ones for the days that are there; sums over days come as a sorted stream, one pair of blocks at a time.
    """
    w = Window.partitionBy("asset").orderBy("idx")
    moves = universe.withColumn("ret", F.log("price") - F.log(F.lag("price").over(w))).where(F.col("ret").isNotNull()).select("asset", "idx", "ret")
    blocks = blocked(moves, side, days)
    left = blocks.select(F.col("block").alias("x"), "days", F.col("names").alias("names_x"), F.col("rets").alias("rets_x"))
    right = blocks.select(F.col("block").alias("y"), "days", F.col("names").alias("names_y"), F.col("rets").alias("rets_y"))
    both = left.join(right, "days").where("x <= y")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r, s = (np.frombuffer(row[f"rets_{k}"]).reshape(-1, days) for k in "xy")
                m, n = (~np.isnan(v) * 1.0 for v in (r, s))
                r, s = np.nan_to_num(r), np.nan_to_num(s)
                sums = np.zeros((6, len(row["names_x"]), len(row["names_y"])))
                sums[:, : len(r), : len(s)] = m @ n.T, r @ n.T, m @ s.T, r**2 @ n.T, m @ (s**2).T, r @ s.T
                cols = [pa.array([row[c]], t) for c, t in (("x", pa.int32()), ("y", pa.int32()), ("names_x", pa.list_(pa.string())), ("names_y", pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([sums.tobytes()], pa.binary())], names=["x", "y", "names_x", "names_y", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for row in batch.to_pylist():
                sums = np.frombuffer(row["sums"]).reshape(6, len(row["names_x"]), len(row["names_y"]))
                if (row["x"], row["y"]) != at:
                    if held:
                        yield pairs(*held)
                    at, held = (row["x"], row["y"]), [row["names_x"], row["names_y"], np.zeros_like(sums), row["x"] == row["y"]]
                held[2] += sums
        if held:
            yield pairs(*held)

    def pairs(names_x: list[str], names_y: list[str], sums: np.ndarray, same: bool) -> pa.RecordBatch:
        n, sx, sy, sxx, syy, sxy = sums
        with np.errstate(invalid="ignore", divide="ignore"):
            var = np.maximum((sxx - sx**2 / n) * (syy - sy**2 / n), 0) / n**2
            corr = np.where(np.sqrt(var) > 1e-15, (sxy - sx * sy / n) / n / np.sqrt(var), np.nan)
            keep = (n > 0) & ((np.abs(corr) >= least) if least > 0 else True)
        if same:
            keep &= np.triu(np.ones_like(keep), 1)
        i, j = np.nonzero(keep)
        a, b = np.array(names_x, object)[i], np.array(names_y, object)[j]
        turned = a > b
        a, b = np.where(turned, b, a), np.where(turned, a, b)
        value = corr[i, j]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n[i, j].astype(np.int64)), pa.array(value, mask=np.isnan(value))], names=["asset_a", "asset_b", "n_obs", "corr"])

    parts = both.mapInArrow(multiply, SUMS).repartition("x", "y").sortWithinPartitions("x", "y")
    return parts.mapInArrow(add, "asset_a string, asset_b string, n_obs long, corr double")


def screen(universe: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs whose returns move together, tested; the cheap filter comes first, by hand, as none moves through a grouped task."""
    chosen = correlation_matrix(universe, least).where(F.abs("corr") >= least).select("asset_a", "asset_b")
    a = universe.select(F.col("asset").alias("asset_a"), "idx", F.col("price").alias("price_a"))
    b = universe.select(F.col("asset").alias("asset_b"), "idx", F.col("price").alias("price_b"))
    bars = chosen.join(a, "asset_a").join(b, ["asset_b", "idx"]).withColumn("pair_id", F.concat_ws("|", "asset_a", "asset_b"))
    return analyse(bars.select("pair_id", "idx", "price_a", "price_b")).orderBy("eg_pvalue", "pair_id")


def screen_outcomes(closes: DataFrame, candidates: DataFrame, least: float = 0.5, dates: int = LEAST_DATES) -> DataFrame:
    """What the screen does with each candidate: ``tested``, ``correlation below``, ``flat leg``, or why it can't be used; pairs that
    are passed over are rows like the others, so they can be counted."""
    w = Window.partitionBy("pair_id").orderBy("idx")
    moves = joined(closes, candidates, dates).withColumns({k: F.log(f"price_{k}") - F.log(F.lag(f"price_{k}").over(w)) for k in "ab"})
    scale = F.sqrt(F.var_pop("a") * F.var_pop("b"))
    corr = moves.groupBy("pair_id").agg(F.when(scale > 1e-15, F.covar_pop("a", "b") / scale).alias("corr"))
    every = outcomes(closes, candidates, dates).withColumn("pair_id", F.concat_ws("|", "asset_a", "asset_b")).join(corr, "pair_id", "left")
    tested = F.when(F.col("corr").isNull(), "flat leg").when(F.abs("corr") < least, "correlation below").otherwise("tested")
    return every.select("asset_a", "asset_b", F.when(F.col("ok"), tested).otherwise(F.col("reason")).alias("outcome"), "n_dates", "corr")
