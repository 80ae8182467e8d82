"""Hedge ratios, spreads and z-scores, all by trailing windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import spans
from ..functions.windows import MIN_STDDEV, MIN_VARIANCE, ordered, regression, zscore
from ..sources.pairs import log_prices


def spreads(bars: DataFrame, hedge_window: int, *keys: str) -> DataFrame:
    """alpha, beta, r2 and spread of each bar; null before the window is full and where leg B is flat."""
    fit = regression("log_a", "log_b", hedge_window, *keys)
    rows = log_prices(bars).withColumns(fit)
    return rows.withColumn("spread", F.col("log_a") - F.col("alpha") - F.col("beta") * F.col("log_b"))


def signals(bars: DataFrame, config: Config, current: bool = False) -> DataFrame:
    """Spread and z of each bar.

    z standardises the spread of the last bar but this one that has a spread, over the window that
    ends there; so the spread at t first matters to a fill at t + 2. With ``current`` it is the
    bar's own. Windows run over bars that have a spread.
    """
    rows = spreads(bars, config.hedge_window)
    dense = rows.where(F.col("spread").isNotNull()).withColumn("z", zscore("spread", config.zscore_window, lag=0 if current else 1))
    return rows.join(dense.select("pair_id", "idx", "z"), ["pair_id", "idx"], "left")


def signals_by(bars: DataFrame, keys: tuple[str, ...] = ("pair_id", "label"), hedge: str = "hedge_window", standard: str = "zscore_window") -> DataFrame:
    """signals() where the windows of each series are columns: one plan for all lengths. ``idx`` counts the bars of a series from 0."""
    rows = spans.moments(log_prices(bars), hedge, "log_b", "log_a", keys, place="idx")
    fit = F.when(F.col("span.var_x") >= MIN_VARIANCE, F.col("span.cov") / F.col("span.var_x"))
    flat = F.col("span.var_y") * F.col(hedge) < MIN_VARIANCE
    rows = rows.withColumn("beta", fit).withColumn("alpha", F.col("span.mean_y") - F.col("beta") * F.col("span.mean_x"))
    rows = rows.withColumn("r2", F.when(F.col("beta").isNotNull(), F.when(flat, F.lit(0.0)).otherwise(F.col("beta") * F.col("span.cov") / F.col("span.var_y"))))
    rows = rows.withColumn("spread", F.col("log_a") - F.col("alpha") - F.col("beta") * F.col("log_b")).drop("span")
    dense = spans.numbered(rows.where(F.col("spread").isNotNull()).select(*keys, "idx", standard, "spread"), keys)
    known = spans.moments(dense, standard, "spread", None, keys)
    sd = F.sqrt(F.col("span.var_x") * F.col(standard) / (F.col(standard) - 1))
    # each bar gets the z of the spread before its own
    last = known.select(*keys, (F.col("place") + 1).alias("place"), F.when(sd >= MIN_STDDEV, (F.col("spread") - F.col("span.mean_x")) / sd).alias("z"))
    placed = dense.select(*keys, "idx", "place").join(last, [*keys, "place"]).select(*keys, "idx", "z")
    return rows.join(placed, [*keys, "idx"], "left")


def leaky(rows: DataFrame, peek: int, weight: float = 1.0) -> DataFrame:
    """Of ``rows`` from signals(), z mixed with the z that comes ``peek`` spreads later. On purpose
    not causal: it measures what reading ahead would bring. Where the later z is missing, z stays."""
    dense = rows.where(F.col("spread").isNotNull())
    later = F.lead("z", peek).over(ordered()) if peek else F.col("z")
    mixed = dense.select("pair_id", "idx", F.when(F.col("z").isNotNull(), F.coalesce((1 - F.lit(weight)) * F.col("z") + F.lit(weight) * later, "z")).alias("leaky_z"))
    return rows.join(mixed, ["pair_id", "idx"], "left")


__all__ = ["MIN_STDDEV", "leaky", "signals", "signals_by", "spreads"]
