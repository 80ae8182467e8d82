"""Is a result more than luck: t test per trade, stationary bootstrap of the Sharpe ratio."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import t_p_value
from .metrics import returns

BLOCK = 20.0


def trade_tests(done: DataFrame, *keys: str) -> DataFrame:
    per = done.groupBy(*keys).agg(F.count("*").alias("n_trades"), F.avg("pnl_net").alias("mean_pnl"), (F.stddev_samp("pnl_net") / F.sqrt(F.count("*"))).alias("se_pnl")).where("n_trades >= 2")
    return per.withColumn("t_stat", F.when(F.col("se_pnl") > 0, F.col("mean_pnl") / F.col("se_pnl")).otherwise(F.lit(0.0)))


def with_p_values(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", t_p_value(F.col("t_stat"), (F.col("n_trades") - 1).cast("double")))


def sharpe_intervals(moves: DataFrame, config: Config, *keys: str) -> DataFrame:
    """Sharpe ratio with Lo's standard error and with the one for skewed, heavy-tailed returns, annual."""
    sd = F.stddev_samp("ret")
    flat = lambda x, other: F.when(sd < 1e-12, F.lit(other)).otherwise(x)
    per = moves.groupBy(*keys).agg(F.count("*").alias("n"), flat((F.avg("ret") - config.rate) / sd, 0.0).alias("sr"), flat(F.skewness("ret"), 0.0).alias("skewness"), flat(F.kurtosis("ret") + 3, 3.0).alias("kurtosis"))
    year, square = F.sqrt(F.lit(config.bars_per_year)), F.pow("sr", F.lit(2.0))
    spread = (1 - F.col("skewness") * F.col("sr") + (F.col("kurtosis") - 1) / 4 * square) / (F.col("n") - 1)
    shaped = F.when(F.col("n") >= 2, F.sqrt(F.greatest(spread, F.lit(1e-12))) * year)
    return per.select(*keys, "n", (F.col("sr") * year).alias("sharpe_ratio"), (F.sqrt((1 + square / 2) / F.col("n")) * year).alias("sharpe_se"), "skewness", "kurtosis", shaped.alias("sharpe_se_shaped"))


def resampled(ret: np.ndarray, rng: np.random.Generator, block: float = BLOCK) -> np.ndarray:
    """Runs of consecutive values, circular, of geometric length with mean ``block``."""
    n = len(ret)
    fresh = rng.random(n) < 1 / max(1.0, block)
    fresh[0] = True
    at = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    return ret[(rng.integers(0, n, n)[at][run] + np.arange(n) - at[run]) % n]


def bootstrap(moves: DataFrame, config: Config, reps: int = 2000, seed: int = 12345, block: float = BLOCK, parts: int = 16) -> DataFrame:
    """Resampled Sharpe ratios, ``reps`` per pair_id. Replicates are dealt over tasks; each has a stream of its own, so the
    draws differ from one sequential stream but not in distribution. Undefined returns (of a value at or below zero) are left out."""
    year, rate = np.sqrt(config.bars_per_year), config.rate
    series = moves.where("ret is not null").groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ret"))), lambda x: x["ret"]).alias("rets"))
    dealt = series.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ret, out = np.asarray(group.rets.iloc[0], float), []
        for rep in range(int(key[1]), reps, parts):
            x = resampled(ret, np.random.default_rng([seed, rep]), block) - rate
            sd = x.std(ddof=1)
            out.append((key[0], rep, 0.0 if sd < 1e-12 else float(x.mean() / sd * year)))
        return pd.DataFrame(out, columns=["pair_id", "rep", "sharpe"])

    return dealt.groupBy("pair_id", "part").applyInPandas(run, "pair_id string, rep long, sharpe double")


def bootstrap_intervals(draws: DataFrame) -> DataFrame:
    at = lambda q: F.percentile("sharpe", F.lit(q))
    return draws.groupBy("pair_id").agg(F.count("*").alias("reps"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), F.avg((F.col("sharpe") <= 0).cast("double")).alias("p_value"))


def assess(bars: DataFrame, done: DataFrame, config: Config, alpha: float = 0.05, reps: int = 2000, seed: int = 12345) -> DataFrame:
    """One row per pair: t test of its trades, Sharpe ratio with errors, bootstrap interval and a verdict. A pair of under
    two trades has null tests."""
    moves = returns(bars, "pair_id")
    counts = bars.select("pair_id").distinct().join(done.groupBy("pair_id").agg(F.count("*").alias("n_trades")), "pair_id", "left").fillna(0, ["n_trades"])
    out = counts.join(with_p_values(trade_tests(done, "pair_id")).drop("n_trades"), "pair_id", "left")
    out = out.join(sharpe_intervals(moves, config, "pair_id").drop("n"), "pair_id", "left")
    out = out.join(bootstrap_intervals(bootstrap(moves, config, reps, seed)).withColumnRenamed("p_value", "bootstrap_p"), "pair_id", "left")
    sure = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    figures = F.format_string("(t = %.2f, p = %.3f)", "t_stat", "p_value")
    verdict = F.when(F.col("n_trades") < 2, "too few trades to tell").when(sure, F.concat(F.lit("mean result of a trade differs from zero "), figures)).otherwise(F.concat(F.lit("mean result of a trade doesn't differ from zero "), figures))
    return out.withColumns({"is_significant": sure, "verdict": verdict})
