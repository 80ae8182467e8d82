"""Fan-outs of the backtest: parameter grids, leaked signals, filters, walk-forward. One fold per pair and label."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, ConfigError
from ..functions.cut import cut
from ..operators import backtest, cointegration, kalman, metrics, signals
from ..sources.pairs import plain, synthetic

WINDOWS, ENTRIES, EXITS = (30, 60, 90, 120), (1.5, 2.0, 2.5), (0.25, 0.5, 0.75)
SHIFTS = tuple(range(11))
FRACTIONS = tuple(k / 10 for k in range(11))
MEMORIES = (2.0, 3.0, 5.0, 8.0, 12.0)
SUMMARY = ("sharpe_ratio", "annualized_return", "max_drawdown", "n_trades", "win_rate", "total_costs", "final_nav")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def grid(windows=WINDOWS, entries=ENTRIES, exits=EXITS, base: Config | None = None) -> tuple[list[tuple[str, Config]], list[tuple[str, str]]]:
    """(label, parameters) of the valid cells, and (label, error) of the others; the stop lies 1.5 beyond the entry."""
    good, bad = [], []
    for w in windows:
        for e in entries:
            for x in exits:
                label = f"w{w}_e{e:g}_x{x:g}"
                try:
                    good.append((label, (base or Config()).but(hedge_window=w, zscore_window=w, entry=e, exit=x, stop=e + 1.5)))
                except ConfigError as error:
                    bad.append((label, str(error)))
    return good, bad


def results(bars: DataFrame, done: DataFrame, config: Config) -> DataFrame:
    return metrics.metrics(bars, done, config, *backtest.KEYS).select(*backtest.KEYS, *SUMMARY)


def compared(rows: DataFrame, configs: list[tuple[str, Config]]) -> DataFrame:
    """Summary per pair and label; the parameter sets share windows, so ``rows`` has the signals of all."""
    placed = cut(backtest.with_config(rows, [c.row(label) for label, c in configs]))
    done = cut(backtest.trades(backtest.path(placed), placed))
    base = configs[0][1]
    return cut(results(cut(backtest.audit(placed, done, base)), done, base))


def together(frames: list[tuple[str, DataFrame]], config: Config) -> DataFrame:
    """Summary per pair and label, of signals that differ by label: one fold and one set of accounts for all."""
    placed = cut(union([backtest.with_config(rows, [config.row(label)]) for label, rows in frames]))
    done = cut(backtest.trades(backtest.path(placed), placed))
    return cut(results(cut(backtest.audit(placed, done, config)), done, config))


def accounted(rows: DataFrame, config: Config) -> DataFrame:
    """Summary per pair and label of signals that have their label, and perhaps windows of their own."""
    own = rows.drop("hedge_window", "zscore_window")
    placed = cut(own.join(backtest.config_table(rows.sparkSession, [config.row("")]).drop("label")))
    done = cut(backtest.trades(backtest.path(placed), placed))
    return results(cut(backtest.audit(placed, done, config)), done, config)


def doses(spark, values: list[tuple], names: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(values, names))


def sweep(bars: DataFrame, cells: list[tuple[str, Config]] | None = None) -> DataFrame:
    """The grid over all pairs, in one plan: signals once per pair of windows, folds per cell. Cells are literals of the plan."""
    cells = cells or grid()[0]
    spark = bars.sparkSession
    sizes = sorted({(c.hedge_window, c.zscore_window) for _, c in cells})
    series = bars.join(F.broadcast(spark.createDataFrame([(f"{h}/{z}", h, z) for h, z in sizes], "label string, hedge_window int, zscore_window int")))
    rows = signals.signals_by(series).drop("hedge_window", "zscore_window").withColumnRenamed("label", "windows")
    table = [c.row(label) | {"windows": f"{c.hedge_window}/{c.zscore_window}"} for label, c in cells]
    placed = cut(rows.join(backtest.config_table(spark, table), "windows").drop("windows"))
    done = cut(backtest.trades(backtest.path(placed), placed))
    base = cells[0][1]
    found = results(cut(backtest.audit(placed, done, base)), done, base)
    named = spark.createDataFrame(pd.DataFrame([{"label": label, "window": c.hedge_window, "entry": c.entry, "exit": c.exit} for label, c in cells]))
    return found.join(F.broadcast(named), "label")


def pivoted(swept: DataFrame) -> DataFrame:
    """Mean Sharpe ratio by window and entry."""
    return swept.groupBy("pair_id", "window").pivot("entry", list(ENTRIES)).agg(F.avg("sharpe_ratio"))


def spread_of(swept: DataFrame) -> DataFrame:
    x = F.col("sharpe_ratio")
    return swept.groupBy("pair_id").agg(F.count("*").alias("n_cells"), F.min(x).alias("least"), F.median(x).alias("median"), F.max(x).alias("most"), F.avg((x > 0).cast("double")).alias("positive_share"))


def cash_interest(bars: DataFrame, config: Config) -> DataFrame:
    """The same trades with and without interest on cash."""
    rows = cut(signals.signals(bars, config))
    return union([results(ran[2], ran[1], c) for c in (config, config.but(cash_interest=False)) for ran in [backtest.run(rows, c, "interest_on" if c.cash_interest else "interest_off", keep=True)]])


def timing_shift(bars: DataFrame, config: Config, shifts: tuple[int, ...] = SHIFTS, weight: float = 1.0, compat: bool = False) -> DataFrame:
    """Results when decisions see the z of so many spreads later. ``compat`` sizes leg B at a hedge ratio of 1."""
    rows = cut(signals.signals(bars, config))
    frames = []
    for k in shifts:
        seen = signals.leaky(rows, k, weight).withColumn("z", F.col("leaky_z"))
        frames.append((f"shift_{k:02d}", seen.withColumn("beta", F.lit(1.0)) if compat else seen))
    return together(frames, config).join(doses(bars.sparkSession, [(f"shift_{k:02d}", float(k)) for k in shifts], "label string, dose double"), "label")


def uniforms(seed: int, n: int) -> list[float]:
    """Draws of the 30-bit linear congruence 1664525 / 1013904223."""
    state, out = seed & 0x3FFFFFFF, []
    for _ in range(n):
        state = (1664525 * state + 1013904223) & 0x3FFFFFFF
        out.append(state / (1 << 30))
    return out


def outcome_filter(bars: DataFrame, config: Config, fractions: tuple[float, ...] = FRACTIONS, seed: int = 42, compat: bool = False) -> DataFrame:
    """Results when a share of the trades that will lose isn't entered; a pair's losers take the draws in order."""
    if any(not 0 <= f <= 1 for f in fractions):
        raise ConfigError("a fraction lies between 0 and 1")
    rows = cut(signals.signals(bars, config))
    _, honest, _ = backtest.run(rows, config, "honest")

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("entry_index")
        return group.assign(u=uniforms(seed, len(group)))[["pair_id", "entry_index", "u"]]

    losers = honest.where("pnl_net <= 0").select("pair_id", "entry_index").groupBy("pair_id").applyInPandas(draw, "pair_id string, entry_index long, u double")
    flagged = rows.join(losers.withColumnRenamed("entry_index", "idx"), ["pair_id", "idx"], "left")
    if compat:
        flagged = flagged.withColumn("beta", F.lit(1.0))
    flagged = cut(flagged)
    frames = [(f"filter_{f:.1f}", flagged.withColumn("skip", F.coalesce(F.col("u") < f, F.lit(False)))) for f in fractions]
    return together(frames, config).join(doses(bars.sparkSession, [(f"filter_{f:.1f}", f) for f in fractions], "label string, dose double"), "label")


def calibration(bars: DataFrame, config: Config) -> DataFrame:
    """Both curves of leaked knowledge, one under the other."""
    return timing_shift(bars, config).withColumn("leak_type", F.lit("timing_shift")).unionByName(outcome_filter(bars, config).withColumn("leak_type", F.lit("outcome_filter")))


def kalman_backtest(bars: DataFrame, config: Config, f: kalman.Filter, label: str) -> DataFrame:
    _, done, bars_ = backtest.run(kalman.kalman_signals(bars, f, config.zscore_window), config, label, keep=True)
    return results(bars_, done, config)


def kalman_sweep(bars: DataFrame, config: Config, half_life: float, ratios: tuple[float, ...] = MEMORIES) -> DataFrame:
    """The backtest on filters whose memory is so many half-lives."""
    filters = [(f"memory_{r:g}", r, kalman.Filter.of_memory(r * half_life)) for r in ratios]
    found = together([(label, kalman.kalman_signals(bars, f, config.zscore_window)) for label, _, f in filters], config)
    return found.join(doses(bars.sparkSession, [(label, r, f.memory, f.signal_to_noise) for label, r, f in filters], "label string, memory_ratio double, memory_bars double, signal_to_noise double"), "label")


def window_sensitivity(bars: DataFrame, ratios: tuple[float, ...] = (2.0, 3.0, 4.5, 6.0, 9.0, 12.5), base: Config | None = None) -> DataFrame:
    """The backtest with windows of so many half-lives of each pair's own residual, all pairs and ratios in one plan. Pairs without
    mean reversion have no rows, nor have windows under three bars."""
    config = base or Config()
    half = cointegration.half_lives(cointegration.residuals(bars), "pair_id").where("is_mean_reverting").select("pair_id", "half_life")
    labels = doses(bars.sparkSession, [(f"ratio_{r:g}", r) for r in ratios], "label string, window_ratio double")
    plan = half.join(labels).withColumn("window", F.round(F.col("half_life") * F.col("window_ratio")).cast("int")).where("window >= 3")
    series = bars.join(plan.select("pair_id", "label", F.col("window").alias("hedge_window"), F.col("window").alias("zscore_window")), "pair_id")
    found = accounted(signals.signals_by(series), config)
    return plan.join(found, ["pair_id", "label"])


def half_life_sensitivity(spark, half_lives: tuple[float, ...] = (5.0, 10.0, 15.0, 20.0, 30.0), n: int = 2520, seed: int = 7, config: Config | None = None) -> DataFrame:
    """The backtest on synthetic pairs that differ in how fast they revert."""
    rows = [(f"half_life_{h:g}", n, seed, 1.2, h, 0.03, 0.01, True) for h in half_lives]
    bars = plain(synthetic(spark.createDataFrame(rows, "pair_id string, n int, seed long, beta double, half_life double, spread_sd double, trend_sd double, cointegrated boolean")))
    return compared(signals.signals(bars, config or Config()), [("base", config or Config())])


def split(bars: DataFrame, share: float = 0.6) -> DataFrame:
    """Bars with their part: the first floor(share * n) are in the sample."""
    n = F.count("*").over(Window.partitionBy("pair_id"))
    return bars.withColumn("part", F.when(F.col("idx") < F.floor(n * share), "in").otherwise("out"))


def walk_forward(bars: DataFrame, share: float = 0.6, multiple: float = 5.0) -> DataFrame:
    """Window from the half-life in the first part, result in the second; a window over a quarter of that part drops the pair."""
    parts = split(bars, share)
    inner, outer = parts.where("part = 'in'").drop("part"), parts.where("part = 'out'").drop("part")
    half = cointegration.half_lives(cointegration.residuals(inner), "pair_id")
    size = outer.groupBy("pair_id").agg(F.count("*").alias("n_out"), F.min("idx").alias("first"))
    plan = half.join(size, "pair_id").select("pair_id", "half_life", "n_out", "first", F.round(F.coalesce("half_life", F.lit(200.0)) * multiple).cast("int").alias("window"))
    plan = plan.withColumn("window", F.greatest("window", F.lit(3))).withColumn("kept", F.col("window") <= F.floor(F.col("n_out") / 4))
    series = outer.join(plan.where("kept").select("pair_id", "first", F.lit("out_of_sample").alias("label"), F.col("window").alias("hedge_window"), F.col("window").alias("zscore_window")), "pair_id")
    found = accounted(signals.signals_by(series.withColumn("idx", F.col("idx") - F.col("first")).drop("first")), Config())
    return plan.select("pair_id", "half_life", "window", "kept").join(found.select("pair_id", "sharpe_ratio", "n_trades"), "pair_id", "left")


def walk_forward_summary(rows: DataFrame) -> DataFrame:
    n = F.count("sharpe_ratio")
    out = rows.agg(F.avg("sharpe_ratio").alias("mean_sharpe"), F.when(n >= 2, F.stddev_samp("sharpe_ratio") / F.sqrt(n)).alias("se"), F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))
    few = F.format_string("%d of %d pairs kept; their mean Sharpe ratio of %+.3f can't tell an edge from noise", "n_kept", F.col("n_kept") + F.col("n_dropped"), "mean_sharpe")
    enough = F.format_string("%d of %d pairs kept; mean Sharpe ratio %+.3f, error %.3f", "n_kept", F.col("n_kept") + F.col("n_dropped"), "mean_sharpe", "se")
    return out.withColumn("verdict", F.when(F.col("n_kept") == 0, "no pair kept, so nothing is known out of sample").when(F.col("n_kept") < 3, few).otherwise(enough))
