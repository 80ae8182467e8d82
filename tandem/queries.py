"""The catalogue of pairs queries; each takes (spark, sf_dir). Money is rounded to cents, other reals to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .functions import scalars, windows
from .operators import backtest, cointegration, kalman, metrics, significance, signals, stability, variance_ratio
from .plans import experiments
from .sources import pairs

CONFIG = Config()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r(x: str | Column, places: int = 6) -> Column:
    """Rounded, under its own name if it has one; minus zero as zero."""
    column = F.col(x) if isinstance(x, str) else x
    out = F.round(column, places) + F.lit(0.0)
    return out.alias(x) if isinstance(x, str) else out


def money(x: str) -> Column:
    return r(x, 2)


def base_signals(spark: SparkSession, d: str) -> DataFrame:
    return signals.signals(pairs.derived(spark, d), CONFIG)


def base_run(spark: SparkSession, d: str, keep: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    return backtest.run(base_signals(spark, d), CONFIG, keep=keep)


@query
def bars_daily(spark, d):
    return pairs.derived(spark, d).select("pair_id", "idx", "date", r("price_a"), r("price_b"))


@query
def bars_validation(spark, d):
    return pairs.faults(pairs.derived(spark, d))


@query
def log_prices(spark, d):
    return pairs.log_prices(pairs.derived(spark, d)).select("pair_id", "idx", r("log_a"), r("log_b"))


@query
def rolling_mean_std(spark, d):
    rows = pairs.log_prices(pairs.derived(spark, d))
    return rows.select("pair_id", "idx", r(windows.mean("log_a", 20)).alias("mean_a"), r(F.sqrt(windows.variance("log_a", 20))).alias("sd_a"))


@query
def visible_days(spark, d):
    """Of each bar the numbers of the last five that it may see, and how many it may see in all."""
    rows = pairs.derived(spark, d)
    return rows.select("pair_id", "idx", F.array_join(windows.visible("idx", k=5).cast("array<string>"), ",").alias("last_five"), F.count("idx").over(windows.so_far()).alias("n_visible"))


@query
def rolling_corr(spark, d):
    rows = pairs.log_prices(pairs.derived(spark, d))
    return rows.select("pair_id", "idx", r(windows.correlation("log_a", "log_b", 60)).alias("corr"))


@query
def rolling_ols(spark, d):
    return signals.spreads(pairs.derived(spark, d), 60).select("pair_id", "idx", r("alpha"), r("beta"), r("r2"))


@query
def spread_series(spark, d):
    return signals.spreads(pairs.derived(spark, d), 60).where("spread is not null").select("pair_id", "idx", r("spread"))


@query
def zscore_current(spark, d):
    return signals.signals(pairs.derived(spark, d), CONFIG, current=True).select("pair_id", "idx", r("z"))


@query
def zscore_lagged(spark, d):
    return windows.assert_causal(base_signals(spark, d)).select("pair_id", "idx", r("beta"), r("spread"), r("z"))


@query
def signal_path(spark, d):
    rows = base_signals(spark, d).where(F.abs("z") >= CONFIG.entry)
    return rows.groupBy("pair_id", F.when(F.col("z") > 0, "short_spread").otherwise("long_spread").alias("side")).agg(F.count("*").alias("n_bars"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query
def leaky_z_shift_3(spark, d):
    return signals.leaky(base_signals(spark, d), 3).select("pair_id", "idx", r("leaky_z"))


@query
def position_path(spark, d):
    rows = backtest.with_config(base_signals(spark, d), [CONFIG.row("base")])
    return backtest.path(rows).select("pair_id", "trade", "direction", "entry_index", "exit_index", "exit_reason")


@query
def trades(spark, d):
    done = base_run(spark, d)[1]
    return done.select("pair_id", "direction", "entry_index", "exit_index", "entry_date", "exit_date", r("entry_z"), r("exit_z"), money("pnl_gross"), money("costs"), money("pnl_net"), "exit_reason", "holding_bars")


@query
def fills(spark, d):
    bars = base_run(spark, d)[2]
    return bars.where("trade_event != ''").select("pair_id", "idx", "trade_event", money("costs_this_bar"))


@query
def bar_audit(spark, d):
    bars = base_run(spark, d)[2]
    return bars.select("pair_id", "idx", "date", r("hedge_ratio"), r("spread"), r("zscore"), "position", r("qty_a", 4), r("qty_b", 4), money("cash"), money("position_value"), money("nav"), money("costs_this_bar"), money("interest_this_bar"), "trade_event")


def asked_by_bands(rows: DataFrame) -> DataFrame:
    """``rows`` with intents read from z: far out enter, near the middle leave, in a narrow band on either side turn round. Unlike the
    rule of the backtest these don't look at the position, so some entries come while one is open."""
    z = F.col("z")
    intent = F.when(z <= -2, "enter:long_spread").when(z >= 2, "enter:short_spread").when(F.abs(z) <= 0.1, "exit:reversion").when(z.between(-1.3, -1.2), "flip:long_spread").when(z.between(1.2, 1.3), "flip:short_spread")
    return rows.withColumns({"label": F.lit("bands"), "intent": F.coalesce(intent, F.lit("hold"))})


@query
def intent_events(spark, d):
    return backtest.executed(asked_by_bands(base_signals(spark, d)))[1].select("pair_id", "idx", "trade_event")


@query
def intent_trades(spark, d):
    done = backtest.run_intents(asked_by_bands(base_signals(spark, d)), CONFIG)[1]
    return done.select("pair_id", "direction", "entry_index", "exit_index", "exit_reason", money("pnl_gross"), money("costs"), money("pnl_net"))


@query
def nav_identity_violations(spark, d):
    return backtest.identity_violations(base_run(spark, d)[2]).select("pair_id", "idx", "gap")


@query
def next_bar_violations(spark, d):
    _, done, bars = base_run(spark, d)
    return backtest.next_bar_violations(bars, done, CONFIG.entry).select("pair_id", "entry_index", "asked")


@query
def returns_sharpe(spark, d):
    moves = metrics.returns(base_run(spark, d)[2], "pair_id")
    per = metrics.sharpe("ret", CONFIG.rate, CONFIG.bars_per_year)
    return moves.groupBy("pair_id").agg(F.count("*").alias("n_returns"), *(r(c).alias(n) for n, c in per.items()))


@query
def drawdown_series(spark, d):
    return metrics.drawdowns(base_run(spark, d)[2], "pair_id").select("pair_id", "idx", money("peak"), r("drawdown"))


@query
def max_drawdown(spark, d):
    return metrics.max_drawdown(base_run(spark, d, keep=True)[2], "pair_id").select("pair_id", r("max_drawdown"), "max_drawdown_duration")


@query
def equity_decomposition(spark, d):
    return metrics.decomposition(base_run(spark, d)[2], "pair_id").select("pair_id", "idx", money("interest_so_far"), money("trading_pnl"))


@query
def exit_reason_share(spark, d):
    return metrics.exit_shares(base_run(spark, d)[1], "pair_id").select("pair_id", "exit_reason", "n", r("share"))


@query
def metrics_nav(spark, d):
    return metrics.nav_metrics(base_run(spark, d, keep=True)[2], CONFIG, "pair_id").select("pair_id", "n_bars", "n_trading_bars", money("final_nav"), r("total_return"), r("annualized_return"), r("max_drawdown"), r("calmar_ratio", 4), r("exposure_frac"))


@query
def metrics_trades(spark, d):
    per = metrics.trade_metrics(base_run(spark, d)[1], CONFIG.capital, "pair_id")
    return per.select("pair_id", "n_trades", "n_wins", "n_losses", r("win_rate"), r("avg_holding_bars"), money("avg_win"), money("avg_loss"), r("profit_factor"), money("gross_pnl"), r("turnover", 4), "n_stop_loss", "n_reversion", "n_max_holding", "n_end_of_data")


@query
def metrics_full(spark, d):
    _, done, bars = base_run(spark, d, keep=True)
    return metrics.long_form(metrics.metrics(bars, done, CONFIG, "pair_id"), "pair_id").select("pair_id", "metric", r("value", 4))


@query
def sweep_36(spark, d):
    return experiments.sweep(pairs.derived(spark, d)).select("pair_id", "label", "window", "entry", "exit", r("sharpe_ratio"), r("max_drawdown"), "n_trades", r("win_rate"), money("final_nav"))


@query
def sweep_pivot(spark, d):
    table = experiments.pivoted(experiments.sweep(pairs.derived(spark, d)))
    return table.select("pair_id", "window", *(r(F.col(f"`{e}`")).alias(str(e)) for e in experiments.ENTRIES))


@query
def sweep_summary(spark, d):
    return experiments.spread_of(experiments.sweep(pairs.derived(spark, d))).select("pair_id", "n_cells", r("least"), r("median"), r("most"), r("positive_share"))


@query
def cash_interest_compare(spark, d):
    return experiments.cash_interest(pairs.derived(spark, d), CONFIG).select("pair_id", "label", r("sharpe_ratio"), "n_trades", money("final_nav"))


@query
def timing_shift_curve(spark, d):
    return experiments.timing_shift(pairs.derived(spark, d), CONFIG).select("pair_id", "dose", r("sharpe_ratio"), "n_trades", r("win_rate"), money("final_nav"))


@query
def outcome_filter_curve(spark, d):
    return experiments.outcome_filter(pairs.derived(spark, d), CONFIG).select("pair_id", "dose", r("sharpe_ratio"), "n_trades", r("win_rate"), money("final_nav"))


@query
def calibration_union(spark, d):
    return experiments.calibration(pairs.derived(spark, d), CONFIG).groupBy("leak_type", "pair_id").agg(F.count("*").alias("n_doses"), F.max("n_trades").alias("most_trades"))


@query
def kalman_path(spark, d):
    return kalman.kalman(pairs.derived(spark, d), kalman.Filter()).select("pair_id", "idx", r("alpha"), r("beta"), r("innovation"))


@query
def kalman_sweep(spark, d):
    return experiments.kalman_sweep(pairs.derived(spark, d), CONFIG, 15.0).select("pair_id", "memory_ratio", r("memory_bars"), r("sharpe_ratio"), "n_trades", money("final_nav"))


@query
def kalman_rmse(spark, d):
    return kalman.nearest_rank(kalman.rmse_experiment(spark), "gain_pct")


@query
def pair_correlations(spark, d):
    return cointegration.correlations(pairs.derived(spark, d)).select("pair_id", "n_obs", r("level_corr"), r("return_corr"))


@query
def universe_corr_matrix(spark, d):
    return cointegration.correlation_matrix(pairs.universe(spark, d)).select("asset_a", "asset_b", "n_obs", r("corr"))


@query
def universe_screen_prefilter(spark, d):
    return cointegration.correlation_matrix(pairs.universe(spark, d)).where(F.abs("corr") >= 0.01).select("asset_a", "asset_b", r("corr"))


@query
def universe_screen(spark, d):
    return cointegration.screen(pairs.universe(spark, d), 0.0)


@query
def candidate_outcomes(spark, d):
    return pairs.outcomes(pairs.closes(spark, d), pairs.candidates(spark, d)).select("asset_a", "asset_b", "ok", "n_dates", "reason")


@query
def screen_outcomes(spark, d):
    closes = pairs.closes(spark, d)
    return cointegration.screen_outcomes(closes, pairs.candidates(spark, d), 0.02).select("asset_a", "asset_b", "outcome", "n_dates", r("corr", 4))


@query
def full_sample_ols(spark, d):
    return cointegration.full_ols(pairs.derived(spark, d)).select("pair_id", r("alpha"), r("beta"))


@query
def half_life(spark, d):
    rows = cointegration.residuals(pairs.derived(spark, d))
    return cointegration.half_lives(rows, "pair_id").select("pair_id", r("slope"), r("half_life", 4), "is_mean_reverting")


@query
def half_sample_betas(spark, d):
    return stability.half_betas(pairs.derived(spark, d)).select("pair_id", r("beta_first"), r("beta_second"))


def residual_levels(spark, d):
    return cointegration.residuals(pairs.derived(spark, d)).select("pair_id", "idx", F.col("spread").alias("x"))


@query
def variance_ratio_levels(spark, d):
    return variance_ratio.variance_ratios(residual_levels(spark, d)).select("pair_id", "horizon", "n_obs", r("variance_ratio"))


@query
def variance_ratio_z(spark, d):
    return variance_ratio.variance_ratios(residual_levels(spark, d)).select("pair_id", "horizon", r("z_homoskedastic", 4), r("z_robust", 4))


@query
def variance_ratio_tests(spark, d):
    found = variance_ratio.variance_ratio_tests(residual_levels(spark, d))
    return found.select("pair_id", "horizon", "n_obs", r("variance_ratio"), r("z_homoskedastic", 4), r("z_robust", 4), r("p_homoskedastic", 4), r("p_robust", 4), "rejects_random_walk", "interpretation")


@query
def t_test_inputs(spark, d):
    per = significance.trade_tests(base_run(spark, d)[1], "pair_id")
    return per.select("pair_id", "n_trades", money("mean_pnl"), r("t_stat", 4))


@query
def t_test_p_values(spark, d):
    found = significance.with_p_values(significance.trade_tests(base_run(spark, d)[1], "pair_id"))
    return found.select("pair_id", "n_trades", money("mean_pnl"), money("se_pnl"), r("t_stat", 4), r("p_value", 5))


@query
def sharpe_lo_interval(spark, d):
    return significance.sharpe_intervals(metrics.returns(base_run(spark, d)[2], "pair_id"), CONFIG, "pair_id").select("pair_id", "n", r("sharpe_ratio"), r("sharpe_se"))


@query
def sharpe_shaped_error(spark, d):
    per = significance.sharpe_intervals(metrics.returns(base_run(spark, d)[2], "pair_id"), CONFIG, "pair_id")
    return per.select("pair_id", r("skewness", 4), r("kurtosis", 4), r("sharpe_se_shaped"))


@query
def significance_report(spark, d):
    _, done, bars = base_run(spark, d, keep=True)
    return significance.assess(bars, done, CONFIG)


@query
def stability_report(spark, d):
    return stability.analyse(pairs.derived(spark, d))


def with_smoothed(spark, d):
    """The derived pairs, and pairs of their trailing averages, which revert slowly."""
    bars = pairs.derived(spark, d)
    return bars.unionByName(pairs.smoothed(bars))


@query
def walk_forward_report(spark, d):
    out = experiments.walk_forward_summary(experiments.walk_forward(with_smoothed(spark, d)))
    return out.select(r("mean_sharpe", 4), r("se", 4), "n_kept", "n_dropped", "verdict")


@query
def window_ratio_sensitivity(spark, d):
    found = experiments.window_sensitivity(with_smoothed(spark, d))
    return found.select("pair_id", "window_ratio", "window", r("half_life", 4), r("sharpe_ratio", 4), "n_trades", r("win_rate"), money("final_nav"))


@query
def walk_forward_split(spark, d):
    return experiments.split(pairs.derived(spark, d)).groupBy("pair_id", "part").agg(F.count("*").alias("n_bars"), F.min("idx").alias("first_idx"))


@query
def walk_forward(spark, d):
    return experiments.walk_forward(with_smoothed(spark, d)).select("pair_id", r("half_life"), "window", "kept", r("sharpe_ratio"), "n_trades")


@query
def adf_eg_johansen(spark, d):
    return cointegration.analyse(pairs.derived(spark, d))


@query
def cusum(spark, d):
    return stability.cusum_summary(stability.cusum(pairs.derived(spark, d))).select("pair_id", r("max_excursion"), "break_index", "crossed")


@query
def rolling_eg(spark, d):
    return stability.rolling_engle_granger(pairs.derived(spark, d))


@query
def break_robustness(spark, d):
    return stability.robustness(pairs.derived(spark, d))


@query
def bootstrap_ci(spark, d):
    moves = metrics.returns(base_run(spark, d)[2], "pair_id")
    return significance.bootstrap_intervals(significance.bootstrap(moves, CONFIG))


@query
def vr_power(spark, d):
    return variance_ratio.power(spark, 30.0, 500)


@query
def deflated_sharpe(spark, d):
    """The best cell of the grid against the luck of trying all of it."""
    swept = experiments.sweep(pairs.derived(spark, d))
    best = swept.groupBy("pair_id").agg(F.max("sharpe_ratio").alias("observed"), F.count("*").alias("trials"))
    n = pairs.derived(spark, d).groupBy("pair_id").agg((F.count("*") - 1).alias("n_obs"))
    year = F.sqrt(F.lit(CONFIG.bars_per_year))
    rows = best.join(n, "pair_id").withColumn("expected_best", scalars.expected_best("trials", "n_obs"))
    error = F.sqrt((1 + F.pow(F.col("observed") / year, F.lit(2.0)) / 2) / (F.col("n_obs") - 1)) * year
    rows = rows.withColumn("excess", F.col("observed") - F.col("expected_best")).withColumn("statistic", F.col("excess") / error)
    rows = rows.withColumn("p_value", scalars.normal_tail("statistic"))
    return rows.select("pair_id", "trials", r("observed"), r("expected_best"), r("excess"), r("statistic", 4), r("p_value", 5), (F.col("excess") > 0).alias("survives"))


@query
def synthetic_datasets(spark, d):
    made = pairs.datasets(spark)
    return made.groupBy("pair_id").agg(F.count("*").alias("n_bars"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("price_a") <= 0).alias("bad_prices"))
