"""Reducers over value series and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.scalars import annualised, calmar, simple_return

FLAT = 1e-12


def returns(bars: DataFrame, *keys: str) -> DataFrame:
    """nav and its simple return per bar; the first bar of a series has none."""
    w = Window.partitionBy(*keys).orderBy("idx")
    rows = bars.withColumn("before", F.lag("nav").over(w))
    return rows.where(F.col("before").isNotNull()).select(*keys, "idx", simple_return(F.col("nav"), F.col("before")).alias("ret"))


def drawdowns(bars: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("peak", F.max("nav").over(w)).select(*keys, "idx", "nav", "peak", (F.col("nav") / F.col("peak") - 1).alias("drawdown"))


def max_drawdown(bars: DataFrame, *keys: str) -> DataFrame:
    """Deepest drawdown (the first of equals) and its length: from its peak to the first bar at or above it, or the last."""
    every = drawdowns(bars, *keys)
    worst = every.groupBy(*keys).agg(F.min(F.struct("drawdown", "idx", "peak")).alias("worst"), F.max("idx").alias("last"))
    worst = worst.select(*keys, "last", F.col("worst.drawdown").alias("max_drawdown"), F.col("worst.idx").alias("trough"), F.col("worst.peak").alias("top"))
    placed = every.select(*keys, "idx", "nav").join(worst, [*keys])
    ends = placed.groupBy(*keys).agg(
        F.first("max_drawdown").alias("max_drawdown"),
        F.first("last").alias("last"),
        F.min(F.when((F.col("nav") >= F.col("top")) & (F.col("idx") <= F.col("trough")), F.col("idx"))).alias("peak_at"),
        F.min(F.when((F.col("nav") >= F.col("top")) & (F.col("idx") >= F.col("trough")), F.col("idx"))).alias("again"),
    )
    length = F.when(F.col("max_drawdown") < 0, F.coalesce("again", "last") - F.col("peak_at")).otherwise(F.lit(0))
    return ends.select(*keys, "max_drawdown", length.cast("long").alias("max_drawdown_duration"))


def sharpe(ret: str, rate: float, per_year: float) -> dict[str, Column]:
    sd = F.stddev_samp(ret)
    bar = F.when(sd < FLAT, F.lit(0.0)).otherwise((F.avg(ret) - F.lit(rate)) / sd)
    return {"sharpe_per_bar": bar, "sharpe_ratio": bar * F.sqrt(F.lit(per_year)), "annualized_volatility": sd * F.sqrt(F.lit(per_year))}


def nav_metrics(bars: DataFrame, config: Config, *keys: str) -> DataFrame:
    values = bars.groupBy(*keys).agg(
        F.count("*").alias("n_bars"),
        F.min_by("nav", "idx").alias("initial_nav"),
        F.max_by("nav", "idx").alias("final_nav"),
        F.sum("costs_this_bar").alias("total_costs"),
        F.sum("interest_this_bar").alias("total_interest"),
        F.count_if(F.col("idx") >= config.warmup).alias("n_trading_bars"),
        F.count_if((F.col("idx") >= config.warmup) & (F.col("position") != "flat")).alias("held_bars"),
    )
    moves = returns(bars, *keys).groupBy(*keys).agg(*(c.alias(n) for n, c in sharpe("ret", config.rate, config.bars_per_year).items()))
    out = values.join(moves, [*keys], "left").join(max_drawdown(bars, *keys), [*keys])
    annual = annualised(F.col("final_nav"), F.col("initial_nav"), F.col("n_bars") - 1, config.bars_per_year)
    out = out.withColumns({"total_return": F.col("final_nav") / F.col("initial_nav") - 1, "annualized_return": annual, "net_pnl": F.col("final_nav") - F.col("initial_nav")})
    exposure = F.when(F.col("n_trading_bars") == 0, F.lit(0.0)).otherwise(F.col("held_bars") / F.col("n_trading_bars"))
    return out.withColumns({"calmar_ratio": calmar(F.col("annualized_return"), F.col("max_drawdown")), "exposure_frac": exposure}).drop("held_bars")


def trade_metrics(done: DataFrame, capital: float, *keys: str) -> DataFrame:
    """Per key with trades; a trade that nets zero is a loss."""
    win = F.col("pnl_net") > 0
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("pnl_net"))), F.lit(0.0))
    reason = lambda r: F.count_if(F.col("exit_reason") == r)
    sums = done.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.count_if(win).alias("n_wins"),
        F.count_if(~win).alias("n_losses"),
        part(win).alias("gross_win"),
        F.abs(part(~win)).alias("gross_loss"),
        F.avg("holding_bars").alias("avg_holding_bars"),
        F.sum("pnl_gross").alias("gross_pnl"),
        (F.sum(F.col("notional0") + F.col("notional1")) / capital).alias("turnover"),
        *(reason(r).alias(f"n_{r}") for r in ("stop_loss", "reversion", "max_holding", "end_of_data")),
    )
    ratio = lambda top, bottom: F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)
    return sums.withColumns(
        {
            "win_rate": ratio(F.col("n_wins"), F.col("n_trades")),
            "avg_win": ratio(F.col("gross_win"), F.col("n_wins")),
            "avg_loss": ratio(-F.col("gross_loss"), F.col("n_losses")),
            "profit_factor": F.when(F.col("gross_loss") < FLAT, F.lit(0.0)).otherwise(F.col("gross_win") / F.col("gross_loss")),
        }
    ).drop("gross_win", "gross_loss")


def metrics(bars: DataFrame, done: DataFrame, config: Config, *keys: str) -> DataFrame:
    """All metrics per key, one row; without trades their counts and sums are 0."""
    by_nav = nav_metrics(bars, config, *keys)
    by_trade = trade_metrics(done, config.capital, *keys)
    return by_nav.join(by_trade, [*keys], "left").fillna(0)


def long_form(wide: DataFrame, *keys: str) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in names)).unpivot(list(keys), names, "metric", "value")


def exit_shares(done: DataFrame, *keys: str) -> DataFrame:
    per = done.groupBy(*keys, "exit_reason").agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def decomposition(bars: DataFrame, *keys: str) -> DataFrame:
    """Interest so far, and what trading made besides."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumns({"interest_so_far": F.sum("interest_this_bar").over(w), "first_nav": F.min_by("nav", "idx").over(w)})
    return rows.select(*keys, "idx", "nav", "interest_so_far", (F.col("nav") - F.col("first_nav") - F.col("interest_so_far")).alias("trading_pnl"))
