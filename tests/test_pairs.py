"""The pairs library: hand vectors, invariants, and queries against their SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.config import Config, ConfigError, DataError
from tandem.functions import scalars, windows
from tandem.operators import backtest, kalman, metrics, significance, signals, stability, variance_ratio
from tandem.operators.cointegration import mackinnon_p
from tandem.oracles import ORACLE_SQL
from tandem.queries import QUERIES
from tandem.sources import pairs


def series(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(pd.DataFrame({"pair_id": "p", "idx": range(n), **cols}))


def walk(seed=3, n=300, half_life=10.0):
    rng = np.random.default_rng(seed)
    trend, phi, level, spread = np.cumsum(rng.normal(0, 0.01, n)), 2 ** (-1 / half_life), 0.0, []
    for e in rng.normal(0, 0.01, n):
        level = phi * level + e
        spread.append(level)
    return np.exp(math.log(100) + 1.1 * trend + np.array(spread)), np.exp(math.log(50) + trend)


def bars(spark, n=300, seed=3):
    a, b = walk(seed, n)
    return spark.createDataFrame(pd.DataFrame({"pair_id": "p", "idx": range(n), "date": pd.bdate_range("2020-01-01", periods=n).date, "price_a": a, "price_b": b}))


def test_windows_by_hand(spark):
    rows = series(spark, x=[1.0, 2, 3, 4, 5])
    got = rows.select("idx", windows.mean("x", 3).alias("m"), windows.variance("x", 3).alias("v"), windows.zscore("x", 3).alias("z")).orderBy("idx").collect()
    assert got[1].m is None and (got[4].m, got[4].v, got[4].z) == (4.0, 1.0, 1.0)
    flat = series(spark, x=[5.0] * 10).select(windows.zscore("x", 5).alias("z")).collect()
    assert all(r.z is None for r in flat)
    two = series(spark, x=[1.0] * 6, y=[1.0, 2, 3, 4, 5, 6])
    assert all(r.c is None for r in two.select(windows.correlation("x", "y", 5).alias("c")).collect())


def test_plans_that_read_ahead_are_refused(spark):
    rows = series(spark, x=[1.0, 2, 3])
    windows.assert_causal(rows.withColumn("m", windows.mean("x", 2)))
    for column in (F.lead("x").over(windows.ordered()), F.lag("x", -1).over(windows.ordered()), F.sum("x").over(windows.ordered().rowsBetween(-1, 1)), F.sum("x").over(windows.ordered())):
        with pytest.raises(windows.LookaheadError):
            windows.assert_causal(rows.withColumn("bad", column))


def test_truncation_leaves_the_past_alone(spark):
    config, whole = Config(hedge_window=20, zscore_window=20), bars(spark)
    cols = ["idx", "beta", "spread", "z"]
    full = signals.signals(whole, config).select(*cols).toPandas().set_index("idx").sort_index()
    for cut in (60, 150):
        part = signals.signals(whole.where(F.col("idx") <= cut), config).select(*cols).toPandas().set_index("idx").sort_index()
        pd.testing.assert_frame_equal(part, full.loc[:cut])
    leak = lambda df: signals.leaky(signals.signals(df, config), 3).select("idx", "leaky_z").toPandas().set_index("idx").sort_index()
    assert not leak(whole.where("idx <= 150")).equals(leak(whole).loc[:150])


@pytest.mark.parametrize("changes", [{"hedge_window": 2}, {"exit": 2.0}, {"stop": 2.0}, {"fraction": 0.0}, {"capital": -1.0}, {"max_holding": 0}, {"entry": float("nan")}])
def test_bad_parameters(changes):
    with pytest.raises(ConfigError):
        Config(**changes)


def test_decisions():
    d = lambda z, pos, held=1: backtest.decide(z, pos, held, 2.0, 0.5, 3.5, 60)
    assert d(2.0, 0) == "short" and d(-2.0, 0) == "long" and d(1.99, 0) == "hold" and d(float("nan"), 1) == "hold"
    assert d(-4.0, 1) == "stop_loss" and d(3.0, 1) == "hold" and d(0.5, -1) == "reversion" and d(0.1, 1, 60) == "max_holding"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=3, max_size=80))
def test_round_trips_follow_each_other(z):
    trips = list(backtest.round_trips(np.arange(len(z)), np.array(z), 2.0, 0.5, 3.5, 10))
    for _, a, b, reason in trips:
        assert abs(z[a - 1]) >= 2.0 and a <= b and (a < b or reason == "end_of_data")
    assert all(x[2] <= y[1] for x, y in zip(trips, trips[1:], strict=False))


def test_accounts_add_up(spark):
    config = Config(hedge_window=20, zscore_window=20, entry=1.0, exit=0.2, stop=4.0)
    rows = signals.signals(bars(spark), config)
    _, done, audit = backtest.run(rows, config)
    assert done.count() > 3 and backtest.identity_violations(audit).isEmpty() and backtest.next_bar_violations(audit, done, 1.0).isEmpty()
    m = metrics.metrics(audit, done, config, "pair_id").first()
    assert m.n_trades == m.n_wins + m.n_losses == m.n_stop_loss + m.n_reversion + m.n_max_holding + m.n_end_of_data
    per = done.agg(F.sum("costs").alias("c"), F.sum("pnl_net").alias("p")).first()
    assert m.total_costs == pytest.approx(per.c) and m.net_pnl == pytest.approx(per.p + m.total_interest)


def test_drawdown_by_hand(spark):
    got = metrics.max_drawdown(series(spark, nav=[100.0, 120, 90, 110, 80, 130]), "pair_id").first()
    assert got.max_drawdown == pytest.approx(-1 / 3) and got.max_drawdown_duration == 4


def test_distributions():
    # the tail beyond t, by integrating the density over the angle with x = sqrt(df) * tan(angle)
    for t, df in ((0.3, 1), (1.7, 4), (2.5, 9), (3.1, 37), (0.0, 6)):
        whole, tail = (np.trapezoid(np.cos(a) ** (df - 1), a) for a in (np.linspace(0, np.pi / 2, 20001), np.linspace(np.arctan(t / df**0.5), np.pi / 2, 20001)))
        assert scalars.t_two_sided(t, df) == pytest.approx(tail / whole, abs=1e-6)
    got = scalars.deflated_sharpe(0.654, 30, 2515)
    assert got["expected_best"] == pytest.approx(0.6563, abs=1e-4) and got["p_value"] == pytest.approx(0.503, abs=1e-3)
    # the ends of the response surfaces: a strong rejection isn't turned into none, nor an exploding residual into one
    for tau, series, p in ((-19, 1, 0), (-30, 1, 0), (-48, 1, 0), (3, 1, 1), (-16.2, 2, 0), (-38, 2, 0), (-48, 2, 0), (0.93, 2, 1), (5, 2, 1)):
        assert mackinnon_p(tau, series) == p
    for series in (1, 2):
        ps = [mackinnon_p(t, series) for t in np.linspace(-60, 6, 1000)]
        assert all(x <= y + 1e-4 for x, y in zip(ps, ps[1:], strict=False))
    assert mackinnon_p(-2.86, 1) == pytest.approx(0.05, abs=1e-3) and mackinnon_p(-3.34, 2) == pytest.approx(0.05, abs=1e-3)


def test_variance_ratio_of_a_reverting_series(spark):
    rng, phi, x = np.random.default_rng(1), 0.5, [0.0]
    for e in rng.normal(size=3999):
        x.append(phi * x[-1] + e)
    got = {r.horizon: r.variance_ratio for r in variance_ratio.variance_ratios(series(spark, x=x)).collect()}
    for q in (2, 4, 8):
        assert got[q] == pytest.approx((1 - phi**q) / (q * (1 - phi)), abs=0.06)
    assert variance_ratio.variance_ratios(series(spark, x=[1.0] * 50)).where("variance_ratio is not null").isEmpty()


def test_filter_tracks_better_than_a_window():
    ols, kf = kalman.rmse_gain(1000)
    assert kf < ols
    with pytest.raises(ConfigError):
        kalman.Filter(observation=0.0)


def test_recursive_residuals_are_forecast_errors():
    rng = np.random.default_rng(2)
    x, y = np.column_stack([np.ones(40), rng.normal(size=40)]), rng.normal(size=40)
    w = stability.recursive_residuals(x, y)
    b = np.linalg.lstsq(x[:20], y[:20], rcond=None)[0]
    scale = 1 + x[20] @ np.linalg.inv(x[:20].T @ x[:20]) @ x[20]
    assert w[18] == pytest.approx((y[20] - x[20] @ b) / math.sqrt(scale))


def test_price_files(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("date,price_a,price_b\n2020-01-01,1.5,2\n2020-01-02,1.6,2.1\n")
    assert pairs.read_prices(spark, str(good)).count() == 2
    head, fine = "date,price_a,price_b\n", "2020-01-01,1,2\n"
    faults = {
        "line 0: nothing in it": "\n\n",
        "line 1: the columns should be": "date,a,b\n" + fine,
        "line 1: no rows below": head,
        "line 3: price_a should be a number but is 'x'": head + fine + "\n2020-01-02,x,2\n2020-01-03,y,2\n",
        "line 3: price_b should be above zero and finite but is -2": head + fine + "2020-01-02,1,-2\n",
        "line 2: price_a should be above zero": head + "2020-01-02,0,2\n",
        "line 2: price_a should be above zero and finite but is nan": head + "2020-01-02,nan,2\n",
        "line 3: 4 fields where 3 belong": head + fine + "2020-01-02,1,2,3\n",
        "line 2: date has no value": head + ",1,2\n",
        "line 3: date 2020-01-01 comes after 2020-01-02": head + "2020-01-02,1,2\n" + fine,
    }
    for k, (message, text) in enumerate(faults.items()):
        bad = tmp_path / f"bad{k}.csv"
        bad.write_text(text)
        with pytest.raises(Exception, match=f"bad{k}.csv, {message}"):
            pairs.read_prices(spark, str(bad)).count()


def test_parts_of_a_history_are_put_in_order(spark, tmp_path):
    days = [str(x.date()) for x in pd.bdate_range("2020-01-01", periods=200)]
    for name, part in (("a.csv", days[:30]), ("b.csv", days[30:170]), ("c.csv", days[170:])):
        (tmp_path / name).write_text("date,price_a,price_b\n\n" + "".join(f"{x},1,2\n" for x in part))
    got = pairs.read_prices(spark, str(tmp_path)).orderBy("idx").toPandas()
    assert got.date.tolist() == days and got.idx.tolist() == list(range(200))
    (tmp_path / "d.csv").write_text("date,price_a,price_b\n" + f"{days[-1]},1,2\n")
    with pytest.raises(DataError, match=f"d: starts on {days[-1]}, but the file before it ends on {days[-1]}"):
        pairs.read_prices(spark, str(tmp_path))


def test_tables_come_back(spark, tmp_path):
    rows = bars(spark, 40)
    pairs.write_prices(rows, str(tmp_path / "prices"))
    back = pairs.read_prices(spark, str(tmp_path / "prices")).orderBy("idx").toPandas()
    want = rows.orderBy("idx").toPandas()
    np.testing.assert_allclose(back[["price_a", "price_b"]], want[["price_a", "price_b"]])
    assert back.date.tolist() == want.date.astype(str).tolist()
    table = spark.createDataFrame([("p", 1, 0.125, None), ("q", 2, None, "x")], "pair_id string, idx long, value double, note string")
    pairs.write_table(table, str(tmp_path / "table"))
    assert sorted(map(tuple, pairs.read_table(spark, str(tmp_path / "table"), "pair_id string, idx long, value double, note string").collect())) == [("p", 1, 0.125, None), ("q", 2, None, "x")]
    pairs.write_summary(table.where("idx = 1"), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().value == 0.125


def test_a_trade_needs_two_legs(spark):
    sizes = lambda beta: spark.range(1).select(scalars.quantities(F.lit(100.0), F.lit(0.5), F.lit(beta).cast("double") + F.col("id"), F.lit(10.0), F.lit(5.0))[1].alias("b"))
    assert sizes(-2.0).first().b == 20.0
    for beta in (0.0, None):
        with pytest.raises(Exception, match="hedge ratio must be"):
            sizes(beta).collect()


def test_reports(spark, monkeypatch):
    monkeypatch.setattr(pairs, "derived", lambda spark, d: bars(spark, 1100))
    got = QUERIES["significance_report"](spark, "").first()
    tested = QUERIES["t_test_p_values"](spark, "").first()
    assert (got.n_trades, got.reps) == (tested.n_trades, 2000) and got.p_value == pytest.approx(tested.p_value, abs=1e-5) and got.ci_low < got.sharpe_ratio < got.ci_high
    assert got.is_significant == (got.p_value < 0.05) and f"p = {got.p_value:.3f}" in got.verdict
    got = QUERIES["stability_report"](spark, "").first()
    assert got.n_windows == (1100 - 504) // 21 + 1 and got.drift == pytest.approx(abs(got.beta_second - got.beta_first)) and got.mean_pvalue <= got.max_pvalue
    assert got.is_stable == (got.verdict == "no sign of a break")


def test_bootstrap_leaves_out_undefined_returns(spark):
    moves = series(spark, ret=np.random.default_rng(1).normal(0.001, 0.01, 100))
    gap = spark.createDataFrame([("p", 100, None)], "pair_id string, idx long, ret double")
    a, b = (significance.bootstrap_intervals(significance.bootstrap(x, Config(), 50)).first() for x in (moves, moves.unionByName(gap)))
    assert a == b and a.ci_low < a.ci_high


def test_turnover_without_costs(spark):
    config = Config(commission_bps=0.0, slippage_bps=0.0)
    _, done, _ = backtest.run(signals.signals(bars(spark), config), config)
    assert metrics.trade_metrics(done, config.capital, "pair_id").first().turnover > 0.5


@pytest.mark.parametrize("name", ["bars_daily", "zscore_lagged", "trades", "metrics_nav", "variance_ratio_levels", "kalman_path", "timing_shift_curve", "outcome_filter_curve"])
def test_query_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want, got = con.execute(ORACLE_SQL[name]).df(), QUERIES[name](spark, small).toPandas()
    cols = sorted(got.columns)
    key = [c for c in ("pair_id", "idx", "entry_index", "horizon", "dose") if c in cols]
    assert sorted(want.columns) == cols
    a, b = (x[cols].sort_values(key).reset_index(drop=True) for x in (got, want))
    for c in cols:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=2e-6)
        else:
            assert [str(v)[:10] for v in a[c]] == [str(v)[:10] for v in b[c]]


def test_stability_and_bootstrap_queries_do_the_whole_job(spark, monkeypatch):
    monkeypatch.setattr(pairs, "derived", lambda spark, d: bars(spark, 1100))
    swept = {r.window: r.n_windows for r in QUERIES["break_robustness"](spark, "").collect()}
    assert swept == {w: (1100 - w) // 21 + 1 for w in (252, 378, 504, 630, 756, 882, 1008)}
    assert sorted(r.start_index for r in QUERIES["rolling_eg"](spark, "").collect()) == list(range(0, 1100 - 504 + 1, 21))
    assert [r.reps for r in QUERIES["bootstrap_ci"](spark, "").collect()] == [2000]
