"""Long series: windows by column, shared moments, segments, scans; each against the plain form."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.functions import spans, windows
from tandem.functions.cut import cut
from tandem.operators import backtest, kalman, signals, stability
from tandem.operators.cointegration import correlation_matrix, engle_granger
from tandem.plans import experiments
from test_pairs import bars


def test_moments_of_windows_by_column(spark):
    rng = np.random.default_rng(4)
    frame = pd.concat(pd.DataFrame({"pair_id": p, "place": range(n), "k": k, "x": 1e6 + rng.normal(size=n), "y": rng.normal(size=n).cumsum()}) for p, k, n in (("a", 1, 30), ("b", 7, 100), ("c", 60, 59), ("d", 60, 500), ("e", 500, 500)))
    got = spans.moments(spark.createDataFrame(frame), "k", "x", "y").select("pair_id", "place", "span.*").toPandas().set_index(["pair_id", "place"]).sort_index()
    for (pair, place), row in frame.set_index(["pair_id", "place"]).iterrows():
        k, found = int(row.k), got.loc[pair, place]
        if place + 1 < k:
            assert math.isnan(found.var_x)
            continue
        own = frame[(frame.pair_id == pair) & (frame.place > place - k) & (frame.place <= place)]
        want = own.x.mean(), own.x.var(ddof=0), own.y.mean(), own.y.var(ddof=0), ((own.x - own.x.mean()) * (own.y - own.y.mean())).mean()
        np.testing.assert_allclose([found.mean_x, found.var_x, found.mean_y, found.var_y, found["cov"]], want, atol=1e-9)


def test_rows_are_numbered_over_blocks(spark):
    idx = [5, 6, 9, 20, 21, 40, 100]
    rows = spark.createDataFrame([(p, i) for p in "ab" for i in idx], "pair_id string, idx long")
    got = spans.numbered(rows, ("pair_id",), block=10).toPandas().sort_values(["pair_id", "idx"])
    assert got.place.tolist() == list(range(7)) * 2


def test_signals_with_windows_by_column(spark):
    whole = bars(spark, 260)
    sizes = {"s": (20, 20), "m": (33, 20), "l": (20, 47)}
    table = spark.createDataFrame([(k, *v) for k, v in sizes.items()], "label string, hedge_window int, zscore_window int")
    got = signals.signals_by(whole.crossJoin(table)).toPandas()
    for label, (h, z) in sizes.items():
        want = signals.signals(whole, Config(hedge_window=h, zscore_window=z)).toPandas().sort_values("idx")
        own = got[got.label == label].sort_values("idx")
        assert own.idx.tolist() == want.idx.tolist()
        for c in ("alpha", "beta", "r2", "spread", "z"):
            np.testing.assert_allclose(own[c].to_numpy(float), want[c].to_numpy(float), atol=1e-8)
    # rows after a bar don't matter to it
    part = signals.signals_by(whole.where("idx < 150").crossJoin(table)).select("label", "idx", "z").toPandas().sort_values(["label", "idx"])
    np.testing.assert_array_equal(part.z.to_numpy(), got[got.idx < 150].sort_values(["label", "idx"]).z.to_numpy())


def test_walk_forward_is_one_plan(spark, small, monkeypatch):
    from tandem import queries

    two = bars(spark, 900).unionByName(bars(spark, 900, seed=5).withColumn("pair_id", F.lit("q")))
    got = {r.pair_id: r for r in experiments.walk_forward(two).collect()}
    assert all(r.kept and r.window == round(r.half_life * 5) and r.n_trades > 0 for r in got.values()) and len({r.window for r in got.values()}) == 2
    for name, row in got.items():
        a = two.where(F.col("pair_id") == name).where("idx >= 540").withColumn("idx", F.col("idx") - 540)
        config = Config(hedge_window=row.window, zscore_window=row.window)
        want = experiments.compared(signals.signals(a, config), [("x", config)]).first()
        assert row.sharpe_ratio == pytest.approx(want.sharpe_ratio, abs=1e-7) and row.n_trades == want.n_trades
    found = experiments.walk_forward(queries.with_smoothed(spark, small)).where("kept").count()
    assert found >= 2
    by_ratio = experiments.window_sensitivity(two, (2.0, 6.0)).collect()
    assert len(by_ratio) == 4 and all(r.window == round(r.half_life * r.window_ratio) for r in by_ratio)




def test_rolling_tests_equal_refits(spark):
    two = bars(spark, 700).unionByName(bars(spark, 433, seed=8).withColumn("pair_id", F.lit("q")))
    windows = (60, 126, 252)
    # stretches of 252 starts, so that windows reach over their ends
    got = stability.rolled(two, windows, 21, segment=256).toPandas()
    for name, n in (("p", 700), ("q", 433)):
        own = two.where(F.col("pair_id") == name).orderBy("idx").toPandas()
        a, b = np.log(own.price_a.to_numpy()), np.log(own.price_b.to_numpy())
        for w in windows:
            rows = got[(got.pair_id == name) & (got.window == w)].sort_values("start_index")
            assert rows.start_index.tolist() == list(range(0, n - w + 1, 21)) and (rows.end_index - rows.start_index == w - 1).all()
            for r in rows.itertuples():
                tau, p, beta = engle_granger(a[r.start_index : r.end_index + 1], b[r.start_index : r.end_index + 1])
                assert (r.statistic, r.eg_pvalue, r.hedge_ratio) == pytest.approx((tau, p, beta), abs=1e-8)


def test_rolling_tests_of_flat_and_exact_legs(spark):
    rng = np.random.default_rng(1)
    b = np.exp(np.cumsum(rng.normal(0, 0.01, 120)))
    frame = lambda name, a: pd.DataFrame({"pair_id": name, "idx": range(120), "price_a": a, "price_b": b})
    rows = spark.createDataFrame(pd.concat([frame("flat", np.full(120, 5.0)), frame("exact", 3 * b**2)]))
    got = stability.rolled(rows, (60,), 20).toPandas()
    assert set(got.pair_id) == {"exact"} and got.hedge_ratio.to_numpy() == pytest.approx(2.0)


def test_robustness_counts_changes_of_sign(spark):
    got = stability.robustness(bars(spark, 700), (63, 126, 252)).orderBy("window").collect()
    signs = [np.sign(r.deterioration) for r in got]
    changes = sum(x != y for x, y in zip(signs, signs[1:], strict=False))
    assert [r.window for r in got] == [63, 126, 252] and {r.sign_changes for r in got} == {changes} == {sum(r.sign_change for r in got)}


Z = st.lists(st.one_of(st.floats(-5, 5), st.sampled_from([math.nan, 0.0, 2.5, -2.5, 4.0])), min_size=1, max_size=60)


@settings(max_examples=300, deadline=None)
@given(Z, st.integers(0, 60), st.integers(1, 9), st.sets(st.integers(0, 60)), st.integers(0, 3))
def test_a_segment_maps_every_state_as_the_fold_does(z, cut, longest, skip, gap):
    z, rule = np.array(z), (2.0, 0.5, 3.5, longest)
    border = len(z) + gap
    _, state = backtest.replay(np.arange(len(z)), z, *rule, frozenset(skip))
    later = np.array([2.5, 2.5, 0.1, -2.2, np.nan, -2.2, 1.0, -4.0] * 2)[: 3 + cut % 13]
    idx = np.arange(len(later)) + border
    want, left = backtest.replay(idx, later, *rule, frozenset(skip), state)
    found = backtest.transitions(idx, later, *rule, frozenset(skip), border)[backtest.place_of(state, longest, border)]
    since = state[1] if found[1] is None else found[1]
    assert (found[0], found[2], found[3]) == (left[0], left[2], left[3]) and (not left[0] or since == left[1])
    assert len(backtest.states(longest, border)) == 6 + 2 * (longest + 1) + 6


@pytest.mark.parametrize("segment", [7, 50, 1000])
def test_trips_don_t_hang_on_the_cuts(spark, segment):
    rng = np.random.default_rng(6)
    frames, want = [], []
    for name, n, hold in (("a", 400, 6), ("b", 333, 20), ("c", 5, 3)):
        z = np.convolve(rng.normal(size=n + 4), np.ones(5) / 1.5, "valid")[:n]
        z[rng.random(n) < 0.05] = np.nan
        skip = rng.random(n) < 0.1
        # idx has gaps, so that a cut may fall into one
        idx = np.cumsum(rng.integers(1, 3, n)) - 1
        frames.append(pd.DataFrame({"pair_id": name, "label": "x", "idx": idx, "z": z, "entry": 1.5, "exit": 0.4, "stop": 3.0, "max_holding": hold, "skip": skip}))
        trips = backtest.round_trips(idx, z, 1.5, 0.4, 3.0, hold, frozenset(idx[skip].tolist()))
        want += [(name, k, "long_spread" if d == 1 else "short_spread", a, b, reason) for k, (d, a, b, reason) in enumerate(trips)]
    got = backtest.path(spark.createDataFrame(pd.concat(frames)), segment).select("pair_id", "trade", "direction", "entry_index", "exit_index", "exit_reason").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20


@pytest.mark.parametrize("f", [kalman.Filter(), kalman.Filter(state=0.0), kalman.Filter(observation=1e-2, state=1e-3, alpha=2.0, beta=-1.0, start=50.0)])
def test_filter_by_segments(spark, f):
    whole = bars(spark, 500)
    frame = whole.orderBy("idx").toPandas()
    want = kalman.filtered(np.log(frame.price_a.to_numpy()), np.log(frame.price_b.to_numpy()), f)
    for segment in (1, 64, 10_000) if f.state else (77,):
        got = kalman.kalman(whole, f, segment).orderBy("idx").toPandas()
        np.testing.assert_allclose(got[["alpha", "beta", "prediction", "innovation", "innovation_variance"]].to_numpy(), want, atol=1e-9)


def test_elements_can_be_joined_in_any_grouping():
    rng = np.random.default_rng(2)
    e = kalman.steps(rng.normal(4, 0.1, 21), rng.normal(3, 0.1, 21), kalman.Filter())
    at = lambda k: tuple(x[k] for x in e)
    one = at(0)
    for k in range(1, 21):
        one = kalman.joined(one, at(k))
    for x, y in zip(one, kalman.reduced(e), strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-8, atol=1e-10)


def test_nearest_ranks_over_ranges(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=501), 1)
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    got = {r.share: r.value for r in kalman.nearest_rank(rows, "v", (0.0, 0.1, 0.5, 0.99, 1.0)).collect()}
    assert got == {s: np.sort(values)[math.floor(s * 500)] for s in (0.0, 0.1, 0.5, 0.99, 1.0)}
    assert [r.value for r in kalman.nearest_rank(rows.where("v is null"), "v").collect()] == [None] * 5


def test_cash_of_a_million_bars(spark):
    n, r = 1_000_000, Config().rate
    rng = np.random.default_rng(7)
    flow = np.where(rng.random(n) < 0.01, rng.normal(0, 2e4, n), 0.0)
    rows = spark.range(n, numPartitions=8).select(F.lit("p").alias("pair_id"), F.lit("x").alias("label"), F.col("id").alias("idx"), F.lit(1e5).alias("capital"))
    flows = spark.createDataFrame(pd.DataFrame({"idx": np.flatnonzero(flow), "flow": flow[flow != 0]}))
    got = backtest.with_cash(rows.join(flows, "idx", "left").fillna(0.0, ["flow"]), r).select("idx", "cash")
    # the value of money grows by e^155 over a million bars, so digits are compared
    cash, want, shown = 1e5, {}, set(range(0, n, 50_021)) | {0, 1, 1023, 1024, 1025, n - 1}
    for t in range(n):
        cash = (cash * (1 + r) if t else cash) + flow[t]
        if t in shown:
            want[t] = cash
    found = {x.idx: x.cash for x in got.where(F.col("idx").isin(sorted(shown))).collect()}
    assert found.keys() == want.keys() and all(found[t] == pytest.approx(want[t], rel=1e-9, abs=0.01) for t in want)
    # with interest off a cent is a cent
    plain = backtest.with_cash(rows.join(flows, "idx", "left").fillna(0.0, ["flow"]), 0.0).where(F.col("idx") == n - 1).first().cash
    assert plain == pytest.approx(1e5 + flow.sum(), abs=0.01)


def test_a_broken_account_stops_the_run(spark, tmp_path):
    config = Config(hedge_window=20, zscore_window=20, entry=1.0, exit=0.2, stop=4.0)
    rows, done, audit = backtest.run(signals.signals(bars(spark, 1500), config), config)
    assert audit.count() == 1500 and backtest.identity_violations(audit).isEmpty()
    # a position that isn't what was paid for
    planted = done.withColumn("qty_b", F.when(F.col("trade") == 1, F.col("qty_b") * 1.5).otherwise(F.col("qty_b")))
    with pytest.raises(Exception, match="don't add up at bar"):
        backtest.audit(rows, planted, config).write.parquet(f"{tmp_path}/audit")
    # the check is in the plan that writes: nothing is scanned again for it
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans(backtest.reconciled(done.sparkSession.createDataFrame([], audit.schema))) == 1
    # across the borders of blocks too
    one = audit.withColumn("nav", F.when(F.col("idx") >= 1024, F.col("nav") + 1.0).otherwise(F.col("nav"))).withColumn("cash", F.col("nav") - F.col("position_value"))
    assert [r.idx for r in backtest.identity_violations(one).collect()] == [1024]


def test_reading_ahead_is_found_anywhere_in_a_plan(spark):
    rows = spark.createDataFrame([("p", k, float(k)) for k in range(9)], "pair_id string, idx long, x double")
    w = windows.ordered()
    wide = rows.withColumns({f"m{k}": windows.mean("x", k + 2) for k in range(40)})
    assert windows.assert_causal(wide) is wide
    ahead = {
        "after 40 others": wide.withColumn("bad", F.lead("x").over(w)),
        "among 40 others": rows.withColumn("bad", F.lead("x").over(w)).withColumns({f"m{k}": windows.mean("x", k + 2) for k in range(40)}),
        "dropped again": wide.withColumn("bad", F.lag("x", -2).over(w)).withColumn("y", F.col("bad") + 1).drop("bad"),
        "backwards": rows.withColumn("bad", F.lag("x").over(Window.partitionBy("pair_id").orderBy(F.desc("idx")))),
        "backwards sum": rows.withColumn("bad", F.sum("x").over(Window.partitionBy("pair_id").orderBy(F.desc("idx")).rowsBetween(-3, 0))),
        "no order": rows.withColumn("bad", F.avg("x").over(Window.partitionBy("pair_id"))),
        "by value": rows.withColumn("bad", F.row_number().over(Window.partitionBy("pair_id").orderBy("x"))),
        "by range": rows.withColumn("bad", F.sum("x").over(w)),
        "in a joined side": rows.join(rows.select("idx", F.lead("x").over(w).alias("bad")), "idx"),
        "a fold": rows.groupBy("pair_id").applyInPandas(lambda g: g, rows.schema),
    }
    for name, df in ahead.items():
        with pytest.raises(windows.LookaheadError):
            windows.assert_causal(df)
        with pytest.raises(windows.LookaheadError):
            windows.assert_causal(cut(df).withColumn("m", windows.mean("x", 2)))
        assert name
    # backwards twice is forwards
    windows.assert_causal(rows.withColumn("fine", F.lead("x").over(Window.partitionBy("pair_id").orderBy(F.desc("idx")))))
    windows.assert_causal(cut(wide).withColumn("again", windows.mean("m3", 4)))
    with pytest.raises(windows.LookaheadError, match="unknown plan"):
        windows.assert_causal(wide.checkpoint())

    def fold(g):
        return g

    windows.assert_causal(rows.groupBy("pair_id").applyInPandas(fold, rows.schema), trusted=("fold",))


def test_correlations_by_blocks(spark):
    rng = np.random.default_rng(5)
    n, days = 30, 90
    price = np.exp(np.cumsum(rng.normal(0, 0.01, (n, days)) + rng.normal(0, 0.01, days), axis=1))
    rows = [(f"a{k:02d}", t, float(price[k, t])) for k in range(n) for t in range(days) if k != 7 or t < 60]
    rows += [("flat", t, 5.0) for t in range(days)] + [("late", t, float(t + 1)) for t in range(60, days)]
    frame = pd.DataFrame(rows, columns=["asset", "idx", "price"]).pivot(index="idx", columns="asset", values="price")
    moves = np.log(frame).diff()
    table = spark.createDataFrame(rows, "asset string, idx long, price double")
    got = {(r.asset_a, r.asset_b): r for r in correlation_matrix(table, side=8, days=25).collect()}
    for i, a in enumerate(frame.columns):
        for b in frame.columns[i + 1 :]:
            both = moves[[a, b]].dropna()
            if both.empty:
                assert (a, b) not in got
                continue
            r = got.pop((a, b))
            assert r.n_obs == len(both)
            assert r.corr is None if "flat" in (a, b) else r.corr == pytest.approx(both[a].corr(both[b]), abs=1e-9)
    assert not got
    some = correlation_matrix(table, 0.6, side=8, days=25).collect()
    assert some and all(abs(r.corr) >= 0.6 for r in some)


def test_five_thousand_assets_meet_in_blocks(spark):
    n, days = 5000, 12
    noise = F.randn(3)
    table = spark.range(n * days, numPartitions=4).select(F.format_string("a%04d", F.floor(F.col("id") / days).cast("int")).alias("asset"), (F.col("id") % days).alias("idx"), F.exp(noise).alias("price"))
    found = correlation_matrix(table, 0.99)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and not any("idx" in x for x in joins)
    assert all(abs(r.corr) >= 0.99 and r.asset_a < r.asset_b for r in found.collect())
