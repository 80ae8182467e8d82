"""Files as a data source, candidate pairs, and intents from outside."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tandem.config import Config, DataError
from tandem.operators import backtest, cointegration, metrics, signals
from tandem.sources import files, pairs
from test_pairs import bars

CONFIG = Config(hedge_window=20, zscore_window=20, entry=1.0, exit=0.2, stop=4.0)


def test_tables_make_the_round_trip(spark, tmp_path):
    two = bars(spark, 200).unionByName(bars(spark, 150, seed=4).withColumn("pair_id", F.lit("q")))
    _, done, audit = backtest.run(signals.signals(two, CONFIG), CONFIG, keep=True)
    long = metrics.long_form(metrics.metrics(audit, done, CONFIG, "pair_id"), "pair_id")
    for table, df, write, read in (("bars", audit, pairs.write_bars, pairs.read_bars), ("trades", done, pairs.write_trades, pairs.read_trades)):
        write(df, f"{tmp_path}/{table}")
        names = [n for n, _ in files.spark_columns(table)]
        assert sorted(p.name for p in (tmp_path / table).iterdir()) == ["p.csv", "q.csv"]
        key = ["pair_id", files.ORDER[table]]
        got, want = (x.select(names).toPandas().sort_values(key).reset_index(drop=True) for x in (read(spark, f"{tmp_path}/{table}"), df))
        for c, t in files.spark_columns(table):
            if t == "double":
                np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9)
            else:
                assert got[c].astype(str).tolist() == want[c].astype(str).tolist()
    pairs.write_metrics(long, f"{tmp_path}/metrics")
    got = {r.pair_id: r.metrics for r in pairs.read_metrics(spark, f"{tmp_path}/metrics").collect()}
    want = {r.pair_id: r for r in metrics.metrics(audit, done, CONFIG, "pair_id").collect()}
    assert got.keys() == want.keys() and all(got[p]["final_nav"] == pytest.approx(want[p].final_nav) and len(got[p]) == 30 for p in got)
    with pytest.raises(DataError, match="needs the columns"):
        pairs.write_trades(audit, f"{tmp_path}/none")
    with pytest.raises(DataError, match="no table is called"):
        files.read(spark, str(tmp_path), "fees")


def test_faults_of_result_files(spark, tmp_path):
    head = "metric,value\n"
    for k, (text, message) in enumerate(((head + "a,1\nb\n", "line 3: 1 fields where 2 belong"), (head + "a,x\n", "line 2: value should be a number"), (head + "a,\n", "line 2: value has no value"), ("value,metric\n1,a\n", "line 1: the columns should be metric,value"))):
        (tmp_path / f"m{k}.csv").write_text(text)
        with pytest.raises(Exception, match=f"m{k}.csv, {message}"):
            pairs.read_metrics(spark, f"{tmp_path}/m{k}.csv").collect()
    with pytest.raises(Exception, match="no such file"):
        pairs.read_trades(spark, f"{tmp_path}/missing").collect()


def test_a_folder_of_a_thousand_files(spark, tmp_path):
    for k in range(1000):
        (tmp_path / f"pair{k:04d}.csv").write_text("date,price_a,price_b\n" + "".join(f"2020-01-{d:02d},{k + d},2\n" for d in (1, 2, 3)))
    rows = files.read(spark, str(tmp_path), "prices").coalesce(4)
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    got = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.max_by("price_a", "idx").alias("last")).toPandas().sort_values("pair_id")
    assert len(got) == 1000 and (got.n == 3).all() and got["last"].tolist() == [k + 3 for k in range(1000)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.format_string("p%d", F.col("id") % 4).alias("pair_id"), F.format_string("m%02d", "id").alias("metric"), F.when(F.col("id") < 39, F.col("id") * 1.0).otherwise(F.raise_error(F.lit("planted")).cast("double")).alias("value"))
    with pytest.raises(Exception, match="planted"):
        pairs.write_metrics(rows, f"{tmp_path}/out")
    assert not (tmp_path / "out").exists() or not [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]


def test_outcomes_of_candidates(spark):
    days = pd.bdate_range("2020-01-01", periods=300).date
    rows = [(a, d, float(k + 1)) for a, n in (("long", 300), ("also", 250), ("short", 40)) for k, d in enumerate(days[:n])]
    rows += [("zero", d, 0.0 if k == 5 else 1.0) for k, d in enumerate(days)] + [("none", days[0], None)] + [("flat", d, 2.0) for d in days]
    closes = spark.createDataFrame(rows, "asset string, date date, close double")
    asked = [("long", "also"), ("long", "also"), ("long", "short"), ("long", "zero"), ("none", "long"), ("long", "unheard"), ("long", None), ("long", "flat")]
    wanted = spark.createDataFrame(asked, "asset_a string, asset_b string")
    got = {(r.asset_a, r.asset_b): (r.ok, r.n_dates, r.reason) for r in pairs.outcomes(closes, wanted).collect()}
    assert got == {
        ("long", "also"): (True, 250, ""),
        ("long", "short"): (False, 40, "40 dates in common, 200 needed"),
        ("long", "zero"): (False, 300, "1 dates without positive prices"),
        ("none", "long"): (False, 0, "no closes of none"),
        ("long", "unheard"): (False, 0, "no closes of unheard"),
        ("long", None): (False, 0, "no closes of ?"),
        ("long", "flat"): (True, 300, ""),
    }
    ready = pairs.joined(closes, wanted).groupBy("pair_id").agg(F.count("*").alias("n"), F.max("idx").alias("last")).collect()
    assert {(r.pair_id, r.n, r["last"]) for r in ready} == {("long|also", 250, 249), ("long|flat", 300, 299)}
    told = {r.outcome for r in cointegration.screen_outcomes(closes, wanted, 0.5).collect()}
    assert {"tested", "flat leg", "no closes of none"} <= told


def by_hand(asked):
    """(trips, events) of one series, bar by bar."""
    side, since, trips, events = None, None, [], {}
    for t in range(len(asked)):
        kind, _, what = (asked[t - 1] if t else "hold").partition(":")
        if kind == "enter" and side:
            events[t] = "ignored_enter_while_open"
        elif kind in ("enter", "flip") and not side:
            side, since, events[t] = what, t, f"entry:{what}"
        elif kind == "flip":
            trips.append((side, since, t, "reversion"))
            side, since, events[t] = what, t, f"flip:{what}"
        elif kind == "exit" and side:
            trips.append((side, since, t, what))
            side, events[t] = None, f"exit:{what}"
    if side:
        last = len(asked) - 1
        trips.append((side, since, last, "end_of_data"))
        events[last] = ";".join([*([events[last]] if last in events else []), "exit:end_of_data"])
    return trips, events


def test_intents_from_outside(spark):
    rng = np.random.default_rng(8)
    kinds = ["hold", "enter:long_spread", "enter:short_spread", "exit:stop_loss", "exit:reversion", "flip:long_spread", "flip:short_spread", None]
    series = {f"s{k}": [kinds[i] for i in rng.integers(0, 8 if k % 2 else 5, 1 + 7 * k)] for k in range(12)}
    series["last"] = ["hold", "enter:long_spread", "flip:short_spread", "enter:long_spread"]
    rows = spark.createDataFrame([(p, "x", t, i) for p, xs in series.items() for t, i in enumerate(xs)], "pair_id string, label string, idx long, intent string")
    trips, events = backtest.executed(rows)
    want = {p: by_hand([x or "hold" for x in xs]) for p, xs in series.items()}
    got = sorted((r.pair_id, r.trade, r.direction, r.entry_index, r.exit_index, r.exit_reason) for r in trips.collect())
    assert got == sorted((p, k, *t) for p, (ts, _) in want.items() for k, t in enumerate(ts))
    assert {(r.pair_id, r.idx): r.trade_event for r in events.collect()} == {(p, t): e for p, (_, es) in want.items() for t, e in es.items()}
    assert want["last"][1] == {2: "entry:long_spread", 3: "flip:short_spread;exit:end_of_data"}


def test_accounts_of_intents_add_up(spark):
    rows = signals.signals(bars(spark, 200), CONFIG).withColumns({"label": F.lit("x"), "intent": F.when(F.col("idx") % 9 == 3, "enter:long_spread").when(F.col("idx") % 9 == 6, "flip:short_spread").otherwise("hold")}).withColumn("intent", F.when(F.col("idx") < 60, "hold").otherwise(F.col("intent")))
    _, done, audit = backtest.run_intents(rows, CONFIG)
    assert done.count() > 10 and backtest.identity_violations(audit).isEmpty()
    seen = {r.trade_event for r in audit.collect()}
    assert {"entry:short_spread", "flip:short_spread", "ignored_enter_while_open"} <= seen
