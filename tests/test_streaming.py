"""The streaming form gives what the batch form gives."""

import numpy as np
import pandas as pd

from tandem.config import Config
from tandem.operators import backtest, signals
from tandem.streaming.live import live


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    n = 160
    trend, noise = np.cumsum(rng.normal(0, 0.01, n)), rng.normal(0, 0.01, n)
    frame = pd.DataFrame({"pair_id": "p", "idx": np.arange(n), "date": pd.bdate_range("2020-01-01", periods=n).date, "price_a": np.exp(4 + trend + noise), "price_b": np.exp(3 + trend)})
    bars, config = spark.createDataFrame(frame), Config(hedge_window=20, zscore_window=20, entry=1.5)
    for k in range(4):  # a file per trigger; the last one also brings late bars
        part = bars.where(f"idx >= {k * 40} and idx < {k * 40 + 40}")
        (part if k < 3 else part.union(bars.where("idx < 5"))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = live(stream.select("pair_id", "idx", "price_a", "price_b"), config).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("live").toPandas().sort_values("idx").reset_index(drop=True)
    rows = signals.signals(bars, config)
    want = rows.select("idx", "beta", "spread", "z").toPandas().sort_values("idx").reset_index(drop=True)
    assert got.idx.tolist() == list(range(n))
    for c in ("beta", "spread", "z"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-8)
    _, done, _ = backtest.run(rows, config)
    opened = {r.entry_index: f"entry:{r.direction}" for r in done.collect()}
    assert {r.idx: r.event for r in got.itertuples() if r.event.startswith("entry")} == opened
