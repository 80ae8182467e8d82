"""The signal and the trading rule on a stream of bars: state per pair, one row out per bar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config
from ..functions.windows import MIN_STDDEV, MIN_VARIANCE
from ..operators.backtest import decide

OUT = "pair_id string, idx long, beta double, spread double, z double, position string, event string"
STATE = "last long, log_a array<double>, log_b array<double>, spreads array<double>, direction int, since long, pending string"


def live(bars: DataFrame, config: Config) -> DataFrame:
    """Bars (pair_id, idx, price_a, price_b) to signals, positions and events, append mode.

    A trigger's bars are put in order; a bar that isn't after the last one of its pair is late and
    dropped, as order is what the windows stand on. State is two windows and a position per pair.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, log_a, log_b, spreads, direction, since, pending = state.get if state.exists else (-1, [], [], [], 0, -1, "hold")
        log_a, log_b, spreads, rows = list(log_a), list(log_b), list(spreads), []
        every = pd.concat(list(batches)).sort_values("idx")
        for t, pa, pb in zip(every.idx, every.price_a, every.price_b, strict=True):
            if t <= last:
                continue
            last, event = int(t), ""
            if pending in ("long", "short"):
                direction, since, event = (1 if pending == "long" else -1), last, f"entry:{pending}_spread"
            elif pending != "hold":
                direction, event = 0, f"exit:{pending}"
            log_a, log_b = (log_a + [float(np.log(pa))])[-config.hedge_window :], (log_b + [float(np.log(pb))])[-config.hedge_window :]
            beta = spread = z = None
            if len(log_a) == config.hedge_window:
                x, y = np.array(log_b), np.array(log_a)
                if x.var() >= MIN_VARIANCE:
                    beta = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
                    spread = float(y[-1] - (y.mean() - beta * x.mean()) - beta * x[-1])
                    if len(spreads) == config.zscore_window and (sd := np.std(spreads, ddof=1)) >= MIN_STDDEV:
                        z = float((spreads[-1] - np.mean(spreads)) / sd)
                    spreads = (spreads + [spread])[-config.zscore_window :]
            pending = decide(float("nan") if z is None else z, direction, last - since, config.entry, config.exit, config.stop, config.max_holding)
            rows.append((key[0], last, beta, spread, z, {1: "long_spread", -1: "short_spread", 0: "flat"}[direction], event))
        state.update((last, log_a, log_b, spreads, direction, since, pending))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return bars.groupBy("pair_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
