"""Does a pair's relation hold over time: rolling cointegration, recursive residuals, halves, window sweeps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.pairs import log_prices
from .cointegration import engle_granger, least_squares, mackinnon_p

#: Constants of the boundary lines by confidence level (Brown, Durbin and Evans 1975).
BOUNDARY = {0.90: 0.850, 0.95: 0.948, 0.99: 1.143}
SWEEP = (252, 378, 504, 630, 756, 882, 1008)
DETERIORATION = 0.3


#: Window starts of a pair that one task works on.
SEGMENT = 4096
ROLLED = "pair_id string, window long, start_index long, end_index long, statistic double, eg_pvalue double, hedge_ratio double"


class SharedMoments:
    """Engle-Granger tests of windows of one stretch of bars, from moments that all of them share.

    Row d of the design holds 1, both log prices at d, and the changes of both from d - k to d - k + 1 for k = 0, 1 and so on: residuals
    and their lagged changes are combinations of its columns, whatever the window's regression. Sums of its outer products over
    every ``step`` rows are cumulated; a window is the difference of two of them, less a few rows at its ends, so its regression,
    the choice of lags and the test need no pass over its bars.
    """

    def __init__(self, log_a: np.ndarray, log_b: np.ndarray, lags: int, step: int):
        self.a, self.b, self.lags, self.step = log_a, log_b, lags, step
        # an origin inside the stretch keeps what the differences cancel small
        a, b = log_a - log_a.mean(), log_b - log_b.mean()
        m = len(a) - 1
        self.rows = np.zeros((m, 3 + 2 * (lags + 1)))
        self.rows[:, 0], self.rows[:, 1], self.rows[:, 2] = 1, a[:m], b[:m]
        for k in range(lags + 1):
            self.rows[k:, 3 + 2 * k], self.rows[k:, 4 + 2 * k] = np.diff(a)[: m - k], np.diff(b)[: m - k]
        blocks = self.rows[: m // step * step].reshape(-1, step, self.rows.shape[1])
        self.sums = np.concatenate([np.zeros((1, *2 * [self.rows.shape[1]])), np.cumsum(np.matmul(blocks.transpose(0, 2, 1), blocks), axis=0)])

    def gram(self, lo: int, hi: int) -> np.ndarray:
        """Sum of outer products of rows lo to hi."""
        i, j = -(-lo // self.step), hi // self.step
        if i > j:
            return self.rows[lo:hi].T @ self.rows[lo:hi]
        head, tail = self.rows[lo : i * self.step], self.rows[j * self.step : hi]
        return self.sums[j] - self.sums[i] + head.T @ head + tail.T @ tail

    def test(self, lo: int, n: int) -> tuple[float, float] | None:
        """(statistic, hedge ratio) of bars lo to lo + n; None where a leg is flat."""
        own = self.gram(lo, lo + n - 1)
        last = np.array([1, self.rows[lo + n - 2, 1] + self.rows[lo + n - 2, 3], self.rows[lo + n - 2, 2] + self.rows[lo + n - 2, 4]])
        level = own[:3, :3] + np.outer(last, last)
        centred = level[1:, 1:] - np.outer(level[0, 1:], level[0, 1:]) / n
        if min(centred[0, 0], centred[1, 1]) < 1e-24 * n:
            return None
        beta = centred[0, 1] / centred[1, 1]
        alpha = (level[0, 1] - beta * level[0, 2]) / n
        most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)

        def normal(first: int, lags: int) -> tuple[np.ndarray, np.ndarray, float]:
            # columns of the regression: the residual, then its lagged changes; the change itself is the left side
            mix = np.zeros((self.rows.shape[1], lags + 2))
            mix[:3, 0] = -alpha, 1, -beta
            for k in range(lags + 1):
                mix[3 + 2 * k, k + 1], mix[4 + 2 * k, k + 1] = 1, -beta
            g = mix.T @ self.gram(lo + first, lo + n - 1) @ mix
            use = [0, *range(2, lags + 2)]
            return g[np.ix_(use, use)], g[use, 1], float(g[1, 1])

        g, target, total = normal(most, most)
        count = n - 1 - most
        # sums of squares of all numbers of lags from one triangular factor
        found = np.linalg.solve(np.linalg.cholesky(g), target)
        left = total - np.cumsum(found**2)
        if left[-1] <= 1e-10 * total:
            raise np.linalg.LinAlgError("residuals too small for moments")
        lags = int(np.argmin(count * np.log(left / count) + 2 * np.arange(1, most + 2)))
        g, target, total = normal(lags, lags)
        inverse = np.linalg.inv(g)
        b = inverse @ target
        error = (total - b @ target) / (n - 1 - lags - len(b))
        return float(b[0] / np.sqrt(error * inverse[0, 0])), float(beta)


def rolled(bars: DataFrame, windows: tuple[int, ...], step: int, segment: int = SEGMENT) -> DataFrame:
    """The test on all windows of each of some lengths that start every ``step`` bars, in one pass. A stretch of ``segment`` starts is a
    task; the bars that its last windows reach into the next stretch are the only ones that come twice."""
    if min(windows) < 30 or step < 1:
        raise ValueError("a window has at least 30 bars, a step at least one")
    longest = max(windows)
    size = max(segment, longest) // step * step
    size += step * (size < longest)
    lags = max(min(int(np.ceil(12 * (w / 100) ** 0.25)), w // 2 - 2) for w in windows)
    at = F.floor(F.col("idx") / size)
    twice = (F.pmod(F.col("idx"), F.lit(size)) < longest - 1) & (at > 0)
    placed = log_prices(bars).select("pair_id", "idx", "log_a", "log_b", F.explode(F.when(twice, F.array(at - 1, at)).otherwise(F.array(at))).alias("stretch"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        a, b, start = group.log_a.to_numpy(), group.log_b.to_numpy(), key[1] * size
        out = []
        if len(a) >= min(windows):
            shared = SharedMoments(a, b, lags, step)
            for n in windows:
                for lo in range(0, min(size, len(a) - n + 1), step):
                    try:
                        found = shared.test(lo, n)
                    except np.linalg.LinAlgError:
                        # a nearly exact relation: moments can't tell it from none, the bars can
                        found = engle_granger(a[lo : lo + n], b[lo : lo + n])[::2]
                    if found:
                        out.append((key[0], n, start + lo, start + lo + n - 1, found[0], mackinnon_p(found[0], 2), found[1]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in ROLLED.split(", ")])

    return placed.groupBy("pair_id", "stretch").applyInPandas(run, ROLLED)


def rolling_engle_granger(bars: DataFrame, window: int = 504, step: int = 21, alpha: float = 0.05) -> DataFrame:
    """The test on windows that start every ``step`` bars; those in which a leg is flat are left out."""
    found = rolled(bars, (window,), step).select("pair_id", "start_index", "end_index", "eg_pvalue", "hedge_ratio")
    return found.withColumn("is_cointegrated", F.col("eg_pvalue") < alpha)


def recursive_residuals(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One-step forecast errors of regressions on all rows before, in standard deviations of their own."""
    k = x.shape[1]
    inverse = np.linalg.pinv(x[:k].T @ x[:k])
    b = inverse @ (x[:k].T @ y[:k])
    out = np.empty(len(y) - k)
    for t in range(k, len(y)):
        h = inverse @ x[t]
        scale = 1 + x[t] @ h
        error = y[t] - x[t] @ b
        out[t - k] = error / np.sqrt(scale)
        inverse = inverse - np.outer(h, h) / scale
        b = b + h * (error / scale)
    return out


PATH = "pair_id string, idx long, cusum double, bound double, excursion double"


def cusum(bars: DataFrame, level: float = 0.95) -> DataFrame:
    """Cumulated recursive residuals of the error-correction regression, and their boundary, per bar."""
    if level not in BOUNDARY:
        raise ValueError(f"the boundary is known for {sorted(BOUNDARY)} only")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        a, b, idx = group.log_a.to_numpy(), group.log_b.to_numpy(), group.idx.to_numpy()
        names = [c.split()[0] for c in PATH.split(", ")]
        if len(a) < 30 or np.diff(b).std() < 1e-12:
            return pd.DataFrame(columns=names)
        gap = least_squares(np.column_stack([np.ones(len(b)), b]), a)[1]
        x = np.column_stack([np.ones(len(b) - 1), np.diff(b), gap[:-1]])
        w = recursive_residuals(x, np.diff(a))
        m = len(w)
        path = np.cumsum(w) / w.std(ddof=1)
        bound = BOUNDARY[level] * (np.sqrt(m) + 2 * np.arange(1, m + 1) / np.sqrt(m))
        return pd.DataFrame(dict(zip(names, (group.pair_id.iloc[0], idx[-m:], path, bound, np.abs(path) / bound), strict=True)))

    return log_prices(bars).select("pair_id", "idx", "log_a", "log_b").groupBy("pair_id").applyInPandas(run, PATH)


def cusum_summary(path: DataFrame) -> DataFrame:
    out = F.col("excursion") > 1
    return path.groupBy("pair_id").agg(F.max("excursion").alias("max_excursion"), F.min(F.when(out, F.col("idx"))).alias("break_index"), F.coalesce(F.bool_or(out), F.lit(False)).alias("crossed"))


def half_betas(bars: DataFrame) -> DataFrame:
    """Slopes of the first and second half; the first is the shorter one. Null under ten bars or where leg B is flat."""
    n = F.count("*").over(Window.partitionBy("pair_id"))
    rows = log_prices(bars).withColumn("half", F.when(F.col("idx") < F.floor(n / 2), 1).otherwise(2))
    slope = F.when((F.count("*") >= 10) & (F.stddev_pop("log_b") >= 1e-12), F.regr_slope("log_a", "log_b"))
    per = rows.groupBy("pair_id", "half").agg(slope.alias("beta"))
    return per.groupBy("pair_id").agg(*(F.max(F.when(F.col("half") == h, F.col("beta"))).alias(f"beta_{name}") for h, name in ((1, "first"), (2, "second"))))


def rates(rolling: DataFrame, *keys: str) -> DataFrame:
    """Share of windows that are cointegrated: of all, of the first and second half of them, and the decline."""
    keys = keys or ("pair_id",)
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy("start_index"))
    rows = rolling.withColumns({"place": place, "n": F.count("*").over(w)})
    hit = F.col("is_cointegrated").cast("double")
    early = F.col("place") <= F.floor(F.col("n") / 2)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg(hit).alias("rate"), F.avg(F.when(early, hit)).alias("first_rate"), F.avg(F.when(~early, hit)).alias("second_rate"), F.avg("eg_pvalue").alias("mean_pvalue"), F.max("eg_pvalue").alias("max_pvalue"), F.min(F.when(~F.col("is_cointegrated"), F.col("end_index"))).alias("first_failure"))
    return out.withColumn("deterioration", F.col("first_rate") - F.col("second_rate"))


def analyse(bars: DataFrame, window: int = 504, step: int = 21) -> DataFrame:
    """One row per pair; stable means no crossing and no decline by DETERIORATION or more."""
    out = cusum_summary(cusum(bars)).join(half_betas(bars), "pair_id", "left").join(rates(rolling_engle_granger(bars, window, step)), "pair_id", "left")
    out = out.fillna(0, ["n_windows"])
    drift = F.abs(F.col("beta_second") - F.col("beta_first"))
    stable = ~F.col("crossed") & (F.coalesce("deterioration", F.lit(0.0)) < DETERIORATION)
    crossing = F.when(F.col("crossed"), F.format_string("residuals leave their bounds at bar %d", "break_index"))
    decline = F.when(F.col("deterioration") >= DETERIORATION, F.format_string("cointegrated windows fall from %.0f %% to %.0f %%", F.col("first_rate") * 100, F.col("second_rate") * 100))
    return out.withColumns({"drift": drift, "is_stable": stable, "verdict": F.when(stable, "no sign of a break").otherwise(F.concat_ws("; ", crossing, decline))})


def robustness(bars: DataFrame, windows: tuple[int, ...] = SWEEP, step: int = 21, alpha: float = 0.05) -> DataFrame:
    """Decline by window length, all lengths from the same moments; a verdict that hangs on one window isn't one. ``sign_changes`` counts,
    per pair, how often the decline changes its sign from one length to the next."""
    found = rolled(bars, windows, step).withColumn("is_cointegrated", F.col("eg_pvalue") < alpha)
    out = rates(found, "pair_id", "window").select("pair_id", F.col("window").cast("int").alias("window"), "n_windows", "first_rate", "second_rate", "deterioration")
    pair = Window.partitionBy("pair_id")
    sign = F.signum("deterioration")
    out = out.withColumns({"fires": F.col("deterioration") >= DETERIORATION, "sign_change": F.coalesce(sign != F.lag(sign).over(pair.orderBy("window")), F.lit(False))})
    return out.withColumn("sign_changes", F.count_if("sign_change").over(pair))
