"""DuckDB SQL for the queries of the catalogue that SQL can express."""

from __future__ import annotations

PAIRS = """
raw AS (
  SELECT 'returnflag' AS pair_id, CAST(l_shipdate AS DATE) AS date, l_returnflag = 'A' AS first_leg, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS n
  FROM lineitem WHERE l_returnflag IN ('A', 'R')
  UNION ALL
  SELECT 'orderstatus', CAST(o_orderdate AS DATE), o_orderstatus = 'F', CAST(round(o_totalprice * 100) AS BIGINT), 1
  FROM orders WHERE o_orderstatus IN ('F', 'O')
),
daily AS (
  SELECT pair_id, date,
         CAST(sum(cents) FILTER (first_leg) AS DOUBLE) / (CAST(sum(n) FILTER (first_leg) AS DOUBLE) * 100) AS price_a,
         CAST(sum(cents) FILTER (NOT first_leg) AS DOUBLE) / (CAST(sum(n) FILTER (NOT first_leg) AS DOUBLE) * 100) AS price_b
  FROM raw GROUP BY pair_id, date
),
bars AS (
  SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY date) - 1 AS idx, date, price_a, price_b, ln(price_a) AS log_a, ln(price_b) AS log_b
  FROM daily WHERE price_a > 0 AND price_b > 0
)"""



def spread_chain(source: str = "bars", k: str = "60") -> str:
    """Spreads of ``source`` over windows of ``k`` rows, a number or a column."""
    return f""",
fits AS (
  SELECT *, CASE WHEN ok THEN slope END AS beta, CASE WHEN ok THEN mean_a - slope * mean_b END AS alpha,
         CASE WHEN ok THEN CASE WHEN var_a * {k} < 1e-12 THEN 0 ELSE cov * cov / (var_a * var_b) END END AS r2
  FROM (
    SELECT *, cov / nullif(var_b, 0) AS slope, n = {k} AND var_b >= 1e-12 AS ok FROM (
      SELECT *, count(*) OVER w AS n, avg(log_a) OVER w AS mean_a, avg(log_b) OVER w AS mean_b, var_pop(log_a) OVER w AS var_a, var_pop(log_b) OVER w AS var_b, covar_pop(log_a, log_b) OVER w AS cov
      FROM {source} WINDOW w AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN {k} - 1 PRECEDING AND CURRENT ROW)
    )
  )
),
spreads AS (SELECT *, log_a - alpha - beta * log_b AS spread FROM fits)"""


def signal_chain(source: str = "bars", k: str = "60") -> str:
    return (
        spread_chain(source, k)
        + f""",
dense AS (
  SELECT pair_id, idx, CASE WHEN n_last = {k} AND sd >= 1e-10 THEN (last - mean) / sd END AS z, CASE WHEN n_now = {k} AND sd_now >= 1e-10 THEN (spread - mean_now) / sd_now END AS z_now
  FROM (
    SELECT *, lag(spread) OVER (PARTITION BY pair_id ORDER BY idx) AS last, count(*) OVER v AS n_last, avg(spread) OVER v AS mean, stddev_samp(spread) OVER v AS sd,
           count(*) OVER w AS n_now, avg(spread) OVER w AS mean_now, stddev_samp(spread) OVER w AS sd_now
    FROM spreads WHERE spread IS NOT NULL
    WINDOW v AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), w AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN {k} - 1 PRECEDING AND CURRENT ROW)
  )
),
sig AS (SELECT s.*, d.z, d.z_now FROM spreads s LEFT JOIN dense d USING (pair_id, idx))"""
    )


def accounts(source: str = "sig", entry: str = "2", leave: str = "0.5", stop: str = "3.5", skip: str = "false", interest: str = "1") -> str:
    """The trading rule and its accounts on ``source``; the parameters are numbers or columns of it, by ``s``."""
    return f""",
fold AS (
  SELECT DISTINCT pair_id, CAST(-1 AS BIGINT) AS idx, 0 AS dir, CAST(-1 AS BIGINT) AS since, 'hold' AS asked, 'hold' AS done, false AS waiting FROM {source}
  UNION ALL
  SELECT pair_id, idx, dir, since,
         CASE WHEN z IS NULL THEN 'hold'
              WHEN dir = 0 THEN CASE WHEN z <= -entry THEN 'long' WHEN z >= entry THEN 'short' ELSE 'hold' END
              WHEN dir * z <= -stop THEN 'stop_loss' WHEN idx - since >= 60 THEN 'max_holding' WHEN abs(z) <= leave THEN 'reversion' ELSE 'hold' END,
         done, (waiting OR barred) AND coalesce(abs(z) >= entry, true)
  FROM (
    SELECT pair_id, idx, z, entry, leave, stop, waiting, barred, CASE WHEN barred THEN 'hold' ELSE asked END AS done,
           CASE WHEN barred OR asked = 'hold' THEN dir WHEN asked = 'long' THEN 1 WHEN asked = 'short' THEN -1 ELSE 0 END AS dir,
           CASE WHEN asked IN ('long', 'short') AND NOT barred THEN idx ELSE since END AS since
    FROM (
      SELECT f.pair_id, s.idx, s.z, {entry} AS entry, {leave} AS leave, {stop} AS stop, f.asked, f.dir, f.since, f.waiting, f.asked IN ('long', 'short') AND (f.waiting OR {skip}) AS barred
      FROM fold f JOIN {source} s ON s.pair_id = f.pair_id AND s.idx = f.idx + 1
    )
  )
),
ends AS (SELECT pair_id, max(idx) AS last_idx FROM {source} GROUP BY pair_id),
trips AS (
  SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY entry_index) - 1 AS trade, CASE WHEN side = 'long' THEN 'long_spread' ELSE 'short_spread' END AS direction,
         entry_index, coalesce(exit_index, last_idx) AS exit_index, coalesce(reason, 'end_of_data') AS exit_reason
  FROM (
    SELECT pair_id, done AS side, idx AS entry_index, lead(idx) OVER w AS exit_index, lead(done) OVER w AS reason
    FROM fold WHERE done <> 'hold' WINDOW w AS (PARTITION BY pair_id ORDER BY idx)
  ) JOIN ends USING (pair_id) WHERE side IN ('long', 'short')
),
priced AS (
  SELECT t.*, CASE WHEN direction = 'long_spread' THEN 1 ELSE -1 END AS sign, e.date AS entry_date, x.date AS exit_date, e.price_a AS a0, e.price_b AS b0, x.price_a AS a1, x.price_b AS b1, p.beta AS hedge,
         coalesce(p.z, 0) AS entry_z, coalesce(CASE WHEN exit_reason = 'end_of_data' THEN x.z ELSE q.z END, 0) AS exit_z
  FROM trips t JOIN {source} e ON e.pair_id = t.pair_id AND e.idx = t.entry_index JOIN {source} x ON x.pair_id = t.pair_id AND x.idx = t.exit_index
  JOIN {source} p ON p.pair_id = t.pair_id AND p.idx = t.entry_index - 1 JOIN {source} q ON q.pair_id = t.pair_id AND q.idx = t.exit_index - 1
),
sized AS (SELECT *, sign * 25000.0 / a0 AS qty_a, -sign * abs(hedge) * 25000.0 / b0 AS qty_b FROM priced),
trades AS (
  SELECT *, value1 - value0 AS pnl_gross, cost0 + cost1 AS costs, value1 - value0 - cost0 - cost1 AS pnl_net, exit_index - entry_index AS holding_bars FROM (
    SELECT *, qty_a * a0 + qty_b * b0 AS value0, qty_a * a1 + qty_b * b1 AS value1, (abs(qty_a * a0) + abs(qty_b * b0)) * 3e-4 AS cost0, (abs(qty_a * a1) + abs(qty_b * b1)) * 3e-4 AS cost1 FROM sized
  )
),
flows AS (
  SELECT pair_id, idx, sum(flow) AS flow, sum(cost) AS cost, string_agg(event, ';' ORDER BY event) AS event FROM (
    SELECT pair_id, entry_index AS idx, -value0 - cost0 AS flow, cost0 AS cost, 'entry:' || direction AS event FROM trades
    UNION ALL SELECT pair_id, exit_index, value1 - cost1, cost1, 'exit:' || exit_reason FROM trades
  ) GROUP BY pair_id, idx
),
rate AS (SELECT pow(1.04::DOUBLE, 1.0::DOUBLE / 252) - 1 AS r),
cashed AS (
  SELECT s.*, coalesce(f.flow, 0) AS flow, coalesce(f.cost, 0) AS costs_this_bar, coalesce(f.event, '') AS trade_event, coalesce(t.direction, 'flat') AS position, coalesce(t.qty_a, 0) AS qty_a, coalesce(t.qty_b, 0) AS qty_b,
         pow(1 + r * {interest}, s.idx) * (100000 + sum(coalesce(f.flow, 0) * pow(1 + r * {interest}, -s.idx)) OVER (PARTITION BY s.pair_id ORDER BY s.idx)) AS cash, r * {interest} AS r
  FROM {source} s CROSS JOIN rate LEFT JOIN flows f ON f.pair_id = s.pair_id AND f.idx = s.idx LEFT JOIN trades t ON t.pair_id = s.pair_id AND s.idx >= t.entry_index AND s.idx < t.exit_index
),
audit AS (
  SELECT *, qty_a * price_a + qty_b * price_b AS position_value, cash + qty_a * price_a + qty_b * price_b AS nav, coalesce(lag(cash) OVER (PARTITION BY pair_id ORDER BY idx) * r, 0) AS interest_this_bar FROM cashed
),
moves AS (SELECT pair_id, idx, CASE WHEN before > 0 THEN nav / before - 1 END AS ret FROM (SELECT *, lag(nav) OVER (PARTITION BY pair_id ORDER BY idx) AS before FROM audit) WHERE before IS NOT NULL),
falls AS (SELECT pair_id, idx, nav, peak, nav / peak - 1 AS drawdown FROM (SELECT *, max(nav) OVER (PARTITION BY pair_id ORDER BY idx) AS peak FROM audit)),
worst AS (SELECT pair_id, min(drawdown) AS max_drawdown, arg_min(idx, (drawdown, idx)) AS trough, arg_min(peak, (drawdown, idx)) AS top, max(idx) AS last_idx FROM falls GROUP BY pair_id),
deepest AS (
  SELECT pair_id, any_value(max_drawdown) AS max_drawdown,
         CASE WHEN any_value(max_drawdown) < 0 THEN coalesce(min(idx) FILTER (nav >= top AND idx >= trough), any_value(last_idx)) - min(idx) FILTER (nav >= top AND idx <= trough) ELSE 0 END AS max_drawdown_duration
  FROM falls JOIN worst USING (pair_id) GROUP BY pair_id
)"""


SPREADS = spread_chain()
SIGNALS = signal_chain()
RUN = SIGNALS + accounts()

RESIDUALS = """,
line AS (SELECT pair_id, regr_intercept(log_a, log_b) AS alpha, regr_slope(log_a, log_b) AS beta FROM bars GROUP BY pair_id),
residuals AS (SELECT pair_id, idx, log_a - alpha - beta * log_b AS x FROM bars JOIN line USING (pair_id))"""

RATIOS = (
    RESIDUALS
    + """,
horizons AS (SELECT unnest([2, 4, 8, 16]) AS q),
drift AS (SELECT pair_id, count(*) - 1 AS n, (arg_max(x, idx) - arg_min(x, idx)) / (count(*) - 1) AS mu FROM residuals GROUP BY pair_id HAVING count(*) > 1),
steps AS (SELECT pair_id, idx, n, mu, x, pow(x - lag(x) OVER (PARTITION BY pair_id ORDER BY idx) - mu, 2) AS c2 FROM residuals JOIN drift USING (pair_id)),
ones AS (SELECT pair_id, any_value(n) AS n, sum(c2) AS ss FROM steps GROUP BY pair_id),
longs AS (SELECT a.pair_id, q, sum(pow(a.x - b.x - q * a.mu, 2)) AS sq FROM steps a CROSS JOIN horizons JOIN steps b ON b.pair_id = a.pair_id AND b.idx = a.idx - q GROUP BY a.pair_id, q),
lags AS (SELECT a.pair_id, k, sum(a.c2 * b.c2) AS p FROM steps a CROSS JOIN (SELECT unnest(range(1, 16)) AS k) JOIN steps b ON b.pair_id = a.pair_id AND b.idx = a.idx - k GROUP BY a.pair_id, k),
thetas AS (SELECT pair_id, q, sum(pow(2.0 * (q - k) / q, 2) * p) AS t FROM lags CROSS JOIN horizons WHERE k < q GROUP BY pair_id, q),
ratios AS (
  SELECT pair_id, CAST(q AS INTEGER) AS horizon, n AS n_obs, CASE WHEN n + 1 >= 32 AND n > q AND ss > 0 THEN sq / (q * (n - q + 1) * (1 - q::DOUBLE / n)) / (ss / (n - 1)) END AS vr,
         sqrt(2.0 * (2 * q - 1) * (q - 1) / (3.0 * q * n)) AS plain, t / (ss * ss) AS theta
  FROM ones JOIN longs USING (pair_id) JOIN thetas USING (pair_id, q)
)"""
)

UNIVERSE = """
priced AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS asset, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS price FROM orders GROUP BY 1, 2),
whole AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS idx FROM priced WHERE date IN (SELECT date FROM priced GROUP BY date HAVING count(*) = 5)),
rets AS (SELECT * FROM (SELECT asset, idx, ln(price) - ln(lag(price) OVER (PARTITION BY asset ORDER BY idx)) AS ret FROM whole) WHERE ret IS NOT NULL),
matrix AS (SELECT a.asset AS asset_a, b.asset AS asset_b, count(*) AS n_obs, covar_pop(a.ret, b.ret) / sqrt(var_pop(a.ret) * var_pop(b.ret)) AS corr FROM rets a JOIN rets b ON a.idx = b.idx AND a.asset < b.asset GROUP BY 1, 2)"""


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0::DOUBLE AS {x}"


def rs(*names: str) -> str:
    return ", ".join(r(x) for x in names)


def ms(*names: str) -> str:
    return ", ".join(r(x, 2) for x in names)


def sql(chain: str, select: str, base: str = PAIRS) -> str:
    return f"WITH RECURSIVE {base}{chain} {select}"


MEAN = "avg(log_a) OVER w", "stddev_samp(log_a) OVER w"
SHARPE = "(avg(ret) - any_value(rt)) / stddev_samp(ret)"
MOVED = "(SELECT moves.*, rate.r AS rt FROM moves CROSS JOIN rate)"

ORACLE_SQL: dict[str, str] = {
    "bars_daily": sql("", f"SELECT pair_id, idx, date, {rs('price_a', 'price_b')} FROM bars"),
    "bars_validation": sql("", "SELECT pair_id, count(*) AS n_rows, count(*) FILTER (price_a <= 0) AS bad_price_a, count(*) FILTER (price_b <= 0) AS bad_price_b, count(*) FILTER (date IS NULL) AS missing_date, count(*) FILTER (date <= before) AS not_increasing FROM (SELECT *, lag(date) OVER (PARTITION BY pair_id ORDER BY idx) AS before FROM bars) GROUP BY pair_id"),
    "log_prices": sql("", f"SELECT pair_id, idx, {rs('log_a', 'log_b')} FROM bars"),
    "rolling_mean_std": sql("", f"SELECT pair_id, idx, {rs('mean_a', 'sd_a')} FROM (SELECT pair_id, idx, CASE WHEN count(*) OVER w = 20 THEN {MEAN[0]} END AS mean_a, CASE WHEN count(*) OVER w = 20 THEN {MEAN[1]} END AS sd_a FROM bars WINDOW w AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"),
    "rolling_corr": sql(SPREADS, f"SELECT pair_id, idx, {rs('corr')} FROM (SELECT pair_id, idx, CASE WHEN n = 60 AND sqrt(var_a * var_b) * 60 >= 1e-10 THEN cov / sqrt(var_a * var_b) END AS corr FROM fits)"),
    "rolling_ols": sql(SPREADS, f"SELECT pair_id, idx, {rs('alpha', 'beta', 'r2')} FROM fits"),
    "spread_series": sql(SPREADS, f"SELECT pair_id, idx, {rs('spread')} FROM spreads WHERE spread IS NOT NULL"),
    "zscore_current": sql(SIGNALS, "SELECT pair_id, idx, round(z_now, 6) + 0.0::DOUBLE AS z FROM sig"),
    "zscore_lagged": sql(SIGNALS, f"SELECT pair_id, idx, {rs('beta', 'spread', 'z')} FROM sig"),
    "signal_path": sql(SIGNALS, "SELECT pair_id, CASE WHEN z > 0 THEN 'short_spread' ELSE 'long_spread' END AS side, count(*) AS n_bars, min(idx) AS first_idx, max(idx) AS last_idx FROM sig WHERE abs(z) >= 2 GROUP BY 1, 2"),
    "leaky_z_shift_3": sql(SIGNALS, "SELECT s.pair_id, s.idx, round(x.leaky_z, 6) + 0.0::DOUBLE AS leaky_z FROM sig s LEFT JOIN (SELECT pair_id, idx, CASE WHEN z IS NOT NULL THEN coalesce(lead(z, 3) OVER (PARTITION BY pair_id ORDER BY idx), z) END AS leaky_z FROM dense) x USING (pair_id, idx)"),
    "position_path": sql(RUN, "SELECT pair_id, trade, direction, entry_index, exit_index, exit_reason FROM trips"),
    "trades": sql(RUN, f"SELECT pair_id, direction, entry_index, exit_index, entry_date, exit_date, {rs('entry_z', 'exit_z')}, {ms('pnl_gross', 'costs', 'pnl_net')}, exit_reason, holding_bars FROM trades"),
    "fills": sql(RUN, f"SELECT pair_id, idx, trade_event, {ms('costs_this_bar')} FROM audit WHERE trade_event <> ''"),
    "bar_audit": sql(RUN, f"SELECT pair_id, idx, date, round(beta, 6) + 0.0::DOUBLE AS hedge_ratio, {rs('spread')}, round(z, 6) + 0.0::DOUBLE AS zscore, position, {r('qty_a', 4)}, {r('qty_b', 4)}, {ms('cash', 'position_value', 'nav', 'costs_this_bar', 'interest_this_bar')}, trade_event FROM audit"),
    "nav_identity_violations": sql(RUN, "SELECT pair_id, idx, gap FROM (SELECT pair_id, idx, nav - lag(nav) OVER w - lag(qty_a) OVER w * (price_a - lag(price_a) OVER w) - lag(qty_b) OVER w * (price_b - lag(price_b) OVER w) - interest_this_bar + costs_this_bar AS gap FROM audit WINDOW w AS (PARTITION BY pair_id ORDER BY idx)) WHERE abs(gap) > 1e-6"),
    "next_bar_violations": sql(RUN, "SELECT t.pair_id, t.entry_index, a.z AS asked FROM trades t LEFT JOIN audit a ON a.pair_id = t.pair_id AND a.idx = t.entry_index - 1 WHERE a.z IS NULL OR abs(a.z) < 2"),
    "returns_sharpe": sql(RUN, f"SELECT pair_id, n_returns, {rs('sharpe_per_bar', 'sharpe_ratio', 'annualized_volatility')} FROM (SELECT pair_id, count(*) AS n_returns, {SHARPE} AS sharpe_per_bar, {SHARPE} * sqrt(252) AS sharpe_ratio, stddev_samp(ret) * sqrt(252) AS annualized_volatility FROM {MOVED} GROUP BY pair_id)"),
    "drawdown_series": sql(RUN, f"SELECT pair_id, idx, {ms('peak')}, {rs('drawdown')} FROM falls"),
    "max_drawdown": sql(RUN, f"SELECT pair_id, {rs('max_drawdown')}, max_drawdown_duration FROM deepest"),
    "equity_decomposition": sql(RUN, f"SELECT pair_id, idx, {ms('interest_so_far', 'trading_pnl')} FROM (SELECT pair_id, idx, so_far AS interest_so_far, nav - first_nav - so_far AS trading_pnl FROM (SELECT *, sum(interest_this_bar) OVER (PARTITION BY pair_id ORDER BY idx) AS so_far, first_value(nav) OVER (PARTITION BY pair_id ORDER BY idx) AS first_nav FROM audit))"),
    "exit_reason_share": sql(RUN, f"SELECT pair_id, exit_reason, n, {rs('share')} FROM (SELECT pair_id, exit_reason, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY pair_id) AS share FROM trades GROUP BY pair_id, exit_reason)"),
    "metrics_nav": sql(RUN, f"SELECT pair_id, n_bars, n_trading_bars, {ms('final_nav')}, {rs('total_return', 'annualized_return', 'max_drawdown')}, {r('calmar_ratio', 4)}, {rs('exposure_frac')} FROM (SELECT *, CASE WHEN abs(max_drawdown) < 1e-12 THEN 0 ELSE annualized_return / abs(max_drawdown) END AS calmar_ratio FROM (SELECT pair_id, count(*) AS n_bars, count(*) FILTER (idx >= 60) AS n_trading_bars, arg_max(nav, idx) AS final_nav, arg_max(nav, idx) / arg_min(nav, idx) - 1 AS total_return, CASE WHEN arg_max(nav, idx) <= 0 THEN -1 ELSE pow(arg_max(nav, idx) / arg_min(nav, idx), 252.0::DOUBLE / (count(*) - 1)) - 1 END AS annualized_return, any_value(max_drawdown) AS max_drawdown, coalesce(count(*) FILTER (idx >= 60 AND position <> 'flat')::DOUBLE / nullif(count(*) FILTER (idx >= 60), 0), 0) AS exposure_frac FROM audit JOIN deepest USING (pair_id) GROUP BY pair_id))"),
    "metrics_trades": sql(RUN, f"SELECT pair_id, n_trades, n_wins, n_losses, {rs('win_rate', 'avg_holding_bars')}, {ms('avg_win', 'avg_loss')}, {rs('profit_factor')}, {ms('gross_pnl')}, {r('turnover', 4)}, n_stop_loss, n_reversion, n_max_holding, n_end_of_data FROM (SELECT pair_id, count(*) AS n_trades, count(*) FILTER (pnl_net > 0) AS n_wins, count(*) FILTER (pnl_net <= 0) AS n_losses, count(*) FILTER (pnl_net > 0)::DOUBLE / count(*) AS win_rate, avg(holding_bars) AS avg_holding_bars, coalesce(avg(pnl_net) FILTER (pnl_net > 0), 0) AS avg_win, coalesce(avg(pnl_net) FILTER (pnl_net <= 0), 0) AS avg_loss, CASE WHEN coalesce(abs(sum(pnl_net) FILTER (pnl_net <= 0)), 0) < 1e-12 THEN 0 ELSE coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) / abs(sum(pnl_net) FILTER (pnl_net <= 0)) END AS profit_factor, sum(pnl_gross) AS gross_pnl, sum((cost0 + cost1) / 3e-4::DOUBLE) / 100000 AS turnover, count(*) FILTER (exit_reason = 'stop_loss') AS n_stop_loss, count(*) FILTER (exit_reason = 'reversion') AS n_reversion, count(*) FILTER (exit_reason = 'max_holding') AS n_max_holding, count(*) FILTER (exit_reason = 'end_of_data') AS n_end_of_data FROM trades GROUP BY pair_id)"),
    "pair_correlations": sql("", f"SELECT pair_id, n_obs, {rs('level_corr', 'return_corr')} FROM (SELECT pair_id, count(*) AS n_obs, covar_pop(log_a, log_b) / sqrt(var_pop(log_a) * var_pop(log_b)) AS level_corr, covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)) AS return_corr FROM (SELECT *, log_a - lag(log_a) OVER (PARTITION BY pair_id ORDER BY idx) AS ra, log_b - lag(log_b) OVER (PARTITION BY pair_id ORDER BY idx) AS rb FROM bars) GROUP BY pair_id)"),
    "universe_corr_matrix": sql("", f"SELECT asset_a, asset_b, n_obs, {rs('corr')} FROM matrix", UNIVERSE),
    "universe_screen_prefilter": sql("", f"SELECT asset_a, asset_b, {rs('corr')} FROM matrix WHERE abs(corr) >= 0.01", UNIVERSE),
    "full_sample_ols": sql(RESIDUALS, f"SELECT pair_id, {rs('alpha', 'beta')} FROM line"),
    "half_life": sql(RESIDUALS, f"SELECT pair_id, {rs('slope')}, {r('half_life', 4)}, half_life IS NOT NULL AS is_mean_reverting FROM (SELECT pair_id, slope, CASE WHEN n >= 2 AND slope < 0 AND slope > -1 THEN -ln(2) / ln(1 + slope) END AS half_life FROM (SELECT pair_id, regr_slope(x - before, before) AS slope, count(before) AS n FROM (SELECT *, lag(x) OVER (PARTITION BY pair_id ORDER BY idx) AS before FROM residuals) GROUP BY pair_id))"),
    "half_sample_betas": sql("", f"SELECT pair_id, {rs('beta_first', 'beta_second')} FROM (SELECT pair_id, CASE WHEN count(*) FILTER (early) >= 10 THEN regr_slope(log_a, log_b) FILTER (early) END AS beta_first, CASE WHEN count(*) FILTER (NOT early) >= 10 THEN regr_slope(log_a, log_b) FILTER (NOT early) END AS beta_second FROM (SELECT *, idx < floor(count(*) OVER (PARTITION BY pair_id) / 2) AS early FROM bars) GROUP BY pair_id)"),
    "variance_ratio_levels": sql(RATIOS, "SELECT pair_id, horizon, n_obs, round(vr, 6) + 0.0::DOUBLE AS variance_ratio FROM ratios"),
    "variance_ratio_z": sql(RATIOS, "SELECT pair_id, horizon, round((vr - 1) / plain, 4) + 0.0::DOUBLE AS z_homoskedastic, round(CASE WHEN theta > 0 THEN (vr - 1) / sqrt(theta) END, 4) + 0.0::DOUBLE AS z_robust FROM ratios"),
    "t_test_inputs": sql(RUN, f"SELECT pair_id, n_trades, {ms('mean_pnl')}, {r('t_stat', 4)} FROM (SELECT pair_id, count(*) AS n_trades, avg(pnl_net) AS mean_pnl, avg(pnl_net) / (stddev_samp(pnl_net) / sqrt(count(*))) AS t_stat FROM trades GROUP BY pair_id HAVING count(*) >= 2)"),
    "sharpe_lo_interval": sql(RUN, f"SELECT pair_id, n, {rs('sharpe_ratio', 'sharpe_se')} FROM (SELECT pair_id, n, sr * sqrt(252) AS sharpe_ratio, sqrt((1 + sr * sr / 2) / n) * sqrt(252) AS sharpe_se FROM (SELECT pair_id, count(*) AS n, {SHARPE} AS sr FROM {MOVED} GROUP BY pair_id))"),
    "sharpe_shaped_error": sql(RUN, f"SELECT pair_id, {r('skewness', 4)}, {r('kurtosis', 4)}, {rs('sharpe_se_shaped')} FROM (SELECT *, sqrt(greatest((1 - skewness * sr + (kurtosis - 1) / 4 * sr * sr) / (n - 1), 1e-12)) * sqrt(252) AS sharpe_se_shaped FROM (SELECT pair_id, count(*) AS n, {SHARPE} AS sr, avg(pow(ret - mean, 3)) / pow(avg(pow(ret - mean, 2)), 1.5) AS skewness, avg(pow(ret - mean, 4)) / pow(avg(pow(ret - mean, 2)), 2) AS kurtosis FROM (SELECT *, avg(ret) OVER (PARTITION BY pair_id) AS mean FROM {MOVED}) GROUP BY pair_id))"),
    "walk_forward_split": sql("", "SELECT pair_id, part, count(*) AS n_bars, min(idx) AS first_idx FROM (SELECT *, CASE WHEN idx < floor(count(*) OVER (PARTITION BY pair_id) * 0.6::DOUBLE) THEN 'in' ELSE 'out' END AS part FROM bars) GROUP BY 1, 2"),
}

#: Fan-outs: every pair and label is a series of its own, named ``pair|label``.
SUMMED = f""",
summed AS (
  SELECT split_part(pair_id, '|', 1) AS pair, split_part(pair_id, '|', 2) AS label, sharpe_ratio, max_drawdown, final_nav, coalesce(n_trades, 0) AS n_trades, coalesce(win_rate, 0) AS win_rate
  FROM (SELECT pair_id, CASE WHEN stddev_samp(ret) < 1e-12 THEN 0 ELSE {SHARPE} * sqrt(252) END AS sharpe_ratio FROM {MOVED} GROUP BY pair_id)
  JOIN deepest USING (pair_id) JOIN (SELECT pair_id, arg_max(nav, idx) AS final_nav FROM audit GROUP BY pair_id) USING (pair_id)
  LEFT JOIN (SELECT pair_id, count(*) AS n_trades, count(*) FILTER (pnl_net > 0)::DOUBLE / count(*) AS win_rate FROM trades GROUP BY pair_id) USING (pair_id)
)"""

GRID = (
    """,
cells AS (
  SELECT w, e AS entry, x AS leave, e + 1.5::DOUBLE AS stop, 'w' || w || '_e' || en || '_x' || xn AS label
  FROM (SELECT unnest([30, 60, 90, 120]) AS w) CROSS JOIN (VALUES (1.5::DOUBLE, '1.5'), (2.0, '2'), (2.5, '2.5')) AS a(e, en) CROSS JOIN (VALUES (0.25::DOUBLE, '0.25'), (0.5, '0.5'), (0.75, '0.75')) AS b(x, xn)
),
wide AS (SELECT pair_id || '|' || w AS pair_id, bars.* EXCLUDE (pair_id), w FROM bars CROSS JOIN (SELECT DISTINCT w FROM cells))"""
    + signal_chain("wide", "w")
    + """,
swept AS (SELECT split_part(pair_id, '|', 1) || '|' || label AS pair_id, sig.* EXCLUDE (pair_id, w), entry, leave, stop FROM sig JOIN cells USING (w))"""
    + accounts("swept", "s.entry", "s.leave", "s.stop")
    + SUMMED
)

INTEREST = SIGNALS + ", both_ways AS (SELECT pair_id || '|' || label AS pair_id, sig.* EXCLUDE (pair_id), interest FROM sig CROSS JOIN (VALUES ('interest_on', 1), ('interest_off', 0)) AS v(label, interest))" + accounts("both_ways", interest="s.interest") + SUMMED

SHIFTED = (
    """,
later AS (SELECT pair_id, idx, k, CASE WHEN z IS NOT NULL THEN coalesce(lead(z, k) OVER (PARTITION BY pair_id, k ORDER BY idx), z) END AS z FROM dense CROSS JOIN (SELECT unnest(range(11)) AS k)),
shifted AS (SELECT s.pair_id || '|' || k AS pair_id, s.* EXCLUDE (pair_id), l.z FROM spreads s CROSS JOIN (SELECT unnest(range(11)) AS k) LEFT JOIN later l USING (pair_id, idx, k))"""
    + accounts("shifted")
    + SUMMED
)

FILTERED = (
    f""",
losers AS (
  SELECT * FROM (WITH RECURSIVE {accounts()[2:]} SELECT pair_id, entry_index, row_number() OVER (PARTITION BY pair_id ORDER BY entry_index) AS nth FROM trades WHERE pnl_net <= 0)
),
draws AS (
  SELECT CAST(0 AS BIGINT) AS nth, CAST(42 AS BIGINT) AS state
  UNION ALL SELECT nth + 1, (1664525 * state + 1013904223) & 1073741823 FROM draws WHERE nth < (SELECT max(nth) FROM losers)
),
flagged AS (
  SELECT s.pair_id || '|' || k AS pair_id, s.* EXCLUDE (pair_id), coalesce(state / 1073741824.0::DOUBLE < k / 10.0::DOUBLE, false) AS skip
  FROM sig s CROSS JOIN (SELECT unnest(range(11)) AS k) LEFT JOIN losers ON losers.pair_id = s.pair_id AND losers.entry_index = s.idx LEFT JOIN draws USING (nth)
)"""
    + accounts("flagged", skip="s.skip")
    + SUMMED
)

#: The filter of two states, one bar at a time, for each row of ``filters`` (pair_id, name, q).
FILTER = """,
runs AS (SELECT pair_id || '|' || name AS pair_id, bars.* EXCLUDE (pair_id), q FROM bars CROSS JOIN filters),
states AS (
  SELECT DISTINCT pair_id, CAST(-1 AS BIGINT) AS idx, 0.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta, 1.0::DOUBLE AS p, 0.0::DOUBLE AS c, 1.0::DOUBLE AS d, 0.0::DOUBLE AS innovation FROM runs
  UNION ALL
  SELECT pair_id, idx, alpha + u / v * e, beta + w / v * e, greatest(p - u / v * u, 0), c - u / v * w, greatest(d - w / v * w, 0), e
  FROM (
    SELECT *, greatest(u + w * x + 1e-3::DOUBLE, 1e-15::DOUBLE) AS v FROM (
      SELECT s.pair_id, b.idx, b.log_b AS x, s.alpha, s.beta, s.p + b.q AS p, s.c, s.d + b.q AS d, b.log_a - s.alpha - s.beta * b.log_b AS e, s.p + b.q + s.c * b.log_b AS u, s.c + (s.d + b.q) * b.log_b AS w
      FROM states s JOIN runs b ON b.pair_id = s.pair_id AND b.idx = s.idx + 1
    )
  )
)"""

MEMORIES = (
    ", filters AS (SELECT CAST(r AS VARCHAR) AS name, 1e-3::DOUBLE / pow(r * 15.0::DOUBLE, 2) AS q FROM (SELECT unnest([2, 3, 5, 8, 12]) AS r))"
    + FILTER
    + """,
tracked AS (SELECT b.*, s.alpha, s.beta, CASE WHEN b.idx >= 10 THEN b.log_a - s.alpha - s.beta * b.log_b END AS spread FROM runs b JOIN states s USING (pair_id, idx)),
scored AS (
  SELECT pair_id, idx, CASE WHEN n = 60 AND idx >= 70 AND sd >= 1e-10 THEN (spread - mean) / sd END AS z
  FROM (SELECT *, count(*) OVER w AS n, avg(spread) OVER w AS mean, stddev_samp(spread) OVER w AS sd FROM tracked WHERE idx >= 10 WINDOW w AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
),
remembered AS (SELECT t.*, z FROM tracked t LEFT JOIN scored USING (pair_id, idx))"""
    + accounts("remembered")
    + SUMMED
)

#: The pairs, and pairs of trailing averages of their prices.
BOTH = """,
averages AS (
  SELECT pair_id || '_20' AS pair_id, idx - 19 AS idx, date, price_a, price_b FROM (
    SELECT pair_id, idx, date, avg(price_a) OVER w AS price_a, avg(price_b) OVER w AS price_b FROM bars WINDOW w AS (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
  ) WHERE idx >= 19
),
every AS (SELECT pair_id, idx, date, price_a, price_b, log_a, log_b FROM bars UNION ALL SELECT *, ln(price_a), ln(price_b) FROM averages)"""

#: Window of five half-lives of the first part, results in the second.
WALK = (
    BOTH
    + """,
halves AS (SELECT *, idx < floor(count(*) OVER (PARTITION BY pair_id) * 0.6::DOUBLE) AS inside FROM every),
fitted AS (SELECT pair_id, regr_intercept(log_a, log_b) AS alpha, regr_slope(log_a, log_b) AS beta FROM halves WHERE inside GROUP BY pair_id),
reverting AS (
  SELECT pair_id, regr_slope(x - before, before) AS slope, count(before) AS n FROM (
    SELECT pair_id, x, lag(x) OVER (PARTITION BY pair_id ORDER BY idx) AS before FROM (SELECT h.pair_id, idx, log_a - alpha - beta * log_b AS x FROM halves h JOIN fitted USING (pair_id) WHERE inside)
  ) GROUP BY pair_id
),
planned AS (
  SELECT *, k <= floor(n_out / 4) AS kept FROM (
    SELECT pair_id, half_life, greatest(CAST(round(coalesce(half_life, 200) * 5) AS INTEGER), 3) AS k, n_out, first_out
    FROM (SELECT pair_id, CASE WHEN n >= 2 AND slope < 0 AND slope > -1 THEN -ln(2) / ln(1 + slope) END AS half_life FROM reverting)
    JOIN (SELECT pair_id, count(*) AS n_out, min(idx) AS first_out FROM halves WHERE NOT inside GROUP BY pair_id) USING (pair_id)
  )
),
outside AS (SELECT pair_id, idx - first_out AS idx, date, price_a, price_b, log_a, log_b, k FROM halves JOIN planned USING (pair_id) WHERE NOT inside AND kept)"""
    + signal_chain("outside", "k")
    + accounts()
    + SUMMED
)

#: Windows of several half-lives of each pair's residual.
RATIO = (
    BOTH
    + """,
fitted AS (SELECT pair_id, regr_intercept(log_a, log_b) AS alpha, regr_slope(log_a, log_b) AS beta FROM every GROUP BY pair_id),
reverting AS (
  SELECT pair_id, regr_slope(x - before, before) AS slope FROM (
    SELECT pair_id, x, lag(x) OVER (PARTITION BY pair_id ORDER BY idx) AS before FROM (SELECT e.pair_id, idx, log_a - alpha - beta * log_b AS x FROM every e JOIN fitted USING (pair_id))
  ) GROUP BY pair_id
),
ratios AS (
  SELECT pair_id, half_life, ratio, CAST(round(half_life * ratio) AS INTEGER) AS k
  FROM (SELECT pair_id, -ln(2) / ln(1 + slope) AS half_life FROM reverting WHERE slope < 0 AND slope > -1) CROSS JOIN (SELECT unnest([2.0, 3.0, 4.5, 6.0, 9.0, 12.5])::DOUBLE AS ratio)
),
spread_out AS (SELECT e.pair_id || '|' || ratio AS pair_id, e.* EXCLUDE (pair_id), k FROM every e JOIN ratios USING (pair_id) WHERE k >= 3)"""
    + signal_chain("spread_out", "k")
    + accounts()
    + SUMMED
)

#: Intents by bands of z, filled one bar at a time.
INTENTS = (
    SIGNALS
    + """,
asks AS (
  SELECT *, CASE WHEN z <= -2 THEN 'enter:long_spread' WHEN z >= 2 THEN 'enter:short_spread' WHEN abs(z) <= 0.1 THEN 'exit:reversion'
                 WHEN z BETWEEN -1.3 AND -1.2 THEN 'flip:long_spread' WHEN z BETWEEN 1.2 AND 1.3 THEN 'flip:short_spread' ELSE 'hold' END AS intent FROM sig
),
steps AS (
  SELECT DISTINCT pair_id, CAST(-1 AS BIGINT) AS idx, 'flat' AS position, 'hold' AS asked, '' AS event FROM asks
  UNION ALL
  SELECT s.pair_id, a.idx,
         CASE WHEN s.asked LIKE 'flip:%' OR s.asked LIKE 'enter:%' AND s.position = 'flat' THEN split_part(s.asked, ':', 2) WHEN s.asked LIKE 'exit:%' THEN 'flat' ELSE s.position END,
         a.intent,
         CASE WHEN s.position = 'flat' AND (s.asked LIKE 'enter:%' OR s.asked LIKE 'flip:%') THEN 'entry:' || split_part(s.asked, ':', 2)
              WHEN s.position <> 'flat' AND s.asked LIKE 'enter:%' THEN 'ignored_enter_while_open' WHEN s.position <> 'flat' AND (s.asked LIKE 'flip:%' OR s.asked LIKE 'exit:%') THEN s.asked ELSE '' END
  FROM steps s JOIN asks a ON a.pair_id = s.pair_id AND a.idx = s.idx + 1
),
ended AS (SELECT pair_id, max(idx) AS last_idx FROM asks GROUP BY pair_id),
filled AS (SELECT pair_id, idx, position, event, idx = last_idx AND position <> 'flat' AS open_end FROM steps JOIN ended USING (pair_id)),
fills AS (SELECT pair_id, idx, position, event FROM filled WHERE event LIKE 'entry:%' OR event LIKE 'flip:%' OR event LIKE 'exit:%'),
rounds AS (
  SELECT * FROM (SELECT pair_id, idx AS entry_index, position AS direction, lead(idx) OVER w AS exit_index, lead(event) OVER w AS closed FROM fills WINDOW w AS (PARTITION BY pair_id ORDER BY idx)) WHERE direction <> 'flat'
),
deals AS (
  SELECT r.pair_id, direction, entry_index, coalesce(exit_index, last_idx) AS exit_index, CASE WHEN closed IS NULL THEN 'end_of_data' WHEN closed LIKE 'flip:%' THEN 'reversion' ELSE split_part(closed, ':', 2) END AS exit_reason
  FROM rounds r JOIN ended USING (pair_id)
),
worth AS (
  SELECT *, qty_a * (a1 - a0) + qty_b * (b1 - b0) AS pnl_gross, 3e-4 * (abs(qty_a) * (a0 + a1) + abs(qty_b) * (b0 + b1)) AS costs FROM (
    SELECT d.*, sign * 25000.0 / a0 AS qty_a, -sign * abs(hedge) * 25000.0 / b0 AS qty_b FROM (
      SELECT d.*, CASE WHEN direction = 'long_spread' THEN 1 ELSE -1 END AS sign, e.price_a AS a0, e.price_b AS b0, x.price_a AS a1, x.price_b AS b1, p.beta AS hedge
      FROM deals d JOIN asks e ON e.pair_id = d.pair_id AND e.idx = d.entry_index JOIN asks x ON x.pair_id = d.pair_id AND x.idx = d.exit_index JOIN asks p ON p.pair_id = d.pair_id AND p.idx = d.entry_index - 1
    ) d
  )
)"""
)

CANDIDATES = """
orders_of AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS p, day(o_orderdate) = 1 AS opening, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
closes AS (
  SELECT asset, date, CAST(sum(cents) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS close FROM (SELECT p AS asset, date, cents FROM orders_of UNION ALL SELECT p || '/first', date, cents FROM orders_of WHERE opening) GROUP BY 1, 2
),
names AS (SELECT DISTINCT p FROM orders_of),
wanted AS (SELECT a.p AS asset_a, b.p AS asset_b FROM names a JOIN names b ON a.p < b.p UNION ALL SELECT p, p || '/first' FROM names UNION ALL SELECT p, p || '/none' FROM names),
common AS (SELECT asset_a, asset_b, a.date, a.close AS price_a, b.close AS price_b FROM wanted JOIN closes a ON a.asset = asset_a JOIN closes b ON b.asset = asset_b AND b.date = a.date),
results AS (
  SELECT *, reason = '' AS ok FROM (
    SELECT asset_a, asset_b, n_dates,
           CASE WHEN asset_a NOT IN (SELECT asset FROM closes) THEN 'no closes of ' || asset_a WHEN asset_b NOT IN (SELECT asset FROM closes) THEN 'no closes of ' || asset_b
                WHEN n_dates < 200 THEN n_dates || ' dates in common, 200 needed' WHEN bad > 0 THEN bad || ' dates without positive prices' ELSE '' END AS reason
    FROM (SELECT asset_a, asset_b, count(c.date) AS n_dates, count(*) FILTER (price_a <= 0 OR price_b <= 0) AS bad FROM wanted LEFT JOIN common c USING (asset_a, asset_b) GROUP BY 1, 2)
  )
)"""

def phi(x: str) -> str:
    """The normal distribution function, by its series over odd double factorials; 0 or 1 in ten digits and more beyond 8."""
    return f"(CASE WHEN abs({x}) > 8 THEN ({x} > 0)::INTEGER ELSE 0.5 + sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs({x}) + 1e-300::DOUBLE) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + 0.5 * ln(pi())))) END)"


def t_tail(t: str, df: str) -> str:
    """Two-sided tail of Student's distribution, by Simpson's rule over the angle."""
    area = lambda lo: f"list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({lo} + (pi() / 2 - {lo}) * i / 2000), 0), {df} - 1))) * (pi() / 2 - {lo})"
    return f"({area(f'atan(abs({t}) / sqrt({df}))')} / ({area('0.0::DOUBLE')}))"


#: Recursive least squares of the change of a on the change of b and the last gap, one bar at a time: coefficients and the inverse.
CUSUM = (
    RESIDUALS
    + """,
design AS (
  SELECT pair_id, idx AS n, idx, log_a - lag(log_a) OVER w AS y, log_b - lag(log_b) OVER w AS u, lag(x) OVER w AS g
  FROM bars JOIN residuals USING (pair_id, idx) WINDOW w AS (PARTITION BY pair_id ORDER BY idx) QUALIFY u IS NOT NULL
),
three AS (SELECT pair_id, max(u) FILTER (n = 1) AS u1, max(u) FILTER (n = 2) AS u2, max(u) FILTER (n = 3) AS u3, max(g) FILTER (n = 1) AS g1, max(g) FILTER (n = 2) AS g2, max(g) FILTER (n = 3) AS g3, max(y) FILTER (n = 1) AS y1, max(y) FILTER (n = 2) AS y2, max(y) FILTER (n = 3) AS y3 FROM design GROUP BY pair_id),
dets AS (SELECT *, u1 * (g2 - g3) - u2 * (g1 - g3) + u3 * (g1 - g2) AS det FROM three),
inverted AS (
  SELECT *, (u2 * g3 - u3 * g2) / det AS a1, (u3 * g1 - u1 * g3) / det AS a2, (u1 * g2 - u2 * g1) / det AS a3, (g2 - g3) / det AS b1, (g3 - g1) / det AS b2, (g1 - g2) / det AS b3, (u3 - u2) / det AS c1, (u1 - u3) / det AS c2, (u2 - u1) / det AS c3 FROM dets
),
recursed AS (
  SELECT pair_id, CAST(3 AS BIGINT) AS n, a1 * y1 + a2 * y2 + a3 * y3 AS k0, b1 * y1 + b2 * y2 + b3 * y3 AS k1, c1 * y1 + c2 * y2 + c3 * y3 AS k2,
         a1 * a1 + a2 * a2 + a3 * a3 AS p00, a1 * b1 + a2 * b2 + a3 * b3 AS p01, a1 * c1 + a2 * c2 + a3 * c3 AS p02, b1 * b1 + b2 * b2 + b3 * b3 AS p11, b1 * c1 + b2 * c2 + b3 * c3 AS p12, c1 * c1 + c2 * c2 + c3 * c3 AS p22, 0.0::DOUBLE AS w
  FROM inverted
  UNION ALL
  SELECT pair_id, n, k0 + h0 * e / s, k1 + h1 * e / s, k2 + h2 * e / s, p00 - h0 * h0 / s, p01 - h0 * h1 / s, p02 - h0 * h2 / s, p11 - h1 * h1 / s, p12 - h1 * h2 / s, p22 - h2 * h2 / s, e / sqrt(s)
  FROM (
    SELECT *, 1 + h0 + u * h1 + g * h2 AS s FROM (
      SELECT r.* EXCLUDE (n), d.n, d.u, d.g, d.y - k0 - k1 * d.u - k2 * d.g AS e, p00 + p01 * d.u + p02 * d.g AS h0, p01 + p11 * d.u + p12 * d.g AS h1, p02 + p12 * d.u + p22 * d.g AS h2
      FROM recursed r JOIN design d ON d.pair_id = r.pair_id AND d.n = r.n + 1
    )
  )
),
pathed AS (
  SELECT r.pair_id, d.idx, abs(sum(w) OVER (PARTITION BY r.pair_id ORDER BY r.n) / stddev_samp(w) OVER (PARTITION BY r.pair_id)) / (0.948::DOUBLE * (sqrt(m) + 2 * (r.n - 3) / sqrt(m))) AS excursion
  FROM recursed r JOIN design d USING (pair_id, n) JOIN (SELECT pair_id, max(n) - 3 AS m FROM design GROUP BY pair_id) USING (pair_id) WHERE r.n > 3
)"""
)

#: The quantile of the normal distribution at p, by halving.
QUANTILE = f"""halved AS (
  SELECT p, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS i FROM wanted_p
  UNION ALL
  SELECT p, CASE WHEN {phi('((lo + hi) / 2)')} < p THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {phi('((lo + hi) / 2)')} < p THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM halved WHERE i < 50
),
quantiles AS (SELECT p, lo AS q FROM halved WHERE i = 50)"""

METRICS = """,
facts AS (
  SELECT pair_id, count(*)::DOUBLE AS n_bars, arg_min(nav, idx) AS initial_nav, arg_max(nav, idx) AS final_nav, sum(costs_this_bar) AS total_costs, sum(interest_this_bar) AS total_interest,
         count(*) FILTER (idx >= 60)::DOUBLE AS n_trading_bars, coalesce(count(*) FILTER (idx >= 60 AND position <> 'flat')::DOUBLE / nullif(count(*) FILTER (idx >= 60), 0), 0) AS exposure_frac
  FROM audit GROUP BY pair_id
),
risks AS (SELECT pair_id, sr AS sharpe_per_bar, sr * sqrt(252) AS sharpe_ratio, sd * sqrt(252) AS annualized_volatility FROM (SELECT pair_id, stddev_samp(ret) AS sd, CASE WHEN stddev_samp(ret) < 1e-12 THEN 0 ELSE SHARPE END AS sr FROM MOVED GROUP BY pair_id)),
deals AS (
  SELECT pair_id, count(*)::DOUBLE AS n_trades, count(*) FILTER (pnl_net > 0)::DOUBLE AS n_wins, count(*) FILTER (pnl_net <= 0)::DOUBLE AS n_losses, avg(holding_bars) AS avg_holding_bars, sum(pnl_gross) AS gross_pnl,
         sum((cost0 + cost1) / 3e-4::DOUBLE) / 100000 AS turnover, count(*) FILTER (pnl_net > 0)::DOUBLE / count(*) AS win_rate, coalesce(avg(pnl_net) FILTER (pnl_net > 0), 0) AS avg_win, coalesce(avg(pnl_net) FILTER (pnl_net <= 0), 0) AS avg_loss,
         coalesce(sum(pnl_net) FILTER (pnl_net > 0), 0) / nullif(abs(coalesce(sum(pnl_net) FILTER (pnl_net <= 0), 0)), 0) AS profit_factor,
         count(*) FILTER (exit_reason = 'stop_loss')::DOUBLE AS n_stop_loss, count(*) FILTER (exit_reason = 'reversion')::DOUBLE AS n_reversion, count(*) FILTER (exit_reason = 'max_holding')::DOUBLE AS n_max_holding, count(*) FILTER (exit_reason = 'end_of_data')::DOUBLE AS n_end_of_data
  FROM trades GROUP BY pair_id
),
full_row AS (
  SELECT *, CASE WHEN abs(max_drawdown) < 1e-12 THEN 0 ELSE annualized_return / abs(max_drawdown) END AS calmar_ratio FROM (
    SELECT facts.*, risks.* EXCLUDE (pair_id), max_drawdown, max_drawdown_duration::DOUBLE AS max_drawdown_duration, deals.* EXCLUDE (pair_id), final_nav / initial_nav - 1 AS total_return, final_nav - initial_nav AS net_pnl,
           CASE WHEN final_nav <= 0 THEN -1 ELSE pow(final_nav / initial_nav, 252.0::DOUBLE / (n_bars - 1)) - 1 END AS annualized_return
    FROM facts JOIN risks USING (pair_id) JOIN deepest USING (pair_id) LEFT JOIN deals USING (pair_id)
  )
),
reals AS (SELECT pair_id, COLUMNS(* EXCLUDE (pair_id))::DOUBLE FROM full_row)""".replace("SHARPE", SHARPE).replace("MOVED", MOVED)

ORACLE_SQL |= {
    "metrics_full": sql(RUN + METRICS, "SELECT pair_id, metric, round(coalesce(value, 0), 4) + 0.0::DOUBLE AS value FROM reals UNPIVOT INCLUDE NULLS (value FOR metric IN (COLUMNS(* EXCLUDE (pair_id))))"),
    "sweep_36": sql(GRID, f'SELECT pair AS pair_id, label, w::BIGINT AS "window", entry, leave AS exit, {rs("sharpe_ratio", "max_drawdown")}, n_trades, {rs("win_rate")}, {ms("final_nav")} FROM summed JOIN cells USING (label)'),
    "sweep_pivot": sql(GRID, 'SELECT pair AS pair_id, w::BIGINT AS "window", ' + ", ".join(f'round(avg(sharpe_ratio) FILTER (entry = {e}), 6) + 0.0::DOUBLE AS "{e}"' for e in (1.5, 2.0, 2.5)) + " FROM summed JOIN cells USING (label) GROUP BY 1, 2"),
    "sweep_summary": sql(GRID, f"SELECT pair_id, n_cells, {rs('least', 'median', 'most', 'positive_share')} FROM (SELECT pair AS pair_id, count(*) AS n_cells, min(sharpe_ratio) AS least, median(sharpe_ratio) AS median, max(sharpe_ratio) AS most, avg((sharpe_ratio > 0)::INTEGER) AS positive_share FROM summed GROUP BY 1)"),
    "cash_interest_compare": sql(INTEREST, f"SELECT pair AS pair_id, label, {rs('sharpe_ratio')}, n_trades, {ms('final_nav')} FROM summed"),
    "timing_shift_curve": sql(SIGNALS + SHIFTED, f"SELECT pair AS pair_id, label::DOUBLE AS dose, {rs('sharpe_ratio')}, n_trades, {rs('win_rate')}, {ms('final_nav')} FROM summed"),
    "outcome_filter_curve": sql(SIGNALS + FILTERED, f"SELECT pair AS pair_id, label::DOUBLE / 10 AS dose, {rs('sharpe_ratio')}, n_trades, {rs('win_rate')}, {ms('final_nav')} FROM summed"),
    "calibration_union": sql(SIGNALS, "SELECT leak_type, pair AS pair_id, count(*) AS n_doses, max(n_trades) AS most_trades FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS leak_type, pair, n_trades FROM (WITH RECURSIVE {chain[2:]} SELECT * FROM summed)" for name, chain in (("timing_shift", SHIFTED), ("outcome_filter", FILTERED))) + ") GROUP BY 1, 2"),
    "kalman_path": sql(", filters AS (SELECT '' AS name, 1e-5::DOUBLE AS q)" + FILTER, f"SELECT split_part(pair_id, '|', 1) AS pair_id, idx, {rs('alpha', 'beta', 'innovation')} FROM states WHERE idx >= 0"),
    "kalman_sweep": sql(MEMORIES, f"SELECT pair AS pair_id, label::DOUBLE AS memory_ratio, label::DOUBLE * 15 AS memory_bars, {rs('sharpe_ratio')}, n_trades, {ms('final_nav')} FROM summed"),
    "window_ratio_sensitivity": sql(RATIO, f'SELECT pair_id, ratio AS window_ratio, k AS "window", {r("half_life", 4)}, {r("sharpe_ratio", 4)}, n_trades, {rs("win_rate")}, {ms("final_nav")} FROM ratios JOIN summed ON pair = pair_id AND label::DOUBLE = ratio'),
    "walk_forward_report": sql(WALK, f"""SELECT {r("mean_sharpe", 4)}, {r("se", 4)}, n_kept, n_dropped,
        CASE WHEN n_kept = 0 THEN 'no pair kept, so nothing is known out of sample'
             WHEN n_kept < 3 THEN printf('%d of %d pairs kept; their mean Sharpe ratio of %+.3f can''t tell an edge from noise', n_kept, n_kept + n_dropped, mean_sharpe)
             ELSE printf('%d of %d pairs kept; mean Sharpe ratio %+.3f, error %.3f', n_kept, n_kept + n_dropped, mean_sharpe, se) END AS verdict
      FROM (SELECT avg(sharpe_ratio) AS mean_sharpe, CASE WHEN count(sharpe_ratio) >= 2 THEN stddev_samp(sharpe_ratio) / sqrt(count(sharpe_ratio)) END AS se, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_dropped
            FROM planned LEFT JOIN summed ON pair = pair_id)"""),
    "intent_events": sql(INTENTS, "SELECT pair_id, idx, concat_ws(';', nullif(event, ''), CASE WHEN open_end THEN 'exit:end_of_data' END) AS trade_event FROM filled WHERE event <> '' OR open_end"),
    "intent_trades": sql(INTENTS, f"SELECT pair_id, direction, entry_index, exit_index, exit_reason, {ms('pnl_gross', 'costs')}, round(pnl_gross - costs, 2) + 0.0::DOUBLE AS pnl_net FROM worth"),
    "candidate_outcomes": sql("", "SELECT asset_a, asset_b, ok, n_dates, reason FROM results", CANDIDATES),
    "screen_outcomes": sql("", f"""SELECT asset_a, asset_b, CASE WHEN NOT ok THEN reason WHEN corr IS NULL THEN 'flat leg' WHEN abs(corr) < 0.02 THEN 'correlation below' ELSE 'tested' END AS outcome, n_dates, {r('corr', 4)}
      FROM results LEFT JOIN (
        SELECT asset_a, asset_b, covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0) AS corr FROM (
          SELECT asset_a, asset_b, ln(price_a) - ln(lag(price_a) OVER w) AS a, ln(price_b) - ln(lag(price_b) OVER w) AS b FROM common SEMI JOIN (SELECT * FROM results WHERE ok) USING (asset_a, asset_b) WINDOW w AS (PARTITION BY asset_a, asset_b ORDER BY date)
        ) WHERE a IS NOT NULL GROUP BY 1, 2) USING (asset_a, asset_b)""", CANDIDATES),
    "visible_days": sql("", "SELECT pair_id, idx, list_aggregate(list(idx) OVER (PARTITION BY pair_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 'string_agg', ',') AS last_five, count(*) OVER (PARTITION BY pair_id ORDER BY idx) AS n_visible FROM bars"),
    "cusum": sql(CUSUM, f"SELECT pair_id, {r('max_excursion')}, break_index, crossed FROM (SELECT pair_id, max(excursion) AS max_excursion, min(idx) FILTER (excursion > 1) AS break_index, bool_or(excursion > 1) AS crossed FROM pathed GROUP BY pair_id)"),
    "t_test_p_values": sql(RUN, f"SELECT pair_id, n_trades, {ms('mean_pnl', 'se_pnl')}, {r('t_stat', 4)}, round({t_tail('t_stat', '(n_trades - 1)')}, 5) + 0.0::DOUBLE AS p_value FROM (SELECT *, mean_pnl / se_pnl AS t_stat FROM (SELECT pair_id, count(*) AS n_trades, avg(pnl_net) AS mean_pnl, stddev_samp(pnl_net) / sqrt(count(*)) AS se_pnl FROM trades GROUP BY pair_id HAVING count(*) >= 2))"),
    "variance_ratio_tests": sql(RATIOS, f"""SELECT pair_id, horizon, n_obs, round(vr, 6) + 0.0::DOUBLE AS variance_ratio, round(z, 4) + 0.0::DOUBLE AS z_homoskedastic, round(zr, 4) + 0.0::DOUBLE AS z_robust,
        round(2 * (1 - {phi('abs(z)')}), 4) + 0.0::DOUBLE AS p_homoskedastic, round(2 * (1 - {phi('abs(zr)')}), 4) + 0.0::DOUBLE AS p_robust, 2 * (1 - {phi('abs(zr)')}) < 0.05 AS rejects_random_walk,
        CASE WHEN vr IS NULL THEN 'undefined' WHEN vr < 0.95 THEN 'mean-reverting' WHEN vr > 1.05 THEN 'trending' ELSE 'random walk' END AS interpretation
      FROM (SELECT *, (vr - 1) / plain AS z, CASE WHEN theta > 0 THEN (vr - 1) / sqrt(theta) END AS zr FROM ratios)"""),
    "deflated_sharpe": sql(GRID + f""", best AS (SELECT pair, max(sharpe_ratio) AS observed, count(*) AS trials FROM summed GROUP BY pair),
      wanted_p AS (SELECT DISTINCT 1 - 1.0::DOUBLE / trials AS p FROM best UNION SELECT DISTINCT 1 - 1 / (trials * exp(1.0::DOUBLE)) FROM best), {QUANTILE},
      lucky AS (
        SELECT b.*, n_obs, sqrt(252.0::DOUBLE / n_obs) * ((1 - 0.5772156649015329::DOUBLE) * x.q + 0.5772156649015329::DOUBLE * y.q) AS expected_best, sqrt((1 + pow(observed / sqrt(252), 2) / 2) / (n_obs - 1)) * sqrt(252) AS error
        FROM best b JOIN (SELECT pair_id, count(*) - 1 AS n_obs FROM bars GROUP BY pair_id) ON pair_id = pair JOIN quantiles x ON x.p = 1 - 1.0::DOUBLE / trials JOIN quantiles y ON y.p = 1 - 1 / (trials * exp(1.0::DOUBLE))
      )""", f"SELECT pair AS pair_id, trials, {rs('observed', 'expected_best')}, round(observed - expected_best, 6) + 0.0::DOUBLE AS excess, round(s, 4) + 0.0::DOUBLE AS statistic, round(1 - {phi('s')}, 5) + 0.0::DOUBLE AS p_value, observed > expected_best AS survives FROM (SELECT *, (observed - expected_best) / error AS s FROM lucky)"),
    "walk_forward": sql(WALK, f'SELECT pair_id, {rs("half_life")}, k AS "window", kept, {rs("sharpe_ratio")}, n_trades FROM planned LEFT JOIN summed ON pair = pair_id'),
}
