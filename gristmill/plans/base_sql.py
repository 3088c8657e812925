"""SQL for DuckDB that queries share: bars, features and the prediction panel as common table expressions."""

from __future__ import annotations

import math

from gristmill.operators.features import FEATURES

BARS = """
bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume, CASE WHEN o_orderpriority < '3' THEN 'FAST' ELSE 'SLOW' END AS sector FROM orders GROUP BY 1, 2, 8),
bench AS (SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close, max(o_totalprice) AS high, min(o_totalprice) AS low FROM orders GROUP BY 1)"""


def _full(fn: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER w{n} = {n} THEN {fn}({c}) OVER w{n} END"


def _ema(c: str, span: int) -> str:
    b = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"pow({b}, i) * sum(CASE WHEN i = 0 THEN 1.0 ELSE 1 - {b} END * {c} * pow({b}, -i)) OVER (PARTITION BY symbol ORDER BY i)"


_WINDOWS = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in (10, 14, 20, 50, 60, 252))
A = repr(math.sqrt(252.0))
FEATURES_SQL = f"""{BARS},
f1 AS (SELECT *, row_number() OVER w - 1 AS i, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 5) OVER w - 1 AS ret_5, close / lag(close, 20) OVER w - 1 AS ret_20,
  ln(close / lag(close, 1) OVER w) AS log_ret_1, open / lag(close, 1) OVER w - 1 AS gap_pct, (high - low) / close AS range_pct, close - lag(close, 1) OVER w AS chg
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
f2 AS (SELECT *, CASE WHEN chg > 0 THEN chg WHEN chg IS NOT NULL THEN 0.0 END AS gain, CASE WHEN chg < 0 THEN -chg WHEN chg IS NOT NULL THEN 0.0 END AS loss FROM f1),
f3 AS (SELECT *, {_full('stddev_samp', 'log_ret_1', 20)} * {A} AS vol_20, {_full('stddev_samp', 'log_ret_1', 60)} * {A} AS vol_60,
  {_full('avg', 'close', 10)} AS sma_10, {_full('avg', 'close', 20)} AS sma_20, {_full('avg', 'close', 50)} AS sma_50, {_full('stddev_samp', 'close', 20)} AS std_20,
  {_full('avg', 'volume', 20)} AS vol_mean_20, {_full('stddev_samp', 'volume', 20)} AS vol_std_20, {_full('max', 'high', 20)} AS high_20, {_full('min', 'low', 20)} AS low_20,
  {_full('avg', 'gain', 14)} AS avg_gain, {_full('avg', 'loss', 14)} AS avg_loss, {_ema('close', 12)} AS ema_12, {_ema('close', 26)} AS ema_26
  FROM f2 WINDOW {_WINDOWS}),
f4 AS (SELECT *, ema_12 - ema_26 AS macd, list(vol_20) FILTER (vol_20 IS NOT NULL) OVER w252 AS seen FROM f3 WINDOW {_WINDOWS}),
b1 AS (SELECT date, close / lag(close, 1) OVER w - 1 AS bench_ret_1, close / lag(close, 5) OVER w - 1 AS bench_ret_5, close / lag(close, 20) OVER w - 1 AS bench_trend_20, ln(close / lag(close, 1) OVER w) AS bench_log_ret_1
  FROM bench WINDOW w AS (ORDER BY date)),
b2 AS (SELECT *, CASE WHEN count(bench_log_ret_1) OVER v20 = 20 THEN stddev_samp(bench_log_ret_1) OVER v20 END * {A} AS bench_vol_20,
  CASE WHEN count(bench_log_ret_1) OVER v60 = 60 THEN stddev_samp(bench_log_ret_1) OVER v60 END * {A} AS bench_vol_60
  FROM b1 WINDOW v20 AS (ORDER BY date ROWS 19 PRECEDING), v60 AS (ORDER BY date ROWS 59 PRECEDING)),
f5 AS (SELECT f4.*, b2.* EXCLUDE (date), {_ema('macd', 9)} AS macd_signal,
  CASE WHEN log_ret_1 IS NOT NULL THEN bench_log_ret_1 END AS bb, CASE WHEN bench_log_ret_1 IS NOT NULL THEN log_ret_1 END AS oo,
  coalesce(ret_1 > 0, false)::INTEGER AS up FROM f4 LEFT JOIN b2 USING (date)),
feat AS (SELECT symbol, date, sector, open, high, low, close, volume, i, log_ret_1 IS NULL AS first_row, ret_1, ret_5, ret_20, log_ret_1, gap_pct, range_pct, vol_20, vol_60, vol_20 / nullif(vol_60, 0) AS vol_ratio,
  close / sma_10 - 1 AS sma_10_gap, close / sma_50 - 1 AS sma_50_gap, (sma_10 - sma_50) / sma_50 AS trend_strength, (close - sma_20) / nullif(2 * std_20, 0) AS bb_pos, 4 * std_20 / sma_20 AS bb_width,
  (volume - vol_mean_20) / nullif(vol_std_20, 0) AS volume_z, volume / vol_mean_20 AS rel_volume, ln(1 + close * volume) AS dollar_volume_log, close / high_20 - 1 AS close_to_high_20, close / low_20 - 1 AS close_to_low_20,
  100 - 100 / (1 + avg_gain / CASE WHEN avg_loss = 0 THEN 1e-9 ELSE avg_loss END) AS rsi_14, close / ema_12 - 1 AS ema_12_gap, macd, macd_signal, macd - macd_signal AS macd_hist,
  CASE WHEN count(bb) OVER w60 = 60 THEN covar_samp(oo, bb) OVER w60 / nullif(var_samp(bb) OVER w60, 0) END AS beta_60,
  CASE WHEN count(bb) OVER w60 = 60 THEN covar_samp(oo, bb) OVER w60 / nullif(sqrt(var_samp(bb) OVER w60 * var_samp(oo) OVER w60), 0) END AS corr_bench_60,
  bench_ret_1, bench_ret_5, bench_trend_20, bench_vol_20, bench_vol_60, ret_1 - bench_ret_1 AS excess_ret_1,
  avg(ret_1) OVER (PARTITION BY date, sector) AS sector_ret_1, avg(up) OVER (PARTITION BY date, sector) AS sector_breadth, avg(up) OVER (PARTITION BY date) AS market_breadth,
  CASE WHEN vol_20 IS NOT NULL AND len(seen) >= 60 THEN (len(list_filter(seen, lambda x: x < vol_20)) + (len(list_filter(seen, lambda x: x = vol_20)) + 1) / 2) / len(seen) END AS regime_vol_percentile
  FROM f5 WINDOW {_WINDOWS})"""

#: Predictions over the bars: three members, their mean, how far they agree, what came, and the expected move.
PANEL_SQL = f"""{FEATURES_SQL},
p1 AS (SELECT symbol, date, sector, 0.5 + 0.3 * tanh(ret_1 / 4) AS p1, 0.5 - 0.2 * tanh(ret_5 / 4) AS p2, 0.5 + 0.25 * tanh(sma_10_gap) AS p3,
  lead(close) OVER w / close - 1 AS raw, lead(date) OVER w AS known_at, tanh(vol_20 / 100) / 25 AS day_move, coalesce(volume_z, 0) AS volume_z, corr_bench_60, ret_1, market_breadth
  FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY date)),
panel AS (SELECT symbol, date, sector, p1, p2, p3, (p1 + p2 + p3) / 3 AS p, greatest(k / 3, 1 - k / 3) AS agreement, sqrt(greatest(0, (p1 * p1 + p2 * p2 + p3 * p3) / 3 - ((p1 + p2 + p3) / 3) * ((p1 + p2 + p3) / 3))) AS spread,
  CASE WHEN raw > 0 THEN 1.0 ELSE 0.0 END AS y, tanh(raw) / 50 AS fwd_ret, known_at, day_move, volume_z, corr_bench_60, ret_1, market_breadth,
  2 * abs((p1 + p2 + p3) / 3 - 0.5) * coalesce(day_move, 0.012) * 10000 AS edge_bps
  FROM (SELECT *, (p1 >= 0.5)::INTEGER + (p2 >= 0.5)::INTEGER + (p3 >= 0.5)::INTEGER AS k FROM p1) WHERE raw IS NOT NULL AND p3 IS NOT NULL AND p2 IS NOT NULL)"""


def features_query(columns: list[str]) -> str:
    return f"WITH {FEATURES_SQL} SELECT symbol, date, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM feat"


ALL_FEATURES = features_query(FEATURES)
