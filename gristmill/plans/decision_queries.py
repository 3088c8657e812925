"""Gates, stress tests, backtests, risk, failures and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.operators import decisions as dc
from gristmill.operators.intelligence import market_state
from gristmill.operators.panel import MEMBERS, prediction_panel
from gristmill.plans.aggregate_queries import TRIAGE_SQL, triaged
from gristmill.plans.base_sql import BARS, PANEL_SQL
from gristmill.plans.feature_queries import matrix
from gristmill.plans.metric_queries import panel


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = matrix(spark, sf_dir)
    return dc.forecasts_of(prediction_panel(features), dc.position_risk(features), dc.regimes(market_state(features)))


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts whose quality, calibration, health, stability and coverage are measured as of their dates."""
    return dc.measured_forecasts(forecasts(spark, sf_dir), panel(spark, sf_dir), dc.quality_to_date(triaged(spark, sf_dir)))


def measured_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).select("symbol", "date", "data_quality", "calibration_ece", "drift_state", "stability_score", r6(F.col("modality_coverage")).alias("modality_coverage"))


def measured_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = dc.gate(measured(spark, sf_dir))
    return gated.select("symbol", "date", "verdict", r6(F.col("trust"), 4).alias("trust"), F.array_join("blocking", "|").alias("blocking"))


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each check fails."""
    gated = dc.gate(forecasts(spark, sf_dir))
    return gated.select(F.explode("blocking").alias("check")).groupBy("check").agg(F.count("*").alias("failed"))


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = dc.gate(forecasts(spark, sf_dir))
    return gated.select("symbol", "date", "verdict", r6(F.col("trust"), 4).alias("trust"), r6(F.col("net_edge_bps"), 4).alias("net_edge_bps"), F.array_join("blocking", "|").alias("blocking"))


def stress_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dc.stress(forecasts(spark, sf_dir)).groupBy("scenario", "verdict")
    return out.agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


def pretrade_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("symbol", "date", r6(F.col("edge_bps"), 4).alias("edge_bps"))


def backtest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.backtest_daily(panel(spark, sf_dir)).select("strategy", "date", r6(F.col("net")).alias("net"), r6(F.col("exposure")).alias("exposure"))


def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.performance(dc.backtest_daily(panel(spark, sf_dir)))


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.equity_curve(dc.backtest_daily(panel(spark, sf_dir)))


def position_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.position_risk(matrix(spark, sf_dir))


def decision_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.decided(panel(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))


def decision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.decision_quality(dc.decided(panel(spark, sf_dir)))


def vol_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.vol_deciles(panel(spark, sf_dir))


def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.failure_tags(panel(spark, sf_dir)).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    regime = dc.regimes(market_state(matrix(spark, sf_dir)))
    rows = dc.failure_causes(panel(spark, sf_dir), regime, dc.quality_to_date(triaged(spark, sf_dir)))
    return rows.select("symbol", "date", F.array_join("tags", "|").alias("tags"))


def cemetery_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dc.failure_tags(panel(spark, sf_dir)).select("symbol", "date", r6(F.col("conviction")).alias("conviction"), F.array_join("tags", "|").alias("tags"))
    return rows.orderBy(F.desc("conviction"), "symbol", "date").limit(40)


def recommend_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.recommend(spark, dc.gate(forecasts(spark, sf_dir)))


def forecast_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.audit(dc.gate(forecasts(spark, sf_dir)))


def leaderboard_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.leaderboard(panel(spark, sf_dir), MEMBERS)


def market_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.market_pressure(dc.gate(forecasts(spark, sf_dir)))


def experiment_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the mean of the members beat each of them? Supported if Brier falls by more than 0.0005."""
    rows = panel(spark, sf_dir)
    loss = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    one = rows.agg(loss("p").alias("p"), *(loss(m).alias(m) for m in MEMBERS))
    arms = one.select("p", F.explode(F.array(*(F.struct(F.lit(m).alias("arm"), F.col(m).alias("brier")) for m in MEMBERS))).alias("a")).select("p", "a.*")
    gain = F.col("brier") - F.col("p")
    return arms.select("arm", r6(F.col("brier")).alias("brier"), r6(gain).alias("gain"), F.when(gain > 0.0005, "SUPPORTED").otherwise("NOT SUPPORTED").alias("conclusion"))


QUERIES = {f.__name__: f for f in (measured_inputs, measured_verdicts, failure_causes, gate_checks, gate_verdicts, stress_grid, pretrade_edge, backtest_daily, backtest_summary, equity_curve, position_risk, decision_categories, decision_quality, failure_tags, vol_deciles, cemetery_topk, recommend_rank, forecast_audit, leaderboard_weights, market_pressure, experiment_arms)}

_P = f"WITH {PANEL_SQL}"
STATE_SQL = """s1 AS (SELECT date, any_value(bench_ret_1) AS bench_ret_1, any_value(bench_trend_20) AS bench_trend_20, any_value(bench_vol_20) AS bench_vol_20, any_value(bench_vol_60) AS bench_vol_60, any_value(market_breadth) AS market_breadth, stddev_samp(ret_1) AS dispersion FROM feat GROUP BY date),
s2 AS (SELECT *, CASE WHEN count(market_breadth) OVER w = 20 THEN avg(market_breadth) OVER w END AS market_breadth_20, CASE WHEN count(dispersion) OVER w = 20 THEN avg(dispersion) OVER w END AS dispersion_20, sum(ln(1 + coalesce(tanh(bench_ret_1) / 50, 0))) OVER (ORDER BY date) AS g FROM s1 WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)),
state AS (SELECT * EXCLUDE (g), exp(g - max(g) OVER (ORDER BY date)) - 1 AS drawdown FROM s2),
r1 AS (SELECT date, bench_trend_20 AS tr, bench_vol_20 / bench_vol_60 AS ra, least(1.0, 0.4 + abs(tanh(bench_trend_20)) / 2) AS regime_confidence FROM state WHERE bench_trend_20 IS NOT NULL AND bench_vol_60 IS NOT NULL),
regime AS (SELECT date, CASE WHEN regime_confidence < 0.42 THEN 'TRANSITION' WHEN ra > 1.25 THEN 'HIGH_VOLATILITY' WHEN tr > 0.2 THEN 'BULL' WHEN tr < -0.2 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime, regime_confidence FROM r1)"""
_RISK = """k1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM feat),
k2 AS (SELECT *, sum(ln(1 + tanh(ret_1) / 50)) OVER (PARTITION BY symbol ORDER BY date) AS c FROM k1 WHERE k <= 60),
k3 AS (SELECT *, exp(c - max(c) OVER (PARTITION BY symbol ORDER BY date)) - 1 AS d FROM k2),
k4 AS (SELECT symbol, arg_max(vol_20, date) AS vol_20, arg_max(beta_60, date) AS beta_60, min(d) AS dd FROM k3 GROUP BY symbol),
k5 AS (SELECT *, greatest(0.0, least(100.0, 100 * (0.5 * least(tanh(vol_20 / 100) / 25 / 0.045, 2.0) / 2 + 0.25 * least(abs(coalesce(beta_60, 1.0)) / 1.8, 1.0) + 0.25 * least(abs(dd) / 0.25, 1.0)))) AS score FROM k4),
risk AS (SELECT symbol, round(dd, 6) AS drawdown_60, round(score, 6) AS risk_score, CASE WHEN score < 35 THEN 'LOW' WHEN score < 62 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM k5)"""
_FORECAST = f"""{PANEL_SQL}, {STATE_SQL}, {_RISK},
fc AS (SELECT symbol, date, p AS probability, day_move AS expected_move, 96.0 AS data_quality, agreement AS model_agreement, 0.3 * (1 - agreement) + 0.4 * least(spread / 0.2, 1.0) AS uncertainty, 0.02 AS calibration_ece,
  CASE WHEN year(date) % 5 = 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS drift_state, coalesce(regime, 'TRANSITION') AS regime, coalesce(regime_confidence, 0.0) AS regime_confidence, coalesce(risk_score, 50.0) AS risk_score, 0.7 AS stability_score, 0.8 AS modality_coverage,
  (p2 + p3) / 2 AS probability_without, greatest(((p2 >= 0.5)::INTEGER + (p3 >= 0.5)::INTEGER) / 2, 1 - ((p2 >= 0.5)::INTEGER + (p3 >= 0.5)::INTEGER) / 2) AS agreement_without
  FROM panel LEFT JOIN risk USING (symbol) LEFT JOIN regime USING (date))"""
_CHECKS = [
    ("DATA QUALITY", "data_quality >= 85", 0.15), ("FORECAST CONVICTION", "abs(probability - 0.5) >= 0.055", 0.20), ("MODEL AGREEMENT", "model_agreement >= 0.55", 0.15), ("UNCERTAINTY", "uncertainty <= 0.62", 0.15), ("CALIBRATION", "calibration_ece <= 0.06", 0.08),
    ("MODEL HEALTH", "drift_state IN ('HEALTHY', 'WATCH')", 0.10), ("MARKET STABILITY", "regime_confidence >= 0.45 AND regime <> 'TRANSITION'", 0.07), ("RISK", "risk_score <= 75", 0.05), ("COST ADVANTAGE", "2 * abs(probability - 0.5) * abs(expected_move) * 10000 - 18 >= 12", 0.05),
]


def _gate(src: str, to: str) -> str:
    blocking = ", ".join(f"CASE WHEN NOT coalesce({x}, false) THEN '{n}' END" for n, x, _ in _CHECKS)
    weight = " + ".join(f"CASE WHEN coalesce({x}, false) THEN {w} ELSE 0 END" for _, x, w in _CHECKS)
    return f"""{to}0 AS (SELECT *, list_filter([{blocking}], lambda x: x IS NOT NULL) AS blocking, 2 * abs(probability - 0.5) * abs(expected_move) * 10000 - 18 AS net_edge_bps,
  greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({weight})::DOUBLE * 100 * (0.85 + 0.15 * stability_score)::DOUBLE * (0.9 + 0.1 * modality_coverage)::DOUBLE)) AS trust FROM {src}),
{to} AS (SELECT *, CASE WHEN len(blocking) > 0 THEN 'NO ACTION' WHEN probability >= 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict FROM {to}0)"""


_GAPS = ", ".join(f"sum(CASE WHEN least(9, greatest(0, floor(p * 10))) = {i} THEN p - y ELSE 0 END) AS gap_{i}" for i in range(10))
_EVER = " + ".join(f"abs(sum(gap_{i}) OVER e)" for i in range(10))
_MEASURED = f"""{_FORECAST}, {TRIAGE_SQL.removeprefix(BARS + ",")},
m0 AS (SELECT known_at AS date, count(*) AS n, sum((p - y) ** 2) AS loss, count(*) FILTER ((p >= 0.5) = (y = 1)) AS hits, {_GAPS} FROM panel WHERE known_at IS NOT NULL GROUP BY 1),
m1 AS (SELECT date, ({_EVER}) / sum(n) OVER e AS ece, sum(hits) OVER l / sum(n) OVER l AS acc, sum(loss) OVER l / sum(n) OVER l - (sum(loss) OVER e - sum(loss) OVER l) / nullif(sum(n) OVER e - sum(n) OVER l, 0) AS worse
  FROM m0 WINDOW e AS (ORDER BY date), l AS (ORDER BY date ROWS 119 PRECEDING)),
known AS (SELECT date, round(ece, 6) AS ece, CASE WHEN acc < 0.45 THEN 'UNRELIABLE' WHEN worse > 0.02 THEN 'DEGRADED' WHEN worse > 0.008 THEN 'WATCH' ELSE 'HEALTHY' END AS drift FROM m1),
q0 AS (SELECT symbol, date, sum(CASE status WHEN 'VALID' THEN 1.0 WHEN 'SUSPICIOUS' THEN 0.5 ELSE 0 END)::DOUBLE AS worth, count(*) AS n FROM tri GROUP BY 1, 2),
qual AS (SELECT symbol, date, round(100 * sum(worth) OVER w / sum(n) OVER w, 6) AS dq FROM q0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t0 AS (SELECT symbol, date, p, p - lag(p) OVER w AS step, coalesce((p >= 0.5) <> (lag(p) OVER w >= 0.5), false)::INTEGER AS flip, ((day_move IS NOT NULL)::INTEGER + (corr_bench_60 IS NOT NULL)::INTEGER + (market_breadth IS NOT NULL)::INTEGER) / 3 AS cover FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t1 AS (SELECT *, count(p) OVER (PARTITION BY symbol ORDER BY date ROWS 9 PRECEDING) AS k, sum(flip) OVER v AS flips, stddev_pop(step) OVER v AS sd FROM t0 WINDOW v AS (PARTITION BY symbol ORDER BY date ROWS 8 PRECEDING)),
t2 AS (SELECT symbol, date, cover, round(CASE WHEN k >= 3 THEN greatest(0.0, least(1.0, 1 - flips / (k - 1) - least(sd / 0.08, 1.0) * 0.5)) ELSE 0.5 END, 6) AS steady FROM t1),
mf AS (SELECT fc.* REPLACE (coalesce(dq, 50.0) AS data_quality, coalesce(ece, 0.05) AS calibration_ece, coalesce(drift, 'HEALTHY') AS drift_state, steady AS stability_score, cover AS modality_coverage)
  FROM fc JOIN t2 USING (symbol, date) LEFT JOIN qual USING (symbol, date) LEFT JOIN known USING (date))"""
_SCENARIOS = {
    "VOLATILITY_X2": {"expected_move": "expected_move * 2", "risk_score": "least(100.0, risk_score * 1.6)", "uncertainty": "least(1.0, uncertainty + 0.12)"},
    "NEGATIVE_SENTIMENT": {"probability": "0.5 + (probability - 0.5) * 0.6", "uncertainty": "least(1.0, uncertainty + 0.1)"},
    "SECTOR_REVERSAL": {"model_agreement": "greatest(0.0, model_agreement - 0.25)", "probability": "0.5 + (probability - 0.5) * 0.7"},
    "MARKET_SHOCK": {"regime": "'TRANSITION'", "regime_confidence": "least(regime_confidence, 0.4)", "risk_score": "least(100.0, risk_score + 25)", "expected_move": "expected_move * 1.5"},
    "MODEL_REMOVED": {"probability": "probability_without", "model_agreement": "agreement_without", "uncertainty": "least(1.0, uncertainty + 0.08)"},
    "NEWS_MISSING": {"modality_coverage": "greatest(0.0, modality_coverage - 0.2)", "uncertainty": "least(1.0, uncertainty + 0.05)"},
    "DELAYED_DATA": {"data_quality": "greatest(0.0, data_quality - 18)", "uncertainty": "least(1.0, uncertainty + 0.07)"},
}
_STRESSED = "st AS (" + " UNION ALL ".join(f"SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in change.items())}), '{n}' AS scenario FROM base" for n, change in _SCENARIOS.items()) + ")"
_OK = "abs(p - 0.5) >= 0.055 AND agreement >= 0.55 AND spread <= 0.62 AND edge_bps >= 30"
_BT = f"""{_P}, sg AS (SELECT *, lead(fwd_ret) OVER (PARTITION BY symbol ORDER BY date) AS later, CASE WHEN {_OK} THEN CASE WHEN p >= 0.5 THEN 1.0 ELSE -1.0 END ELSE 0.0 END AS gated FROM panel),
sig AS (SELECT date, 'BUY_AND_HOLD' AS strategy, 1.0 AS signal, fwd_ret AS ret FROM sg UNION ALL SELECT date, 'ALWAYS_LONG_SIGNAL', CASE WHEN p >= 0.5 THEN 1.0 ELSE -1.0 END, fwd_ret FROM sg
  UNION ALL SELECT date, 'MODEL', CASE WHEN p >= 0.5 + 0.055 THEN 1.0 WHEN p <= 0.5 - 0.055 THEN -1.0 ELSE 0.0 END, fwd_ret FROM sg UNION ALL SELECT date, 'ADAPTIVE_GATE', gated, fwd_ret FROM sg UNION ALL SELECT date, 'ADAPTIVE_GATE_T1', gated, later FROM sg),
bd0 AS (SELECT strategy, date, avg(signal * ret) FILTER (signal <> 0 AND ret IS NOT NULL) AS gross, avg(abs(signal)) FILTER (signal <> 0 AND ret IS NOT NULL) AS ex FROM sig GROUP BY 1, 2),
bd AS (SELECT strategy, date, coalesce(gross - CASE WHEN strategy = 'BUY_AND_HOLD' THEN 0 ELSE 2 * ex * 9 / 10000 END, 0) AS net, coalesce(ex, 0) AS exposure FROM bd0),
eq AS (SELECT *, sum(ln(1 + net)) OVER (PARTITION BY strategy ORDER BY date) AS g FROM bd),
ed AS (SELECT *, exp(g - max(g) OVER (PARTITION BY strategy ORDER BY date)) - 1 AS dd FROM eq)"""
_DEC = f"""{_P}, d0 AS (SELECT *, abs(p - 0.5) >= 0.055 AND agreement >= 0.55 AND edge_bps >= 30 AS acted, (p >= 0.5) = (y = 1) AS correct, (sign(p - 0.5) * fwd_ret - 18 / 10000) * 10000 AS net FROM panel),
dec AS (SELECT *, CASE WHEN acted AND correct THEN 'ACTED_WITH_EDGE_CORRECT' WHEN acted THEN 'ACTED_WITH_EDGE_INCORRECT' WHEN edge_bps < 30 THEN 'ABSTAINED_BELOW_EDGE' ELSE 'ABSTAINED_DESPITE_EDGE' END AS category FROM d0)"""
_FAIL = f"""{_P}, h0 AS (SELECT *, list(day_move) FILTER (day_move IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date) AS seen, coalesce((p >= 0.5) <> (lag(p) OVER (PARTITION BY symbol ORDER BY date) >= 0.5), false)::INTEGER AS flip FROM panel),
h1 AS (SELECT *, sum(flip) OVER (PARTITION BY symbol ORDER BY date ROWS 2 PRECEDING) AS flips, CASE WHEN day_move IS NOT NULL THEN len(list_filter(seen, lambda x: x <= day_move)) / len(seen) END AS vs, abs(p - 0.5) AS conviction FROM h0),
h2 AS (SELECT symbol, date, conviction, list_filter([CASE WHEN vs >= 0.9 THEN 'VOLATILITY_SHOCK' END, CASE WHEN conviction < 0.055 THEN 'INSUFFICIENT_EVIDENCE' END, CASE WHEN agreement < 0.7 THEN 'MODEL_DISAGREEMENT' END,
  CASE WHEN agreement >= 0.7 AND conviction > 0.08 THEN 'MODEL_OVERCONFIDENCE' END, CASE WHEN flips > 1 THEN 'FORECAST_INSTABILITY' END], lambda x: x IS NOT NULL) AS t FROM h1 WHERE (p >= 0.5) <> (y = 1)),
fail AS (SELECT symbol, date, conviction, CASE WHEN len(t) > 0 THEN t ELSE ['UNEXPLAINED'] END AS tags FROM h2)"""
_CAUSES = f"""{_FAIL}, {STATE_SQL}, {TRIAGE_SQL.removeprefix(BARS + ",")},
sh AS (SELECT date, coalesce(regime <> lag(regime) OVER (ORDER BY date), false) AS shift FROM regime),
qq AS (SELECT symbol, date, sum(bad) OVER w / sum(n) OVER w AS rate FROM (SELECT symbol, date, count(*) FILTER (status <> 'VALID') AS bad, count(*) AS n FROM tri GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
cz AS (SELECT symbol, date, list_filter(tags, lambda x: x <> 'UNEXPLAINED') || list_filter([CASE WHEN shift THEN 'REGIME_SHIFT' END, CASE WHEN day_move IS NULL OR corr_bench_60 IS NULL THEN 'MISSING_MODALITY' END, CASE WHEN round(rate, 6) > 0.05 THEN 'DATA_QUALITY' END], lambda x: x IS NOT NULL) AS t
  FROM fail JOIN (SELECT symbol, date, day_move, corr_bench_60 FROM panel) USING (symbol, date) LEFT JOIN qq USING (symbol, date) LEFT JOIN sh USING (date))"""
_PROFILES = ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, (a, b, c, d) in dc.PROFILES.items())
ORACLES = {
    "measured_inputs": f"WITH {_MEASURED} SELECT symbol, date, data_quality::DOUBLE AS data_quality, calibration_ece::DOUBLE AS calibration_ece, drift_state, stability_score::DOUBLE AS stability_score, round(modality_coverage, 6) AS modality_coverage FROM mf",
    "measured_verdicts": f"WITH {_MEASURED}, {_gate('mf', 'g')} SELECT symbol, date, verdict, round(trust, 4) AS trust, array_to_string(blocking, '|') AS blocking FROM g",
    "gate_checks": f"WITH {_FORECAST}, {_gate('fc', 'g')} SELECT u AS \"check\", count(*) AS failed FROM (SELECT unnest(blocking) AS u FROM g) GROUP BY 1",
    "gate_verdicts": f"WITH {_FORECAST}, {_gate('fc', 'g')} SELECT symbol, date, verdict, round(trust, 4) AS trust, round(net_edge_bps, 4) AS net_edge_bps, array_to_string(blocking, '|') AS blocking FROM g",
    "stress_grid": f"WITH {_FORECAST}, {_gate('fc', 'g')}, base AS (SELECT * EXCLUDE (blocking, net_edge_bps, trust, verdict), verdict AS base_verdict FROM g), {_STRESSED}, {_gate('st', 'z')} SELECT scenario, verdict, count(*) AS n, count(*) FILTER (verdict <> base_verdict) AS changed FROM z GROUP BY 1, 2",
    "pretrade_edge": f"{_P} SELECT symbol, date, round(edge_bps, 4) AS edge_bps FROM panel",
    "backtest_daily": f"{_BT} SELECT strategy, date, round(net, 6) AS net, round(exposure, 6) AS exposure FROM bd",
    "backtest_summary": f"""{_BT}, var AS (SELECT strategy, CASE WHEN count(*) > 20 THEN quantile_cont(net, 0.05) ELSE 0 END AS var FROM bd GROUP BY 1),
      a AS (SELECT strategy, count(*) AS n_sessions, sum(ln(1 + net)) AS g, stddev_samp(net) AS sd, stddev_samp(net) FILTER (net < 0) AS dsd, count(*) FILTER (net < 0) AS nd, min(dd) AS mdd, max(var) AS var, avg(net) FILTER (net <= var) AS cvar, avg((net > 0)::INTEGER) AS hit, avg(exposure) AS ex, count(*) FILTER (exposure > 0) AS traded FROM ed JOIN var USING (strategy) GROUP BY 1),
      b AS (SELECT *, exp(g * 252 / n_sessions) - 1 AS ann, CASE WHEN n_sessions > 2 THEN sd * sqrt(252.0) ELSE 0 END AS vol, CASE WHEN nd > 2 THEN dsd * sqrt(252.0) ELSE 0 END AS dvol FROM a)
      SELECT strategy, n_sessions, round(100 * (exp(g) - 1), 6) AS total_return_pct, round(100 * ann, 6) AS annualised_return_pct, round(100 * vol, 6) AS annualised_vol_pct, round(CASE WHEN vol > 1e-9 THEN (ann - 0.065) / vol ELSE 0 END, 6) AS sharpe, round(CASE WHEN dvol > 1e-9 THEN (ann - 0.065) / dvol ELSE 0 END, 6) AS sortino,
        round(100 * mdd, 6) AS max_drawdown_pct, round(100 * var, 6) AS var_95_pct, round(100 * coalesce(cvar, var), 6) AS cvar_95_pct, round(100 * hit, 6) AS hit_rate_pct, round(ex, 6) AS mean_exposure, traded AS sessions_traded FROM b""",
    "equity_curve": f"{_BT} SELECT strategy, date, round(exp(g), 6) AS equity, round(dd, 6) AS drawdown FROM ed",
    "position_risk": f"WITH {PANEL_SQL}, {_RISK} SELECT * FROM risk",
    "decision_categories": f"{_DEC} SELECT category, count(*) AS n FROM dec GROUP BY 1",
    "decision_quality": f"""{_DEC}, q AS (SELECT count(*) AS n, avg(correct::INTEGER) AS acc, avg(correct::INTEGER) FILTER (acted) AS sel, avg(acted::INTEGER) AS cov, coalesce(avg(net) FILTER (acted), 0) AS m, coalesce(avg(net) FILTER (NOT acted), 0) AS m0, avg((net > 0)::INTEGER) FILTER (acted) AS win, median(net) FILTER (acted) AS med, min(net) FILTER (acted) AS worst, max(net) FILTER (acted) AS best, count(*) FILTER (acted) AS trades FROM dec)
      SELECT n, round(100 * acc, 6) AS forecast_accuracy_pct, round(100 * sel, 6) AS selective_accuracy_pct, round(100 * cov, 6) AS action_coverage_pct, round(100 * (1 - cov), 6) AS abstention_rate_pct, round(m, 6) AS mean_net_bps, round(cov * m, 6) AS decision_utility_bps, round(-m0, 6) AS downside_avoidance_bps, round(m - m0, 6) AS abstention_value_bps,
        round(100 * win, 6) AS net_win_rate_pct, round(med, 6) AS median_net_bps, round(worst, 6) AS worst_bps, round(best, 6) AS best_bps, trades FROM q""",
    "vol_deciles": f"""{_P}, c AS (SELECT a.symbol, a.date, any_value(a.day_move) AS v, count(b.day_move) AS seen, count(*) FILTER (b.day_move < a.day_move) AS below, count(*) FILTER (b.day_move = a.day_move) AS same
      FROM panel a JOIN panel b ON a.symbol = b.symbol AND b.date <= a.date GROUP BY 1, 2), s AS (SELECT symbol, date, CASE WHEN v IS NOT NULL THEN (below + (same + 1) / 2) / seen END AS share FROM c)
      SELECT symbol, date, round(share, 6) AS pct_rank, CASE WHEN share IS NOT NULL THEN round_even(greatest(0, least(10, share * 10)), 0)::INTEGER END AS decile FROM s""",
    "failure_tags": f"{_FAIL} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM fail) GROUP BY 1",
    "failure_causes": f"{_CAUSES} SELECT symbol, date, CASE WHEN len(t) = 0 THEN 'UNEXPLAINED' ELSE array_to_string(t, '|') END AS tags FROM cz",
    "cemetery_topk": f"{_FAIL} SELECT symbol, date, round(conviction, 6) AS conviction, array_to_string(tags, '|') AS tags FROM fail ORDER BY round(conviction, 6) DESC, symbol, date LIMIT 40",
    "recommend_rank": f"""WITH {_FORECAST}, {_gate('fc', 'g')}, pr(profile, wt, we, wr, wv) AS (VALUES {_PROFILES}),
      s AS (SELECT profile, symbol, date, verdict, CASE WHEN net_edge_bps IS NOT NULL THEN round(100 * (wt::DOUBLE * trust / 100 + we::DOUBLE * greatest(0.0, least(1.0, (net_edge_bps + 40) / 80)) + wr::DOUBLE * (1 - risk_score / 100) - wv::DOUBLE * 0.15 * least(expected_move * 10, 1.0)), 6) END AS score FROM g, pr)
      SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC NULLS LAST, symbol, date)::INTEGER AS place, CASE WHEN verdict <> 'NO ACTION' THEN 'CANDIDATE' ELSE 'WATCH ONLY' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY profile ORDER BY score DESC NULLS LAST, symbol, date) <= 6""",
    "forecast_audit": f"""WITH {_FORECAST}, {_gate('fc', 'g')}, a AS (SELECT symbol, date, list_filter([CASE WHEN NOT coalesce(probability BETWEEN 0 AND 1, false) THEN 'probability_range' END, CASE WHEN net_edge_bps IS NULL THEN 'edge_known' END, CASE WHEN NOT coalesce(trust BETWEEN 0 AND 100, false) THEN 'trust_range' END,
      CASE WHEN NOT coalesce(verdict = 'NO ACTION' OR (verdict = 'POSITIVE') = (probability >= 0.5), false) THEN 'direction' END, CASE WHEN NOT coalesce((verdict = 'NO ACTION') = (len(blocking) > 0), false) THEN 'blocked_if_no_action' END, CASE WHEN NOT coalesce(verdict = 'NO ACTION' OR net_edge_bps >= 12, false) THEN 'costs_cleared' END,
      CASE WHEN regime = 'TRANSITION' THEN 'regime_resolved' END, CASE WHEN drift_state NOT IN ('HEALTHY', 'WATCH') THEN 'healthy' END, CASE WHEN NOT coalesce(risk_score BETWEEN 0 AND 100, false) THEN 'risk_range' END], lambda x: x IS NOT NULL) AS f FROM g)
      SELECT symbol, date, CASE WHEN len(f) = 0 THEN 'PASS' WHEN len(f) <= 2 THEN 'PARTIAL' ELSE 'FAIL' END AS result, array_to_string(f, '|') AS failed FROM a""",
    "leaderboard_weights": f"""{_P}, u AS (UNPIVOT (SELECT y, p1, p2, p3 FROM panel) ON p1, p2, p3 INTO NAME member VALUE p), b AS (SELECT member, avg((p - y) ** 2) AS brier FROM u GROUP BY 1),
      h AS (SELECT *, CASE WHEN brier < 0.25 THEN 'HEALTHY' WHEN brier < 0.27 THEN 'WATCH' WHEN brier < 0.3 THEN 'DEGRADED' ELSE 'UNRELIABLE' END AS health FROM b),
      w AS (SELECT *, exp(-12 * brier) * CASE health WHEN 'HEALTHY' THEN 1.0 WHEN 'WATCH' THEN 0.85 WHEN 'DEGRADED' THEN 0.4 ELSE 0.0 END AS raw FROM h)
      SELECT member, round(brier, 6) AS brier, health, round(CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 1 / count(*) OVER () END, 4) AS weight FROM w""",
    "market_pressure": f"WITH {_FORECAST}, {_gate('fc', 'g')}, m AS (SELECT date, avg((verdict <> 'NO ACTION')::INTEGER) AS part, avg(expected_move) AS mv, any_value(regime_confidence) AS conf FROM g GROUP BY date) SELECT date, round(part, 6) AS participation, round(100 * (0.5 * (1 - part) + 0.3 * least(coalesce(mv, 0) * 25, 1.0) + 0.2 * (1 - conf)), 4) AS pressure FROM m",
    "experiment_arms": f"{_P}, o AS (SELECT avg((p - y) ** 2) AS bp, avg((p1 - y) ** 2) AS p1, avg((p2 - y) ** 2) AS p2, avg((p3 - y) ** 2) AS p3 FROM panel), u AS (UNPIVOT o ON p1, p2, p3 INTO NAME arm VALUE brier) SELECT arm, round(brier, 6) AS brier, round(brier - bp, 6) AS gain, CASE WHEN brier - bp > 0.0005 THEN 'SUPPORTED' ELSE 'NOT SUPPORTED' END AS conclusion FROM u",
}
