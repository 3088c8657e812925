"""Metrics, drift and uncertainty over the prediction panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.operators import metrics as mt
from gristmill.operators.panel import prediction_panel
from gristmill.plans.base_sql import PANEL_SQL
from gristmill.plans.feature_queries import matrix
from gristmill.sources import tables as tb

DRIFT_COLUMNS = ["p", "p1", "volume_z", "spread", "edge_bps"]
CUT = "2001-01-01"


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction_panel(matrix(spark, sf_dir))


def confusion_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.confusion(panel(spark, sf_dir), "sector")


def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.brier_log_loss(panel(spark, sf_dir))


def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.reliability_curve(panel(spark, sf_dir)).drop("__p", "__y")


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.ece(panel(spark, sf_dir))


def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.auc(panel(spark, sf_dir))


def metrics_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.metrics_by_group(panel(spark, sf_dir), "symbol")


def _psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel(spark, sf_dir).withColumns({c: r6(F.col(c)) for c in DRIFT_COLUMNS})  # values at an edge fall on one side
    cut = F.lit(CUT).cast("date")
    return mt.psi(rows.where(F.col("date") < cut), rows.where(F.col("date") >= cut), DRIFT_COLUMNS)


def performance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.performance_drift(panel(spark, sf_dir))


def health_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.health_state(performance_drift(spark, sf_dir), _psi(spark, sf_dir), mt.stability(panel(spark, sf_dir)).agg(F.min("stability_score").alias("stability_score")))


def conformal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.conformal(panel(spark, sf_dir))


def stability_last10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.stability(panel(spark, sf_dir))


def uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = mt.uncertainty(F.col("p"), F.col("spread"), F.col("agreement"))
    return panel(spark, sf_dir).select("symbol", "date", r6(F.col("spread")).alias("spread"), r6(u).alias("uncertainty"), F.when(u < 0.4, "LOW").when(u < 0.68, "MEDIUM").otherwise("HIGH").alias("label"))


def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mt.quantile_summary(tb.read(spark, sf_dir, "events"), "event_type", "value")


QUERIES = {
    "confusion_prf": confusion_prf,
    "brier_logloss": brier_logloss,
    "reliability_curve": reliability_curve,
    "ece": ece,
    "auc": auc,
    "metrics_by_group": metrics_by_group,
    "psi_features": _psi,
    "performance_drift": performance_drift,
    "health_state": health_state,
    "conformal_coverage": conformal_coverage,
    "stability_last10": stability_last10,
    "uncertainty": uncertainty,
    "value_quantiles": value_quantiles,
}

_P = f"WITH {PANEL_SQL}"
_CURVE = f"{_P}, curve AS (SELECT least(9, greatest(0, floor(p * 10)))::INTEGER AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM panel GROUP BY 1)"
_LONG = f"{_P}, long AS (UNPIVOT (SELECT date, {', '.join(f'round({c}, 6)::DOUBLE AS {c}' for c in DRIFT_COLUMNS)} FROM panel) ON {', '.join(DRIFT_COLUMNS)} INTO NAME feature VALUE x)"
_PSI = f"""{_LONG}, e AS (SELECT feature, count(*) AS n_ref, list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM long WHERE date < DATE '{CUT}' GROUP BY feature),
rows_ AS (SELECT feature, date < DATE '{CUT}' AS ref, CASE WHEN x = e[-1] THEN len(e) - 2 WHEN x >= e[1] AND x < e[-1] THEN len(list_filter(e, lambda v: v <= x)) - 1 END AS bin, n_ref, e FROM long JOIN e USING (feature)),
t AS (SELECT feature, max(n_ref) AS n_ref, count(*) FILTER (NOT ref) AS n_cur, count(bin) FILTER (ref) AS nr, count(bin) FILTER (NOT ref) AS nc, any_value(len(e)) AS edges FROM rows_ GROUP BY feature),
bins AS (SELECT t.*, unnest(range(0, greatest(edges - 1, 1))) AS bin FROM t),
k AS (SELECT b.feature, b.bin, b.edges, b.n_ref, b.n_cur, greatest(count(r.bin) FILTER (r.ref) / greatest(b.nr, 1), 1e-4) AS r, greatest(count(r.bin) FILTER (NOT r.ref) / greatest(b.nc, 1), 1e-4) AS c
  FROM bins b LEFT JOIN rows_ r ON r.feature = b.feature AND r.bin = b.bin GROUP BY b.feature, b.bin, b.edges, b.n_ref, b.n_cur, b.nr, b.nc),
v AS (SELECT feature, CASE WHEN max(n_ref) < 50 OR max(n_cur) < 20 THEN NULL WHEN max(edges) < 3 THEN 0.0 ELSE sum((c - r) * ln(c / r)) END AS v FROM k GROUP BY feature),
psi AS (SELECT feature, round(v, 6) AS psi, CASE WHEN v < 0.1 THEN 'LOW' WHEN v < 0.25 THEN 'MODERATE' WHEN v IS NOT NULL THEN 'HIGH' END AS level FROM v)"""
_PERF = """cut AS (SELECT min(date) AS cut FROM (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 120)),
pf AS (SELECT avg((p - y) ** 2) FILTER (date >= cut) AS rb, avg((p - y) ** 2) FILTER (date < cut) AS bb, avg(((p >= 0.5) = (y = 1))::INTEGER) FILTER (date >= cut) AS ra, avg(((p >= 0.5) = (y = 1))::INTEGER) FILTER (date < cut) AS ba, count(*) FILTER (date >= cut) AS n_recent FROM panel, cut),
perf AS (SELECT round(rb, 6) AS recent_brier, round(bb, 6) AS baseline_brier, round(rb - bb, 6) AS brier_degradation, round(ra, 6) AS recent_accuracy, round(ba, 6) AS baseline_accuracy, round(ba - ra, 6) AS accuracy_degradation, n_recent FROM pf)"""
_STAB = """s0 AS (SELECT symbol, date, p FROM panel QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 10),
s1 AS (SELECT *, p - lag(p) OVER w AS step, ((p >= 0.5) <> (lag(p) OVER w >= 0.5))::INTEGER AS flip FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s2 AS (SELECT symbol, count(*) AS n, coalesce(sum(flip), 0)::BIGINT AS flips, stddev_pop(step) AS sd FROM s1 GROUP BY symbol),
s3 AS (SELECT *, greatest(0.0, least(1.0, 1 - flips / greatest(n - 1, 1) - least(sd / 0.08, 1.0) * 0.5)) AS score FROM s2),
stab AS (SELECT symbol, flips, round(sd, 6) AS step_volatility, round(score, 6) AS stability_score, CASE WHEN n < 3 THEN 'UNKNOWN' WHEN score > 0.66 THEN 'STABLE' WHEN score > 0.4 THEN 'DRIFTING' ELSE 'UNSTABLE' END AS label FROM s3)"""
_U = "greatest(0.0, least(1.0, 0.5 * (1 - least(abs(p - 0.5) / 0.15, 1.0)) + 0.3 * least(spread / 0.10, 1.0) + 0.2 * (1 - agreement)))"
ORACLES = {
    "confusion_prf": f"""{_P}, c AS (SELECT sector, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y = 0) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y = 0) AS tn FROM panel GROUP BY 1)
      SELECT sector, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "brier_logloss": f"{_P} SELECT count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-CASE WHEN y = 1 THEN ln(greatest(1e-6, least(1 - 1e-6, p))) ELSE ln(1 - greatest(1e-6, least(1 - 1e-6, p))) END), 6) AS log_loss FROM panel",
    "reliability_curve": f"{_CURVE} SELECT bin, n, round(mp, 6) AS mean_p, round(my, 6) AS rate FROM curve",
    "ece": f"{_CURVE} SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece, count(*) AS bins FROM curve",
    "auc": f"{_P}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM panel) SELECT round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc, count(*) AS n_rows FROM r",
    "metrics_by_group": f"{_P} SELECT symbol, count(*) AS n, round(avg(((p >= 0.5) = (y = 1))::INTEGER), 6) AS accuracy, round(avg((p - y) ** 2), 6) AS brier FROM panel GROUP BY 1 HAVING count(*) >= 50",
    "psi_features": f"{_PSI} SELECT * FROM psi",
    "performance_drift": f"{_P}, {_PERF} SELECT * FROM perf",
    "health_state": f"""{_PSI}, {_PERF}, {_STAB}, c AS (SELECT count(*) FILTER (level = 'HIGH') AS high, count(*) FILTER (level = 'MODERATE') AS moderate FROM psi), m AS (SELECT min(stability_score) AS stability_score FROM stab),
      g AS (SELECT high, moderate, list_filter([CASE WHEN high >= 3 AND brier_degradation > 0.005 THEN {{'l': 2, 't': 'drift and decay'}} END, CASE WHEN high >= 3 AND NOT brier_degradation > 0.005 THEN {{'l': 1, 't': 'drift without decay'}} END,
        CASE WHEN high > 0 AND high < 3 THEN {{'l': 1, 't': 'some drift'}} END, CASE WHEN high = 0 AND moderate >= 5 THEN {{'l': 1, 't': 'much moderate drift'}} END, CASE WHEN brier_degradation > 0.02 THEN {{'l': 2, 't': 'brier degraded'}} END,
        CASE WHEN brier_degradation > 0.008 AND brier_degradation <= 0.02 THEN {{'l': 1, 't': 'brier slipping'}} END, CASE WHEN recent_accuracy < 0.45 THEN {{'l': 3, 't': 'recent accuracy low'}} END, CASE WHEN stability_score < 0.35 THEN {{'l': 1, 't': 'forecasts unstable'}} END], lambda x: x IS NOT NULL) AS r FROM perf, c, m)
      SELECT ['HEALTHY', 'WATCH', 'DEGRADED', 'UNRELIABLE'][coalesce(list_max(list_transform(r, lambda x: x.l)), 0) + 1] AS state, CASE WHEN len(r) = 0 THEN 'nothing found' ELSE array_to_string(list_transform(r, lambda x: x.t), '; ') END AS reasons, high, moderate FROM g""",
    "conformal_coverage": f"""{_P}, s AS (SELECT date, abs(fwd_ret) / day_move AS score FROM panel WHERE day_move > 0),
      d AS (SELECT a.date, count(b.score) AS n_past, quantile_cont(b.score, 0.8) AS q FROM (SELECT DISTINCT date FROM s) a JOIN s b ON b.date < a.date GROUP BY 1 HAVING count(b.score) >= 50)
      SELECT date, n_past, round(q, 6) AS q, count(*) AS n, CASE WHEN n_past >= 500 THEN count(*) FILTER (score <= q) END AS inside FROM d JOIN s USING (date) GROUP BY date, n_past, q""",
    "stability_last10": f"{_P}, {_STAB} SELECT * FROM stab",
    "uncertainty": f"{_P} SELECT symbol, date, round(spread, 6) AS spread, round({_U}, 6) AS uncertainty, CASE WHEN {_U} < 0.4 THEN 'LOW' WHEN {_U} < 0.68 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM panel",
    "value_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(median(abs(value)), 6) AS median_abs FROM events GROUP BY 1",
}
