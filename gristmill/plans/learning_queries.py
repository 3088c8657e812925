"""Walk-forward models, calibration, the adaptive ensemble and regimes by mixture."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.operators import auditing as au
from gristmill.operators import decisions as dc
from gristmill.operators import experiments as ex
from gristmill.operators import joins
from gristmill.operators import learning as ln
from gristmill.operators import metrics as mt
from gristmill.operators import replaying as rp
from gristmill.operators.features import W
from gristmill.operators.intelligence import market_state
from gristmill.operators.panel import MEMBERS
from gristmill.plans.base_sql import PANEL_SQL
from gristmill.plans.decision_queries import STATE_SQL, measured
from gristmill.plans.feature_queries import matrix
from gristmill.plans.intelligence_queries import STATE_COLUMNS, state
from gristmill.plans.metric_queries import panel
from gristmill.sources import tables as tb
from gristmill.sources.collections import Collection
from gristmill.sources.lake import shared_folder, written

COLUMNS = ["p1", "p2", "p3", "volume_z", "day_move", "spread"]


def walkforward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.fold_counts(panel(spark, sf_dir))


def walkforward(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of a model's out-of-sample probabilities by fold."""
    out = ln.walk_forward(panel(spark, sf_dir), kind, COLUMNS)
    return mt.metrics_by_group(out, "fold")


def isotonic_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.isotonic_rolling(panel(spark, sf_dir)).select("symbol", "date", r6(F.col("p")).alias("p"), r6(F.col("p_cal")).alias("p_cal"))


def adaptive_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ln.adaptive_ensemble(panel(spark, sf_dir), MEMBERS)
    return rows.select("symbol", "date", *(r6(F.col(c)).alias(c) for c in rows.columns if c not in ("symbol", "date")))


def regime_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ln.regime_ensemble(panel(spark, sf_dir), dc.regimes(market_state(matrix(spark, sf_dir))), MEMBERS)
    return rows.select("symbol", "date", "regime", *(r6(F.col(c)).alias(c) for c in rows.columns if c not in ("symbol", "date", "regime")))


def regime_gmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.regime_history(state(spark, sf_dir), STATE_COLUMNS)


def replay_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.replay_model(panel(spark, sf_dir), list(MEMBERS))


def replay_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.replay_timeline(replay_model(spark, sf_dir))


PRICE = ["ret_1", "ret_5", "vol_20", "sma_10_gap", "rsi_14", "volume_z"]
CONTEXT = ["bench_ret_1", "bench_trend_20", "sector_ret_1", "market_breadth", "corr_bench_60"]
NEWS = ["news_count", "news_sentiment", "news_strength"]
REGIMES = ["BULL", "BEAR", "HIGH_VOLATILITY"]


def _shipment_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, published_at, sentiment): shipments stand for headlines about the priority of their order."""
    items, orders = tb.read(spark, sf_dir, "lineitem"), tb.read(spark, sf_dir, "orders")
    rows = items.join(orders, items["l_orderkey"] == orders["o_orderkey"])
    return rows.select(F.col("o_orderpriority").alias("symbol"), F.col("l_shipdate").alias("published_at"), (20 * F.col("l_discount") - 1).alias("sentiment"))


def experiment_arms_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms A to F: price, context, news, regimes, data a session late, and abstention. Trees have no SQL; tests hold the
    protocol on rows with a planted signal."""
    features = matrix(spark, sf_dir)
    own = panel(spark, sf_dir).select("symbol", "date", "known_at", "y", "fwd_ret", "day_move")
    regime = dc.regimes(market_state(features)).select("date", "regime_confidence", *((F.col("regime") == r).cast("double").alias(r.lower()) for r in REGIMES))
    news = joins.news_window(features.select("symbol", "date"), _shipment_news(spark, sf_dir)).select("symbol", "date", *NEWS)
    rows = own.join(features.select("symbol", "date", *PRICE, *CONTEXT), ["symbol", "date"]).join(news, ["symbol", "date"], "left").join(regime, "date", "left")
    return ex.arms(rows, PRICE, CONTEXT, NEWS, ["regime_confidence", *map(str.lower, REGIMES)])


def forecast_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen checks of every replayed forecast, upserted by audit id; the batch comes twice and changes nothing."""
    replayed = replay_model(spark, sf_dir).select("symbol", "date", "train_end", "sessions_after")
    inputs = measured(spark, sf_dir).select("symbol", "date", "data_quality", "calibration_ece")
    seen = tb.bars(spark, sf_dir).select("symbol", "date", F.lit(True).alias("snapshot"), F.datediff("date", F.lag("date", 1).over(W())).alias("staleness_days"))
    rows = replayed.join(inputs, ["symbol", "date"], "left").join(seen, ["symbol", "date"], "left")
    audited = au.audit(rows.select(
        "symbol", F.col("date").alias("as_of"), joins.cutoff("date").alias("cutoff"), "train_end", F.lit(1).alias("horizon"), F.array(*map(F.lit, MEMBERS)).alias("feature_columns"), "snapshot", "data_quality", "staleness_days",
        F.lit("ridge-1").alias("model_version"), F.lit("features-1").alias("feature_version"), F.sha2(F.lit("ridge-1|features-1"), 256).alias("code_fingerprint"), "calibration_ece", F.lit(dc.COSTS.round_trip).alias("cost_bps"), F.lit("UNAVAILABLE").alias("news_state"), "sessions_after",
    ))
    audited = written(audited, "audits")
    kept = Collection(spark, f"{shared_folder(spark)}/audits-{uuid.uuid4().hex}", ["audit_id"], {"verdict": "string"})
    for _ in range(2):
        kept.upsert(audited, "forecast_audits", 0)
    return kept.read()


QUERIES = {"experiment_arms_all": experiment_arms_all, "forecast_audits": forecast_audits, "replay_model": replay_model, "replay_timeline": replay_timeline, "walkforward_folds": walkforward_folds, **{f"walkforward_{k}": partial(walkforward, k) for k in ("baseline", "lr", "rf", "gbt")}, "isotonic_rolling": isotonic_rolling, "adaptive_ensemble": adaptive_ensemble, "regime_ensemble": regime_ensemble, "regime_gmm": regime_gmm}
_W = {m: f"coalesce(exp(-12 * mse_{m}), 1.0)" for m in MEMBERS}
_T = " + ".join(_W.values())
_V = {m: f"coalesce(exp(-12 * CASE WHEN n_all < 40 THEN NULL WHEN n_own >= 200 THEN (all_{m} + own_{m}) / 2 ELSE all_{m} END), 1.0)" for m in MEMBERS}
_VT = " + ".join(_V.values())
_FOLDS = """sp AS (SELECT min(date) AS a, max(date) AS b FROM panel), c0 AS (SELECT b, unnest(range(0, 60)) AS i, a FROM sp), c1 AS (SELECT b, CAST(a + INTERVAL 36 MONTH AS DATE) AS f, i FROM c0),
      c2 AS (SELECT b, CAST(f + i * INTERVAL 6 MONTH AS DATE) AS cut FROM c1), fo AS (SELECT row_number() OVER (ORDER BY cut)::INTEGER AS fold, cut, coalesce(lead(cut) OVER (ORDER BY cut), b + 1) AS until FROM c2 WHERE cut <= b)"""
_I = range(3)
_PAIRS = [(i, j) for i in _I for j in _I if i <= j]
_X = dict(enumerate(MEMBERS))
_C = {(i, j): f"(xx_{min(i, j)}_{max(i, j)} - x_{i} * x_{j} / n)" + (" * 1.01" if i == j else "") for i in _I for j in _I}
_DET = "(a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02))"
_REPLAY = f"""{PANEL_SQL}, mo AS (SELECT known_at AS d, max(date) AS last, count(*) AS n, sum(y) AS y, {', '.join(f'sum({_X[i]}) AS x_{i}, sum({_X[i]} * y) AS xy_{i}' for i in _I)}, {', '.join(f'sum({_X[i]} * {_X[j]}) AS xx_{i}_{j}' for i, j in _PAIRS)} FROM panel WHERE known_at IS NOT NULL GROUP BY 1),
      up AS (SELECT d, max(last) OVER w AS last, sum(n) OVER w AS n, sum(y) OVER w AS y, {', '.join(f'sum(x_{i}) OVER w AS x_{i}, sum(xy_{i}) OVER w AS xy_{i}' for i in _I)}, {', '.join(f'sum(xx_{i}_{j}) OVER w AS xx_{i}_{j}' for i, j in _PAIRS)} FROM mo WINDOW w AS (ORDER BY d)),
      ma AS (SELECT d, last, n, y / n AS base, {', '.join(f'x_{i} / n AS m{i}, xy_{i} - x_{i} * y / n AS c{i}' for i in _I)}, {', '.join(f'{_C[i, j]} AS a{i}{j}' for i, j in _PAIRS)} FROM up WHERE n >= 200),
      so AS (SELECT *, (c0 * (a11 * a22 - a12 * a12) - a01 * (c1 * a22 - a12 * c2) + a02 * (c1 * a12 - a11 * c2)) / {_DET} AS b0, (a00 * (c1 * a22 - a12 * c2) - c0 * (a01 * a22 - a12 * a02) + a02 * (a01 * c2 - c1 * a02)) / {_DET} AS b1,
        (a00 * (a11 * c2 - c1 * a12) - a01 * (a01 * c2 - c1 * a02) + c0 * (a01 * a12 - a11 * a02)) / {_DET} AS b2 FROM ma),
      ah AS (SELECT *, CASE WHEN count(fwd_ret) OVER f = 5 THEN exp(sum(ln(1 + fwd_ret)) OVER f) - 1 END AS realised, CASE WHEN count(fwd_ret) OVER f = 5 THEN last_value(known_at) OVER f END AS resolved_on, count(*) OVER g AS sessions_after FROM panel
        WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), g AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
      fc AS (SELECT ah.*, so.n AS n_train, so.last AS train_end, greatest(0.01, least(0.99, base + b0 * (p1 - m0) + b1 * (p2 - m1) + b2 * (p3 - m2))) AS q FROM ah ASOF JOIN so ON ah.date > so.d),
      ac AS (SELECT *, abs(q - 0.5) >= 0.055 AND 2 * abs(q - 0.5) * coalesce(day_move, 0) * 10000 - 18 >= 12 AS acts, CASE WHEN realised IS NOT NULL THEN (q >= 0.5) = (realised > 0) END AS correct FROM fc),
      re AS (SELECT symbol, date, n_train::BIGINT AS n_train, train_end, round(q, 6) AS p, CASE WHEN NOT acts THEN 'NO ACTION' WHEN q >= 0.5 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict, round(realised, 6) AS realised, resolved_on, correct,
        CASE WHEN realised IS NULL THEN 'PENDING' WHEN acts AND correct THEN 'GOOD_DECISION_GOOD_OUTCOME' WHEN acts THEN 'GOOD_DECISION_BAD_OUTCOME' WHEN abs(realised) * 10000 < 18 THEN 'GOOD_ABSTENTION' WHEN correct THEN 'MISSED_OPPORTUNITY' ELSE 'AVOIDED_LOSS' END AS decision_quality, sessions_after FROM ac)"""
ORACLES = {
    "replay_model": f"WITH {_REPLAY} SELECT * FROM re",
    "replay_timeline": f"""WITH {_REPLAY}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS k FROM re)
      SELECT symbol, count(*) AS points, count(correct) AS resolved, round(100 * avg(correct::INTEGER), 6) AS hit_rate_pct, round(100 * avg((verdict <> 'NO ACTION')::INTEGER), 6) AS action_rate_pct, count(*) FILTER (train_end >= date) AS leaks FROM k WHERE k % 20 = 0 GROUP BY 1""",
    "walkforward_baseline": f"""WITH {PANEL_SQL}, {_FOLDS}, st AS (SELECT fold, greatest(0.01, least(0.99, avg(y))) AS base, stddev_pop(p1) AS sc FROM fo JOIN panel ON known_at < cut GROUP BY 1),
      pr AS (SELECT fold, y, greatest(0.01, least(0.99, base + 0.08 * tanh(p1 / (2 * CASE WHEN sc > 0 THEN sc ELSE 1 END)))) AS p FROM fo JOIN st USING (fold) JOIN panel ON date >= cut AND date < until)
      SELECT fold, count(*) AS n, round(avg(((p >= 0.5) = (y = 1))::INTEGER), 6) AS accuracy, round(avg((p - y) ** 2), 6) AS brier FROM pr GROUP BY 1 HAVING count(*) >= 50""",
    "regime_ensemble": f"""WITH {PANEL_SQL}, {STATE_SQL}, pr AS (SELECT panel.*, coalesce(regime, 'UNKNOWN') AS regime FROM panel LEFT JOIN regime USING (date)),
      er AS (SELECT known_at AS d, regime, {', '.join(f'sum(({m} - y) ** 2) AS e_{m}' for m in MEMBERS)}, count(*) AS n FROM pr WHERE known_at IS NOT NULL GROUP BY 1, 2),
      ea AS (SELECT d, {', '.join(f'sum(e_{m}) AS e_{m}' for m in MEMBERS)}, sum(n) AS n FROM er GROUP BY 1),
      ka AS (SELECT d, sum(n) OVER w AS n_all, {', '.join(f'sum(e_{m}) OVER w / sum(n) OVER w AS all_{m}' for m in MEMBERS)} FROM ea WINDOW w AS (ORDER BY d ROWS 119 PRECEDING)),
      ko AS (SELECT d, regime AS r, sum(n) OVER w AS n_own, {', '.join(f'sum(e_{m}) OVER w / sum(n) OVER w AS own_{m}' for m in MEMBERS)} FROM er WINDOW w AS (PARTITION BY regime ORDER BY d ROWS 119 PRECEDING)),
      ja AS (SELECT pr.*, ka.* EXCLUDE (d) FROM pr ASOF LEFT JOIN ka ON pr.date >= ka.d),
      jo AS (SELECT ja.*, ko.* EXCLUDE (d, r) FROM ja ASOF LEFT JOIN ko ON ja.regime = ko.r AND ja.date >= ko.d)
      SELECT symbol, date, regime, round(greatest(1e-4, least(1 - 1e-4, 0.5 + (({' + '.join(f'{_V[m]} * {m}' for m in MEMBERS)}) / ({_VT}) - 0.5) * (1 - 0.6 * greatest(0, least(1, spread / 0.12)) * (1 - agreement)))), 6) AS p_final, {', '.join(f'round({_V[m]} / ({_VT}), 6) AS w_{m}' for m in MEMBERS)} FROM jo""",
    "walkforward_folds": f"""WITH {PANEL_SQL}, sp AS (SELECT min(date) AS a, max(date) AS b FROM panel), c0 AS (SELECT b, unnest(range(0, 60)) AS i, a FROM sp), c1 AS (SELECT b, CAST(a + INTERVAL 36 MONTH AS DATE) AS f, i FROM c0), c2 AS (SELECT b, CAST(f + i * INTERVAL 6 MONTH AS DATE) AS cut FROM c1),
      fo AS (SELECT row_number() OVER (ORDER BY cut)::INTEGER AS fold, cut, coalesce(lead(cut) OVER (ORDER BY cut), b + 1) AS until FROM c2 WHERE cut <= b)
      SELECT fold, cut, until, count(*) FILTER (known_at < cut) AS n_train, count(*) FILTER (date >= cut AND date < until) AS n_test FROM fo JOIN panel ON known_at < cut OR (date >= cut AND date < until) GROUP BY 1, 2, 3""",
    "adaptive_ensemble": f"""WITH {PANEL_SQL}, er AS (SELECT known_at AS d, {', '.join(f'sum(({m} - y) ** 2) AS e_{m}' for m in MEMBERS)}, count(*) AS n FROM panel GROUP BY 1),
      kn AS (SELECT d, {', '.join(f'sum(e_{m}) OVER w / sum(n) OVER w AS mse_{m}' for m in MEMBERS)} FROM er WINDOW w AS (ORDER BY d ROWS 59 PRECEDING)),
      jo AS (SELECT p.*, kn.* EXCLUDE (d) FROM panel p ASOF LEFT JOIN kn ON p.date >= kn.d)
      SELECT symbol, date, round(greatest(1e-4, least(1 - 1e-4, ({' + '.join(f'{_W[m]} * {m}' for m in MEMBERS)}) / ({_T}))), 6) AS p_raw, {', '.join(f'round({_W[m]} / ({_T}), 6) AS w_{m}' for m in MEMBERS)} FROM jo""",
}
