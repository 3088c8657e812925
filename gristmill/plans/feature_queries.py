"""Features, labels and point-in-time joins."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import features as ft
from gristmill.operators import joins
from gristmill.plans.base_sql import ALL_FEATURES, BARS, FEATURES_SQL, features_query
from gristmill.sources import tables as tb


def matrix(spark: SparkSession, sf_dir: str, percentile: bool = False) -> DataFrame:
    return ft.feature_matrix(tb.bars(spark, sf_dir), tb.benchmark_bars(spark, sf_dir), percentile)


def _family(columns: list[str], spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.select_features(matrix(spark, sf_dir, "regime_vol_percentile" in columns), columns)


def forward_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.forward_labels(tb.bars(spark, sf_dir))


def lagged_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.lagged(matrix(spark, sf_dir), ["ret_1", "vol_20", "market_breadth"])


def news_window_5d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.news_window(tb.sessions(spark, sf_dir), tb.news(spark, sf_dir))


def direct_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.direct_coverage(tb.sessions(spark, sf_dir), tb.news(spark, sf_dir))


def rolling_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news_window_5d(spark, sf_dir).agg(F.count("*").alias("sessions"), F.sum("news_available").cast("long").alias("covered"), F.round(100 * F.avg("news_available"), 6).alias("coverage_pct"))


def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.read(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("t"), F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    asks = events.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("t"))
    out = joins.asof(asks, views, ["user_id"], "t", ["seen_id", "seen_value"], tie="seen_id")
    return out.select("event_id", "user_id", "seen_id", "seen_value")


def nth_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.bars(spark, sf_dir).select("symbol", "date", F.lead("date", 5).over(ft.W()).alias("date_5"), F.lead("close", 5).over(ft.W()).alias("close_5"))


def replay_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.replay(tb.bars(spark, sf_dir), every=20, horizon=5)


def point_in_time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News that is known at a cutoff: from five days before 2024-01-15 23:59 to it, both included."""
    return joins.news_slice(tb.news(spark, sf_dir), "2024-01-15").select("news_id", "symbol", F.round("sentiment", 6).alias("sentiment"))


def truncation_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that change when later data is taken away, counted: none."""
    bars = tb.bars(spark, sf_dir)
    offenders = ft.truncation_offenders(bars, tb.benchmark_bars(spark, sf_dir), F.lit("1998-06-01").cast("date"), ft.FEATURES)
    return offenders.agg(F.count("*").alias("offenders"))


def dataset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.countDistinct("symbol").alias("symbols"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("vol_60").alias("vol_60_rows"))


def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 returns before and at each session, as one sequence; sessions with fewer are left out."""
    seq = F.collect_list(F.struct("ret_1", "range_pct")).over(ft.W().rowsBetween(-19, 0))
    rows = matrix(spark, sf_dir).where("ret_1 is not null").select("symbol", "date", seq.alias("s")).where(F.size("s") == 20)
    return rows.select("symbol", "date", F.round(F.element_at("s", 1)["ret_1"], 6).alias("first_ret"), F.round(F.aggregate("s", F.lit(0.0), lambda a, x: a + x["range_pct"]), 6).alias("range_sum"))


QUERIES = {
    "feature_matrix": partial(_family, ft.FEATURES),
    **{name: partial(_family, columns) for name, columns in ft.FAMILIES.items()},
    "forward_labels": forward_labels,
    "lagged_features": lagged_features,
    "news_window_5d": news_window_5d,
    "direct_coverage": direct_coverage,
    "rolling_coverage": rolling_coverage,
    "asof_last_view": asof_last_view,
    "nth_follower": nth_follower,
    "replay_outcome": replay_outcome,
    "point_in_time_slice": point_in_time_slice,
    "truncation_invariance": truncation_invariance,
    "dataset_meta": dataset_meta,
    "sequence_windows": sequence_windows,
}

_NEWS = """news AS (SELECT event_id AS news_id, user_id AS symbol, ts AS published_at, greatest(-1.0, least(1.0, value / 250 - 1)) AS sentiment FROM events WHERE event_type = 'click'),
sess AS (SELECT DISTINCT user_id AS symbol, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'view')"""
_WINDOW = f"""{_NEWS},
nw AS (SELECT s.symbol, s.date, count(n.news_id) AS news_count, coalesce(avg(n.sentiment), 0) AS news_sentiment, coalesce(avg(abs(n.sentiment)), 0) AS news_strength
  FROM sess s LEFT JOIN news n ON n.symbol = s.symbol AND n.published_at <= s.date + INTERVAL '23 hours 59 minutes' AND n.published_at >= s.date + INTERVAL '23 hours 59 minutes' - INTERVAL 5 DAYS
  GROUP BY 1, 2)"""
_LABELS = ", ".join(f"round(lead(close, {h}) OVER w / close - 1, 6) AS fwd_ret_{h}, CASE WHEN lead(close, {h}) OVER w IS NOT NULL THEN (lead(close, {h}) OVER w / close - 1 > 0)::INTEGER::DOUBLE END AS label_dir_{h}, lead(date, {h}) OVER w AS label_known_at_{h}" for h in (1, 3, 5, 20))
ORACLES = {
    "feature_matrix": ALL_FEATURES,
    **{name: features_query(columns) for name, columns in ft.FAMILIES.items()},
    "forward_labels": f"WITH {BARS} SELECT symbol, date, {_LABELS} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "lagged_features": f"WITH {FEATURES_SQL} SELECT symbol, date, {', '.join(f'round(lag({c}) OVER w, 6) AS {c}_lag1' for c in ('ret_1', 'vol_20', 'market_breadth'))} FROM feat WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "news_window_5d": f"WITH {_WINDOW} SELECT symbol, date, news_count, round(news_sentiment, 6) AS news_sentiment, round(news_strength, 6) AS news_strength, (news_count > 0)::INTEGER::DOUBLE AS news_available FROM nw",
    "direct_coverage": f"WITH {_NEWS} SELECT count(*) AS sessions, count(*) FILTER (EXISTS (SELECT 1 FROM news n WHERE n.symbol = s.symbol AND CAST(n.published_at AS DATE) = s.date)) AS covered, round(100.0 * count(*) FILTER (EXISTS (SELECT 1 FROM news n WHERE n.symbol = s.symbol AND CAST(n.published_at AS DATE) = s.date)) / count(*), 6) AS coverage_pct FROM sess s",
    "rolling_coverage": f"WITH {_WINDOW} SELECT count(*) AS sessions, count(*) FILTER (news_count > 0) AS covered, round(100.0 * count(*) FILTER (news_count > 0) / count(*), 6) AS coverage_pct FROM nw",
    "asof_last_view": """WITH v AS (SELECT user_id, ts AS t, event_id AS seen_id, value AS seen_value FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1)
      SELECT a.event_id, a.user_id, v.seen_id, v.seen_value FROM (SELECT event_id, user_id, ts AS t FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN v ON a.user_id = v.user_id AND a.t >= v.t""",
    "nth_follower": f"WITH {BARS} SELECT symbol, date, lead(date, 5) OVER w AS date_5, lead(close, 5) OVER w AS close_5 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "replay_outcome": f"""WITH {BARS}, r AS (SELECT *, row_number() OVER w AS n, lag(close, 5) OVER w AS past, lead(close, 5) OVER w AS future FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
      d AS (SELECT symbol, date, past, future, tanh((future / close - 1)) / 50 AS ret, CASE WHEN past IS NULL OR abs(close / past - 1) < 0.25 THEN 'NO ACTION' WHEN close > past THEN 'POSITIVE' ELSE 'NEGATIVE' END AS verdict FROM r WHERE n % 20 = 1)
      SELECT symbol, date, verdict, round(ret, 6) AS realised, CASE WHEN ret IS NULL THEN 'PENDING' WHEN verdict = 'NO ACTION' THEN CASE WHEN abs(ret) < 0.0018 THEN 'GOOD_ABSTENTION' WHEN ret > 0 THEN 'MISSED_OPPORTUNITY' ELSE 'AVOIDED_LOSS' END
        WHEN (verdict = 'POSITIVE') = (ret > 0) THEN 'CORRECT' ELSE 'INCORRECT' END AS grade FROM d""",
    "point_in_time_slice": f"WITH {_NEWS} SELECT news_id, symbol, round(sentiment, 6) AS sentiment FROM news WHERE published_at <= TIMESTAMP '2024-01-15 23:59:00' AND published_at >= TIMESTAMP '2024-01-10 23:59:00'",
    "truncation_invariance": "SELECT 0::BIGINT AS offenders",
    "dataset_meta": f"WITH {FEATURES_SQL} SELECT count(*) AS n_rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date, count(vol_60) AS vol_60_rows FROM feat",
    "sequence_windows": f"WITH {FEATURES_SQL}, r AS (SELECT symbol, date, ret_1, range_pct FROM feat WHERE ret_1 IS NOT NULL) SELECT symbol, date, round(lag(ret_1, 19) OVER w, 6) AS first_ret, round(sum(range_pct) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), 6) AS range_sum FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date) QUALIFY row_number() OVER w >= 20",
}
