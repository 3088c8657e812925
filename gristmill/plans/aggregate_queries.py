"""Profiles, breadth, inverted indexes, triage, clusters and rollups."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import aggregates as ag
from gristmill.plans.base_sql import BARS
from gristmill.sources import tables as tb

AS_OF = "2001-06-30"


def symbol_year_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.symbol_year_profile(tb.bars(spark, sf_dir))


def symbol_year_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tb.bars(spark, sf_dir).withColumn("year", F.year("date"))
    return bars.rollup("sector", "symbol", "year").agg(F.count("*").alias("sessions"), F.sum("volume").cast("long").alias("total_volume"), F.grouping_id().cast("long").alias("level"))


def breadth(dead_band: float, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.breadth(tb.bars(spark, sf_dir), dead_band)


def inverted_index(terms, spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.inverted_index(tb.read(spark, sf_dir, "documents"), terms(F.col("text")), "source")


def triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with rows that break every check, made from rows of the table by their place."""
    bars = tb.bars(spark, sf_dir).drop("sector")
    day = F.dayofyear("date")
    dirty = bars.select(
        "symbol",
        "date",
        F.when(day % 97 == 1, F.lit(None)).otherwise(F.col("open")).alias("open"),
        F.when(day % 89 == 2, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(day % 101 == 3, -F.col("close")).when(day % 103 == 4, 0.0).otherwise(F.col("close")).alias("close"),
        F.when(day % 53 == 5, 0).otherwise(F.col("volume")).alias("volume"),
    )
    return ag.triage(dirty.union(dirty.where(day % 61 == 6)), AS_OF)


def triage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(spark, sf_dir).select("symbol", "date", "nth", "status", "reasons")


def triage_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.reason_counts(triaged(spark, sf_dir))


def quality_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.quality_by_symbol(triaged(spark, sf_dir))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.quality_score(triaged(spark, sf_dir))


def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triaged(spark, sf_dir).where("z > 6").select("symbol", "date", "nth", F.round("z", 4).alias("z"))


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.read(spark, sf_dir, "events")
    return ag.keep_first(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("event_id", "user_id", "event_type")


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.read(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), (F.col("user_id") % 7).alias("sector"), F.col("user_id").cast("string").alias("symbol"), F.col("value").alias("severity"), F.col("event_type").alias("kind"))
    return ag.event_clusters(events)


def trailing_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.trailing(tb.bars(spark, sf_dir), 60).select("symbol", "date", "close")


def every_fifth_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.every_kth(tb.bars(spark, sf_dir), 5).select("symbol", "date", "close")


def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def pivot_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.read(spark, sf_dir, "events")
    kinds = ["click", "view", "purchase"]
    out = events.groupBy(F.to_date("ts").alias("date")).pivot("event_type", kinds).agg(F.avg("value"))
    return out.select("date", *(F.round(k, 6).alias(k) for k in kinds))


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (user, day) with views only, clicks only, or both."""
    pairs = lambda kind: tb.read(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day")).distinct()
    a, b = pairs("view"), pairs("click")
    parts = [a.intersect(b).withColumn("part", F.lit("both")), a.exceptAll(b).withColumn("part", F.lit("view")), b.exceptAll(a).withColumn("part", F.lit("click"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "symbol_year_profile": symbol_year_profile,
    "symbol_year_rollup": symbol_year_cube,
    "breadth_exact": partial(breadth, 0.0),
    "breadth_deadband": partial(breadth, 0.0005),
    "inverted_index_local": partial(inverted_index, ag.terms_local),
    "inverted_index_strict": partial(inverted_index, ag.terms_strict),
    "triage_status": triage_status,
    "triage_reason_counts": triage_reason_counts,
    "quality_per_symbol": quality_per_symbol,
    "quality_score": quality_score,
    "mad_outliers": mad_outliers,
    "dedup_keep_first": dedup_keep_first,
    "event_clusters": event_clusters,
    "trailing_sessions": trailing_sessions,
    "every_fifth_session": every_fifth_session,
    "event_distribution": distribution,
    "pivot_by_type": pivot_by_type,
    "set_operations": set_operations,
}


def _breadth(band: float) -> str:
    return f"""WITH {BARS}, r AS (SELECT *, close / open - 1 AS ret FROM bars WHERE open > 0)
      SELECT date, count(*) FILTER (ret > {band}) AS advancers, count(*) FILTER (ret < -{band}) AS decliners, count(*) - count(*) FILTER (ret > {band}) - count(*) FILTER (ret < -{band}) AS unchanged,
      round(count(*) FILTER (ret > {band}) / count(*), 6) AS breadth_ratio, count(*) FILTER (ret > {band}) - count(*) FILTER (ret < -{band}) AS net_breadth, round(avg(ret), 6) AS mean_session_return, sum(volume)::BIGINT AS session_volume FROM r GROUP BY date"""


def _index(terms: str) -> str:
    return f"""WITH t AS (SELECT source AS symbol, unnest({terms}) AS term FROM documents), p AS (SELECT term, symbol, count(*) AS n FROM t GROUP BY 1, 2)
      SELECT term, sum(n)::BIGINT AS documents, count(*) AS symbols, string_agg(symbol || ':' || n, ',' ORDER BY symbol || ':' || n) AS postings FROM p GROUP BY term HAVING sum(n) >= 3"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LOCAL = f"list_distinct(list_filter(list_transform(regexp_split_to_array(lower(replace(text, '''', ' ')), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}]', '', 'g')), lambda w: length(w) >= 4 AND NOT list_contains({_list(ag.STOP_LOCAL)}, w)))"
_STRICT = f"list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z0-9''&.-]+'), lambda t: regexp_replace(t, '^[.''-]+|[.''-]+$', '', 'g')), lambda t: length(t) >= 3 AND NOT list_contains({_list(ag.STOP_STRICT)}, t)))"
TRIAGE_SQL = f"""{BARS},
d0 AS (SELECT symbol, date, CASE WHEN dayofyear(date) % 97 = 1 THEN NULL ELSE open END AS open, CASE WHEN dayofyear(date) % 89 = 2 THEN low - 1 ELSE high END AS high, low,
  CASE WHEN dayofyear(date) % 101 = 3 THEN -close WHEN dayofyear(date) % 103 = 4 THEN 0.0 ELSE close END AS close, CASE WHEN dayofyear(date) % 53 = 5 THEN 0 ELSE volume END AS volume FROM bars),
d1 AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE dayofyear(date) % 61 = 6),
d2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY open, high, low, close, volume) AS nth FROM d1),
d3 AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, date_diff('day', lag(date) OVER w, date) AS gap, close - lag(close) OVER w AS diff FROM d2 WINDOW w AS (PARTITION BY symbol ORDER BY date, nth)),
d4 AS (SELECT *, abs(ret - median(ret) OVER (PARTITION BY symbol)) AS dev, sum(CASE WHEN diff = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date, nth ROWS 4 PRECEDING) = 5 AS flat FROM d3),
d5 AS (SELECT *, dev / nullif(1.4826 * median(dev) OVER (PARTITION BY symbol), 0) AS z FROM d4),
d6 AS (SELECT *, list_filter([CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL THEN 'missing_values' END, CASE WHEN open < 0 OR high < 0 OR low < 0 OR close < 0 OR volume < 0 THEN 'negative_values' END,
  CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'non_positive_price' END, CASE WHEN high < low THEN 'high_below_low' END, CASE WHEN high < greatest(open, close) - 1e-6 OR low > least(open, close) + 1e-6 THEN 'impossible_ohlc' END,
  CASE WHEN nth > 1 THEN 'duplicate_rows' END, CASE WHEN date > DATE '{AS_OF}' THEN 'future_timestamp' END], lambda x: x IS NOT NULL) AS invalid,
  list_filter([CASE WHEN isodow(date) >= 6 THEN 'weekend_timestamp' END, CASE WHEN abs(ret) > 0.35 THEN 'extreme_return' END, CASE WHEN gap > 12 THEN 'calendar_gap' END, CASE WHEN volume = 0 THEN 'zero_volume' END,
  CASE WHEN flat THEN 'stale_price_run' END, CASE WHEN z > 12 THEN 'return_outlier_mad' END], lambda x: x IS NOT NULL) AS suspicious FROM d5),
tri AS (SELECT *, CASE WHEN len(invalid) > 0 THEN 'INVALID' WHEN len(suspicious) > 0 THEN 'SUSPICIOUS' ELSE 'VALID' END AS status, array_to_string(CASE WHEN len(invalid) > 0 THEN invalid ELSE suspicious END, '|') AS reasons FROM d6)"""
_PAIRS = "a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click')"
ORACLES = {
    "symbol_year_profile": f"WITH {BARS} SELECT symbol, year(date)::INTEGER AS year, count(*) AS sessions, round(avg(close), 4) AS avg_close, sum(volume)::BIGINT AS total_volume, max(high) AS year_high, min(low) AS year_low, round(100 * (max(high) - min(low)) / greatest(min(low), 1e-9), 2) AS range_pct FROM bars GROUP BY 1, 2",
    "symbol_year_rollup": f"WITH {BARS} SELECT sector, symbol, year(date)::INTEGER AS year, count(*) AS sessions, sum(volume)::BIGINT AS total_volume, grouping_id(sector, symbol, year(date))::BIGINT AS level FROM bars GROUP BY ROLLUP (sector, symbol, year(date))",
    "breadth_exact": _breadth(0.0),
    "breadth_deadband": _breadth(0.0005),
    "inverted_index_local": _index(_LOCAL),
    "inverted_index_strict": _index(_STRICT),
    "triage_status": f"WITH {TRIAGE_SQL} SELECT symbol, date, nth::INTEGER AS nth, status, reasons FROM tri",
    "triage_reason_counts": f"WITH {TRIAGE_SQL} SELECT reason, count(*) AS hits FROM (SELECT unnest(list_concat(invalid, suspicious)) AS reason FROM tri) GROUP BY reason",
    "quality_per_symbol": f"""WITH {TRIAGE_SQL}, g AS (SELECT symbol, count(*) AS n_rows, count(*) FILTER (status = 'VALID') AS valid, count(*) FILTER (status = 'SUSPICIOUS') AS quarantined, count(*) FILTER (status = 'INVALID') AS rejected, max(date) AS own_last FROM tri GROUP BY symbol)
      SELECT symbol, n_rows, valid, quarantined, rejected, date_diff('day', own_last, max(own_last) OVER ())::INTEGER AS staleness_days, round(100.0 * (valid + quarantined) / n_rows, 6) AS coverage_score, valid + quarantined < 250 OR date_diff('day', own_last, max(own_last) OVER ()) > 10 AS violated FROM g""",
    "quality_score": f"WITH {TRIAGE_SQL} SELECT count(*) AS rows_in, count(*) FILTER (status = 'INVALID') AS rejected, round(100 * (count(*) FILTER (status = 'VALID') + 0.5 * count(*) FILTER (status = 'SUSPICIOUS')) / count(*), 6) AS score FROM tri",
    "mad_outliers": f"WITH {TRIAGE_SQL} SELECT symbol, date, nth::INTEGER AS nth, round(z, 4) AS z FROM tri WHERE z > 6",
    "dedup_keep_first": "SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "event_clusters": """SELECT CAST(ts AS DATE) AS date, user_id % 7 AS sector, string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY CAST(user_id AS VARCHAR)) AS symbols, round(max(value), 6) AS severity, round(avg(value), 6) AS mean_severity, count(*) AS n_events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds
      FROM events GROUP BY 1, 2 ORDER BY severity DESC, n_events DESC, date, sector LIMIT 60""",
    "trailing_sessions": f"WITH {BARS} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 60",
    "every_fifth_session": f"WITH {BARS} SELECT symbol, date, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date) % 5 = 1",
    "event_distribution": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "pivot_by_type": "SELECT CAST(ts AS DATE) AS date, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS view, round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase FROM events GROUP BY 1",
    "set_operations": f"WITH {_PAIRS} SELECT *, 'both' AS part FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'view' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'click' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
}
