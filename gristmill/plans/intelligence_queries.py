"""Market state, patterns, similar states, evidence, the correlation graph, texts and nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.operators import aggregates as ag
from gristmill.operators import decisions as dc
from gristmill.operators import graph as gr
from gristmill.operators import intelligence as it
from gristmill.operators import texts as tx
from gristmill.plans.base_sql import FEATURES_SQL, PANEL_SQL
from gristmill.plans.decision_queries import STATE_SQL
from gristmill.plans.feature_queries import matrix
from gristmill.plans.metric_queries import panel
from gristmill.sources import tables as tb
from gristmill.sources.lake import shared_folder, written

STATE_COLUMNS = ["bench_trend_20", "bench_vol_20", "market_breadth_20", "dispersion_20"]


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.market_state(matrix(spark, sf_dir))


def market_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state(spark, sf_dir)
    return rows.select("date", *(r6(F.col(c)).alias(c) for c in rows.columns if c != "date"))


def regime_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.regime_changes(dc.regimes(state(spark, sf_dir))).select("date", "regime", "changed")


def pattern_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.pattern_library(state(spark, sf_dir))


def knn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest earlier states of every session."""
    days = state(spark, sf_dir)
    return it.similar_states(days, STATE_COLUMNS, days=days)


def evidence_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.evidence(panel(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue of six groups of nations."""
    orders, customers = tb.read(spark, sf_dir, "orders"), tb.read(spark, sf_dir, "customer")
    days = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy((F.col("c_nationkey") % 6).cast("long").alias("node"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("x"))
    return days


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.correlation_pairs(_series(spark, sf_dir), 400)


def corr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.correlation_edges(_pairs(spark, sf_dir))


def corr_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.correlation_change(_pairs(spark, sf_dir))


def degree_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return it.degrees(corr_edges(spark, sf_dir))


def _part_components(spark: SparkSession, items: DataFrame) -> DataFrame:
    _checkpoints(spark)
    return it.components(it.item_links(items.select(F.col("l_orderkey").cast("long").alias("group"), F.col("l_partkey").cast("long").alias("item"))))


def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the parts that were ordered together, over all orders. Recursive SQL is too slow for the whole
    table; a test holds it against brute force."""
    return graph_components_all(spark, sf_dir)


def graph_components_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the parts that were ordered together, one star an order, over all orders."""
    return _part_components(spark, tb.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"))


def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _series(spark, sf_dir).select("node").distinct().withColumn("parity", F.col("node") % 2)
    return it.density(corr_edges(spark, sf_dir), nodes, "parity")


def graph_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checkpoints(spark)
    return it.pagerank(corr_edges(spark, sf_dir))


def _checkpoints(spark: SparkSession) -> None:
    """A folder for checkpoints where the session names none, as in tests."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _neighbours(spark: SparkSession, sf_dir: str, node: Column) -> DataFrame:
    """(src, dst, weight), a row of weight 1 each time that two of an order's parts, or groups of parts, are next to each
    other by part number. An order gives a row less than it has lines."""
    parts = tb.read(spark, sf_dir, "part")
    groups = parts.select("p_partkey", F.min("p_partkey").over(Window.partitionBy(node)).alias("node"))
    items = tb.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(groups, "p_partkey")
    follows = F.lag("node", 1).over(Window.partitionBy("l_orderkey").orderBy("p_partkey"))
    return items.select(follows.alias("src"), F.col("node").alias("dst"), F.lit(1).cast("long").alias("weight")).where("src <> dst")


def graph_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the parts that are ordered together, with their commonest brand."""
    found = gr.communities(_neighbours(spark, sf_dir, F.col("p_partkey")))
    brands = tb.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("group"))
    return gr.community_summary(found, brands)


def graph_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, strength, eigen, betweenness) of the groups of parts by brand and type; two that are often ordered together
    are near."""
    rows = _neighbours(spark, sf_dir, F.concat_ws("|", "p_brand", "p_type"))
    edges = written(rows.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight")), "part_groups")
    pairs = edges.select("src", "dst", F.col("weight").alias("correlation"))
    _checkpoints(spark)
    eigen = gr.eigenvector(edges, it.components(pairs))
    between = gr.betweenness(edges, distance=1 / F.col("w"))
    strength = it.degrees(pairs).select("node", F.col("strength").alias("strength"))
    return strength.join(eigen, "node").join(between, "node").select("node", "strength", r6(F.col("eigen")).alias("eigen"), r6(F.col("betweenness")).alias("betweenness"))


def instrument_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that the names of parts mention."""
    parts = tb.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"))
    names = spark.createDataFrame([("Red",), ("Blue",), ("Ring",)], "name string")
    return tx.mentions(parts, names).groupBy("name").agg(F.count("*").alias("n"))


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of the days on which many symbols moved far, and the days that looked like theirs."""
    moves = panel(spark, sf_dir).where("abs(ret_1) > 3").select("date", "sector", "symbol", F.abs("ret_1").alias("severity"), F.when(F.col("ret_1") > 0, "UP").otherwise("DOWN").alias("kind"))
    clusters = ag.event_clusters(moves, 40)
    return clusters, it.similar_states(state(spark, sf_dir), STATE_COLUMNS, days=clusters)


def case_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the days on which many symbols moved far."""
    clusters, states = _cases(spark, sf_dir)
    return it.case_documents(clusters, it.evidence(panel(spark, sf_dir)), states).drop("document")


def case_similar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similar days of each case that the documents of ``case_documents`` hold."""
    clusters, states = _cases(spark, sf_dir)
    return clusters.join(states, "date").select(F.concat_ws("-", F.lit("case"), "date", "sector").alias("case_id"), "match", "place", "distance")


#: Words of which headlines are made for the queries on sentiment.
WORDS = ["profit", "surges,", "amid", "Fraud", "probe!", "drops", "results", "upgrade", "rally", "inflation", "shares", "(weak)", "buyback"]


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, n = F.array(*map(F.lit, WORDS)), len(WORDS)
    pick = lambda k: F.get(words, (F.col("event_id") * k % n).cast("int"))
    return tb.read(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", pick(1), pick(3), pick(7)).alias("headline"))


def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.lexicon_sentiment(headlines(spark, sf_dir), "headline").drop("headline", "category")


def event_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.lexicon_sentiment(headlines(spark, sf_dir), "headline").groupBy("category").agg(F.count("*").alias("n"))


def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tb.read(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return events.select(F.explode("m").alias("name", "value")).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def _order_paths(orders: DataFrame) -> DataFrame:
    order = F.struct("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("state"))
    docs = orders.groupBy(F.col("o_custkey").alias("key")).agg(F.sort_array(F.collect_list(order)).alias("orders"), F.count("*").alias("n"))
    return tx.flatten_paths(docs)


def flatten_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and values of each customer's orders as one document."""
    return flatten_paths_all(spark, sf_dir)


def flatten_paths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one nested document, as paths and values."""
    return _order_paths(tb.read(spark, sf_dir, "orders"))


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {"customer": (tb.read(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"]), "supplier": (tb.read(spark, sf_dir, "supplier"), "s_suppkey", ["s_name"]), "nation": (tb.read(spark, sf_dir, "nation"), "n_nationkey", ["n_name"])}
    return tx.search(frames, "Er#00000001")


QUERIES = {f.__name__: f for f in (market_state, regime_changes, pattern_library, knn_states, evidence_conflict, corr_edges, corr_change, degree_strength, graph_components, lexicon_sentiment, event_category, props_json, flatten_paths, search_hits, graph_density, graph_pagerank, instrument_mentions, case_documents, graph_components_all, flatten_paths_all, case_similar_days, graph_communities, graph_centrality)}

_S = f"WITH {FEATURES_SQL}, {STATE_SQL}"
_PAIRS_SQL = """ser AS (SELECT (c_nationkey % 6)::BIGINT AS node, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
dk AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM ser) QUALIFY k <= 400),
pr AS (SELECT a.node AS a, b.node AS b, a.x, b.x AS y, k FROM ser a JOIN dk USING (date) JOIN ser b ON a.date = b.date AND a.node < b.node),
pairs AS (SELECT a, b, count(*) AS n, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) AS corr, covar_pop(x, y) FILTER (k <= 200) / nullif(sqrt(var_pop(x) FILTER (k <= 200) * var_pop(y) FILTER (k <= 200)), 0) AS recent,
  covar_pop(x, y) FILTER (k > 200) / nullif(sqrt(var_pop(x) FILTER (k > 200) * var_pop(y) FILTER (k > 200)), 0) AS before FROM pr GROUP BY 1, 2 HAVING count(*) >= 133),
edges AS (SELECT a AS src, b AS dst, round(corr, 6) AS correlation FROM pairs WHERE abs(corr) >= (SELECT quantile_cont(abs(corr), 0.7) FROM pairs))"""
_PATTERN = f"""{_S}, pd AS (SELECT *, CASE WHEN count(ln(1 + tanh(bench_ret_1) / 50)) OVER f = 5 THEN exp(sum(ln(1 + tanh(bench_ret_1) / 50)) OVER f) - 1 END AS forward, lag(drawdown, 10) OVER (ORDER BY date) AS back,
  CASE WHEN count(dispersion_20) OVER e >= 250 THEN quantile_cont(dispersion_20, 0.95) OVER e END AS p95 FROM state WINDOW f AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), e AS (ORDER BY date)),
pl AS (SELECT date, forward, unnest([{{'n': 'VOLATILITY_EXPANSION', 'o': bench_vol_20 / nullif(bench_vol_60, 0) > 1.4}}, {{'n': 'BROAD_SELLOFF', 'o': bench_ret_1 < -0.008 AND market_breadth < 0.25}}, {{'n': 'MOMENTUM_ACCELERATION', 'o': bench_trend_20 > 0.03 AND market_breadth_20 > 0.55 AND bench_vol_20 < bench_vol_60}},
  {{'n': 'RECOVERY', 'o': back < -0.05 AND drawdown - back > 0.03}}, {{'n': 'DISPERSION_SHOCK', 'o': dispersion_20 > p95}}, {{'n': 'BREADTH_DIVERGENCE', 'o': bench_trend_20 > 0.01 AND market_breadth_20 < 0.45}}]) AS u FROM pd),
px AS (SELECT date, forward, u.n AS pattern, coalesce(u.o, false) AS o FROM pl)"""
_KNN_M = ", ".join(f"stddev_samp({c}) OVER (ORDER BY date) AS s_{c}" for c in STATE_COLUMNS)
_KNN_D = " + ".join(f"((a.{c} - b.{c}) / nullif(a.s_{c}, 0)) ** 2" for c in STATE_COLUMNS)
_LEX = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in tx.LEXICON.items()) + "}"
_HEAD = f"""h0 AS (SELECT event_id, {WORDS}[event_id % 13 + 1] || ' ' || {WORDS}[event_id * 3 % 13 + 1] || ' ' || {WORDS}[event_id * 7 % 13 + 1] AS headline FROM events),
h1 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(trim(headline), '\\s+'), lambda t: lower(trim(t, '.,:;!?()[]"'''))), lambda t: {_LEX}[t] IS NOT NULL) AS hits FROM h0),
h2 AS (SELECT *, greatest(-1.0, least(1.0, coalesce(list_sum(list_transform(hits, lambda t: {_LEX}[t])), 0) / 4)) AS score FROM h1)"""
_CAT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(headline), '{w}')" for w in words) + f" THEN '{n}'" for n, words in tx.CATEGORIES.items()) + " ELSE 'GENERAL' END"
_EV = """ev0 AS (SELECT symbol, date, [{'v': volume_z, 's': least(abs(volume_z) / 4, 1.0), 'f': volume_z > 0}, {'v': ret_1, 's': least(abs(ret_1) / 0.04, 1.0), 'f': ret_1 > 0}, {'v': market_breadth, 's': least(abs(market_breadth - 0.5) * 2, 1.0), 'f': market_breadth >= 0.5}, {'v': corr_bench_60, 's': least(abs(corr_bench_60), 1.0), 'f': corr_bench_60 > 0.4}] AS l0 FROM panel),
ev1 AS (SELECT symbol, date, list_filter(l0, lambda e: e.v IS NOT NULL) AS l FROM ev0),
ev2 AS (SELECT symbol, date, len(l) AS channels, coalesce(list_sum(list_transform(list_filter(l, lambda e: e.f), lambda e: e.s)), 0) AS s, coalesce(list_sum(list_transform(list_filter(l, lambda e: NOT e.f), lambda e: e.s)), 0) AS a FROM ev1),
ev AS (SELECT *, coalesce(least(s, a) / nullif(s + a, 0), 0) AS c FROM ev2)"""
ORACLES = {
    "market_state": f"{_S} SELECT date, {', '.join(f'round({c}, 6) AS {c}' for c in ('bench_ret_1', 'bench_trend_20', 'bench_vol_20', 'bench_vol_60', 'market_breadth', 'dispersion', 'market_breadth_20', 'dispersion_20', 'drawdown'))} FROM state",
    "regime_changes": f"{_S} SELECT date, regime, regime IS DISTINCT FROM lag(regime) OVER (ORDER BY date) AS changed FROM regime",
    "pattern_library": f"""{_PATTERN} SELECT pattern, count(*) FILTER (o) AS occurrences, round(100 * avg(o::INTEGER), 6) AS frequency_pct, min(date) FILTER (o) AS first_seen, max(date) FILTER (o) AS last_seen, round(100 * avg(forward) FILTER (o), 6) AS forward_mean_pct, round(100 * median(forward) FILTER (o), 6) AS forward_median_pct,
      round(100 * avg((forward > 0)::INTEGER) FILTER (o), 6) AS up_rate_pct, round(100 * avg((forward > 0)::INTEGER), 6) AS baseline_up_rate_pct, count(forward) FILTER (o) < 30 AS small_sample, arg_max(o, date) AS active FROM px GROUP BY pattern""",
    "knn_states": f"""{_S}, z0 AS (SELECT *, row_number() OVER (ORDER BY date) AS i, {_KNN_M} FROM state WHERE {' AND '.join(c + ' IS NOT NULL' for c in STATE_COLUMNS)}),
      z1 AS (SELECT * FROM z0 WHERE i > 70),
      z2 AS (SELECT a.date, b.date AS match, sqrt({_KNN_D}) AS distance FROM z1 a JOIN z0 b ON b.i <= a.i - 20)
      SELECT date, match, row_number() OVER (PARTITION BY date ORDER BY distance, match)::INTEGER AS place, round(distance, 6) AS distance FROM z2 QUALIFY row_number() OVER (PARTITION BY date ORDER BY distance, match) <= 3""",
    "evidence_conflict": f"WITH {PANEL_SQL}, {_EV} SELECT symbol, date, channels::INTEGER AS channels, round(s, 6) AS supporting, round(a, 6) AS contradicting, round(c, 6) AS conflict, CASE WHEN c > 0.38 THEN 'CONTRADICTED' WHEN s <> a THEN 'SUPPORTED' ELSE 'UNCERTAIN' END AS state FROM ev",
    "corr_edges": f"WITH {_PAIRS_SQL} SELECT * FROM edges",
    "corr_change": f"WITH {_PAIRS_SQL} SELECT a, b, round(recent, 6) AS recent, round(before, 6) AS before, round(recent - before, 6) AS delta, CASE WHEN recent - before >= 0.12 THEN 'SPIKE' WHEN recent - before <= -0.12 THEN 'BREAKDOWN' ELSE 'STABLE' END AS kind FROM pairs ORDER BY abs(round(recent - before, 6)) DESC, a, b LIMIT 6",
    "degree_strength": f"WITH {_PAIRS_SQL} SELECT node, count(*) AS degree, round(sum(abs(correlation)), 6) AS strength FROM (SELECT src AS node, correlation FROM edges UNION ALL SELECT dst, correlation FROM edges) GROUP BY node",
    "lexicon_sentiment": f"WITH {_HEAD} SELECT event_id, round(score, 3) AS sentiment, CASE WHEN score > 0.15 THEN 'POSITIVE' WHEN score < -0.15 THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS label, round(least(1.0, abs(score) + 0.1 * len(hits)), 3) AS strength, array_to_string(hits, ',') AS terms FROM h2",
    "event_category": f"WITH {_HEAD} SELECT {_CAT} AS category, count(*) AS n FROM h0 GROUP BY 1",
    "props_json": "SELECT name, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (SELECT unnest(json_keys(props)) AS name, props FROM events) t, LATERAL (SELECT json_extract_string(props, '$.' || name) AS value) GROUP BY name",
    "flatten_paths": """WITH o AS (SELECT o_custkey AS key, o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
      SELECT key, 'orders[' || i || '].o_orderkey' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM o WHERE i < 50 UNION ALL SELECT key, 'orders[' || i || '].state.status', o_orderstatus FROM o WHERE i < 50
      UNION ALL SELECT key, 'orders[' || i || '].state.priority', o_orderpriority FROM o WHERE i < 50 UNION ALL SELECT DISTINCT key, 'n', CAST(n AS VARCHAR) FROM o""",
    "search_hits": """SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS id, c_name || ' ' || c_mktsegment AS text FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'er#00000001')
      UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'er#00000001') UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'er#00000001')""",
    "graph_density": f"WITH {_PAIRS_SQL}, n AS (SELECT count(DISTINCT node) AS nodes FROM ser) SELECT nodes, (SELECT count(*) FROM edges) AS edges, round(2 * (SELECT count(*) FROM edges) / nullif(nodes * (nodes - 1), 0), 6) AS density, (SELECT round(avg((src % 2 = dst % 2)::INTEGER), 6) FROM edges) AS purity FROM n",
    "instrument_mentions": "WITH w AS (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS w FROM part) SELECT n.name, count(*) AS n FROM w JOIN (VALUES ('Red'), ('Blue'), ('Ring')) n(name) ON lower(n.name) = w.w GROUP BY 1",
    "case_documents": f"""WITH {PANEL_SQL}, {STATE_SQL}, {_EV}, cl AS (SELECT date, sector, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols, round(max(abs(ret_1)), 6) AS severity, count(*) AS n_events FROM panel WHERE abs(ret_1) > 3 GROUP BY 1, 2 ORDER BY severity DESC, n_events DESC, date, sector LIMIT 40),
      sd AS (SELECT date, round(avg(round(c, 6)), 6) AS conflict, count(*) AS n FROM ev GROUP BY 1) SELECT concat_ws('-', 'case', CAST(cl.date AS VARCHAR), sector) AS case_id, symbols, severity, n_events, conflict, n::INTEGER AS n_evidence FROM cl LEFT JOIN sd USING (date)""",
}
ORACLES["flatten_paths_all"] = ORACLES["flatten_paths"]
ORACLES["case_similar_days"] = f"""WITH {PANEL_SQL}, {STATE_SQL}, cl AS (SELECT date, sector, round(max(abs(ret_1)), 6) AS severity, count(*) AS n_events FROM panel WHERE abs(ret_1) > 3 GROUP BY 1, 2 ORDER BY severity DESC, n_events DESC, date, sector LIMIT 40),
  z0 AS (SELECT *, row_number() OVER (ORDER BY date) AS i, {_KNN_M} FROM state WHERE {' AND '.join(c + ' IS NOT NULL' for c in STATE_COLUMNS)}),
  z2 AS (SELECT a.date, b.date AS match, sqrt({_KNN_D}) AS distance FROM z0 a JOIN z0 b ON b.i <= a.i - 20 WHERE a.i > 70 AND a.date IN (SELECT date FROM cl)),
  z3 AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY distance, match)::INTEGER AS place FROM z2)
  SELECT concat_ws('-', 'case', CAST(cl.date AS VARCHAR), sector) AS case_id, match, place, round(distance, 6) AS distance FROM cl JOIN z3 USING (date) WHERE place <= 3"""
