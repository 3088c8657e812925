"""Meanings that a comparison of two implementations wouldn't show."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import aggregates, decisions, features, intelligence, joins, learning, metrics, sketches
from gristmill.plans import intelligence_queries
from gristmill.sources import lake as lk
from gristmill.streaming import bus, state


def bars(spark, closes, symbol="A", start="2020-01-01"):
    day = dt.date.fromisoformat(start)
    rows = [(symbol, day + dt.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c), 10 + i, "S") for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long, sector string")


def test_ema_equals_pandas(spark):
    random.seed(1)
    x = [random.uniform(10, 20) for _ in range(2500)]  # several blocks
    df = bars(spark, x).withColumn("i", F.row_number().over(features.W()) - 1)
    got = [r["e"] for r in features.emas(df, ("close", 12, "e")).orderBy("date").collect()]
    want = pd.Series(x).ewm(span=12, adjust=False).mean()
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_windows_are_null_until_full(spark):
    out = features.price_features(bars(spark, range(10, 40))).orderBy("date").collect()
    assert [r["sma_10_gap"] is None for r in out] == [True] * 9 + [False] * 21
    assert out[20]["vol_20"] is not None and out[19]["vol_20"] is None


def test_labels_look_forward_and_features_may_not(spark):
    out = features.forward_labels(bars(spark, [10, 11, 9]), (1,)).orderBy("date").collect()
    assert [r["label_dir_1"] for r in out] == [1.0, 0.0, None]
    assert out[0]["label_known_at_1"] == dt.date(2020, 1, 2)
    with pytest.raises(ValueError, match="fwd_ret_1"):
        features.forbid_future(["ret_1", "fwd_ret_1"])


def test_truncation_finds_a_leak(spark):
    data = bars(spark, [10 + (i * 7) % 5 for i in range(90)])
    bench = data.select("date", "open", "high", "low", "close", "volume")
    cut = F.lit("2020-03-01").cast("date")
    assert features.truncation_offenders(data, bench, cut, ["ret_1", "vol_20"]).count() == 0
    # the control: a column that knows the whole history does change
    full = data.withColumn("m", F.max("close").over(features.W().rowsBetween(-1000, 1000)))
    assert full.where(F.col("date") <= cut).agg(F.max("m")).first()[0] == 14.0


def test_news_after_the_cutoff_does_not_count(spark):
    sessions = spark.createDataFrame([(1, dt.date(2024, 1, 10))], "symbol long, date date")
    at = lambda s: dt.datetime.fromisoformat(s)
    news = spark.createDataFrame([(1, at("2024-01-10T23:59:00"), 0.5), (1, at("2024-01-05T23:59:00"), -0.5), (1, at("2024-01-05T23:58:59"), 1.0), (1, at("2024-01-11T00:00:00"), 1.0)], "symbol long, published_at timestamp, sentiment double")
    row = joins.news_window(sessions, news).first()
    assert (row["news_count"], row["news_sentiment"], row["news_strength"]) == (2, 0.0, 0.5)


def test_news_are_summed_before_the_window(spark):
    sessions = spark.createDataFrame([("a", dt.date(2024, 1, 10)), ("b", dt.date(2024, 1, 10)), ("c", None)], "symbol string, date date")
    day = F.to_timestamp(F.lit("2024-01-09 00:00:00"))
    news = spark.range(40_000).select(F.lit("a").alias("symbol"), (day + F.make_dt_interval(secs=F.col("id") % 90 + 0.5)).alias("published_at"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(-0.7).alias("sentiment"))
    spoilt = spark.createDataFrame([("b", dt.datetime(2024, 1, 9), float("nan")), ("b", dt.datetime(2024, 1, 9), 0.5)], "symbol string, published_at timestamp, sentiment double")
    out = joins.news_window(sessions, news.union(spoilt))
    got = {r["symbol"]: tuple(r)[2:] for r in out.collect()}
    assert got["a"] == (40_000, -0.3, 0.4, 1.0) and set(got) == {"a", "b"}
    assert got["b"][0] == 2 and got["b"][1] != got["b"][1]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("Window")[-1]  # what the window's one task of a symbol reads


def test_asof_takes_the_last_not_later(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 3, 10), (1, 5, 11), (1, 5, 12), (1, 6, 13)], "k long, t long, id long")
    out = {(r["k"], r["t"]): r["id"] for r in joins.asof(left, right, ["k"], "t", ["id"], "id").collect()}
    assert out == {(1, 5): 12, (1, 1): None, (2, 9): None}


def test_auc_with_ties(spark):
    rows = [(0.1, 0.0), (0.4, 0.0), (0.4, 1.0), (0.8, 1.0)]
    assert metrics.auc(spark.createDataFrame(rows, "p double, y double")).first()["auc"] == 0.875
    assert metrics.auc(spark.createDataFrame([(0.1, 1.0)], "p double, y double")).first()["auc"] is None


def test_triage_reasons(spark):
    data = bars(spark, [10, 10, 30]).union(bars(spark, [10]))
    out = aggregates.triage(data, "2020-01-02").orderBy("date", "nth").collect()
    assert [r["status"] for r in out] == ["VALID", "INVALID", "VALID", "INVALID"]
    assert out[1]["reasons"] == "duplicate_rows" and out[3]["reasons"] == "future_timestamp"
    assert out[3]["suspicious"] == ["extreme_return"]


def forecast(spark, **change):
    base = dict(symbol="A", date=dt.date(2024, 1, 1), probability=0.7, expected_move=0.02, data_quality=95.0, model_agreement=0.9, uncertainty=0.2, calibration_ece=0.01, drift_state="HEALTHY", regime="BULL", regime_confidence=0.8, risk_score=30.0, stability_score=1.0, modality_coverage=1.0)
    return spark.createDataFrame([base | change])


@pytest.mark.parametrize(
    ("change", "check"),
    [({"data_quality": 80.0}, "DATA QUALITY"), ({"model_agreement": 0.5}, "MODEL AGREEMENT"), ({"uncertainty": 0.7}, "UNCERTAINTY"), ({"calibration_ece": 0.1}, "CALIBRATION"), ({"drift_state": "DEGRADED"}, "MODEL HEALTH"), ({"regime": "TRANSITION"}, "MARKET STABILITY"), ({"risk_score": 80.0}, "RISK"), ({"expected_move": 0.001}, "COST ADVANTAGE")],
)
def test_each_failure_closes_the_gate(spark, change, check):
    open_ = decisions.gate(forecast(spark)).first()
    assert open_["verdict"] == "POSITIVE" and open_["trust"] == pytest.approx(100)
    shut = decisions.gate(forecast(spark, **change)).first()
    assert shut["verdict"] == "NO ACTION" and shut["blocking"] == [check] and shut["trust"] < 100


def test_costs():
    assert decisions.COSTS.round_trip == 18 == 2 * decisions.COSTS.one_way


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(20, 21)], "src long, dst long")
    assert {tuple(r) for r in intelligence.components(edges).collect()} == {(i, 0) for i in range(9)} | {(20, 20), (21, 20)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 200)], "src long, dst long")
    assert {tuple(r) for r in intelligence.components(edges).collect()} == {(i, 0) for i in range(101)} | {(200, 200)}


def test_items_are_linked_in_tasks_and_across_them(spark):
    groups = [(1, 10), (1, 11), (2, 11), (2, 12), (3, 40), (3, 40), (4, 50), (4, 51), (5, 60), (5, None), (None, 61), (6, 12), (6, 9)]
    want = {(i, 9) for i in (9, 10, 11, 12)} | {(50, 50), (51, 50)}  # 40 and 60 have no other item in their groups
    for rows in (2, 1000):
        for parts in (1, 5):
            links = intelligence.item_links(spark.createDataFrame(groups, "group long, item long").repartition(parts), rows)
            assert {tuple(r) for r in intelligence.components(links).collect()} == want
    dense = spark.range(20_000).select((F.col("id") % 997).alias("group"), (F.col("id") % 101).alias("item"))
    assert intelligence.item_links(dense).count() < 5_000  # not an edge a row


def test_components_of_all_orders(spark, small):
    lines = [tuple(r) for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    parts = {}
    for order, part in lines:
        parts.setdefault(order, set()).add(part)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for some in parts.values():
        for x in some if len(some) > 1 else ():
            a, b = sorted((root(min(some)), root(x)))
            parent[b] = a
    want = {(x, root(x)) for x in list(parent)}
    assert {tuple(r) for r in intelligence_queries.graph_components(spark, small).collect()} == want


def test_cases_have_similar_days_within_a_month(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(130)]
    states = spark.createDataFrame([(d, float(i * 7 % 31)) for i, d in enumerate(days)], "date date, x double")
    asked = spark.createDataFrame([(days[100],), (days[5],)], "date date")
    got = intelligence.similar_states(states, ["x"], days=asked).orderBy("place").collect()
    assert [(r["date"], r["match"]) for r in got] == [(days[100], days[100 - 31 * k]) for k in (3, 2, 1)]
    clusters = asked.selectExpr("date", "'S' as sector", "'A' as symbols", "1.0 as severity", "1 as n_events")
    said = asked.selectExpr("date", "'A' as symbol", "'SUPPORTED' as state", "1.0 as supporting", "0.0 as contradicting", "0.0 as conflict")
    documents = intelligence.case_documents(clusters, said, intelligence.similar_states(states, ["x"], days=clusters)).collect()
    assert [str(days[7]) in r["document"] for r in documents if "2020-04-10" in r["case_id"]] == [True]


def test_regimes_use_no_future(spark):
    random.seed(4)
    columns = intelligence_queries.STATE_COLUMNS
    rows = [(dt.date(2018, 1, 1) + dt.timedelta(days=4 * i), *(random.gauss(i // 90 % 2, 1) for _ in columns)) for i in range(380)]
    states = spark.createDataFrame(rows, ", ".join(["date date", *(f"{c} double" for c in columns)]))
    whole = {r["date"]: tuple(r) for r in learning.regime_history(states, columns).collect()}
    cut = spark.createDataFrame(rows[:340], states.schema)  # ends in the second fold
    part = {r["date"]: tuple(r) for r in learning.regime_history(cut, columns).collect()}
    assert min(whole) >= dt.date(2021, 1, 1) and len(part) > 60
    assert part == {d: whole[d] for d in part}


def test_isotonic_starts_with_enough_outcomes_and_refits_every_60_sessions(spark):
    day = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(260)]
    rows = [(f"S{k}", day[i], day[i + 1], (k + 0.5) / 20, float((i * 7 + k * 3) % 20 < k)) for i in range(259) for k in range(20)]
    panel = spark.createDataFrame(rows, "symbol string, date date, known_at date, p double, y double")
    # before day i, 20 outcomes of each day up to i - 2 are known
    assert learning.isotonic_cuts(panel) == [day[76], day[136], day[196], day[256]]
    got = learning.isotonic_rolling(panel)
    assert got.count() == len(rows)
    changed = got.where("p <> p_cal").agg(F.min("date")).first()[0]
    assert changed == day[76]


def test_models_have_the_references_size(spark):
    rf, gbt = learning.estimator("rf"), learning.estimator("gbt")
    assert (rf.getNumTrees(), rf.getMaxDepth(), gbt.getMaxIter(), gbt.getMaxDepth()) == (300, 7, 350, 4)


def test_distinct_sketch(spark):
    got = sketches.fm_distinct(spark.range(40_000), "id", 1024).first()[0]
    assert abs(got - 40_000) / 40_000 < 3 * 0.78 / 1024**0.5


def test_bloom_has_no_false_negatives(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    bits = {r["word"]: r["mask"] for r in sketches.bloom_bits(df, "k", 1 << 16, 5).collect()}
    again = sketches.bloom_bits(df.where("k < 50"), "k", 1 << 16, 5).collect()
    assert all(bits[r["word"]] & r["mask"] == r["mask"] for r in again)
    assert sketches.bloom_stats(df, "k").first()["expected_fp"] < 0.01


def test_dgim_stays_close_and_small():
    random.seed(3)
    bits, window, buckets = [int(random.random() < 0.35) for _ in range(6000)], 1024, []
    for at, bit in enumerate(bits):
        if bit:
            buckets = state.dgim_add(buckets, at, window)
    exact = sum(bits[-window:])
    inside = [b for b in buckets if b[0] > len(bits) - 1 - window]
    assert abs(state.dgim_estimate(buckets, len(bits) - 1, window) - exact) <= inside[-1][1] / 2 + 1  # half of the oldest bucket
    assert len(buckets) < 4 * 10


def test_reservoir_is_bounded_and_fixed(spark):
    a = {r["id"] for r in sketches.reservoir(spark.range(5000), "id", 100).collect()}
    assert len(a) == 100 and a == {r["id"] for r in sketches.reservoir(spark.range(5000).repartition(7), "id", 100).collect()}


def test_stream_of_several_batches_keeps_state(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=i), "a", float(i % 7)) for i in range(60)] + [(60, day + dt.timedelta(hours=2), "a", 99.0)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        bus.append_log(df.where(f"event_id div 21 = {part}").coalesce(1), str(tmp_path / "log"))
    stream = bus.json_log(spark, str(tmp_path / "log"), schema, files_per_trigger=1)
    got = bus.drain(state.welford_anomalies(stream), str(tmp_path / "out")).collect()
    want = sketches.welford_anomalies(df).collect()
    assert {r["event_id"] for r in got} == {r["event_id"] for r in want} == {60}


def test_lake(spark, tmp_path):
    lake = lk.Lake(spark, str(tmp_path))
    data = bars(spark, [1, 2, 3])
    assert lake.write(data, "curated", "x").first()["rows"] == 3
    assert lake.read("curated", "x", ["date"], "year = 2020").count() == 3
    with pytest.raises(ValueError, match="zone"):
        lake.path("other", "x")
    with pytest.raises(ValueError, match="empty"):
        lake.write(data.where("false"), "curated", "x")


def test_documents(spark):
    stored = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    new = lk.upsert(stored, spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string"), ["id"])
    assert {tuple(r) for r in new.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert lk.find(stored, {"v": None}).count() == 1
    assert [r["id"] for r in lk.find(stored, sort=[("v", -1)]).collect()] == [2, 1]
