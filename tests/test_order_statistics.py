"""Ranks and quantiles over frames against brute force, with small blocks so that every part is used."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import order_statistics as od

rng = random.Random(2)


def rows_of(n=700):
    out = []
    for k, m in (("a", n), ("b", 90), ("c", 1)):
        for i in range(m):
            v = rng.choice([None, float("nan")]) if rng.random() < 0.1 else rng.choice([round(rng.random(), 2), 0.5])
            out.append((k, i, v, f"x{i}"))
    rng.shuffle(out)
    return out


SCHEMA = "key string, t long, v double, note string"


def brute(rows, n=None):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        for i, r in enumerate(own):
            frame = [x[2] for x in own[0 if n is None else max(0, i - n + 1) : i + 1] if x[2] is not None and x[2] == x[2]]
            out.append((*r[:2], r[3], len(frame), sum(x < r[2] for x in frame) if r[2] is not None else 0, sum(x == r[2] for x in frame)))
    return sorted(out)


def found(df):
    return sorted((r["key"], r["t"], r["note"], r["seen"], r["below"], r["same"]) for r in df.collect())


@pytest.mark.parametrize("block, ranges", [(4096, 256), (64, 8), (40, 3)])
def test_expanding_counts(spark, block, ranges):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(od.expanding_counts(df, ["key"], "t", "v", block=block, ranges=ranges)) == brute(rows)


@pytest.mark.parametrize("n, block", [(25, 4096), (25, 30), (25, 25)])
def test_rolling_counts(spark, n, block):
    rows = rows_of()
    assert found(od.rolling_counts(spark.createDataFrame(rows, SCHEMA), ["key"], "t", "v", n, block=block)) == brute(rows, n)


def test_one_value_of_all_rows(spark):
    df = spark.range(500).select(F.lit("a").alias("key"), F.col("id").alias("t"), F.lit(1.0).alias("v"), F.lit("").alias("note"))
    got = found(od.expanding_counts(df, ["key"], "t", "v", block=50, ranges=4))
    assert [(r[4], r[5]) for r in got] == [(0, i + 1) for i in range(500)]


def test_expanding_quantile(spark):
    rows = [(i, None if i % 11 == 0 else rng.choice([rng.random(), 0.25])) for i in range(400)]
    got = od.expanding_quantile(spark.createDataFrame(rows, "t long, v double").repartition(4), "t", "v", 0.95, "q").orderBy("t").collect()
    for i, r in enumerate(got):
        past = [v for _, v in rows[: i + 1] if v is not None]
        assert (r["q"] is None) if not past else r["q"] == pytest.approx(np.quantile(past, 0.95), abs=1e-12)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert od.expanding_counts(none, ["key"], "t", "v").collect() == []
    assert od.rolling_counts(none, ["key"], "t", "v", 5).collect() == []


def test_a_long_key_takes_seconds(spark):
    df = spark.range(300_000).select(F.lit("a").alias("key"), F.col("id").alias("t"), F.rand(3).alias("v"))
    began = time.time()
    total = od.expanding_counts(df, ["key"], "t", "v").agg(F.count("*"), F.sum("same"), F.max("seen")).first()
    assert tuple(total)[0] == tuple(total)[1] == tuple(total)[2] == 300_000
    assert time.time() - began < 60


@pytest.mark.parametrize("slots", [256, 3])
def test_exact_quantiles_of_keys(spark, slots):
    rows = rows_of()
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["key"]: r for r in od.exact_quantiles(spark.createDataFrame(rows, SCHEMA).repartition(5), ["key"], "v", shares, slots=slots).collect()}
    for key in ("a", "b", "c"):
        own = [r[2] for r in rows if r[0] == key and r[2] is not None and r[2] == r[2]]
        assert (key in got) == bool(own)
        if own:
            assert got[key]["n"] == len(own)
            assert got[key]["q"] == pytest.approx(np.quantile(own, shares).tolist(), abs=1e-12)


def test_exact_quantiles_of_all_rows_and_of_none(spark):
    rows = [(float(i % 7),) for i in range(100)]
    df = spark.createDataFrame(rows, "v double")
    assert od.exact_quantiles(df, [], "v", [0.25, 0.9]).first()["q"] == pytest.approx(np.quantile([r[0] for r in rows], [0.25, 0.9]).tolist())
    assert od.exact_quantiles(df.where("false"), [], "v", [0.5]).collect() == []
