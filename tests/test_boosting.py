"""Boosting of all folds at once: both ways grow the same trees, no fold sees its future, and scores match Spark's trees."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gristmill.operators import boosting as bo
from gristmill.operators import learning as ln

DAY = dt.date(2000, 1, 3)
SMALL = bo.Boosting(rounds=4, depth=3, rate=0.3, least_weight=1.0, bins=8)


def rows_of(n=900, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3))
    up = rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] * (x[:, 1] > 0) - x[:, 2])))
    out = []
    for i in range(n):
        day = DAY + dt.timedelta(days=2 * i)
        a, b, c = (float(v) for v in x[i])
        out.append((f"s{i % 3}", day, day + dt.timedelta(days=1) if i < n - 1 else None, float(up[i]) if i < n - 1 else None, None if i % 41 == 0 else a, float("nan") if i % 37 == 0 else b, c))
    return out


SCHEMA = "symbol string, date date, known_at date, y double, a double, b double, c double"


def placed_of(spark, rows, cuts):
    return bo.fold_places(spark.createDataFrame(rows, SCHEMA), cuts)


CUTS = [DAY + dt.timedelta(days=d) for d in (600, 1000, 1400)]


def found(df):
    return sorted((r["symbol"], r["date"], r["fold"], r["p"]) for r in df.collect())


def test_the_references_size():
    b = bo.Boosting()
    assert (b.rounds, b.depth, b.rate, b.row_share, b.column_share, b.l2, b.least_weight) == (350, 4, 0.045, 0.85, 0.8, 2.0, 8.0)


def test_one_task_a_fold_and_one_job_a_level_grow_the_same_trees(spark):
    placed = placed_of(spark, rows_of(), CUTS)
    one = found(bo.walk_forward_boosting(placed, CUTS, ["a", "b", "c"], SMALL))
    many = found(bo.walk_forward_boosting(placed.repartition(5, "c"), CUTS, ["a", "b", "c"], SMALL, task_rows=0, refresh=3))
    assert len(one) == sum(r[1] >= CUTS[0] for r in rows_of())
    assert [x[:3] for x in one] == [x[:3] for x in many]
    np.testing.assert_allclose([x[3] for x in one], [x[3] for x in many], atol=1e-12)


def test_a_folds_future_changes_nothing(spark):
    rows = rows_of()
    changed = [(s, d, k, 1 - y if y is not None and d >= CUTS[1] else y, 9.0 if d >= CUTS[2] else a, b, c) for s, d, k, y, a, b, c in rows]
    before, after = (found(bo.walk_forward_boosting(placed_of(spark, x, CUTS), CUTS, ["a", "b", "c"], SMALL)) for x in (rows, changed))
    assert [x for x in before if x[2] == 1] == [x for x in after if x[2] == 1]
    assert [x[3] for x in before if x[2] == 3] != [x[3] for x in after if x[2] == 3]


def test_brier_is_that_of_sparks_trees(spark):
    rows = rows_of(6000, 5)
    cut = rows[4500][1]
    b = bo.Boosting(rounds=40, depth=3, rate=0.2, row_share=1.0, column_share=1.0, l2=0.0, least_weight=1.0, bins=32)
    ours = bo.walk_forward_boosting(placed_of(spark, rows, [cut]), [cut], ["a", "b", "c"], b)
    brier = ours.where("y is not null").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0]
    df = spark.createDataFrame(rows, SCHEMA).na.drop(subset=["y"]).withColumn("b", F.nanvl("b", F.lit(None).cast("double"))).fillna(0.0, ["a", "b"])
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(df)
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=40, maxDepth=3, stepSize=0.1, seed=1).fit(df.where(F.col("known_at") < F.lit(cut)))  # its loss is twice as steep
    test = model.transform(df.where(F.col("date") >= F.lit(cut)))
    theirs = test.agg(F.avg(F.pow(vector_to_array("probability")[1] - F.col("y"), 2))).first()[0]
    assert brier < theirs + 0.002
    assert brier < 0.2


def test_baseline_uses_what_each_fold_may_know(spark):
    rows = rows_of()
    got = {(r["symbol"], r["date"]): (r["p"], r["fold"]) for r in bo.momentum_baseline(placed_of(spark, rows, CUTS), CUTS, "a").collect()}
    for k, cut in enumerate(CUTS):
        past = [r for r in rows if r[3] is not None and r[2] < cut]
        base = np.mean([r[3] for r in past])
        scale = np.std([r[4] for r in past if r[4] is not None])
        for r in rows:
            if r[1] >= cut and (k == len(CUTS) - 1 or r[1] < CUTS[k + 1]):
                p, fold = got[r[0], r[1]]
                assert fold == k + 1
                assert p == pytest.approx(min(0.99, max(0.01, base + 0.08 * np.tanh((r[4] or 0.0) / (2 * scale)))), abs=1e-9)


def test_walks_raise_where_a_row_trains_on_its_future(spark):
    rows = spark.createDataFrame([("s", DAY, DAY, 1.0, 0, -1), ("s", DAY + dt.timedelta(days=9), DAY, 1.0, 0, 0)], "symbol string, date date, known_at date, y double, first int, test int")
    with pytest.raises(ValueError, match="fold 1"):
        ln.assert_chronological(ln.fold_spans(rows, 1))
    good = placed_of(spark, rows_of(), CUTS)
    ln.assert_chronological(ln.fold_spans(good, 3))
