"""Mixtures of several starts and folds in the same passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import mixture as mx


def rows_of(n=600):
    rng = np.random.default_rng(5)
    centres = np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]])
    own = rng.integers(0, 3, n)
    x = centres[own] + rng.standard_normal((n, 2)) * [0.6, 0.9]
    return own, [(i, int(i >= 300), float(a), float(b)) for i, (a, b) in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, first int, a double, b double").repartition(3).cache()


def test_planted_clusters_are_found_and_the_best_start_wins(spark):
    own, rows = rows_of()
    df = frame(spark, rows)
    fits = mx.fit(df, ["a", "b"], 2, k=3, starts=4, least=100)
    singles = [mx.fit(df, ["a", "b"], 2, k=3, starts=1, seed=s, least=100) for s in (1, 2)]
    x = np.array([r[2:] for r in rows])
    for fold, n in ((0, 300), (1, 600)):
        best = fits[fold][0]
        assert best.likelihood == max(m.likelihood for m in fits[fold])
        assert best.likelihood >= max(s[fold][0].likelihood for s in singles) - 2e-3
        label = best.posterior(x[:n]).argmax(axis=1)
        pairs = {(a, b) for a, b in zip(own[:n], label) if ((own[:n] == a) & (label == b)).sum() > 5}
        assert len(pairs) == 3 and len({b for _, b in pairs}) == 3
        p = best.joint(x[:n])
        top = p.max(axis=1)
        assert np.mean(top + np.log(np.exp(p - top[:, None]).sum(axis=1))) >= best.likelihood - 1e-6


def test_a_fold_learns_from_its_own_rows_only(spark):
    _, rows = rows_of()
    changed = [(k, f, a + 50 * f, b) for k, f, a, b in rows]
    one, two = (mx.fit(frame(spark, r).orderBy("key"), ["a", "b"], 2, k=3, starts=2, least=100, rounds=6) for r in (rows, changed))
    assert one[0][0].likelihood == pytest.approx(two[0][0].likelihood, abs=0.05)
    assert abs(one[1][0].centre[0] - two[1][0].centre[0]) > 10


def test_too_few_rows_and_constant_columns(spark):
    _, rows = rows_of(50)
    assert mx.fit(frame(spark, rows), ["a", "b"], 2, least=100) == [[], []]
    flat = frame(spark, rows).withColumn("b", F.lit(2.0))
    best = mx.fit(flat, ["a", "b"], 1, k=2, starts=2, least=20, rounds=10)[0][0]
    assert np.isfinite(best.posterior(np.array([[0.0, 2.0]]))).all()
