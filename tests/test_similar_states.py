"""Nearest earlier states without all pairs: the same rows as all pairs give, from fewer of them."""

import datetime as dt

import numpy as np
import pytest

from gristmill.operators import intelligence as it

COLUMNS = ["a", "b", "c"]


def states(n, seed=1):
    rng = np.random.default_rng(seed)
    x = np.zeros((n, 3))
    for i in range(1, n):
        x[i] = 0.97 * x[i - 1] + rng.standard_normal(3) * 0.3
    day = dt.date(1990, 1, 1)
    return [(day + dt.timedelta(days=i), *(None if k == 0 and i % 97 == 5 else float(round(v, 3)) for k, v in enumerate(x[i]))) for i in range(n)]


def brute(rows, k, apart, least):
    rows = [r for r in rows if None not in r]
    x, out = np.array([r[1:] for r in rows]), []
    for i in range(least + apart, len(rows)):
        scale = x[: i + 1].std(axis=0, ddof=1)
        d = np.sqrt((((x[i] - x[: i - apart + 1]) / scale) ** 2).sum(axis=1))
        for place, j in enumerate(np.lexsort((np.arange(len(d)), d))[:k]):
            out.append((rows[i][0], rows[j][0], place + 1, round(float(d[j]), 6)))
    return out


@pytest.mark.parametrize("n", [90, 700])
def test_equals_all_pairs(spark, n):
    rows = states(n)
    df = spark.createDataFrame(rows, "date date, a double, b double, c double")
    got = sorted((r["date"], r["place"], r["match"], r["distance"]) for r in it.similar_states(df, COLUMNS, days=df).collect())
    want = sorted((d, p, m, x) for d, m, p, x in brute(rows, 3, 20, 50))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert sum(g[2] != w[2] for g, w in zip(got, want)) <= 2  # distances that differ in the last bit only


def test_a_tenth_of_the_pairs_is_compared_at_ten_times_the_sessions(spark):
    df = spark.createDataFrame(states(5000, 3), "date date, a double, b double, c double")
    pairs = it.state_pairs(df, COLUMNS, 3, 20, 50, df).count()
    n = df.na.drop().count()
    assert pairs < 0.1 * n * n / 2
