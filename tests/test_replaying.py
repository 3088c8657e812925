"""The model as of an anchor against a fit on the rows known before it."""

import datetime as dt

import numpy as np
import pytest

from gristmill.operators import replaying as rp

DAY = dt.date(2010, 1, 4)
COLUMNS = ["a", "b", "flat"]
SCHEMA = "symbol string, date date, known_at date, y double, fwd_ret double, day_move double, a double, b double, flat double"


def rows_of(n=160):
    rng = np.random.default_rng(8)
    out = []
    for s in ("u", "v"):
        for i in range(n):
            a, b = rng.standard_normal(2)
            ret = float(0.02 * np.tanh(a - 0.5 * b + rng.standard_normal()))
            day, last = DAY + dt.timedelta(days=i), i == n - 1
            out.append((s, day, None if last else day + dt.timedelta(days=1), None if last else float(ret > 0), None if last else ret, 0.02, None if i % 29 == 0 else float(a), float(b) + 3, 1.0))
    return out


def fit(rows, day):
    known = [r for r in rows if r[2] is not None and r[2] < day and r[6] is not None]
    x, y = np.array([r[6:9] for r in known], float), np.array([r[3] for r in known])
    xc, yc = x - x.mean(axis=0), y - y.mean()
    c = xc.T @ xc
    use = np.diag(c) > 1e-9
    beta = np.zeros(3)
    m = c[np.ix_(use, use)]
    beta[use] = np.linalg.solve(m + 0.01 * np.diag(np.diag(m)), (xc.T @ yc)[use])
    return len(known), max(r[1] for r in known), x.mean(axis=0), y.mean(), beta


def run(spark, rows):
    return {(r["symbol"], r["date"]): r for r in rp.replay_model(spark.createDataFrame(rows, SCHEMA), COLUMNS, least=100).collect()}


def test_equals_a_fit_on_what_was_known(spark):
    rows = rows_of()
    got = run(spark, rows)
    assert min(d for _, d in got) > DAY + dt.timedelta(days=50)
    for r in rows[70::13]:
        if (r[0], r[1]) in got:
            n, last, centre, base, beta = fit(rows, r[1])
            x = np.array([c if v is None else v for v, c in zip(r[6:9], centre)])
            found = got[r[0], r[1]]
            assert (found["n_train"], found["train_end"]) == (n, last)
            assert found["p"] == pytest.approx(min(0.99, max(0.01, base + beta @ (x - centre))), abs=2e-6)
            assert found["train_end"] < r[1]


def test_the_future_changes_no_forecast(spark):
    rows, cut = rows_of(), DAY + dt.timedelta(days=110)
    later = [(*r[:3], None if r[3] is None else 1 - r[3], *r[4:6], 99.0, -99.0, 7.0) if r[1] >= cut else r for r in rows]
    before, after = run(spark, rows), run(spark, later)
    assert all(before[k]["p"] == after[k]["p"] and before[k]["train_end"] == after[k]["train_end"] for k in before if k[1] < cut)
    assert any(before[k]["p"] != after[k]["p"] for k in before if k[1] > cut)


def test_outcomes_are_those_of_the_next_sessions(spark):
    rows = rows_of()
    got = run(spark, rows)
    own = {(r[0], r[1]): r[4] for r in rows}
    for (s, day), r in got.items():
        steps = [own.get((s, day + dt.timedelta(days=k))) for k in range(5)]
        if None in steps:
            assert (r["realised"], r["decision_quality"], r["correct"]) == (None, "PENDING", None)
        else:
            realised = np.prod([1 + x for x in steps]) - 1
            assert r["realised"] == pytest.approx(realised, abs=1e-6)
            assert r["correct"] == ((r["p"] >= 0.5) == (realised > 0))
        assert r["sessions_after"] == (DAY + dt.timedelta(days=159) - day).days
    assert {r["decision_quality"] for r in got.values()} >= {"PENDING", "GOOD_DECISION_GOOD_OUTCOME", "GOOD_DECISION_BAD_OUTCOME"}


def test_too_few_outcomes_give_no_anchor(spark):
    assert run(spark, rows_of(20)) == {}
