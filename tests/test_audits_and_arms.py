"""The fourteen checks one by one, and experiment arms on rows with a planted signal."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import auditing as au
from gristmill.operators import experiments as ex
from gristmill.operators.boosting import Boosting

BASE = {
    "symbol": "s", "as_of": dt.date(2020, 1, 10), "cutoff": dt.datetime(2020, 1, 10, 23, 59), "train_end": dt.date(2020, 1, 8), "horizon": 1, "feature_columns": ["ret_1"], "snapshot": True, "data_quality": 90.0, "staleness_days": 3,
    "model_version": "m", "feature_version": "f", "code_fingerprint": "c", "calibration_ece": 0.03, "cost_bps": 18.0, "news_state": "UNAVAILABLE", "sessions_after": 4,
}
SCHEMA = "symbol string, as_of date, cutoff timestamp, train_end date, horizon int, feature_columns array<string>, snapshot boolean, data_quality double, staleness_days int, model_version string, feature_version string, code_fingerprint string, calibration_ece double, cost_bps double, news_state string, sessions_after long"
CASES = [
    ({}, "PASS", ""),
    ({"cutoff": dt.datetime(2020, 1, 9)}, "FAIL", "TEMPORAL ORDER"),
    ({"train_end": dt.date(2020, 1, 10)}, "FAIL", "NO FUTURE TRAINING DATA|PURGE GAP >= HORIZON"),
    ({"horizon": 5}, "FAIL", "PURGE GAP >= HORIZON"),
    ({"feature_columns": ["ret_1", "fwd_ret_5"]}, "FAIL", "NO LABEL COLUMNS IN FEATURES"),
    ({"snapshot": None}, "FAIL", "INPUT SNAPSHOT EXISTS"),
    ({"data_quality": 84.0}, "PARTIAL", "DATA QUALITY CONTRACT"),
    ({"staleness_days": 25}, "PARTIAL", "DATA FRESHNESS"),
    ({"staleness_days": 15}, "PASS", ""),
    ({"model_version": None, "feature_version": " "}, "PARTIAL", "MODEL VERSION RECORDED|FEATURE VERSION RECORDED"),
    ({"code_fingerprint": ""}, "PARTIAL", "CODE FINGERPRINT RECORDED"),
    ({"calibration_ece": None}, "PARTIAL", "CALIBRATION MEASURED"),
    ({"cost_bps": 0.0}, "FAIL", "COST ASSUMPTIONS APPLIED"),
    ({"news_state": "MAYBE"}, "PARTIAL", "MODALITY STATE DECLARED"),
    ({"sessions_after": None}, "FAIL", "FUTURE ROWS EXCLUDED"),
]


def test_each_check(spark):
    rows = [tuple({**BASE, "symbol": f"s{i:02d}", **change}.values()) for i, (change, _, _) in enumerate(CASES)]
    got = au.audit(spark.createDataFrame(rows, SCHEMA)).orderBy("symbol").collect()
    assert [(r["verdict"], r["failed"]) for r in got] == [(v, f) for _, v, f in CASES]
    assert all(r["n_pass"] + r["n_fail"] + r["n_warn"] == 14 for r in got)
    assert got[8]["n_warn"] == 1 and got[0]["audit_id"] == "A-s00-2020-01-10"


def test_arms_tell_a_signal_from_none(spark):
    rng = np.random.default_rng(3)
    rows, day = [], dt.date(2000, 1, 1)
    for i in range(900):
        for s in "ab":
            price, context, news = rng.standard_normal(3)
            up = float(rng.random() < 1 / (1 + np.exp(-0.8 * price - 2.5 * context)))
            rows.append((s, day + dt.timedelta(days=2 * i), day + dt.timedelta(days=2 * i + 1), up, 0.02 if up else -0.02, 0.02, float(price), float(context), float(news), 1.0))
    df = spark.createDataFrame(rows, "symbol string, date date, known_at date, y double, fwd_ret double, day_move double, price double, context double, news double, calm double")
    got = {r["arm"]: r for r in ex.arms(df, ["price"], ["context"], ["news"], ["calm"], Boosting(rounds=25, depth=3, rate=0.2)).collect()}
    assert sorted(got) == [*ex.COMPARED, "F_ABSTENTION_POLICY"]
    assert got["A_PRICE_ONLY"]["conclusion"] == "REFERENCE"
    b = got["B_PRICE_CONTEXT"]
    assert b["conclusion"] == "SUPPORTED" and b["brier_gain"] > 0.03 and b["auc_gain"] > 0.05
    assert got["C_WITH_NEWS"]["conclusion"] == "NOT SUPPORTED"
    late = got["E_DELAYED_DATA"]
    assert late["conclusion"] == "NOT SUPPORTED" and late["brier"] > b["brier"] and late["auc"] == pytest.approx(0.5, abs=0.07)
    f = got["F_ABSTENTION_POLICY"]
    assert f["abstention_pct"] > 0 and f["conclusion"] == "SUPPORTED" and f["brier"] == got["D_REGIME_AWARE"]["brier"]
