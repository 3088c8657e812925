"""The audit of a forecast: fourteen checks of what it was made from, each with a severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.features import FUTURE_PREFIXES


# Names, severities and limits of the checks.
def checks() -> list[tuple[str, str, Column, Column | None]]:
    """(name, severity, passed, warns) over the columns of an audited forecast."""
    c = F.col
    leaks = F.exists("feature_columns", lambda n: F.exists(F.array(*map(F.lit, FUTURE_PREFIXES)), lambda p: n.startswith(p)))
    gap = F.datediff("as_of", "train_end")
    told = lambda name: F.length(F.trim(c(name))) > 0
    return [
        ("TEMPORAL ORDER", "HIGH", c("cutoff") >= c("as_of").cast("timestamp"), None),
        ("NO FUTURE TRAINING DATA", "HIGH", c("train_end") < c("as_of"), None),
        ("PURGE GAP >= HORIZON", "HIGH", gap >= c("horizon"), None),
        ("NO LABEL COLUMNS IN FEATURES", "HIGH", ~leaks, None),
        ("INPUT SNAPSHOT EXISTS", "HIGH", c("snapshot"), None),
        ("DATA QUALITY CONTRACT", "MEDIUM", c("data_quality") >= 85.0, None),
        ("DATA FRESHNESS", "MEDIUM", c("staleness_days").isNull() | (c("staleness_days") <= 10), (c("staleness_days") > 10) & (c("staleness_days") <= 20)),
        ("MODEL VERSION RECORDED", "MEDIUM", told("model_version"), None),
        ("FEATURE VERSION RECORDED", "MEDIUM", told("feature_version"), None),
        ("CODE FINGERPRINT RECORDED", "LOW", told("code_fingerprint"), None),
        ("CALIBRATION MEASURED", "MEDIUM", c("calibration_ece") <= 0.06, None),
        ("COST ASSUMPTIONS APPLIED", "HIGH", c("cost_bps") > 0, None),
        ("MODALITY STATE DECLARED", "LOW", c("news_state").isin("AVAILABLE", "UNAVAILABLE"), None),
        ("FUTURE ROWS EXCLUDED", "HIGH", c("sessions_after") >= 0, None),
    ]


def audit(forecasts: DataFrame) -> DataFrame:
    """(audit_id, symbol, as_of, verdict, n_pass, n_fail, n_warn, failed): PASS without a failed check, FAIL with one of
    high severity, else PARTIAL. What isn't known fails its check."""
    found = [F.struct(F.lit(n).alias("check"), F.lit(s).alias("severity"), F.when(F.coalesce(w, F.lit(False)) if w is not None else F.lit(False), "WARN").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("result")) for n, s, ok, w in checks()]
    rows = forecasts.withColumn("checks", F.array(*found))
    failed = F.filter("checks", lambda x: x["result"] == "FAIL")
    count = lambda r: F.size(F.filter("checks", lambda x: x["result"] == r))
    verdict = F.when(count("FAIL") == 0, "PASS").when(F.exists(failed, lambda x: x["severity"] == "HIGH"), "FAIL").otherwise("PARTIAL")
    return rows.select(
        F.concat_ws("-", F.lit("A"), "symbol", F.col("as_of").cast("string")).alias("audit_id"),
        "symbol",
        "as_of",
        verdict.alias("verdict"),
        count("PASS").alias("n_pass"),
        count("FAIL").alias("n_fail"),
        count("WARN").alias("n_warn"),
        F.array_join(F.transform(failed, lambda x: x["check"]), "|").alias("failed"),
    )
