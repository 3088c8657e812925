"""A panel of predictions over bars, on which metrics, gates and backtests work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expr import safe_div
from gristmill.operators.features import W

MEMBERS = ("p1", "p2", "p3")


def prediction_panel(features: DataFrame) -> DataFrame:
    """Three fixed members (momentum, reversal, trend) as probabilities of a rise, their mean ``p``, the share
    that agree on the direction, their spread, what came (``y``, ``fwd_ret``), the expected daily move and the
    edge before the trade in basis points. Rows without outcome or a member are left out."""
    c = F.col
    rows = features.select(
        "symbol",
        "date",
        "sector",
        (0.5 + 0.3 * F.tanh(c("ret_1") / 4)).alias("p1"),
        (0.5 - 0.2 * F.tanh(c("ret_5") / 4)).alias("p2"),
        (0.5 + 0.25 * F.tanh("sma_10_gap")).alias("p3"),
        (safe_div(F.lead("close", 1).over(W()), c("close")) - 1).alias("raw"),
        F.lead("date", 1).over(W()).alias("known_at"),
        (F.tanh(c("vol_20") / 100) / 25).alias("day_move"),
        F.coalesce("volume_z", F.lit(0.0)).alias("volume_z"),
        "corr_bench_60",
        "ret_1",
        "market_breadth",
    ).where("raw is not null and p2 is not null and p3 is not null")
    p = (c("p1") + c("p2") + c("p3")) / 3
    k = sum((c(m) >= 0.5).cast("int") for m in MEMBERS)
    square = (c("p1") * c("p1") + c("p2") * c("p2") + c("p3") * c("p3")) / 3
    return rows.select(
        "symbol",
        "date",
        "sector",
        *MEMBERS,
        p.alias("p"),
        F.greatest(k / 3, 1 - k / 3).alias("agreement"),
        F.sqrt(F.greatest(F.lit(0.0), square - p * p)).alias("spread"),
        (c("raw") > 0).cast("double").alias("y"),
        (F.tanh("raw") / 50).alias("fwd_ret"),
        "known_at",
        "day_move",
        "volume_z",
        "corr_bench_60",
        "ret_1",
        "market_breadth",
        (2 * F.abs(p - 0.5) * F.coalesce("day_move", F.lit(0.012)) * 10_000).alias("edge_bps"),
    )
