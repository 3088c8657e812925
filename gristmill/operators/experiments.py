"""Experiment arms: one protocol and model, one thing changed in each, and what follows from the difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.operators import learning as ln
from gristmill.operators import metrics as mt
from gristmill.operators.boosting import Boosting
from gristmill.operators.decisions import BAND, COSTS, MIN_EDGE, Costs
from gristmill.operators.features import W
from gristmill.sources.lake import written

#: Arm -> the arm it is compared with. Names and limits are fixed values.
COMPARED = {"A_PRICE_ONLY": None, "B_PRICE_CONTEXT": "A_PRICE_ONLY", "C_WITH_NEWS": "B_PRICE_CONTEXT", "D_REGIME_AWARE": "C_WITH_NEWS", "E_DELAYED_DATA": "B_PRICE_CONTEXT"}
LEAST_GAIN = 0.0005


def _policy(rows: DataFrame, band: float, gated: bool, costs: Costs) -> DataFrame:
    """One row of what a policy earns: trades, share of abstentions, and net basis points a trade and an opportunity."""
    p, cost = F.col("p"), costs.round_trip / 10_000
    signal = F.when(p >= 0.5 + band, 1.0).when(p <= 0.5 - band, -1.0).otherwise(0.0)
    edge = 2 * F.abs(p - 0.5) * F.coalesce("day_move", F.lit(0.012)) * 10_000
    signal = F.when(edge >= costs.round_trip + MIN_EDGE, signal).otherwise(0.0) if gated else signal
    net: Column = F.when(F.col("signal") != 0, F.col("signal") * F.col("fwd_ret") - cost)
    out = rows.where("fwd_ret is not null").withColumn("signal", signal).agg(F.count("*").alias("n"), F.count(net).alias("trades"), F.coalesce(F.avg(net), F.lit(0.0)).alias("net"), F.coalesce(F.sum(net), F.lit(0.0)).alias("total"))
    per = lambda x: F.coalesce(F.try_divide(x, F.col("n")), F.lit(0.0))
    return out.select("trades", r6(100 * (1 - per(F.col("trades")))).alias("abstention_pct"), r6(10_000 * F.col("net")).alias("net_bps_per_trade"), r6(10_000 * per(F.col("total"))).alias("net_bps_per_opportunity"))


def arms(rows: DataFrame, price: list[str], context: list[str], news: list[str], regime: list[str], boosting: Boosting = Boosting(), costs: Costs = COSTS, first_months: int = 36, step_months: int = 12) -> DataFrame:
    """(arm, n_features, n, brier, auc, brier_gain, auc_gain, trades, abstention_pct, net_bps_per_trade,
    net_bps_per_opportunity, conclusion) of the arms A to F.

    A to E are walk-forward models that see price, context, news, regimes, or price and context one session late; an
    arm is SUPPORTED if its Brier score falls by more than LEAST_GAIN and its AUC rises against the arm it is
    compared with. F changes D's policy only: supported if abstaining earns more a trade than trading everything."""
    rows = written(rows, "experiment_rows")
    seen = {"A_PRICE_ONLY": price, "B_PRICE_CONTEXT": price + context, "C_WITH_NEWS": price + context + news, "D_REGIME_AWARE": price + context + news + regime, "E_DELAYED_DATA": price + context}
    measured, told = {}, {}
    for arm, columns in seen.items():
        late = rows.withColumns({c: F.lag(c, 1).over(W()) for c in columns}) if arm.startswith("E_") else rows
        found = ln.walk_forward(late, "gbt", columns, first_months, step_months, boosting)
        told[arm] = written(found.join(rows.select("symbol", "date", "fwd_ret", "day_move"), ["symbol", "date"]), "experiment")
        score = told[arm].agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")).crossJoin(F.broadcast(mt.auc(told[arm]).select("auc")))  # one row each
        measured[arm] = score.crossJoin(F.broadcast(_policy(told[arm], BAND, False, costs))).select(F.lit(arm).alias("arm"), F.lit(COMPARED[arm]).cast("string").alias("other"), F.lit(len(columns)).alias("n_features"), "*")
    table = None
    for row in measured.values():
        table = row if table is None else table.unionByName(row)
    table = written(table, "arms")
    against = table.select(F.col("arm").alias("other"), F.col("brier").alias("brier_0"), F.col("auc").alias("auc_0"))
    gain, rise = F.col("brier_0") - F.col("brier"), F.coalesce("auc", F.lit(0.0)) - F.coalesce("auc_0", F.lit(0.0))
    conclusion = F.when(F.col("other").isNull(), "REFERENCE").when((gain > LEAST_GAIN) & (rise > 0), "SUPPORTED").otherwise("NOT SUPPORTED")
    policy = ["trades", "abstention_pct", "net_bps_per_trade", "net_bps_per_opportunity"]
    out = table.join(F.broadcast(against), "other", "left").select("arm", "n_features", "n", r6(F.col("brier")).alias("brier"), "auc", r6(gain).alias("brier_gain"), r6(F.when(F.col("other").isNotNull(), rise)).alias("auc_gain"), *policy, conclusion.alias("conclusion"))  # five rows
    d = told["D_REGIME_AWARE"]
    every = _policy(d, 0.0, False, costs).select(F.col("net_bps_per_trade").alias("every"))
    abstains = _policy(d, BAND, True, costs).crossJoin(F.broadcast(every)).withColumn("conclusion", F.when(F.col("net_bps_per_trade") > F.col("every"), "SUPPORTED").otherwise("NOT SUPPORTED")).withColumn("arm", F.lit("F_ABSTENTION_POLICY"))
    of_d = table.where("arm = 'D_REGIME_AWARE'").select("n_features", "n", r6(F.col("brier")).alias("brier"), "auc", F.lit(None).cast("double").alias("brier_gain"), F.lit(None).cast("double").alias("auc_gain"))
    return out.unionByName(abstains.drop("every").crossJoin(F.broadcast(of_d)))
