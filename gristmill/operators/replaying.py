"""Replay with a model as of every anchor: what could have been forecast on each date from outcomes known by then.

A ridge model needs only sums: of features, their products, and their products with the outcome. Those are summed
by the date on which outcomes became known, and added up over dates, a row a day; so every date's model is a small
solve on the sums before it, and no model is fitted twice over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import clip, r6
from gristmill.operators.decisions import BAND, COSTS, MIN_EDGE, Costs
from gristmill.operators.features import W
from gristmill.operators.joins import asof

#: Share of each feature's own variation that is added as penalty, and outcomes that a model needs.
RIDGE, LEAST = 0.01, 200


def known_moments(panel: DataFrame, columns: list[str]) -> DataFrame:
    """(date, n, last, y, x_i, xy_i, xx_i_j): sums over all outcomes known up to each date that brought one. Rows without
    an outcome or a feature teach nothing."""
    d = range(len(columns))
    x = [F.col(c).cast("double") for c in columns]
    sums = {"n": F.lit(1), "y": F.col("y"), **{f"x_{i}": x[i] for i in d}, **{f"xy_{i}": x[i] * F.col("y") for i in d}, **{f"xx_{i}_{j}": x[i] * x[j] for i in d for j in range(i, len(columns))}}
    rows = panel.where("known_at is not null").na.drop(subset=["y", *columns])
    daily = rows.groupBy(F.col("known_at").alias("date")).agg(F.max("date").alias("last"), *(F.sum(v).alias(k) for k, v in sums.items()))
    upto = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return daily.select("date", F.max("last").over(upto).alias("last"), *(F.sum(k).over(upto).alias(k) for k in sums))


def _solved(rows: DataFrame, n_columns: int, ridge: float) -> DataFrame:
    """(date, n_train, train_end, base, centre, beta) of rows of moments."""
    pairs = [(i, j) for i in range(n_columns) for j in range(i, n_columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            get = lambda name: c[name].to_numpy(zero_copy_only=False).astype(float)
            n = get("n")
            centre = np.stack([get(f"x_{i}") for i in range(n_columns)], axis=1) / n[:, None]
            base = get("y") / n
            cov = np.empty((len(n), n_columns, n_columns))
            for i, j in pairs:
                cov[:, i, j] = cov[:, j, i] = get(f"xx_{i}_{j}") - n * centre[:, i] * centre[:, j]
            with_y = np.stack([get(f"xy_{i}") for i in range(n_columns)], axis=1) - n[:, None] * centre * base[:, None]
            spread = np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0.0)
            flat = spread <= 1e-12 * np.maximum(n[:, None], 1.0)  # a feature that never varied says nothing
            cov[flat] = 0.0
            np.swapaxes(cov, 1, 2)[flat] = 0.0
            at = np.arange(n_columns)
            cov[:, at, at] = np.where(flat, 1.0, cov[:, at, at] + ridge * spread)
            beta = np.linalg.solve(cov, np.where(flat, 0.0, with_y)[:, :, None])[:, :, 0] if len(n) else np.empty((0, n_columns))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * n_columns), pa.array(v.reshape(-1))) for v in (centre, beta)]
            yield pa.record_batch([c["date"], pa.array(n.astype(np.int64)), c["last"], pa.array(base), *lists], names=["date", "n_train", "train_end", "base", "centre", "beta"])

    return rows.mapInArrow(run, "date date, n_train long, train_end date, base double, centre array<double>, beta array<double>")


def models_as_of(panel: DataFrame, columns: list[str], ridge: float = RIDGE, least: int = LEAST) -> DataFrame:
    """(date, n_train, train_end, base, centre, beta): for each date of ``panel`` the ridge model of the outcomes known
    before it, where there are at least ``least``."""
    moments = known_moments(panel, columns)
    names = [c for c in moments.columns if c != "date"]
    # known before the date: what became known on a date serves from the next day on
    known = moments.withColumns({"date": F.date_add("date", 1), "one": F.lit(0), "tie": F.lit(0)})
    asked = panel.select("date", F.lit(0).alias("one")).distinct()
    found = asof(asked, known, ["one"], "date", names, tie="tie").where(F.col("n") >= least)  # a row a day
    return _solved(found.drop("one"), len(columns), ridge)


def forecast(columns: list[str]) -> Column:
    """The probability of a row by the model joined to it; a missing feature counts as the mean."""
    terms = [F.get("beta", F.lit(i)) * F.coalesce(F.col(c) - F.get("centre", F.lit(i)), F.lit(0.0)) for i, c in enumerate(columns)]
    return clip(sum(terms, F.col("base")), 0.01, 0.99)


def replay_model(panel: DataFrame, columns: list[str], horizon: int = 5, ridge: float = RIDGE, least: int = LEAST, costs: Costs = COSTS) -> DataFrame:
    """Every session with enough known outcomes as an anchor: (symbol, date, n_train, train_end, p, verdict, realised,
    resolved_on, correct, decision_quality, sessions_after). ``panel`` has the session's features, its ``day_move``
    and the next session's return ``fwd_ret``; the outcome is the return over ``horizon`` sessions, null until they
    are there. Nothing dated or known from the anchor on is in the model; the sessions after it are counted only."""
    ahead = W().rowsBetween(0, horizon - 1)
    full = F.count("fwd_ret").over(ahead) == horizon
    rows = panel.withColumns({
        "realised": F.when(full, F.exp(F.sum(F.log1p("fwd_ret")).over(ahead)) - 1),
        "resolved_on": F.when(full, F.last("known_at").over(ahead)),
        "sessions_after": F.count("*").over(W().rowsBetween(1, Window.unboundedFollowing)),
    })
    models = models_as_of(panel, columns, ridge, least)
    rows = rows.join(F.broadcast(models), "date").withColumn("p", forecast(columns))  # a model a day
    p, cost = F.col("p"), costs.round_trip
    edge = 2 * F.abs(p - 0.5) * F.coalesce("day_move", F.lit(0.0)) * 10_000 - cost
    acts = (F.abs(p - 0.5) >= BAND) & (edge >= MIN_EDGE)
    verdict = F.when(~acts, "NO ACTION").when(p >= 0.5, "POSITIVE").otherwise("NEGATIVE")
    correct = F.when(F.col("realised").isNotNull(), (p >= 0.5) == (F.col("realised") > 0))
    small = F.abs("realised") * 10_000 < cost
    quality = (
        F.when(F.col("realised").isNull(), "PENDING")
        .when(acts & correct, "GOOD_DECISION_GOOD_OUTCOME")
        .when(acts, "GOOD_DECISION_BAD_OUTCOME")
        .when(small, "GOOD_ABSTENTION")
        .when(correct, "MISSED_OPPORTUNITY")
        .otherwise("AVOIDED_LOSS")
    )
    return rows.select("symbol", "date", "n_train", "train_end", r6(p).alias("p"), verdict.alias("verdict"), r6(F.col("realised")).alias("realised"), "resolved_on", correct.alias("correct"), quality.alias("decision_quality"), "sessions_after")


def replay_timeline(replayed: DataFrame, step: int = 20) -> DataFrame:
    """By symbol, over every ``step``-th anchor: how often the forecast was right and how often it would have acted."""
    rows = replayed.withColumn("k", F.row_number().over(W()) - 1).where(F.col("k") % step == 0)
    return rows.groupBy("symbol").agg(
        F.count("*").alias("points"),
        F.count("correct").alias("resolved"),
        r6(100 * F.avg(F.col("correct").cast("double"))).alias("hit_rate_pct"),
        r6(100 * F.avg((F.col("verdict") != "NO ACTION").cast("double"))).alias("action_rate_pct"),
        F.count_if(F.col("train_end") >= F.col("date")).alias("leaks"),
    )
