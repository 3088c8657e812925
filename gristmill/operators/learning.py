"""Walk-forward learning on the panel with Spark's own library. Loops on the driver go over folds, never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import clip
from gristmill.operators import boosting as bo
from gristmill.operators import mixture as mx
from gristmill.operators.joins import asof
from gristmill.sources.lake import written


def folds(panel: DataFrame, first_months: int = 36, step_months: int = 6) -> DataFrame:
    """(fold, cut, until): test windows from ``first_months`` after the first date on."""
    span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    cuts = span.select("b", F.explode(F.expr(f"sequence(add_months(a, {first_months}), b, interval {step_months} month)")).alias("cut"))
    w = Window.partitionBy(F.lit(0)).orderBy("cut")  # one row a fold
    return cuts.select(F.row_number().over(w).alias("fold"), "cut", F.coalesce(F.lead("cut", 1).over(w), F.date_add("b", 1)).alias("until"))


def fold_counts(panel: DataFrame, first_months: int = 36, step_months: int = 6) -> DataFrame:
    """How many rows each fold trains on (outcome known before the cut) and is tested on."""
    rows = panel.select("date", "known_at", "y")
    f = folds(rows, first_months, step_months)
    cuts = [r["cut"] for r in f.orderBy("fold").collect()]  # a dozen
    spans = fold_spans(bo.fold_places(rows, cuts), len(cuts))
    return f.join(F.broadcast(spans), "fold").select("fold", "cut", "until", "n_train", "n_test")


def estimator(kind: str):
    """Spark's own model of a kind; gbt is there for one fold, as its trees follow each other."""
    common = {"featuresCol": "x", "labelCol": "y"}
    return {
        "lr": lambda: LogisticRegression(**common, regParam=0.01, maxIter=25),
        "rf": lambda: RandomForestClassifier(**common, numTrees=300, maxDepth=7, minInstancesPerNode=40, seed=7),
        "gbt": lambda: GBTClassifier(**common, maxIter=350, maxDepth=4, stepSize=0.045, subsamplingRate=0.85, seed=7),
    }[kind]()


def assert_chronological(counts: DataFrame) -> None:
    """Raise unless in every fold (see fold_spans) the last outcome that trains was known, and its row dated, before the
    first row that is tested. Folds without rows on a side pass."""
    bad = counts.where("last_known >= first_test or last_trained >= first_test").orderBy("fold").limit(1).collect()
    if bad:
        raise ValueError(f"fold {bad[0]['fold']}: trains on {bad[0]['last_trained']}, known on {bad[0]['last_known']}, tests from {bad[0]['first_test']}")


def fold_spans(placed: DataFrame, n_folds: int) -> DataFrame:
    """(fold, n_train, n_test, last_trained, last_known, first_test, last_test) of rows with their ``first`` and ``test``
    (see boosting.fold_places). Rows are summed by place, so no row is paired with its folds; what a fold trains on adds
    up over the places before it, a row a fold."""
    days = placed.groupBy("first", "test").agg(F.count("*").alias("n"), F.max("date").alias("day"), F.max("known_at").alias("known"), F.min("date").alias("from"))
    spark = placed.sparkSession
    folds_ = F.broadcast(spark.range(n_folds).withColumnRenamed("id", "fold"))
    pairs = days.join(folds_, (F.col("first") <= F.col("fold")) | (F.col("test") == F.col("fold")))  # folds squared
    train, test = F.col("first") <= F.col("fold"), F.col("test") == F.col("fold")
    own = lambda f, c, side: f(F.when(side, F.col(c)))
    out = pairs.groupBy((F.col("fold") + 1).cast("int").alias("fold")).agg(
        F.coalesce(own(F.sum, "n", train), F.lit(0)).alias("n_train"),
        F.coalesce(own(F.sum, "n", test), F.lit(0)).alias("n_test"),
        own(F.max, "day", train).alias("last_trained"),
        own(F.max, "known", train).alias("last_known"),
        own(F.min, "from", test).alias("first_test"),
        own(F.max, "day", test).alias("last_test"),
    )
    return out


def walk_forward(panel: DataFrame, kind: str, columns: list[str], first_months: int = 36, step_months: int = 6, boosting: bo.Boosting = bo.Boosting()) -> DataFrame:
    """(symbol, date, y, p, fold), out of sample: each fold's model is fitted on rows whose outcome was known before its
    cut, and raises if one wasn't. Kinds: baseline (share of rises and the first column's momentum), gbt (all folds at
    once), lr and rf (a fold after the other, by Spark's library). Imputation and scaling are fitted on the same rows."""
    rows = written(panel.select("symbol", "date", "known_at", "y", *columns), "panel")
    found = folds(rows, first_months, step_months).orderBy("fold").collect()  # a dozen rows
    cuts = [f["cut"] for f in found]
    placed = bo.fold_places(rows, cuts)
    assert_chronological(fold_spans(placed, len(cuts)))
    if kind == "baseline":
        return bo.momentum_baseline(placed, cuts, columns[0])
    if kind == "gbt":
        return bo.walk_forward_boosting(placed, cuts, columns, boosting)
    out = None
    for fold in found:
        filled = [f"{c}_f" for c in columns]
        steps = [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), estimator(kind)]
        model = Pipeline(stages=steps).fit(rows.where(F.col("known_at") < F.lit(fold["cut"])))
        test = model.transform(rows.where((F.col("date") >= F.lit(fold["cut"])) & (F.col("date") < F.lit(fold["until"]))))
        part = test.select("symbol", "date", "y", vector_to_array("probability")[1].alias("p"), F.lit(fold["fold"]).alias("fold"))
        out = part if out is None else out.union(part)
    return out


def isotonic_cuts(panel: DataFrame, least: int = 1500, every: int = 60) -> list:
    """Every ``every``-th session from the first before which ``least`` outcomes are known."""
    days = panel.select("date").distinct().select("date", F.lit(0).alias("n"), F.lit(1).alias("session"))
    known = panel.where("known_at is not null and y is not null and p is not null").groupBy(F.col("known_at").alias("date")).agg(F.count("*").alias("n")).withColumn("session", F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("date").rangeBetween(Window.unboundedPreceding, -1)  # two rows a day
    counted = days.union(known).withColumn("date", F.unix_date("date")).withColumn("known", F.sum("n").over(before)).where((F.col("session") == 1) & (F.col("known") >= least))
    ranked = counted.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    return [r["cut"] for r in ranked.where(F.col("i") % every == 0).orderBy("date").select(F.date_from_unix_date("date").alias("cut")).collect()]


def isotonic_rolling(panel: DataFrame, least: int = 1500, low: float = 0.01, high: float = 0.99, every: int = 60) -> DataFrame:
    """Calibrated probabilities: refitted at every ``every``-th session on what was known before it, p itself until
    there are ``least`` outcomes."""
    rows = written(panel.select("symbol", "date", "known_at", "p", "y"), "calibrated")
    cuts = isotonic_cuts(rows, least, every)  # a few a year
    early = rows.where(F.col("date") < F.lit(cuts[0])) if cuts else rows
    out = early.select("symbol", "date", "p", F.col("p").alias("p_cal"))
    for cut, until in zip(cuts, [*cuts[1:], None][: len(cuts)], strict=True):
        test = rows.where(F.col("date") >= F.lit(cut))
        test = test if until is None else test.where(F.col("date") < F.lit(until))
        past = rows.where((F.col("known_at") < F.lit(cut)) & F.col("y").isNotNull() & F.col("p").isNotNull())
        fitted = IsotonicRegression(featuresCol="p", labelCol="y").fit(past).transform(test)
        out = out.union(fitted.select("symbol", "date", "p", clip(F.col("prediction"), low, high).alias("p_cal")))
    return out


def adaptive_ensemble(panel: DataFrame, members: tuple[str, ...], dates: int = 60, sharpness: float = 12.0) -> DataFrame:
    """Members weighted by softmax of their squared error over the last dates on which outcomes became known, up
    to the forecast's own date; equal weights before any is known."""
    errors = panel.groupBy(F.col("known_at").alias("date")).agg(*(F.sum(F.pow(F.col(m) - F.col("y"), 2)).alias(f"e_{m}") for m in members), F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1 - dates, 0)  # one row a day
    known = errors.select(F.lit(0).alias("one"), "date", *((F.sum(f"e_{m}").over(w) / F.sum("n").over(w)).alias(f"mse_{m}") for m in members), F.lit(0).alias("tie"))
    days = panel.select(F.lit(0).alias("one"), "date").distinct()
    at = asof(days, known, ["one"], "date", [f"mse_{m}" for m in members], tie="tie").drop("one")
    rows = panel.join(F.broadcast(at), "date")
    weight = {m: F.coalesce(F.exp(-sharpness * F.col(f"mse_{m}")), F.lit(1.0)) for m in members}
    total = sum(weight.values())
    p = sum(weight[m] * F.col(m) for m in members) / total
    return rows.select("symbol", "date", clip(p, 1e-4, 1 - 1e-4).alias("p_raw"), *((weight[m] / total).alias(f"w_{m}") for m in members))


def regime_ensemble(panel: DataFrame, regime: DataFrame, members: tuple[str, ...], dates: int = 120, first: int = 40, least: int = 200, sharpness: float = 12.0, shrink: float = 0.6) -> DataFrame:
    """The adaptive ensemble by regime: where at least ``least`` outcomes of the date's regime are known, from the last
    ``dates`` dates that brought any, their squared error counts as much as the members' error of all. Disagreement
    of the members draws the probability toward 0.5. Weights are equal before ``first`` outcomes are known. A date without
    a regime has the regime UNKNOWN."""
    rows = panel.join(regime.select("date", "regime"), "date", "left").withColumn("regime", F.coalesce("regime", F.lit("UNKNOWN")))
    sums = [*(F.sum(F.pow(F.col(m) - F.col("y"), 2)).alias(f"e_{m}") for m in members), F.count("*").alias("n")]
    daily = rows.where("known_at is not null").groupBy("regime", F.col("known_at").alias("date")).agg(*sums)
    whole = daily.groupBy("date").agg(*(F.sum(c).alias(c) for c in (*(f"e_{m}" for m in members), "n")))

    def late(frame: DataFrame, key: Column, name: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy("date").rowsBetween(1 - dates, 0)  # a row a day and regime
        return frame.withColumns({"tie": F.lit(0), f"n_{name}": F.sum("n").over(w), **{f"{name}_{m}": F.sum(f"e_{m}").over(w) / F.sum("n").over(w) for m in members}})

    days = rows.select("regime", "date", F.lit(0).alias("one")).distinct()
    days = asof(days, late(whole.withColumn("one", F.lit(0)), F.lit(0), "all"), ["one"], "date", ["n_all", *(f"all_{m}" for m in members)], tie="tie")
    days = asof(days, late(daily, F.col("regime"), "own"), ["regime"], "date", ["n_own", *(f"own_{m}" for m in members)], tie="tie")
    error = {m: F.when(F.col("n_all") < first, None).when(F.col("n_own") >= least, (F.col(f"all_{m}") + F.col(f"own_{m}")) / 2).otherwise(F.col(f"all_{m}")) for m in members}
    weighted = days.select("regime", "date", *(F.coalesce(F.exp(-sharpness * error[m]), F.lit(1.0)).alias(f"v_{m}") for m in members))
    out = rows.join(weighted, ["regime", "date"])
    total = sum(F.col(f"v_{m}") for m in members)
    p = sum(F.col(f"v_{m}") * F.col(m) for m in members) / total
    pull = 1 - shrink * clip(F.col("spread") / 0.12, 0, 1) * (1 - F.col("agreement"))
    return out.select("symbol", "date", "regime", clip(0.5 + (p - 0.5) * pull, 1e-4, 1 - 1e-4).alias("p_final"), *((F.col(f"v_{m}") / total).alias(f"w_{m}") for m in members))


def _names(model: mx.Mixture, columns: list[str]) -> list[str]:
    """Names of a mixture's components by their centres: the most volatile, then the lowest and highest trend if they
    fall and rise."""
    trend, vol = model.mean[:, columns.index("bench_trend_20")], model.mean[:, columns.index("bench_vol_20")]
    names = ["SIDEWAYS"] * len(trend)
    names[int(np.argmax(vol))] = "HIGH_VOLATILITY"
    rest = [i for i in range(len(names)) if names[i] == "SIDEWAYS"]
    if rest and trend[low := min(rest, key=lambda i: trend[i])] < 0:
        names[low] = "BEAR"
    rest = [i for i in rest if names[i] == "SIDEWAYS"]
    if rest and trend[high := max(rest, key=lambda i: trend[i])] > 0:
        names[high] = "BULL"
    return names


def _regimes(rows: DataFrame, columns: list[str], models: list[mx.Mixture | None], unsure: float) -> DataFrame:
    """(date, regime, confidence) of rows with their fold in ``test``, by its model; TRANSITION where no name is likely
    enough, and where the fold has no model."""
    named = [None if m is None else (m, _names(m, columns)) for m in models]  # some numbers a fold
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
            fold = batch.column(d).to_numpy()
            regime, sure = np.full(len(x), "TRANSITION", object), np.zeros(len(x))
            for f in np.unique(fold):
                if named[f]:
                    model, names = named[f]
                    own, kinds = fold == f, sorted(set(names))
                    p = model.posterior(x[own])
                    by_name = np.stack([p[:, [n == kind for n in names]].sum(axis=1) for kind in kinds], axis=1)
                    top = by_name.argmax(axis=1)
                    sure[own] = np.round(by_name.max(axis=1), 6)
                    regime[own] = np.where(by_name.max(axis=1) < unsure, "TRANSITION", np.array(kinds, object)[top])
            yield pa.record_batch([batch.column(d + 1), pa.array(regime, pa.string()), pa.array(sure)], names=["date", "regime", "confidence"])

    return rows.select(*columns, "test", "date").mapInArrow(run, "date date, regime string, confidence double")


def regime_mixture(state: DataFrame, columns: list[str], k: int = 4, seed: int = 7, unsure: float = 0.55, least: int = 250, apply: DataFrame | None = None) -> DataFrame:
    """Gaussian mixture over the market's state, the likeliest of four starts. Scaler and mixture are fitted on
    ``state``; the days of ``apply`` are labelled, or those of ``state`` itself."""
    rows = written(state.na.drop(subset=columns).select("date", *columns, F.lit(0).alias("first"), F.col("date").alias("key")), "state")
    found = mx.fit(rows, columns, 1, k, seed=seed, least=least)
    days = rows if apply is None else apply.na.drop(subset=columns)
    return _regimes(days.withColumn("test", F.lit(0)), columns, [m[0] if m else None for m in found], unsure)


def regime_history(state: DataFrame, columns: list[str], first_months: int = 36, step_months: int = 6, least: int = 250, k: int = 4, seed: int = 7, unsure: float = 0.55) -> DataFrame:
    """Regimes by mixtures that are refitted at each fold's cut, on earlier days only, and name the days up to the
    next cut; all folds and starts are fitted in the same passes. Days before the first cut, and of folds with fewer than
    ``least`` earlier days, are left out."""
    rows = written(state.na.drop(subset=columns).select("date", *columns), "state")
    cuts = [f["cut"] for f in folds(rows, first_months, step_months).orderBy("fold").collect()]  # two rows a year
    upto = F.size(F.filter(F.array(*(F.lit(c).cast("date") for c in cuts)) if cuts else F.array().cast("array<date>"), lambda c: c <= F.col("date")))
    placed = written(rows.withColumns({"first": upto, "test": upto - 1, "key": F.col("date")}), "placed_state")
    found = mx.fit(placed, columns, len(cuts), k, seed=seed, least=least)
    fitted = [i for i, m in enumerate(found) if m]
    return _regimes(placed.where(F.col("test").isin(fitted)), columns, [m[0] if m else None for m in found], unsure)
