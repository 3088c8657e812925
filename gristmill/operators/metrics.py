"""Metrics of probabilities, drift, and uncertainty: one pass of conditional aggregates wherever there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import clip, log_loss_term, r6, safe_div, tags
from gristmill.operators.features import W
from gristmill.operators.order_statistics import exact_quantiles
from gristmill.sources.lake import written


def _confusion(p: Column, y: Column) -> dict[str, Column]:
    hit = p >= 0.5
    return {"tp": F.count_if(hit & (y == 1)), "fp": F.count_if(hit & (y == 0)), "fn": F.count_if(~hit & (y == 1)), "tn": F.count_if(~hit & (y == 0))}


def confusion(panel: DataFrame, *keys: str) -> DataFrame:
    """Counts at threshold 0.5, accuracy, precision, recall and F1 (0 where undefined)."""
    out = panel.groupBy(*keys).agg(*(x.alias(n) for n, x in _confusion(F.col("p"), F.col("y")).items()))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    zero = lambda x: r6(F.coalesce(x, F.lit(0.0)))
    return out.select(*keys, tp, fp, fn, tn, zero(safe_div(tp + tn, tp + fp + fn + tn)).alias("accuracy"), zero(safe_div(tp, tp + fp)).alias("precision"), zero(safe_div(tp, tp + fn)).alias("recall"), zero(safe_div(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def brier_log_loss(panel: DataFrame) -> DataFrame:
    return panel.agg(F.count("*").alias("n"), r6(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), r6(F.avg(log_loss_term(F.col("p"), F.col("y")))).alias("log_loss"))


def reliability_curve(panel: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(F.col("p") * bins).cast("int")))
    return panel.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg("y")).alias("rate"), F.avg("p").alias("__p"), F.avg("y").alias("__y"))


def ece(panel: DataFrame) -> DataFrame:
    curve = reliability_curve(panel)
    return curve.agg(r6(F.sum(F.col("n") * F.abs(F.col("__p") - F.col("__y"))) / F.sum("n")).alias("ece"), F.count("*").alias("bins"))


def auc(panel: DataFrame) -> DataFrame:
    """Area under the ROC curve by ranks, ties averaged; null with one class. Equal scores are counted first, so
    the running sum goes over distinct scores; scores are cut into ranges by their leading digits, whose totals
    are added up over at most 1,001 rows, so no task orders the whole table."""
    at = panel.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("range", F.floor(F.col("p") * 1000))
    totals = at.groupBy("range").agg(F.sum("n").alias("m"))
    before = totals.select("range", (F.sum("m").over(Window.orderBy("range")) - F.col("m")).alias("before"))
    w = Window.partitionBy("range").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = at.join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), F.sum("n").alias("n"))
    n0 = F.col("n") - F.col("n1")
    return sums.select(r6(safe_div(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * n0)).alias("auc"), F.col("n").alias("n_rows"))


def metrics_by_group(panel: DataFrame, key: str, least: int = 50) -> DataFrame:
    out = panel.groupBy(key).agg(F.count("*").alias("n"), r6(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double"))).alias("accuracy"), r6(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"))
    return out.where(F.col("n") >= least)


def psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, least_ref: int = 50, least_cur: int = 20) -> DataFrame:
    """Population stability of each column between two frames: edges are the reference's quantiles, values outside
    them don't count, shares are at least 1e-4. Columns are unpivoted, so all go through one pass; null if a
    frame has too few values, 0 with fewer than two bins."""
    long = lambda df, side: df.select(F.lit(side).alias("side"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select("side", "f.*").where("x is not null and not isnan(x)")
    ref, cur = long(reference, "ref"), long(current, "cur")
    rows = written(ref.unionByName(cur), "unpivoted")
    edges = exact_quantiles(rows.where("side = 'ref'"), ["feature"], "x", [i / bins for i in range(bins + 1)])
    edges = written(edges.select("feature", F.col("n").alias("n_ref"), F.array_distinct("q").alias("e")), "edges")
    rows = rows.join(F.broadcast(edges), "feature")
    inner = F.size("e") - 1
    place = F.size(F.filter("e", lambda x: x <= F.col("x"))) - 1
    b = F.when(F.col("x") == F.element_at("e", -1), inner - 1).when((place >= 0) & (place < inner), place)
    counts = rows.withColumn("bin", b).groupBy("feature", "bin").agg(F.count_if(F.col("side") == "ref").alias("r"), F.count_if(F.col("side") == "cur").alias("c"))
    totals = rows.groupBy("feature").agg(F.count_if(F.col("side") == "cur").alias("n_cur"), F.max("n_ref").alias("n_ref"), F.max("e").alias("e"), F.count_if((F.col("side") == "ref") & b.isNotNull()).alias("nr"), F.count_if((F.col("side") == "cur") & b.isNotNull()).alias("nc"))
    all_bins = totals.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.size("e") - 2, F.lit(0)))).alias("bin"))
    joined = all_bins.join(counts, ["feature", "bin"], "left").fillna(0, ["r", "c"])
    share = lambda n, total: F.greatest(F.col(n) / F.greatest(F.col(total), F.lit(1)), F.lit(1e-4))
    r, c = share("r", "nr"), share("c", "nc")
    value = joined.groupBy("feature").agg(F.sum((c - r) * F.ln(c / r)).alias("v"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max(F.size("e")).alias("edges"))
    v = F.when((F.col("n_ref") < least_ref) | (F.col("n_cur") < least_cur), None).when(F.col("edges") < 3, 0.0).otherwise(F.col("v"))
    return value.select("feature", r6(v).alias("psi"), F.when(v < 0.1, "LOW").when(v < 0.25, "MODERATE").when(v.isNotNull(), "HIGH").alias("level"))


def performance_drift(panel: DataFrame, sessions: int = 120) -> DataFrame:
    """Brier and accuracy of the last sessions against those before. Which dates are recent is found over the
    dates, not the rows."""
    dates = panel.select("date").distinct().orderBy(F.desc("date")).limit(sessions).agg(F.min("date").alias("cut"))
    rows = panel.crossJoin(F.broadcast(dates))  # one row
    recent, loss = F.col("date") >= F.col("cut"), F.pow(F.col("p") - F.col("y"), 2)
    hit = ((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double")
    mean = lambda x, side: F.avg(F.when(recent if side else ~recent, x))
    out = rows.agg(mean(loss, True).alias("rb"), mean(loss, False).alias("bb"), mean(hit, True).alias("ra"), mean(hit, False).alias("ba"), F.count_if(recent).alias("n_recent"))
    return out.select(r6(F.col("rb")).alias("recent_brier"), r6(F.col("bb")).alias("baseline_brier"), r6(F.col("rb") - F.col("bb")).alias("brier_degradation"), r6(F.col("ra")).alias("recent_accuracy"), r6(F.col("ba")).alias("baseline_accuracy"), r6(F.col("ba") - F.col("ra")).alias("accuracy_degradation"), "n_recent")


HEALTH = ("HEALTHY", "WATCH", "DEGRADED", "UNRELIABLE")


def health_state(performance: DataFrame, drift: DataFrame, stability: DataFrame | None = None) -> DataFrame:
    """The worst of what drift, performance and stability say, with reasons. One row each."""
    counts = drift.agg(F.count_if(F.col("level") == "HIGH").alias("high"), F.count_if(F.col("level") == "MODERATE").alias("moderate"))
    row = performance.crossJoin(counts)
    row = row.crossJoin(stability) if stability is not None else row.withColumn("stability_score", F.lit(None).cast("double"))
    high, worse, c = F.col("high"), F.col("brier_degradation") > 0.005, F.col
    rules = [
        ((high >= 3) & worse, 2, "drift and decay"),
        ((high >= 3) & ~F.coalesce(worse, F.lit(False)), 1, "drift without decay"),
        ((high > 0) & (high < 3), 1, "some drift"),
        ((high == 0) & (c("moderate") >= 5), 1, "much moderate drift"),
        (c("brier_degradation") > 0.02, 2, "brier degraded"),
        ((c("brier_degradation") > 0.008) & (c("brier_degradation") <= 0.02), 1, "brier slipping"),
        (c("recent_accuracy") < 0.45, 3, "recent accuracy low"),
        (c("stability_score") < 0.35, 1, "forecasts unstable"),
    ]
    rank = F.greatest(F.lit(0), *(F.when(F.coalesce(rule, F.lit(False)), level).otherwise(0) for rule, level, _ in rules))
    reasons = tags(*((rule, text) for rule, _, text in rules))
    return row.select(F.element_at(F.array(*map(F.lit, HEALTH)), rank + 1).alias("state"), F.array_join(F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("nothing found"))), "; ").alias("reasons"), "high", "moderate")


def conformal(panel: DataFrame, alpha: float = 0.2, least: int = 50, history: int = 500, ranges: int = 256) -> DataFrame:
    """Per date the exact (1 - alpha) quantile of past scores |return| / expected move, all of dates before it, and
    how often the band held from ``history`` scores on. Scores are cut into ``ranges`` of about equal size; counts by
    date and range tell in which of them the two values around the quantile lie, and only those are ranked."""
    rows = panel.where("day_move > 0").select("date", (F.abs("fwd_ret") / F.col("day_move")).alias("score"))
    edges = rows.agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("edges"))  # one row
    placed = rows.crossJoin(F.broadcast(edges)).withColumn("slot", F.when(F.col("score").isNotNull(), F.size(F.filter("edges", lambda e: e <= F.col("score"))))).drop("edges")
    cells = placed.groupBy("date", "slot").agg(F.count("score").alias("n"))
    grid = cells.select("date").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    before = Window.partitionBy("slot").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    past = grid.join(cells, ["date", "slot"], "left").withColumn("n", F.coalesce(F.sum("n").over(before), F.lit(0)))
    upto = Window.partitionBy("date").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    past = past.withColumns({"n_past": F.sum("n").over(Window.partitionBy("date")), "upto": F.sum("n").over(upto)}).where(F.col("n_past") >= least)
    at = (F.col("n_past") - 1) * F.lit(1 - alpha)
    sides = F.explode(F.array(*(F.struct(f(at).cast("long").alias("k"), (at - F.floor(at)).alias("part")) for f in (F.floor, F.ceil))))
    sides = past.select("date", "slot", "n_past", "n", "upto", sides.alias("side")).where("side.k < upto and side.k >= upto - n")
    asked = sides.groupBy(F.col("date").alias("day"), "slot", "n_past").agg(F.collect_set(F.col("side.k") - F.col("upto") + F.col("n")).alias("ks"), F.max("side.part").alias("part"))
    ranked = asked.join(placed, "slot").where("date < day").withColumn("k", F.row_number().over(Window.partitionBy("day", "slot").orderBy("score")) - 1)
    ends = ranked.where(F.array_contains("ks", F.col("k").cast("long"))).groupBy("day").agg(F.max("n_past").alias("n_past"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.max("part").alias("part"))
    q = ends.select(F.col("day").alias("date"), "n_past", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))
    out = rows.join(q, "date").groupBy("date", "n_past", "q").agg(F.count("*").alias("n"), F.count_if(F.col("score") <= F.col("q")).alias("inside"))
    return out.select("date", "n_past", r6(F.col("q")).alias("q"), "n", F.when(F.col("n_past") >= history, F.col("inside")).alias("inside"))


def stability(panel: DataFrame, n: int = 10) -> DataFrame:
    """Of each symbol's last n forecasts: flips of direction, deviation of steps, score and label."""
    last = panel.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("k") <= n)
    steps = last.withColumns({"step": F.col("p") - F.lag("p", 1).over(W()), "flip": (F.col("p") >= 0.5) != (F.lag("p", 1).over(W()) >= 0.5)})
    out = steps.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if("flip").alias("flips"), F.stddev_pop("step").alias("sd"))
    score = clip(1 - F.col("flips") / F.greatest(F.col("n") - 1, F.lit(1)) - F.least(F.col("sd") / 0.08, F.lit(1.0)) * 0.5, 0, 1)
    label = F.when(F.col("n") < 3, "UNKNOWN").when(score > 0.66, "STABLE").when(score > 0.4, "DRIFTING").otherwise("UNSTABLE")
    return out.select("symbol", "flips", r6(F.col("sd")).alias("step_volatility"), r6(score).alias("stability_score"), label.alias("label"))


def uncertainty(mean: Column, spread: Column, agreement: Column) -> Column:
    sharpness = 1 - F.least(F.abs(mean - 0.5) / 0.15, F.lit(1.0))
    return clip(0.5 * sharpness + 0.3 * F.least(spread / 0.10, F.lit(1.0)) + 0.2 * (1 - agreement), 0, 1)


def quantile_summary(df: DataFrame, key: str, c: str) -> DataFrame:
    """The median, 95th and 99th percentile and the median size of a value by key."""
    plain = exact_quantiles(df, [key], c, [0.5, 0.95, 0.99]).select(key, *(r6(F.col("q")[i]).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))
    size = exact_quantiles(df.select(key, F.abs(c).alias("size")), [key], "size", [0.5]).select(key, r6(F.col("q")[0]).alias("median_abs"))
    return plain.join(size, key)
