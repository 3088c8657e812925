"""The market's state, patterns, similar states, evidence, and the correlation graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gristmill.functions.expr import r6, rolling, safe_div
from gristmill.operators.order_statistics import expanding_quantile
from gristmill.sources.lake import written


def _days() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy("date")


def market_state(features: DataFrame) -> DataFrame:
    """By date: benchmark trend and volatility, breadth and dispersion with their 20-day means, drawdown."""
    daily = features.groupBy("date").agg(
        *(F.any_value(c).alias(c) for c in ("bench_ret_1", "bench_trend_20", "bench_vol_20", "bench_vol_60")), F.avg(F.coalesce(F.col("ret_1") > 0, F.lit(False)).cast("double")).alias("market_breadth"), F.stddev_samp("ret_1").alias("dispersion")
    )
    w = _days()
    growth = F.sum(F.log1p(F.coalesce(F.tanh("bench_ret_1") / 50, F.lit(0.0)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = daily.withColumns({"market_breadth_20": rolling(F.avg, "market_breadth", 20, w), "dispersion_20": rolling(F.avg, "dispersion", 20, w), "g": growth})
    return out.withColumn("drawdown", F.exp(F.col("g") - F.max("g").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1).drop("g")


def regime_changes(regimes: DataFrame) -> DataFrame:
    return regimes.withColumn("changed", ~F.col("regime").eqNullSafe(F.lag("regime", 1).over(_days())))


def detectors() -> dict[str, Column]:
    """Conditions on the market's state, with ``dispersion_p95`` so far."""
    c, w = F.col, _days()
    p95 = F.when(F.count("dispersion_20").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 250, F.col("dispersion_p95"))
    back = F.lag("drawdown", 10).over(w)
    return {
        "VOLATILITY_EXPANSION": safe_div(c("bench_vol_20"), c("bench_vol_60")) > 1.4,
        "BROAD_SELLOFF": (c("bench_ret_1") < -0.008) & (c("market_breadth") < 0.25),
        "MOMENTUM_ACCELERATION": (c("bench_trend_20") > 0.03) & (c("market_breadth_20") > 0.55) & (c("bench_vol_20") < c("bench_vol_60")),
        "RECOVERY": (back < -0.05) & (c("drawdown") - back > 0.03),
        "DISPERSION_SHOCK": c("dispersion_20") > p95,
        "BREADTH_DIVERGENCE": (c("bench_trend_20") > 0.01) & (c("market_breadth_20") < 0.45),
    }


def pattern_days(state: DataFrame, horizon: int = 5) -> DataFrame:
    """Each day with the benchmark's return over the next days and a flag for each pattern."""
    after = _days().rowsBetween(1, horizon)
    step = F.log1p(F.tanh("bench_ret_1") / 50)
    state = expanding_quantile(state, "date", "dispersion_20", 0.95, "dispersion_p95")
    flagged = state.withColumn("forward", F.when(F.count(step).over(after) == horizon, F.exp(F.sum(step).over(after)) - 1))
    return flagged.withColumns({n: F.coalesce(d, F.lit(False)) for n, d in detectors().items()})


def pattern_library(state: DataFrame, horizon: int = 5) -> DataFrame:
    names = list(detectors())
    days = pattern_days(state, horizon)
    rows = days.select("date", "forward", F.explode(F.array(*(F.struct(F.lit(n).alias("pattern"), F.col(n).alias("on")) for n in names))).alias("x")).select("date", "forward", "x.*")
    on, fwd = F.col("on"), F.when(F.col("on"), F.col("forward"))
    return rows.groupBy("pattern").agg(
        F.count_if(on).alias("occurrences"), r6(100 * F.avg(on.cast("double"))).alias("frequency_pct"), F.min(F.when(on, F.col("date"))).alias("first_seen"), F.max(F.when(on, F.col("date"))).alias("last_seen"), r6(100 * F.avg(fwd)).alias("forward_mean_pct"), r6(100 * F.median(fwd)).alias("forward_median_pct"),
        r6(100 * F.avg(F.when(fwd.isNotNull(), (fwd > 0).cast("double")))).alias("up_rate_pct"), r6(100 * F.avg(F.when(F.col("forward").isNotNull(), (F.col("forward") > 0).cast("double")))).alias("baseline_up_rate_pct"), (F.count(fwd) < 30).alias("small_sample"), F.max_by("on", "date").alias("active"),
    )


def _boxes(rows: DataFrame, columns: list[str], n: int, size: int) -> DataFrame:
    """``rows`` with ``box``: about ``size`` rows that lie together, by cutting each column in turn into equal parts."""
    parts = max(1, round((n / size) ** (1 / len(columns))))
    out = rows.withColumn("box", F.lit(0))
    for c in columns:
        out = out.withColumn("box", F.col("box") * parts + F.ntile(parts).over(Window.partitionBy("box").orderBy(c, "date")) - 1)
    return out


def state_pairs(state: DataFrame, columns: list[str], k: int, apart: int, least: int, days: DataFrame | None, size: int = 48, first: int = 3) -> DataFrame:
    """(date, match, distance) of all pairs that ``similar_states`` compares: the k nearest of each day are among them.

    States are put in boxes. A day's least distance to a box is that to its edges; boxes of which all days are too late
    are left out. The day is compared with its ``first`` nearest boxes, and then with those whose least distance is no
    more than the k-th that was found. The boxes' edges go to each day as one array, an entry for ``size`` days."""
    w = _days()
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = state.na.drop(subset=columns).withColumn("i", F.row_number().over(w))
    rows = rows.withColumns({f"{n}_{c}": f(c).over(seen) for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))})
    rows = written(rows.select("date", "i", *columns, *(f"s_{c}" for c in columns)), "states")
    asks = rows.withColumn("last", F.lead("date", 1).over(w)).where("last is null or month(last) <> month(date)") if days is None else rows.join(days.select("date").distinct(), "date", "left_semi")
    asks = asks.where(F.col("i") > least + apart)
    boxed = written(_boxes(rows.select("date", "i", *columns), columns, rows.count(), size), "boxes")
    edges = boxed.groupBy("box").agg(F.min("i").alias("from"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    edges = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("boxes"))  # one row

    def gap(b: Column, c: str) -> Column:
        outside = F.greatest(b[f"lo_{c}"] - F.col(c), F.col(c) - b[f"hi_{c}"], F.lit(0.0))
        return F.pow(F.coalesce(safe_div(outside, F.col(f"s_{c}")), F.lit(0.0)), 2)

    near = F.transform(F.filter("boxes", lambda b: b["from"] <= F.col("i") - apart), lambda b: F.struct(F.sqrt(sum(gap(b, c) for c in columns)).alias("bound"), b["box"].alias("box")))
    asks = written(asks.crossJoin(F.broadcast(edges)).withColumn("near", F.sort_array(near)).drop("boxes"), "asks")  # one row

    def compared(part: DataFrame) -> DataFrame:
        """``part`` (the asking days with a box) against all earlier states in the box."""
        b = boxed.select("box", F.col("date").alias("match"), F.col("i").alias("j"), *(F.col(c).alias(f"b_{c}") for c in columns))
        terms = [F.pow(safe_div(F.col(c) - F.col(f"b_{c}"), F.col(f"s_{c}")), 2) for c in columns]
        return part.join(b, "box").where(F.col("j") <= F.col("i") - apart).select("date", "match", F.sqrt(sum(terms)).alias("distance"))

    begun = written(compared(asks.withColumn("box", F.explode(F.slice("near", 1, first)["box"]))), "compared")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.asc_nulls_last("distance")))
    kth = begun.withColumn("place", place).where(F.col("place") == k).select("date", F.col("distance").alias("kth"))
    rest = F.filter(F.slice("near", first + 1, 1 << 30), lambda x: F.col("kth").isNull() | (x["bound"] <= F.col("kth") * (1 + 1e-9)))
    more = compared(asks.join(kth, "date", "left").withColumn("box", F.explode(F.transform(rest, lambda x: x["box"]))))
    return begun.union(more)


def similar_states(state: DataFrame, columns: list[str], k: int = 3, apart: int = 20, least: int = 50, days: DataFrame | None = None) -> DataFrame:
    """For each of ``days`` (column date; each month's last if none are given) the k nearest earlier states by
    distance, at least ``apart`` sessions before and scaled by what was known then; a state's scale comes from its own
    past. Exact, and without all pairs."""
    pairs = state_pairs(state, columns, k, apart, least, days)
    place = F.row_number().over(Window.partitionBy("date").orderBy("distance", "match"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).select("date", "match", "place", r6(F.col("distance")).alias("distance"))


def evidence(panel: DataFrame) -> DataFrame:
    """For and against, by channel and strength, and the conflict between them."""
    c, one = F.col, F.lit(1.0)
    channels = [
        ("VOLUME", c("volume_z"), F.least(F.abs("volume_z") / 4, one), c("volume_z") > 0),
        ("PRICE", c("ret_1"), F.least(F.abs("ret_1") / 0.04, one), c("ret_1") > 0),
        ("BREADTH", c("market_breadth"), F.least(F.abs(c("market_breadth") - 0.5) * 2, one), c("market_breadth") >= 0.5),
        ("CORRELATION", c("corr_bench_60"), F.least(F.abs("corr_bench_60"), one), c("corr_bench_60") > 0.4),
    ]
    ledger = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(n).alias("channel"), s.alias("strength"), f.alias("supports"))) for n, v, s, f in channels)))
    rows = panel.withColumn("ledger", ledger)
    total = lambda side: F.aggregate(F.filter("ledger", lambda e: e["supports"] == side), F.lit(0.0), lambda a, e: a + e["strength"])
    rows = rows.withColumns({"s": total(True), "a": total(False)})
    conflict = F.coalesce(safe_div(F.least("s", "a"), F.col("s") + F.col("a")), F.lit(0.0))
    state = F.when(conflict > 0.38, "CONTRADICTED").when(F.col("s") != F.col("a"), "SUPPORTED").otherwise("UNCERTAIN")
    return rows.select("symbol", "date", F.size("ledger").alias("channels"), r6(F.col("s")).alias("supporting"), r6(F.col("a")).alias("contradicting"), r6(conflict).alias("conflict"), state.alias("state"))


def _correlation(x: Column, y: Column, keep: Column | None = None) -> Column:
    """Pearson correlation from moments, null without variance (corr() raises there)."""
    x, y = (x, y) if keep is None else (F.when(keep, x), F.when(keep, y))
    return safe_div(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def correlation_pairs(series: DataFrame, last: int = 120) -> DataFrame:
    """(a, b, n, corr, recent, before) of series (node, date, x) over the last dates: pairs meet on their dates
    once, and both halves come from the same join."""
    dates = series.select("date").distinct().orderBy(F.desc("date")).limit(last)
    ranked = dates.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))))  # `last` rows
    rows = series.join(F.broadcast(ranked), "date").where("x is not null")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.date") == F.col("b.date")) & (F.col("a.node") < F.col("b.node"))).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.x").alias("x"), F.col("b.x").alias("y"), F.col("a.k").alias("k"))
    x, y, half = F.col("x"), F.col("y"), last // 2
    out = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), _correlation(x, y).alias("corr"), _correlation(x, y, F.col("k") <= half).alias("recent"), _correlation(x, y, F.col("k") > half).alias("before"))
    return out.where(F.col("n") >= max(20, last // 3))


def correlation_edges(pairs: DataFrame, q: float = 0.7) -> DataFrame:
    """Pairs whose absolute correlation is at least the q-quantile of all."""
    cut = pairs.agg(F.percentile(F.abs("corr"), F.lit(q)).alias("cut"))
    return pairs.crossJoin(F.broadcast(cut)).where(F.abs("corr") >= F.col("cut")).select(F.col("a").alias("src"), F.col("b").alias("dst"), r6(F.col("corr")).alias("correlation"))


def correlation_change(pairs: DataFrame, step: float = 0.12, top: int = 6) -> DataFrame:
    delta = F.col("recent") - F.col("before")
    out = pairs.select("a", "b", r6(F.col("recent")).alias("recent"), r6(F.col("before")).alias("before"), r6(delta).alias("delta"), F.when(delta >= step, "SPIKE").when(delta <= -step, "BREAKDOWN").otherwise("STABLE").alias("kind"))
    return out.orderBy(F.desc(F.abs("delta")), "a", "b").limit(top)


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), "correlation").union(edges.select(F.col("dst").alias("node"), "correlation"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), r6(F.sum(F.abs("correlation"))).alias("strength"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) over undirected edges weighted by absolute correlation. A fixed number of rounds, each a join
    and a group-by; every few rounds a checkpoint cuts the lineage."""
    both = edges.select("src", "dst", F.abs("correlation").alias("w")).union(edges.select("dst", "src", F.abs("correlation")))
    links = both.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share").checkpoint()
    ranks = links.select(F.col("src").alias("node")).distinct()
    n = ranks.count()
    ranks = ranks.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        got = links.join(ranks, links["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = got.select(F.col("dst").alias("node"), (F.lit((1 - damping) / max(n, 1)) + damping * F.col("got")).alias("rank"))
        ranks = ranks.checkpoint() if i % 5 == 4 else ranks
    return ranks.select("node", r6(F.col("rank")).alias("rank"))


def density(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """Edges over possible ones, and the share of edges within a group (column ``group`` of nodes by ``node``)."""
    a, b = nodes.select(F.col("node").alias("src"), F.col(group).alias("ga")), nodes.select(F.col("node").alias("dst"), F.col(group).alias("gb"))
    joined = edges.join(a, "src").join(b, "dst")
    n = nodes.agg(F.count("*").alias("nodes"))
    out = joined.agg(F.count("*").alias("edges"), F.avg((F.col("ga") == F.col("gb")).cast("double")).alias("inside")).crossJoin(n)  # one row each
    return out.select("nodes", "edges", r6(safe_div(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))).alias("density"), r6(F.col("inside")).alias("purity"))


def case_documents(clusters: DataFrame, evidence: DataFrame, states: DataFrame) -> DataFrame:
    """A nested document for each cluster of events: its members, what speaks for and against on its day, and the
    days that looked alike."""
    said = evidence.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("symbol", "state", "supporting", "contradicting"))).alias("evidence"), r6(F.avg("conflict")).alias("conflict"))
    alike = states.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("place", "match", "distance"))).alias("alike"))
    out = clusters.join(said, "date", "left").join(alike, "date", "left")
    return out.select(F.concat_ws("-", F.lit("case"), "date", "sector").alias("case_id"), "symbols", "severity", "n_events", "conflict", F.size("evidence").alias("n_evidence"), F.to_json(F.struct("evidence", "alike")).alias("document"))


def _minima(pairs: DataFrame) -> DataFrame:
    """For each ``u``, every neighbour with the least of ``u`` and its neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return pairs.join(least, "u")


#: Edges that a task contracts at once, some 100 bytes each.
CHUNK_EDGES = 1 << 21


def contracted(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of the nodes 0 to n - 1 by the edges (a, b)."""
    label = np.arange(n)
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while not (label[label] == label).all():
            label = label[label]


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of about ``rows``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _stars(edges: DataFrame, rows: int = CHUNK_EDGES) -> DataFrame:
    """(src, dst) with the same components as ``edges``: each node of a task's chunk with the least one that the chunk
    links to it, which may be itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_chunks(batches, rows):
            ends = [c.to_numpy() for c in table.columns]
            nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
            root = nodes[contracted(at[: len(ends[0])], at[len(ends[0]) :], len(nodes))]
            yield pa.record_batch([pa.array(x, table.schema.field(0).type) for x in (nodes, root)], names=["src", "dst"])

    return edges.mapInArrow(run, StructType([StructField(c, edges.schema["src"].dataType) for c in ("src", "dst")]))


def item_links(groups: DataFrame, rows: int = CHUNK_EDGES) -> DataFrame:
    """(src, dst) between different items, with the same components as all pairs of items of a group, from ``groups``
    (group, item: long). A chunk of a task links its items, and tells each of its groups' least item; groups that more
    than one chunk has then link those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_chunks(batches, rows):
            (items, x), (names, y) = (np.unique(table[c].to_numpy(), return_inverse=True) for c in ("item", "group"))
            root = items[contracted(x, y + len(items), len(items) + len(names))]
            own, of_group = root[: len(items)], root[len(items) :]
            linked = own != items
            columns = [pa.array([None] * int(linked.sum()), pa.int64()), pa.array(items[linked]), pa.array(own[linked])], [pa.array(names), pa.array(of_group), pa.array(of_group)]
            for c in columns:
                yield pa.record_batch(c, names=["group", "src", "dst"])

    known = groups.where("group is not null and item is not null").select("group", "item")
    found = known.mapInArrow(run, "group long, src long, dst long").checkpoint()
    told = found.where("group is not null").select("group", "src")
    split = told.groupBy("group").agg(F.min("src").alias("dst"), F.max("src").alias("last")).where("dst <> last").select("group", "dst")
    return found.where("group is null").select("src", "dst").union(told.join(split, "group").where("src <> dst").select("src", "dst").distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, by alternating large and small stars until nothing changes;
    an error if that isn't so after ``rounds``. Tasks contract their own edges first. A checkpoint each round cuts the
    lineage."""
    edges = _stars(edges.select("src", "dst").where("src is not null and dst is not null")).checkpoint()
    current = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct().checkpoint()
    before = None
    for _ in range(rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _minima(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        small = _minima(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", F.col("least").alias("v")))
        current = small.where("u <> v").distinct().checkpoint()
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.join(current, nodes["node"] == current["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
