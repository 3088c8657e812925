"""Gradient boosting of a walk-forward's folds, all at once, from histograms.

Features are binned once, by quantiles of what was known before the first cut. Folds are nested: a row trains in
every fold whose cut comes after its outcome was known, so each row carries the first such fold and the fold it
tests. A level of the current trees of all folds is one job: sums of gradients by fold, node, feature and bin, from
which the driver picks the splits, a number a fold, node and feature. Sums are of whole numbers (gradients in
fixed point), so they don't depend on how rows are dealt, nor on a lost task's second run.

Folds whose rows fit a task are grown there by the same steps, a task a fold, without a job a level: the trees are
the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.sources.lake import written

#: Units of a gradient, so that sums are whole numbers; exact below 2^53, so up to some 10^9 rows of weight 1.
UNITS = float(1 << 20)
#: Rows times folds up to which each fold is grown in one task, and rounds after which margins are written.
TASK_ROWS, REFRESH = 1 << 22, 16


@dataclass(frozen=True)
class Boosting:
    """Fixed values are those that must be equal for equal results: rounds, depth, rate, shares, penalties."""

    rounds: int = 350
    depth: int = 4
    rate: float = 0.045
    row_share: float = 0.85
    column_share: float = 0.8
    l2: float = 2.0
    least_weight: float = 8.0
    bins: int = 64
    seed: int = 7

    def columns(self, t: int, n: int) -> np.ndarray:
        """The features that round ``t`` may split by."""
        return np.sort(np.random.default_rng([self.seed, t]).permutation(n)[: max(1, int(np.ceil(self.column_share * n)))])

    def drawn(self, key: np.ndarray, t: int) -> np.ndarray:
        """Whether each row (by a hash of it) is used in round ``t``."""
        x = key.astype(np.uint64) ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) < self.row_share * (1 << 53)


@dataclass
class Trees:
    """Perfect trees in heap order: a node's rows go right where their bin of ``feature`` exceeds ``bin``; a node
    without a split sends all left. ``leaf`` has what each leaf adds to the margin."""

    feature: np.ndarray  # (trees, nodes)
    bin: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    base: float

    @staticmethod
    def empty(b: Boosting, base: float) -> Trees:
        n = 2**b.depth
        return Trees(np.zeros((b.rounds, n - 1), np.int64), np.full((b.rounds, n - 1), b.bins + 1), np.zeros((b.rounds, n)), base)

    def node(self, bins: np.ndarray, t: int, level: int) -> np.ndarray:
        """The node of each row at a level of tree ``t``, from 0 in the level."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for k in range(level):
            i = (1 << k) - 1 + at
            at = 2 * at + (bins[rows, self.feature[t, i]] > self.bin[t, i])
        return at

    def add(self, margin: np.ndarray, bins: np.ndarray, first: int, last: int) -> np.ndarray:
        depth = self.leaf.shape[1].bit_length() - 1
        for t in range(first, last):
            margin = margin + self.leaf[t, self.node(bins, t, depth)]
        return margin


def sums_of_level(b: Boosting, trees: Trees, t: int, level: int, margin: np.ndarray, bins: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """(nodes, features, bins, 2): gradients and curvatures of the log loss, in units, of the rows that round t draws."""
    use = b.drawn(key, t)
    margin, bins, y = margin[use], bins[use], y[use]
    p = 1 / (1 + np.exp(-margin))
    g, h = np.rint((p - y) * UNITS), np.rint(p * (1 - p) * UNITS)
    node, width = trees.node(bins, t, level), b.bins + 1
    out = np.empty((1 << level, bins.shape[1], width, 2))
    for f in range(bins.shape[1]):
        at = node * width + bins[:, f]
        for j, v in enumerate((g, h)):
            out[:, f, :, j] = np.bincount(at, v, minlength=width << level).reshape(-1, width)
    return out


def split_level(b: Boosting, trees: Trees, t: int, level: int, sums: np.ndarray) -> None:
    """Enter the best split of each node of a level, or none where no split gains; at the last level the leaves too."""
    left = np.cumsum(sums / UNITS, axis=2)
    whole = left[:, :, -1:, :]
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + b.l2)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 1] < b.least_weight) | (right[..., 1] < b.least_weight)] = -np.inf
    barred = np.setdiff1d(np.arange(sums.shape[1]), b.columns(t, sums.shape[1]))
    gain[:, barred] = -np.inf
    for n in range(1 << level):
        f, k = np.unravel_index(int(np.argmax(gain[n])), gain[n].shape)
        i = (1 << level) - 1 + n
        splits = gain[n, f, k] > 1e-9
        if splits:
            trees.feature[t, i], trees.bin[t, i] = f, k
        if level == b.depth - 1:
            for side, s in enumerate((left[n, f, k], right[n, f, k]) if splits else (whole[n, 0, 0], np.zeros(2))):
                trees.leaf[t, 2 * n + side] = -b.rate * s[0] / (s[1] + b.l2)


def grow(b: Boosting, base: float, level_sums: Callable[[Trees, int, int], np.ndarray]) -> Trees:
    """The trees of one fold, from a function that gives the sums of a level."""
    trees = Trees.empty(b, base)
    for t in range(b.rounds):
        for level in range(b.depth):
            split_level(b, trees, t, level, level_sums(trees, t, level))
    return trees


def binned(rows: DataFrame, known: DataFrame, columns: list[str], bins: int) -> Column:
    """An array of the bins of ``columns``: 0 for null and NaN, else 1 + the edges up to the value, edges being
    quantiles of ``known``, ``bins`` - 1 a feature at most."""
    shares = [i / bins for i in range(1, bins)]
    found = known.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), shares, 100 * bins).alias(c) for c in columns)).first()
    edges = {c: sorted(set(found[c] or [])) for c in columns}

    def place(c: str) -> Column:
        x = F.col(c).cast("double")
        table = F.array(*map(F.lit, edges[c])) if edges[c] else F.array().cast("array<double>")
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + F.size(F.filter(table, lambda e: e <= x)))

    return F.array(*(place(c).cast("int") for c in columns))


def _block(batch: pa.RecordBatch, n_features: int) -> dict[str, np.ndarray]:
    c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    out = {n: c[n].to_numpy(zero_copy_only=False) for n in c if n not in ("x", "margin")}
    out["x"] = c["x"].flatten().to_numpy().reshape(-1, n_features)
    if "margin" in c:
        out["margin"] = c["margin"].flatten().to_numpy().reshape(len(batch), -1)
    return out


def _in_tasks(rows: DataFrame, b: Boosting, n_folds: int, n_features: int, bases: list[float]) -> DataFrame:
    """(row, fold, p): each fold grown in one task from its own rows."""
    own = rows.withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: (k >= F.col("first")) | (k == F.col("test")))))

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        c = _block(table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema), n_features)
        train, test = c["first"] <= k, c["test"] == k
        x, y, key_ = c["x"][train], c["y"][train].astype(float), c["key"][train]
        state = {"t": 0, "margin": np.full(int(train.sum()), bases[k])}

        def level_sums(trees: Trees, t: int, level: int) -> np.ndarray:
            state["margin"] = trees.add(state["margin"], x, state["t"], t)
            state["t"] = t
            return sums_of_level(b, trees, t, level, state["margin"], x, y, key_)

        trees = grow(b, bases[k], level_sums)
        margin = trees.add(np.full(int(test.sum()), bases[k]), c["x"][test], 0, b.rounds)
        return pa.table({"row": c["row"][test], "fold": np.full(len(margin), k, np.int32), "p": 1 / (1 + np.exp(-margin))})

    return own.repartition(n_folds, "fold").groupBy("fold").applyInArrow(fit, "row long, fold int, p double")


def _by_jobs(rows: DataFrame, b: Boosting, n_folds: int, n_features: int, bases: list[float], refresh: int) -> DataFrame:
    """(row, fold, p): a level of all folds is one job over all rows; every few rounds the margins are written."""
    spark = rows.sparkSession
    forest = [Trees.empty(b, base) for base in bases]
    shape = (n_features, b.bins + 1, 2)

    def margins(c: dict, model: list[Trees], start: int, stop: int) -> np.ndarray:
        return np.stack([tree.add(c["margin"][:, k], c["x"], start, stop) for k, tree in enumerate(model)], axis=1)

    state = rows.withColumn("margin", F.array(*map(F.lit, bases)))
    state = written(state, "margins")
    start = 0
    for t in range(b.rounds):
        if t - start >= refresh:
            sent = spark.sparkContext.broadcast((forest, start, t))  # some numbers a node and fold

            def moved(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    m = margins(_block(batch, n_features), *sent.value)
                    column = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * n_folds), pa.array(m.reshape(-1)))
                    yield pa.record_batch([*batch.columns[:-1], column], names=batch.schema.names)

            state, start = written(state.mapInArrow(moved, state.schema), "margins"), t
        for level in range(b.depth):
            sent = spark.sparkContext.broadcast((forest, start, t))

            def sums(batches: Iterator[pa.RecordBatch], sent=sent, t=t, level=level) -> Iterator[pa.RecordBatch]:
                model, start, _ = sent.value
                total = np.zeros((n_folds, 1 << level, *shape))
                for batch in batches:
                    c = _block(batch, n_features)
                    m = margins(c, model, start, t)
                    for k, tree in enumerate(model):
                        use = c["first"] <= k
                        total[k] += sums_of_level(b, tree, t, level, m[use, k], c["x"][use], c["y"][use].astype(float), c["key"][use])
                total = total.reshape(-1, 2).astype(np.int64)
                at = np.flatnonzero(total.any(axis=1))
                yield pa.record_batch([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["at", "g", "h"])

            found = state.mapInArrow(sums, "at long, g long, h long").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            total = np.zeros((n_folds * (1 << level) * shape[0] * shape[1], 2))
            total[found["at"].to_numpy()] = np.stack([found["g"].to_numpy(), found["h"].to_numpy()], axis=1)
            for k, part in enumerate(total.reshape(n_folds, 1 << level, *shape)):
                split_level(b, forest[k], t, level, part)
    sent = spark.sparkContext.broadcast((forest, start, b.rounds))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _block(batch, n_features)
            m, use = margins(c, *sent.value), np.flatnonzero(c["test"] >= 0)
            p = 1 / (1 + np.exp(-m[use, c["test"][use]]))
            yield pa.record_batch([pa.array(c["row"][use]), pa.array(c["test"][use].astype(np.int32)), pa.array(p)], names=["row", "fold", "p"])

    return state.mapInArrow(predict, "row long, fold int, p double")


def fold_places(rows: DataFrame, cuts: list) -> DataFrame:
    """``rows`` (date, known_at) with ``first``, the first fold that trains on a row, and ``test``, the fold it tests (-1
    before the first cut), from 0. Outcomes that aren't known train no fold."""
    table = F.array(*(F.lit(c).cast("date") for c in cuts))
    upto = lambda c: F.size(F.filter(table, lambda x: x <= F.col(c)))
    return rows.withColumns({"first": F.coalesce(F.when(F.col("y").isNotNull(), upto("known_at")), F.lit(len(cuts))).cast("int"), "test": (upto("date") - 1).cast("int")})


def momentum_baseline(placed: DataFrame, cuts: list, column: str) -> DataFrame:
    """(symbol, date, y, p, fold): what each fold expects from the share of rises and the sign and size of one feature
    alone, both from the rows it may know. Sums by first fold are added up over folds, a row each."""
    sums = {r["first"]: r for r in placed.where(F.col("first") < len(cuts)).groupBy("first").agg(F.count("*").alias("n"), F.sum("y").alias("up"), F.count(column).alias("m"), F.sum(column).alias("s"), F.sum(F.pow(column, 2)).alias("q")).collect()}
    stats, total = [], np.zeros(5)
    for k in range(len(cuts)):
        if k in sums:
            total = total + np.array([float(v or 0) for v in sums[k][1:]])
        n, up, m, s, q = total
        spread = float(np.sqrt(max(0.0, q / m - (s / m) ** 2))) if m else 0.0
        stats.append((float(min(0.99, max(0.01, up / n))) if n else 0.5, spread or 1.0))
    base, scale = (F.get(F.array(*(F.lit(v[i]) for v in stats)), F.col("test")) for i in (0, 1))
    p = base + 0.08 * F.tanh(F.coalesce(F.col(column), F.lit(0.0)) / (2 * scale))
    return placed.where("test >= 0").select("symbol", "date", "y", F.least(F.lit(0.99), F.greatest(F.lit(0.01), p)).alias("p"), (F.col("test") + 1).alias("fold"))


def walk_forward_boosting(placed: DataFrame, cuts: list, columns: list[str], b: Boosting = Boosting(), task_rows: int = TASK_ROWS, refresh: int = REFRESH) -> DataFrame:
    """(symbol, date, y, p, fold) of the test rows of ``placed`` (see fold_places). Rows are known by a number of their
    own, written first, so that a second run of a task sees the same."""
    rows = placed.withColumns({"x": binned(placed, placed.where("first = 0"), columns, b.bins), "key": F.xxhash64("symbol", "date"), "row": F.monotonically_increasing_id()})
    rows = written(rows.select("row", "symbol", "date", "y", "x", "key", "first", "test"), "boosting_rows")
    n = rows.count()
    counts = {r["first"]: (r["n"], r["up"]) for r in rows.groupBy("first").agg(F.count("*").alias("n"), F.sum("y").alias("up")).collect()}  # a row a fold
    bases, seen, up = [], 0, 0.0
    for k in range(len(cuts)):
        seen, up = seen + counts.get(k, (0, 0))[0], up + float(counts.get(k, (0, 0.0))[1] or 0.0)
        share = min(0.999, max(0.001, up / seen)) if seen else 0.5
        bases.append(float(np.log(share / (1 - share))))
    slim = rows.select("row", F.coalesce(F.col("y"), F.lit(0.0)).cast("double").alias("y"), "x", "key", "first", "test")
    if n * len(cuts) <= task_rows:
        out = _in_tasks(slim, b, len(cuts), len(columns), bases)
    else:
        out = _by_jobs(slim, b, len(cuts), len(columns), bases, refresh)
    return rows.join(out, "row").select("symbol", "date", "y", "p", (F.col("fold") + 1).alias("fold"))
