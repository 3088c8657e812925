"""Ranks and quantiles over growing and sliding frames, without an array of the frame in each row.

A key's rows are numbered and cut into blocks. Sliding frames look into the block before, so its last rows come
along. Growing frames are counted in three parts: the own block; earlier blocks in lower ranges of values, from
counts by block and range that are added up; and earlier blocks in the same range. Each part is a group of bounded
size, so a key's rows never meet in one task, and a task holds a few numbers a row."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gristmill.sources.lake import written

#: Rows of a block, and ranges of values of a key at most.
BLOCK, RANGES = 4096, 256
COUNTS = ("seen", "below", "same")


def _with_counts(schema: StructType) -> StructType:
    return StructType([*schema.fields, *(StructField(c, LongType()) for c in COUNTS)])


def _added(table: pa.Table, counts: tuple[np.ndarray, ...], names: list[str]) -> pa.Table:
    return pa.table([*(table[n] for n in names), *(pa.array(c, pa.int64()) for c in counts)], names=[*names, *COUNTS])


def rolling_counts(df: DataFrame, keys: list[str], order: str, value: str, n: int, block: int = BLOCK) -> DataFrame:
    """``df`` with, over a key's last ``n`` rows by ``order``, how many have a value (``seen``), a lower one (``below``)
    and the same one (``same``, its own included). Rows without a value get 0 lower and same ones."""
    block, names = max(block, n), df.columns
    own = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(own) - 1).withColumn("__b", F.floor(F.col("__i") / block))
    also = F.when(F.col("__i") % block > block - n, F.col("__b") + 1)
    rows = rows.withColumn("__g", F.explode(F.array_compact(F.array("__b", also))))

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        mine = np.flatnonzero(table["__b"].to_numpy() == table["__g"].to_numpy())
        v = table[value].to_numpy().astype(float)  # null becomes NaN, which compares with nothing
        padded = np.r_[np.full(n - 1, np.nan), v]
        frames = np.lib.stride_tricks.sliding_window_view(padded, n)
        out = tuple(np.empty(len(v), np.int64) for _ in COUNTS)
        for a in range(0, len(v), 1024):
            w, x = frames[a : a + 1024], v[a : a + 1024, None]
            for c, hit in zip(out, (~np.isnan(w), w < x, w == x), strict=True):
                c[a : a + 1024] = hit.sum(axis=1)
        return _added(table.take(mine), tuple(c[mine] for c in out), names)

    return rows.groupBy(*keys, "__g").applyInArrow(count, _with_counts(df.schema))


def _in_block(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and equal values among those up to each."""
    below, same = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for a in range(0, len(v), 1024):
        w, x = v[None, : a + 1024], v[a : a + 1024, None]
        upto = np.arange(w.shape[1])[None] <= np.arange(a, a + len(x))[:, None]
        below[a : a + 1024], same[a : a + 1024] = ((w < x) & upto).sum(axis=1), ((w == x) & upto).sum(axis=1)
    return below, same


def expanding_counts(df: DataFrame, keys: list[str], order: str, value: str, block: int = BLOCK, ranges: int = RANGES) -> DataFrame:
    """``df`` with, over a key's rows up to its own by ``order``, how many have a value (``seen``), a lower one
    (``below``) and the same one (``same``, its own included)."""
    own = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(own) - 1).withColumn("__b", F.floor(F.col("__i") / block))
    most = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    names = df.columns

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        v = table[value].to_numpy().astype(float)
        return _added(table, (np.cumsum(~np.isnan(v)), *_in_block(v)), names)

    if most <= block:
        return rows.groupBy(*keys, "__b").applyInArrow(whole, _with_counts(df.schema))

    slots = int(min(ranges, -(-most // block)))
    edges = df.groupBy(*keys).agg(F.percentile_approx(F.col(value).cast("double"), [i / slots for i in range(1, slots)], 100 * slots).alias("__edges"))
    slim = rows.join(edges, keys).select(*keys, "__i", "__b", F.col(value).cast("double").alias("__v"), F.size(F.filter("__edges", lambda e: e <= F.col(value).cast("double"))).alias("__s"))
    slim = slim.where("__v is not null and not isnan(__v)")
    out = StructType([*(df.schema[k] for k in keys), *(StructField(c, LongType()) for c in ("__i", "below", "same"))])

    def part(table: pa.Table, below: np.ndarray, same: np.ndarray) -> pa.Table:
        return pa.table([*(table[k] for k in keys), table["__i"].cast(pa.int64()), pa.array(below), pa.array(same)], names=[*keys, "__i", "below", "same"])

    def in_block(table: pa.Table) -> pa.Table:
        table = table.sort_by("__i")
        return part(table, *_in_block(table["__v"].to_numpy()))

    def in_range(table: pa.Table) -> pa.Table:
        """Values of earlier blocks in the same range: each block looks into the sorted values before it."""
        table = table.sort_by("__i")
        v, b = table["__v"].to_numpy(), table["__b"].to_numpy()
        below, same, past = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.empty(0)
        cuts = np.r_[np.flatnonzero(np.r_[True, b[1:] != b[:-1]]), len(v)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            below[s:e] = np.searchsorted(past, v[s:e], side="left")
            same[s:e] = np.searchsorted(past, v[s:e], side="right") - below[s:e]
            new = np.sort(v[s:e])
            past = np.insert(past, np.searchsorted(past, new), new)
        return part(table, below, same)

    cells = slim.groupBy(*keys, "__b", "__s").agg(F.count("*").alias("n"))
    grid = cells.select(*keys, "__b").distinct().withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    grid = grid.join(cells, [*keys, "__b", "__s"], "left")
    before = Window.partitionBy(*keys, "__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "__b").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("past", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("below", F.coalesce(F.sum("past").over(lower), F.lit(0)))
    by_grid = slim.join(grid.select(*keys, "__b", "__s", "below"), [*keys, "__b", "__s"]).select(*keys, F.col("__i").cast("long").alias("__i"), "below", F.lit(0).cast("long").alias("same"))
    parts = slim.groupBy(*keys, "__b").applyInArrow(in_block, out).union(slim.groupBy(*keys, "__s").applyInArrow(in_range, out)).union(by_grid)
    sums = parts.groupBy(*keys, "__i").agg(F.sum("below").alias("below"), F.sum("same").alias("same"))
    usable = F.col(value).cast("double")
    seen = F.count(F.when(~F.isnan(usable), usable)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("seen", seen).join(sums, [*keys, "__i"], "left")
    return joined.select(*names, "seen", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("below", "same")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], slots: int = RANGES) -> DataFrame:
    """(keys, n, q): for each key the number of its values and their exact quantiles, linear between ranks, in the order
    of ``shares``. Null and NaN count for nothing; a key without values is left out.

    A sketch of each key cuts its values into ranges; counts by range tell which of them hold the ranks asked for, of
    all quantiles at once; only values in those are ordered, equal ones as one row, a range at a time. So no task
    holds a key's values: about ``slots`` times fewer at most. Counts and not the sketch decide, so it is exact."""
    v = F.col(value).cast("double")
    rows = written(df.select(*keys, v.alias("v")).where(v.isNotNull() & ~F.isnan(v)), "values")
    edges = rows.groupBy(*keys).agg(F.percentile_approx("v", [i / slots for i in range(1, slots)], 10 * slots).alias("edges"))
    if keys:
        placed = rows.join(edges, [*keys])
    else:
        placed = rows.crossJoin(F.broadcast(edges))  # one row
    placed = placed.select(*keys, "v", F.size(F.filter("edges", lambda e: e <= F.col("v"))).alias("slot"))
    cells = placed.groupBy(*keys, "slot").agg(F.count("*").alias("m"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))  # a row a range
    cells = cells.withColumns({"n": F.sum("m").over(whole), "upto": F.sum("m").over(whole.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))})
    asked = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares))))
    at = F.col("a.q") * (F.col("n") - 1)
    side = F.explode(F.array(*(F.struct(f(at).cast("long").alias("k"), F.lit(j).alias("side")) for j, f in enumerate((F.floor, F.ceil)))))
    targets = cells.withColumn("a", asked).withColumn("t", side).where("t.k < upto and t.k >= upto - m")
    targets = targets.select(*keys, "slot", "n", (F.col("upto") - F.col("m")).alias("before"), F.col("a.i").alias("i"), at.alias("at"), "t.k", "t.side")
    wanted = targets.select(*keys, "slot", "before").distinct()
    held = placed.join(wanted, [*keys, "slot"]).groupBy(*keys, "slot", "before", "v").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "slot").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = held.withColumn("upto", upto).drop("before").join(targets, [*keys, "slot"]).where("k < upto and k >= upto - c")
    ends = ranked.groupBy(*keys, "n", "i", "at").agg(F.max(F.when(F.col("side") == 0, F.col("v"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("hi"))
    low = F.floor("at")
    value_at = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((low + 1 - F.col("at")) * F.col("lo") + (F.col("at") - low) * F.col("hi"))
    out = ends.select(*keys, "n", F.struct("i", value_at.alias("q")).alias("e")).groupBy(*keys, "n").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return out.select(*keys, "n", F.col("e.q").alias("q"))


def expanding_quantile(series: DataFrame, order: str, value: str, q: float, to: str) -> DataFrame:
    """``series``, one market's rows a day, with the exact quantile ``q`` (linear between ranks) of the values so far: two
    heaps hold those below and above it, so a row costs the logarithm of the rows before it."""
    schema = StructType([*series.schema.fields]).add(to, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [], []  # low has the k + 1 least values, negated, k being the rank below the quantile
        for batch in batches:
            out = []
            for v in batch.column(batch.schema.names.index(value)).to_pylist():
                if v is not None and v == v:
                    heapq.heappush(high, -heapq.heappushpop(low, -v))
                    n = len(low) + len(high)
                    while len(low) < int(q * (n - 1)) + 1:
                        heapq.heappush(low, -heapq.heappop(high))
                n = len(low) + len(high)
                part = q * (n - 1) - int(q * (n - 1)) if n else 0.0
                out.append(None if not n else -low[0] + ((high[0] + low[0]) * part if part and high else 0.0))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, to])

    return series.coalesce(1).sortWithinPartitions(order).mapInArrow(run, schema)
