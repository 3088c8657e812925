"""Connected components of a graph of any size: tasks contract their edges to stars, and shuffles join the stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.storage import map_arrow, materialize

#: Edges of a task (16 bytes each). The number of tasks follows the number of edges.
TASK_EDGES = 1 << 18


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) that are not the least of their component, and that least node of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while not (label[label] == label).all():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v) with the same components as ``edges`` (u, v), each task's edges contracted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            u, v = contract(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return map_arrow(edges, run, "u long, v long")


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u. Counts combine before they are shuffled."""
    none = F.lit(None).cast("long")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(False).alias("root"))
    ends = ends.union(edges.select("v", none, F.lit(True))).groupBy("node").agg(F.min("up").alias("a"), F.max("up").alias("b"), F.max("root").alias("root"))
    return ends.agg(F.max((F.col("a") != F.col("b")) | (F.col("a").isNotNull() & F.col("root")))).first()[0] is not True


def connected_components(edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component): the least node reachable, for each node of an edge.
    Nulls and loops join nothing; nodes without any other edge are left out. Give a materialized frame, as
    its rows are counted to set the number of tasks.

    Edges that fit one task are done when that task has contracted them. Else a round deals the stars by node, so
    that a node with several centres joins them, and moves each node on to the centre of its centre. A task has
    contracted its edges before they are dealt, so a hub comes with one edge a task; the children of a centre
    are never gathered. Each round is written, so a lost executor costs one round."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    parts = -(-edges.count() // task_edges)
    current = materialize(_stars(edges.coalesce(max(1, parts))), "stars")
    if parts > 1:
        for _ in range(rounds):
            if _settled(current):
                break
            by_node = materialize(_stars(_stars(current).repartition(parts, "u")), "stars")
            up = by_node.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("up"))
            current = materialize(by_node.join(up, F.col("v") == F.col("node"), "left").select("u", F.coalesce("up", "v").alias("v")).distinct(), "stars")
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
