"""Communities and centralities against brute force on small graphs."""

import heapq
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import graph as gr


def planted(groups, size, inside, outside, seed):
    rng = np.random.default_rng(seed)
    n, out = groups * size, []
    for a, b in itertools.combinations(range(n), 2):
        if rng.random() < (inside if a // size == b // size else outside):
            out.append((a + 10, b + 10, float(rng.integers(1, 4))))
    return out


def matrix(edges):
    nodes = sorted({x for e in edges for x in e[:2]})
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((len(nodes),) * 2)
    for a, b, x in edges:
        w[at[a], at[b]] += x
        w[at[b], at[a]] += x
    return nodes, w


def brute_modularity(w, label):
    m, k = w.sum() / 2, w.sum(axis=1)
    return sum((w[i, j] - k[i] * k[j] / (2 * m)) for i in range(len(w)) for j in range(len(w)) if label[i] == label[j]) / (2 * m)


def brute_greedy(w):
    """The best merge of two communities, again and again."""
    label = np.arange(len(w))
    best = brute_modularity(w, label)
    while True:
        tried = []
        for a, b in itertools.combinations(np.unique(label), 2):
            if w[np.ix_(label == a, label == b)].any():
                tried.append((round(brute_modularity(w, np.where(label == b, a, label)), 12), -a, -b))
        if not tried or max(tried)[0] <= best + 1e-12:
            return best
        best, a, b = max(tried)
        label = np.where(label == -b, -a, label)


def run(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight double")


@pytest.mark.parametrize("edges", [planted(4, 6, 0.8, 0.08, 1), planted(3, 7, 0.45, 0.15, 4)])
def test_communities_are_as_good_as_greedy_merging(spark, edges):
    df = run(spark, edges)
    found = gr.communities(df)
    label = {r["node"]: r["community"] for r in found.collect()}
    nodes, w = matrix(edges)
    assert sorted(label) == nodes
    assert all(label[c] == c == min(v for v in nodes if label[v] == c) for c in set(label.values()))
    q = brute_modularity(w, [label[v] for v in nodes])
    assert q >= brute_greedy(w) - 1e-9
    assert gr.modularity(gr.canonical(df), found) == pytest.approx(q, abs=1e-9)


def test_rounds_of_best_pairs_find_the_groups(spark):
    edges = planted(3, 5, 0.9, 0.03, 9)
    label = {r["node"]: r["community"] for r in gr.communities(run(spark, edges), task_links=0).collect()}
    nodes, w = matrix(edges)
    assert brute_modularity(w, [label[v] for v in nodes]) >= brute_modularity(w, [(v - 10) // 5 for v in nodes]) - 0.02


def test_a_hub_does_not_cost_a_round_a_neighbour(spark, monkeypatch):
    rounds, real = [], gr.written
    monkeypatch.setattr(gr, "written", lambda df, name: (rounds.append(name), real(df, name))[1])
    label = gr.communities(run(spark, [(1, i, 1.0) for i in range(2, 62)]), task_links=0).collect()
    assert len(label) == 61 and {r["community"] for r in label} == {1}
    assert rounds.count("merges") <= 12 and len(rounds) <= 60


def test_many_copies_of_a_graph_take_few_rounds(spark, monkeypatch):
    rounds, real = [], gr.written
    monkeypatch.setattr(gr, "written", lambda df, name: (rounds.append(name), real(df, name))[1])
    one = planted(1, 12, 0.5, 0.0, 5)
    edges = [(a + 1000 * i, b + 1000 * i, 1.0) for i in range(60) for a, b, _ in one]
    label = {r["node"]: r["community"] for r in gr.communities(run(spark, edges), task_links=60).collect()}
    nodes, w = matrix(edges)
    assert brute_modularity(w, [label[v] for v in nodes]) >= brute_modularity(w, [v // 1000 for v in nodes]) - 1e-9
    assert rounds.count("merges") <= 7 and len(rounds) <= 30


def test_tables_too_large_to_send_give_the_same_communities(spark, monkeypatch):
    edges = run(spark, planted(5, 12, 0.6, 0.03, 8))
    sent = sorted(map(tuple, gr.communities(edges, task_links=40).collect()))
    monkeypatch.setattr(gr, "SENT_ROWS", 0)
    assert sorted(map(tuple, gr.communities(edges, task_links=40).collect())) == sent


def brute_betweenness(nodes, length):
    n, total = len(nodes), np.zeros(len(nodes))
    for s in range(n):
        d, paths, done, heap, order = np.full(n, math.inf), np.zeros(n), set(), [(0.0, s)], []
        d[s], paths[s] = 0, 1
        before = [[] for _ in range(n)]
        while heap:
            x, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u in range(n):
                if length[v, u] > 0:
                    new = x + length[v, u]
                    if new < d[u] - 1e-9:
                        d[u], paths[u], before[u] = new, paths[v], [v]
                        heapq.heappush(heap, (new, u))
                    elif abs(new - d[u]) <= 1e-9 and u not in done:
                        paths[u] += paths[v]
                        before[u].append(v)
        share = np.zeros(n)
        for v in reversed(order):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            if v != s:
                total[v] += share[v]
    return dict(zip(nodes, total / ((n - 1) * (n - 2))))


def test_betweenness_equals_brute_force_in_batches(spark):
    edges = [*planted(2, 6, 0.5, 0.1, 3), (500, 501, 1.0), (501, 502, 1.0), (502, 503, 1.0), (503, 500, 1.0), (10, 11, 2.0)]
    nodes, w = matrix(edges)
    got = {r["node"]: r["betweenness"] for r in gr.betweenness(run(spark, edges), batch_rows=130).collect()}
    assert got == pytest.approx(brute_betweenness(nodes, w), abs=1e-9)


def test_eigenvector_of_each_component(spark):
    edges = [*planted(2, 6, 0.7, 0.2, 6), *((600 + i, 610 + j, 1.0) for i in range(3) for j in range(2))]  # the second is bipartite
    nodes, w = matrix(edges)
    parts = spark.createDataFrame([(v, int(v >= 600)) for v in [*nodes, 999]], "node long, component long")
    got = {r["node"]: r["eigen"] for r in gr.eigenvector(run(spark, edges), parts).collect()}
    assert got.pop(999) == 0.0
    for own in ([v < 600 for v in nodes], [v >= 600 for v in nodes]):
        at = np.flatnonzero(own)
        value, vectors = np.linalg.eigh(w[np.ix_(at, at)])
        assert [got[nodes[i]] for i in at] == pytest.approx(np.abs(vectors[:, -1]).tolist(), abs=1e-4)


def test_odd_graphs(spark):
    none = run(spark, [])
    assert gr.communities(none).collect() == []
    assert gr.betweenness(none).collect() == []
    one = run(spark, [(1, 2, 1.0), (2, 1, 1.0), (3, 3, 5.0), (4, 5, 0.0), (None, 1, 1.0)])
    assert sorted(map(tuple, gr.communities(one).collect())) == [(1, 1), (2, 1)]
    assert sorted(map(tuple, gr.betweenness(one).collect())) == [(1, 0.0), (2, 0.0)]


def test_purity(spark):
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (9, 9)], "node long, community long")
    groups = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "node long, group string")
    assert sorted(map(tuple, gr.community_summary(found, groups).collect())) == [(1, 3, "b", 0.666667), (9, 1, None, 1.0)]
