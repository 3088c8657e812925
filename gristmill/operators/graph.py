"""Communities and centralities of weighted undirected graphs, as joins and group-bys over edges.

Edges are (src, dst, weight). Every round works on all edges, communities or sources at once and is written, so a lost
executor costs a round. Numbers that come to the driver are one row: a modularity, a count, a largest change."""

from __future__ import annotations

import heapq
import itertools
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.sources.lake import written


#: Links between communities that one task joins greedily.
TASK_LINKS = 1 << 16
#: Rows of two numbers that are sent to all tasks; more are shuffled.
SENT_ROWS = 1 << 21


def canonical(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: parallel edges are added up; loops, nulls and weights that aren't positive go."""
    rows = edges.where("src <> dst and weight > 0").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").cast("double").alias("w"))
    return rows.groupBy("a", "b").agg(F.sum("w").alias("w"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "w").union(pairs.select("b", "a", "w"))


def _strengths(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))


def modularity(pairs: DataFrame, assigned: DataFrame) -> float:
    """Of ``assigned`` (node, community) on canonical ``pairs``: the share of weight inside communities less the share
    expected from their strengths."""
    joined = pairs.join(assigned.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(assigned.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = F.explode(F.array(F.struct(F.col("ca").alias("community"), F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0).alias("inside")), F.struct(F.col("cb").alias("community"), F.lit(0.0).alias("inside"))))
    by = joined.select("w", ends.alias("e")).groupBy("e.community").agg(F.sum("w").alias("k"), F.sum("e.inside").alias("inside"))
    r = by.agg(F.sum("inside").alias("inside"), F.sum("k").alias("all"), F.sum(F.pow("k", 2)).alias("squares")).first()
    return 2 * r["inside"] / r["all"] - r["squares"] / r["all"] ** 2 if r["all"] else 0.0


def _greedily(batches: Iterator[pd.DataFrame], m: float) -> Iterator[pd.DataFrame]:
    """(old, new) of joining the best pair of communities again and again, until no pair gains."""
    links, size = defaultdict(dict), {}
    for frame in batches:
        for a, b, w, ka, kb in frame[["a", "b", "w", "ka", "kb"]].itertuples(index=False):
            links[a][b] = links[b][a] = w
            size[a], size[b] = ka, kb
    gain = lambda a, b: links[a][b] / m - size[a] * size[b] / (2 * m * m)
    heap = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b and gain(a, b) > 1e-12]
    heapq.heapify(heap)
    into = {}
    while heap:
        g, a, b = heapq.heappop(heap)
        if b not in links.get(a, ()) or -g != gain(a, b):  # an entry from before one of them grew
            continue
        into[b] = a
        size[a] += size.pop(b)
        for c, w in links.pop(b).items():
            del links[c][b]
            if c != a:
                links[a][c] = links[c][a] = links[a].get(c, 0.0) + w
        for c in links[a]:
            x, y = min(a, c), max(a, c)
            if gain(x, y) > 1e-12:
                heapq.heappush(heap, (-gain(x, y), x, y))
    for old in into:
        new = into[old]
        while new in into:
            new = into[new]
        yield pd.DataFrame({"old": [old], "new": [new]})


def _with(rows: DataFrame, known: DataFrame, on: str, n: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known``, ``n`` rows of two numbers at most: sent to all tasks if they are few, else both are
    shuffled."""
    return rows.join(F.broadcast(known) if n <= SENT_ROWS else known, on, how)


def _between(pairs: DataFrame, assigned: DataFrame, n: int) -> DataFrame:
    """(a, b, w) with a < b between the communities of ``assigned``, of ``n`` nodes."""
    for c in ("a", "b"):
        pairs = _with(pairs, assigned.select(F.col("node").alias(c), F.col("community").alias(f"c{c}")), c, n)
    links = pairs.where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w")
    return written(links.groupBy("a", "b").agg(F.sum("w").alias("w")), "community_links")


def _merged(links: DataFrame, assigned: DataFrame, m: float, task_links: int = TASK_LINKS) -> tuple[DataFrame, bool]:
    """Communities joined while that gains, and whether any were. ``links`` are (a, b, w) between the communities of
    ``assigned``. Once no more than ``task_links`` of them are left, one task joins the best pair again and again.
    Before, a quarter of the communities, another in each round and more of the large ones, are heads; each of the rest
    asks to join one head, by gain times a hash of the pair and round: by gain alone nearly all would ask the same few.
    Those that ask the same head are let in so far as each still gains beside all the others, and by chance beyond that."""
    sizes = written(assigned.groupBy(F.col("community").alias("c")).agg(F.sum("k").alias("k")), "communities")
    changed = False
    for i in itertools.count():
        n = sizes.count()
        k = lambda c: sizes.select(F.col("c").alias(c), F.col("k").alias(f"k{c}"))  # noqa: B023, E731
        few = links.count() <= task_links
        sized = _with(_with(links, k("a"), "a", n), k("b"), "b", n)
        if few:
            moves = sized.coalesce(1).mapInPandas(lambda batches: _greedily(batches, m), "old long, new long")
        else:
            draw = lambda *of, salt=0: F.pmod(F.xxhash64(*of, F.lit(i), F.lit(salt)), F.lit(1 << 20)) / F.lit(float(1 << 20))  # noqa: B023, E731
            gain = F.col("w") / m - F.col("ka") * F.col("kb") / (2 * m * m)
            able = sized.where(gain > 1e-12).withColumn("score", gain * (draw("a", "b") + 2**-20))
            head = lambda c: draw(c, salt=1) < F.greatest(F.lit(0.25), F.least(F.lit(0.75), F.col(f"k{c}") * (n / (8 * m))))  # noqa: B023, E731
            first = head("a")
            asks = able.where(first != head("b")).select(
                *(F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("b", "a", "old"), ("a", "b", "new"), ("kb", "ka", "k"), ("ka", "kb", "k_new"))), "score", "w"
            )
            best = asks.groupBy("old", "k").agg(F.max(F.struct("score", "new", "k_new", "w")).alias("e")).select("old", "k", "e.new", "e.k_new", "e.w")
            best = written(best, "asks")
            full = _with(best, best.groupBy("new").agg(F.sum("k").alias("asked")), "new", n)
            room = 2 * m * F.col("w") > draw("old", salt=2) * F.col("k") * (F.col("k_new") + F.col("asked") - F.col("k"))
            moves = full.where(room).select("old", "new")
        moves = written(moves, "merges")
        count = moves.count()
        if count:
            changed = True
            moved = lambda df, c: _with(df, moves.select(F.col("old").alias(c), F.col("new").alias(f"new_{c}")), c, count, "left").withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")  # noqa: B023, E731
            assigned = written(moved(assigned, "community").select("node", "community", "k"), "assigned")
        if few or not count and able.isEmpty():
            return assigned, changed
        if count:
            sizes = written(moved(sizes, "c").groupBy("c").agg(F.sum("k").alias("k")), "communities")
            relabelled = moved(moved(links, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")
            links = written(relabelled.groupBy("a", "b").agg(F.sum("w").alias("w")), "community_links")


def _offers(links: DataFrame, assigned: DataFrame, m: float, n: int) -> DataFrame:
    """(node, community, k, inside, best, gain): the weight of a node's links inside its community, the neighbouring
    community that gains most by taking it, and how much that is. ``links`` go both ways and are kept by their first node,
    so that they stay where they are."""
    sizes = assigned.groupBy("community").agg(F.sum("k").alias("size"))
    to = _with(links, assigned.select(F.col("node").alias("b"), "community"), "b", n).groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
    own = assigned.select("node", F.col("community").alias("home"), "k")
    rows = to.join(own, "node").join(sizes, "community")
    # what a community offers a node, less what home does without the node, is the gain
    offer = F.struct((F.col("w") / m - F.col("k") * F.col("size") / (2 * m * m)).alias("offer"), (-F.col("community")).alias("c"))
    away = F.col("community") != F.col("home")
    found = rows.groupBy("node", "home", "k").agg(F.max(F.when(away, offer)).alias("move"), F.coalesce(F.max(F.when(~away, F.col("w"))), F.lit(0.0)).alias("inside"))
    home = sizes.select(F.col("community").alias("home"), F.col("size").alias("home_size"))
    gain = F.col("move.offer") - F.col("inside") / m + F.col("k") * (F.col("home_size") - F.col("k")) / (2 * m * m)
    return found.join(home, "home").select("node", F.col("home").alias("community"), "k", "inside", (-F.col("move.c")).alias("best"), gain.alias("gain"))


def _moved(links: DataFrame, assigned: DataFrame, m: float, n: int, rounds: int, least: float) -> tuple[DataFrame, float, bool]:
    """Single nodes moved to the neighbouring community that gains most, the modularity, and whether that came to its
    end before ``rounds``. All moves of a round are made at once, as long as that raises the modularity by ``least``;
    then half of them, picked by a hash. A round that doesn't raise it is taken back, and half as many moves are made."""
    share, before, kept = 1, None, assigned
    for i in range(rounds + 1):
        found = written(_offers(links, assigned, m, n), "offers")
        able = F.col("gain") > 1e-12
        r = found.agg(F.sum("inside").alias("inside"), F.sum(able.cast("long")).alias("able")).first()
        squares = found.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.pow("k", 2))).first()[0]
        q = r["inside"] / (2 * m) - squares / (4 * m * m)
        if before is None or q > before + 1e-10:
            little = before is not None and q < before + least
            kept, before = found, q
            ended = not r["able"] or little and share >= 2
        else:
            little, ended = True, share >= 4
        if ended:
            break
        share *= 1 + little
        moves = able & (F.pmod(F.xxhash64("node", F.lit(i)), F.lit(share)) == 0)
        assigned = kept.select("node", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community"), "k")
    return kept.select("node", "community", "k"), before, ended


def communities(edges: DataFrame, passes: int = 3, rounds: int = 8, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, community) of whole-number nodes: communities are joined while that raises the modularity, then single
    nodes are moved, and so on until a pass gains nothing. A community is named by its least node."""
    pairs = written(canonical(edges), "pairs")
    links = both_ways(pairs).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a").persist()
    strengths = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    assigned = written(strengths.select("node", F.col("node").alias("community"), "k"), "assigned")
    n, m = assigned.agg(F.count("*"), F.sum("k") / 2).first()
    best, ended = None, False
    for i in range(passes if m else 0):
        joined, changed = _merged(_between(pairs, assigned, n) if i else pairs, assigned, m, task_links)
        if ended and not changed:
            break
        after, q, ended = _moved(links, joined, m, n, rounds, 2e-4 if i else 1e-3)
        if best is not None and q <= best:
            break
        gained, assigned, best = best is None or q > best + 1e-4, after, q
        if not gained:
            break
    links.unpersist()
    names = assigned.groupBy("community").agg(F.min("node").alias("least"))
    return assigned.join(names, "community").select("node", F.col("least").alias("community"))


def community_summary(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(community, size, dominant, purity): the commonest group (``groups``: node, group) of a community's nodes, the
    least of equals, and its share."""
    counts = found.join(groups, "node", "left").groupBy("community", "group").agg(F.count("*").alias("n"))
    top = counts.groupBy("community").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), F.col("group").alias("group"))).alias("top"))
    return top.select("community", "size", F.col("top.group").alias("dominant"), r6(-F.col("top.n") / F.col("size")).alias("purity"))


def eigenvector(edges: DataFrame, components: DataFrame, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(node, eigen): in each component (``components``: node, component) the vector of length 1 that multiplying by the
    weights keeps in proportion, 0 for a node without links. Power iteration on the weights plus a sixth of each
    component's largest strength on the diagonal, so that a bipartite component settles too; scaled and written every sixth round, ended by the
    largest change."""
    pairs = written(canonical(edges), "pairs")
    part = components.select("node", "component")
    strengths = _strengths(pairs).join(part, "node")
    shift = strengths.groupBy("component").agg((F.max("k") / 6).alias("shift"))
    loops = strengths.join(shift, "component").select(F.col("node").alias("other"), "node", F.col("shift").alias("w"))
    links = written(both_ways(pairs).select(F.col("b").alias("other"), F.col("a").alias("node"), "w").union(loops), "links")
    state = written(strengths.select("node", "component", F.lit(1.0).alias("x")), "vector")

    def scaled(df: DataFrame) -> DataFrame:
        total = df.groupBy("component").agg(F.sqrt(F.sum(F.pow("x", 2))).alias("length"))  # adds up in tasks first, unlike a window
        return df.join(total, "component").select("node", "component", (F.col("x") / F.col("length")).alias("x"))

    for _ in range(0, rounds, 6):
        x = state.select("node", "x")
        for _ in range(6):
            x = links.join(x.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        after = written(scaled(x.join(state.select("node", "component"), "node")), "vector")
        change = after.join(state.select("node", F.col("x").alias("before")), "node").agg(F.max(F.abs(F.col("x") - F.col("before")))).first()[0]
        state = after
        if change is None or change < tolerance:
            break
    return part.select("node").join(state.select("node", "x"), "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("eigen"))


def _spread(state: DataFrame, links: DataFrame, by: str, to: str, value: str) -> DataFrame:
    """``value`` of (s, by) sent along links (s, by, to) and added up at (s, to)."""
    return links.join(state.withColumnRenamed("node", by), ["s", by]).groupBy("s", F.col(to).alias("node")).agg(F.sum(value).alias(value))


def betweenness(edges: DataFrame, distance: Column | None = None, batch_rows: int = 1 << 22, rounds: int = 10_000) -> DataFrame:
    """(node, betweenness), exact and normalised by (n - 1)(n - 2): the share of shortest paths between other nodes that
    a node is on. ``distance`` (of column w) is an edge's length, its weight if none is given.

    Sources go in batches of about ``batch_rows`` rows of (source, node), picked by a hash. Distances of a batch are
    lowered over all edges until none changes; edges on shortest paths are then known, and paths are counted forward
    and shares sent back along them, a round for each number of edges on a path."""
    pairs = written(canonical(edges).withColumn("w", (F.col("w") if distance is None else distance).cast("double")), "lengths")
    links = written(both_ways(pairs), "links")
    nodes = written(links.select(F.col("a").alias("node")).distinct(), "nodes")
    n = nodes.count()
    out = None
    batches = max(1, -(-n * n // batch_rows))
    for k in range(batches):
        sources = nodes.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == k)
        known = written(sources.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("d")), "distances")
        fresh = known
        for _ in range(rounds):
            reached = links.join(fresh.withColumnRenamed("node", "a"), "a").groupBy("s", F.col("b").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
            both = written(known.join(reached, ["s", "node"], "full").select("s", "node", "d", "new"), "reached")
            lower = F.coalesce(F.col("new") < F.col("d") * (1 - 1e-12), F.col("d").isNull())
            fresh = both.where(lower).select("s", "node", F.col("new").alias("d"))
            if not fresh.limit(1).count():
                break
            known = both.select("s", "node", F.when(lower, F.col("new")).otherwise(F.col("d")).alias("d"))
        d = lambda c: known.select("s", F.col("node").alias(c), F.col("d").alias(f"d{c}"))  # noqa: B023, E731
        on = F.abs(F.col("da") + F.col("w") - F.col("db")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("db"))
        steps = written(links.join(d("a"), "a").join(d("b"), ["s", "b"]).where(on).select("s", "a", "b"), "steps")

        def totals(start: DataFrame, by: str, to: str, value: str) -> DataFrame:
            """``value`` of the start, summed at each node over all paths to it."""
            layers, layer = [start], start
            for _ in range(rounds):
                layer = written(_spread(layer, steps, by, to, value), "layer")  # noqa: B023
                if not layer.limit(1).count():
                    break
                layers.append(layer)
            every = layers[0]
            for more in layers[1:]:
                every = every.union(more)
            return written(every.groupBy("s", "node").agg(F.sum(value).alias(value)), "totals")

        paths = totals(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("paths")), "a", "b", "paths")
        back = totals(paths.select("s", "node", (1 / F.col("paths")).alias("share")), "b", "a", "share")
        shares = paths.join(back, ["s", "node"]).where("s <> node").groupBy("node").agg(F.sum(F.col("paths") * F.col("share") - 1).alias("total"))
        shares = written(shares, "shares")
        out = shares if out is None else out.union(shares)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    sums = out.groupBy("node").agg(F.sum("total").alias("total"))
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("total", F.lit(0.0)) * scale).alias("betweenness"))
