"""Near duplicates among vectors by spherical-cap filters.

A filter is a direction; a vector passes the filters whose directions exceed its bound, the product with its
k-th nearest direction. The directions are a structured random product code: a random rotation, then blocks of
places with a small random code each, a direction being one word of each block's code. So a vector is list-decoded
to its filters, among millions, from a few thousand products: lists of the best words of the blocks are merged.
Vectors meet in filters they share, and are verified there in double precision.

The number of directions grows with the number of distinct vectors, so that a filter holds few unrelated ones at any
size. Rotations are uniform, so how often a pair at the threshold shares no filter of a code doesn't depend on
the data: it is measured on random pairs, and there are as many codes as make a miss in all of them rarer than
MISSED. A pair is counted in the first filter that both pass, by falling size of filters, and nowhere else; pairs are
never written, only each vector's sum and a spanning forest of a filter's links. Equal vectors are one class
throughout. A filter of many vectors is dealt in chunks, each two of which meet in a task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gristmill.llm.components import connected_components, contract
from gristmill.llm.storage import broadcast_if_small, map_arrow, materialize

#: Filters of a code that a vector passes, directions of a code to a vector, words of a block's code at most (beyond,
#: there is one more block), and how often a pair at the threshold may share no filter.
PASSED, LOAD, WORDS, MISSED = 8, 4, 1024, 1e-7
#: Vectors of a chunk: a task gets two at most of a filter.
CHUNK = 2048
#: Classes of so many equal vectors are looked up in a broadcast table: there is at most one in so many rows.
HOT_COPIES = 10_000
#: Filters of up to so many vectors are verified together, pair by pair; larger ones in blocks of BLOCK vectors.
FEW, BLOCK = 48, 512


def _best(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, or all, and their places."""
    k = min(k, p.shape[1])
    at = np.argpartition(-p, k - 1, axis=1)[:, :k]
    return np.take_along_axis(p, at, axis=1), at


class Code:
    """Filters for ``n`` vectors of ``d`` places; pairs of ``threshold`` are to share one."""

    def __init__(self, n: int, d: int, threshold: float, passed: int = PASSED, missed: float = MISSED, seed: int = 1):
        directions = LOAD * max(n, 64)
        self.blocks = 2
        while directions ** (1 / self.blocks) > WORDS:
            self.blocks += 1
        self.words, self.passed, self.seed, self.d = int(np.ceil(directions ** (1 / self.blocks))), passed, seed, d
        self.width = -(-max(d, 12) // self.blocks)  # places of a block; short vectors are padded with zeros
        self.miss = self.missed_by_one(min(threshold, 1.0))
        self.codes = max(1, int(np.ceil(np.log(missed) / np.log(self.miss))))

    def missed_by_one(self, cosine: float, pairs: int = 4000) -> float:
        """How many of random pairs at ``cosine`` share no filter of one code, five standard deviations added."""
        rng = np.random.default_rng([self.seed, 1 << 20])
        a, w = unit_rows(rng.standard_normal(pairs * self.d), self.d), rng.standard_normal((pairs, self.d))
        w -= (w * a).sum(axis=1, keepdims=True) * a
        size = np.sqrt((w * w).sum(axis=1, keepdims=True))
        b = unit_rows(cosine * a + np.sqrt(1 - cosine**2) * w / np.where(size > 0, size, 1), self.d)
        lost = sum(float((x[:, :, None] != y[:, None, :]).all(axis=(1, 2)).mean()) for x, y in ((self.decode(a, k), self.decode(b, k)) for k in range(4))) / 4
        return min(0.999, lost + 5 * np.sqrt((lost + 1 / pairs) / (4 * pairs)))

    @cache  # noqa: B019 - a worker keeps the few codes it decodes with
    def parts(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rotation and the blocks' codes of code ``k``."""
        rng = np.random.default_rng([self.seed, k, self.d, self.words])
        places = self.width * self.blocks
        rotation, upper = np.linalg.qr(rng.standard_normal((places, places)))
        rotation = (rotation * np.sign(np.diag(upper)))[: self.d]
        words = [rng.standard_normal((self.width, self.words)) for _ in range(self.blocks)]
        return rotation, [w / np.linalg.norm(w, axis=0) for w in words]

    def decode(self, unit: np.ndarray, k: int) -> np.ndarray:
        """The filters of code ``k`` that each unit vector passes, a row a vector. The best sums of a word from each
        block hold no word beyond the best ``passed`` of its block, nor a partial sum beyond the best as many."""
        rotation, words = self.parts(k)
        turned = unit @ rotation
        value, code = np.zeros((len(unit), 1)), np.full((len(unit), 1), k, np.int64)
        for b, w in enumerate(words):
            most, at = _best(turned[:, b * self.width : (b + 1) * self.width] @ w, self.passed)
            sums = (value[:, :, None] + most[:, None, :]).reshape(len(unit), -1)
            codes = (code[:, :, None] * self.words + at[:, None, :]).reshape(len(unit), -1)
            value, top = _best(sums, self.passed)
            code = np.take_along_axis(codes, top, axis=1)
        return code


def unit_rows(flat: np.ndarray, d: int) -> np.ndarray:
    """Vectors of ``d`` places, none zero, at length 1; scaled first, so that no square overflows or vanishes."""
    v = flat.astype(np.float64).reshape(-1, d)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _entries(classes: DataFrame, code: Code) -> DataFrame:
    """(cls, filter) of all filters that each class passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit = batch.column(0).to_numpy(), unit_rows(batch.column(1).flatten().to_numpy(), code.d)
            for i in range(0, len(ids), 256):
                found = np.concatenate([code.decode(unit[i : i + 256], k) for k in range(code.codes)], axis=1)
                yield pa.record_batch([pa.array(np.repeat(ids[i : i + 256], found.shape[1])), pa.array(found.reshape(-1))], names=["cls", "filter"])

    return map_arrow(classes.select("cls", "v"), run, "cls long, filter long")


def _bitmaps(bucket: np.ndarray, row: np.ndarray, earlier: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows a bitmap of its earlier filters (row, earlier; bucket of the row), with a place of its own
    for each that more than one row of a bucket has. Rows of a bucket have such a filter in common where
    their bitmaps meet."""
    if not len(row):
        return np.zeros((n, 1), np.uint64)
    order = np.lexsort((earlier, bucket))
    b, e = bucket[order], earlier[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (e[1:] != e[:-1])]
    group = np.cumsum(new) - 1
    common = np.bincount(group) > 1
    counted = np.cumsum(common) - common  # over all buckets; places begin at 0 in each
    first = np.flatnonzero(np.r_[True, b[new][1:] != b[new][:-1]])
    place = counted - np.repeat(counted[first], np.diff(np.r_[first, len(common)]))
    keep = common[group]
    rows, places = row[order][keep], place[group][keep]
    out = np.zeros((n, max(1, int(places.max(initial=0)) // 64 + 1)), np.uint64)
    np.bitwise_or.at(out, (rows, places // 64), np.uint64(1) << (places % 64).astype(np.uint64))
    return out


class _Links:
    """Sums the links of the rows of whole buckets: each pair in the first filter that both vectors pass."""

    def __init__(self, threshold: float, rows: dict[str, np.ndarray], unit: np.ndarray, earlier: np.ndarray, n_earlier: np.ndarray):
        self.threshold, self.unit, self.cls, self.weight, self.side = threshold, unit, rows["cls"], rows["weight"], rows["side"]
        # vectors that share a first filter other than this one have met there
        self.met = np.where(n_earlier > 0, rows["home"], -1 - np.arange(len(unit)))
        bucket = rows["bucket"]
        self.starts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        whole = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.maps = _bitmaps(np.repeat(whole, n_earlier), np.repeat(np.arange(len(unit)), n_earlier), earlier, len(unit))
        self.sums, self.forest = np.zeros(len(unit), np.int64), (np.empty(0, np.int64), np.empty(0, np.int64))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Linked rows i, j: kept if no earlier filter has them both."""
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            fresh = ~(self.maps[a] & self.maps[b]).any(axis=1)
            a, b = a[fresh], b[fresh]
            n = len(self.sums)
            self.sums += (np.bincount(a, self.weight[b], minlength=n) + np.bincount(b, self.weight[a], minlength=n)).astype(np.int64)
            if len(a):
                self.forest = contract(np.r_[self.forest[0], self.cls[a]], np.r_[self.forest[1], self.cls[b]])

    def _open(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.met[i] != self.met[j]) & ((self.side[i] != self.side[j]) | (self.side[i] < 0))

    def few(self) -> None:
        """All pairs of the rows of small buckets, many buckets at once."""
        sizes = np.diff(self.starts)
        ends = np.repeat(self.starts[1:], sizes)
        partners = np.where(np.repeat(sizes, sizes) <= FEW, ends - np.arange(len(ends)) - 1, 0)
        cuts = np.r_[np.searchsorted(np.cumsum(partners), np.arange(0, partners.sum(), 1 << 17)), len(partners)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            p = partners[a:b]
            i = np.repeat(np.arange(a, b), p)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(p) - p, p)
            ok = self._open(i, j)
            i, j = i[ok], j[ok]
            near = np.einsum("ij,ij->i", self.unit[i], self.unit[j]) >= self.threshold
            self.add(i[near], j[near])

    def many(self) -> None:
        """Large buckets in blocks of rows that have the same first filter side by side."""
        for s, e in zip(self.starts[:-1], self.starts[1:], strict=True):
            if e - s > FEW:
                rows = s + np.argsort(self.met[s:e], kind="stable")
                blocks = [rows[k : k + BLOCK] for k in range(0, len(rows), BLOCK)]
                for k, a in enumerate(blocks):
                    for b in blocks[k:]:
                        if self.met[a[0]] == self.met[b[-1]]:
                            continue
                        near = self.unit[a] @ self.unit[b].T >= self.threshold
                        if a is b:
                            near = np.triu(near, 1)
                        x, y = np.nonzero(near)
                        ok = self._open(a[x], b[y])
                        self.add(a[x[ok]], b[y[ok]])

    def rows(self) -> pa.RecordBatch:
        linked = np.flatnonzero(self.sums)
        found = np.unique(self.cls[linked], return_inverse=True)
        sums = np.bincount(found[1], self.sums[linked], minlength=len(found[0])).astype(np.int64)
        up = found[0].copy()
        up[np.searchsorted(found[0], self.forest[0])] = self.forest[1]
        return pa.record_batch([pa.array(found[0], pa.int64()), pa.array(sums), pa.array(up, pa.int64())], names=["cls", "links", "up"])


def _verify(placed: DataFrame, threshold: float, d: int) -> DataFrame:
    """(cls, links, up) of ``placed`` (filter, a, b, side, cls, weight, home, earlier, v): links that a class has in
    some filters, and another class that it reaches by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None

        def judged(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            c = {n: table[n].combine_chunks() if isinstance(table[n], pa.ChunkedArray) else table[n] for n in table.column_names}
            rows = {n: c[n].to_numpy(zero_copy_only=False) for n in ("cls", "weight", "side", "home")}
            f, a, b = (c[n].to_numpy() for n in ("filter", "a", "b"))
            rows["bucket"] = np.cumsum(np.r_[True, (f[1:] != f[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            lengths = c["earlier"].value_lengths().to_numpy().astype(np.int64)
            work = _Links(threshold, rows, unit_rows(c["v"].flatten().to_numpy(), d), c["earlier"].flatten().to_numpy(), lengths)
            work.few()
            work.many()
            return work.rows()

        for batch in batches:
            table = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
            key = [table[n].to_numpy() for n in ("filter", "a", "b")]
            last = np.flatnonzero(np.logical_and.reduce([k == k[-1] for k in key]))[0] if len(table) else 0  # rows are sorted
            carry = table.slice(int(last))
            if last:
                yield judged(table.slice(0, int(last)))
        if carry is not None and len(carry):
            yield judged(carry)

    return map_arrow(placed, run, "cls long, links long, up long")


def _links(classes: DataFrame, n: int, d: int, threshold: float, chunk: int) -> DataFrame:
    """(cls, links, up) among ``classes`` (cls, n, v) of one length."""
    entries = materialize(_entries(classes, Code(n, d, threshold)), "filters")
    shared = materialize(entries.groupBy("filter").agg(F.count("*").alias("size")).where("size > 1"), "shared_filters")
    # by falling size, so that a vector's first filter is the one where most of its like are
    lists = entries.join(broadcast_if_small(shared, 24), "filter").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("size"), "filter"))).alias("passed"))
    parts = F.ceil(-F.col("size") / chunk).cast("int")
    placed = lists.join(classes.select("cls", F.col("n").alias("weight"), "v"), "cls").select("cls", "weight", "v", "passed", F.posexplode("passed").alias("at", "p"))
    placed = placed.select("cls", "weight", "v", F.col("p.size").alias("size"), F.col("p.filter").alias("filter"), F.col("passed")[0]["filter"].alias("home"), F.slice("passed.filter", F.lit(1), F.col("at")).alias("earlier"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own"))
    placed = placed.select("filter", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "cls", "weight", "home", "earlier", "v")
    key = ["filter", "a", "b"]
    return _verify(placed.repartition(*key).sortWithinPartitions(*key), threshold, d)


def _usable(v: str) -> Column:
    """Whether a vector has a length: no null or non-finite component, and one that isn't 0."""
    infinite = float("inf")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, chunk: int = CHUNK, hot: int = HOT_COPIES) -> DataFrame:
    """One row for each row of ``vectors``: (id_col, n_links, component_id, kept).

    Rows link where the cosine of their vectors, in double precision, is at least ``threshold`` (above 0): ``n_links``
    counts the other rows linked directly, ``component_id`` is the least id reachable by links, its own included, and
    ``kept`` says whether that is its own. Every row counts, so equal vectors link with each other, also where rows
    repeat an id. Null, empty and zero vectors, and those with a null or non-finite component, link with nothing;
    so do vectors of different lengths. Null ids are never the least; a component without any other has a null id.
    An empty table gives an empty result. Other columns are not read. Equal vectors are known by 128 bits of hash.
    A pair at the threshold is missed with a chance of MISSED, a closer pair more rarely. Each length of vectors is
    one more pass."""
    spark: SparkSession = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.withColumn("v", F.when(_usable("v"), F.col("v")))
    keys = [F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("k")]
    classes = rows.where("v is not null").select("id", "v", *keys).groupBy("h", "k").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    lengths = classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()  # lengths that more than one vector has
    found = spark.createDataFrame([], "cls long, links long, up long")
    for r in lengths:
        found = found.union(_links(classes.where(F.size("v") == r["d"]), r["n"], r["d"], threshold, chunk))
    found = materialize(found, "links")
    sums = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = materialize(connected_components(found.select(F.col("cls").alias("a"), F.col("up").alias("b"))), "components")
    lowest = parts.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("lowest"))
    linked = parts.join(lowest, "component").select(F.col("node").alias("cls"), "lowest")
    told = classes.select("cls", "h", "k", "n", "least").join(sums, "cls", "left").join(linked, "cls", "left")
    told = told.select("h", "k", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    told = materialize(told, "told")
    one = F.lit(0).cast("long").alias("n_links")
    asked = rows.select("id", F.col("v").isNotNull().alias("usable"), *keys)
    lone = asked.where("not usable").select("id", one, F.col("id").alias("component_id"))
    # rows of a vector with many copies don't meet in one task: the class goes to them
    many = broadcast_if_small(told.where(F.col("n") > hot).drop("n"), 40)
    out = asked.where("usable").join(many.withColumnsRenamed({"h": "hot_h", "k": "hot_k"}), (F.col("h") == F.col("hot_h")) & (F.col("k") == F.col("hot_k")), "left")
    common = out.where("hot_h is not null").select("id", "n_links", "component_id")
    rest = out.where("hot_h is null").select("id", "h", "k").join(told.where(F.col("n") <= hot), ["h", "k"]).select("id", "n_links", "component_id")
    out = common.union(rest).union(lone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e, row_number() OVER () AS r FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r AS a, r AS b FROM ok UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a AS r, min(vec_id) AS component_id FROM reach JOIN ok ON ok.r = reach.b GROUP BY 1),
sums AS (SELECT a AS r, count(*) AS n FROM links GROUP BY 1)
SELECT ok.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, coalesce(ok.vec_id = component_id, false) AS kept FROM ok JOIN least USING (r) LEFT JOIN sums USING (r)
UNION ALL SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM v WHERE e IS NULL OR len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(e, lambda x: x <> 0)) = 0
"""
