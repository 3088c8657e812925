"""Near duplicates among vectors against brute force over all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import assert_same, views
from gristmill.llm import near_vectors
from gristmill.llm.queries import ORACLES, QUERIES

rng = np.random.default_rng(4)


def unit(*shape):
    v = rng.standard_normal(shape)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def near(base, cosine):
    """One vector at exactly ``cosine`` to each row of ``base``."""
    w = rng.standard_normal(base.shape)
    w -= (w * base).sum(-1, keepdims=True) * base
    return cosine * base + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=-1, keepdims=True)


def brute(rows, threshold=0.95):
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: set() for i in range(len(rows))}, list(range(len(rows)))
    for d in {len(rows[i][1]) for i in usable}:
        own = [i for i in usable if len(rows[i][1]) == d]
        m = np.array([rows[i][1] for i in own], dtype=float)
        m /= np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
            links[own[a]].add(own[b])
            links[own[b]].add(own[a])

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, js in links.items():
        for j in js:
            root[find(j)] = find(i)
    least = {}
    for i, (x, _) in enumerate(rows):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return sorted(((x, len(links[i]), least.get(find(i)), x is not None and x == least[find(i)]) for i, (x, _) in enumerate(rows)), key=str)


def run(spark, rows, kind="double", **settings):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"id": F.lit(1), "cls": F.lit(2), "filter": F.lit(3), "label": F.lit(4), "n": F.lit(5), "v": F.lit(6)})
    out = near_vectors.near_vectors(df, **settings)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=str)


def planted(d):
    base = unit(40, d)
    rows = [*unit(300, d), *base, *near(base, 0.9501), *near(base, 0.9499), *near(base, 0.99)]
    group = unit(1, d)
    rows += [*near(np.repeat(group, 150, 0), 0.99)]  # pairs from about 0.97 to 0.99
    rows += [*near(np.repeat(unit(1, d), 60, 0), 0.975)]  # pairs about the threshold
    chain = unit(1, d)[0]
    for _ in range(12):
        chain = near(chain[None], 0.955)[0]
        rows.append(chain)
    order = rng.permutation(len(rows))
    return [(int(k), [float(x) for x in rows[i]]) for k, i in enumerate(order)]


def test_equals_sql(spark, small):
    assert_same(QUERIES["op13_near_vectors"](spark, small), ORACLES["op13_near_vectors"], views(small))


def test_equals_brute_force_with_chunks_copies_and_odd_rows(spark):
    rows = planted(64)
    n = len(rows)
    rows += [(n + i, rows[3][1]) for i in range(40)] + [(n + 100 + i, [2.0 * x for x in rows[3][1]]) for i in range(3)] + [(5, rows[9][1]), (5, rows[5][1]), (None, rows[7][1]), (None, None)]
    rows += [(n + 200, None), (n + 201, []), (n + 202, [0.0] * 64), (n + 203, [float("nan")] * 64), (n + 204, [float("inf")] + [0.0] * 63), (n + 205, [None] + [1.0] * 63), (n + 206, [None] * 64)]
    rows += [(n + 300, [1.0, 0.0]), (n + 301, [1e200, 1e190]), (n + 302, [1e-200, 0.0]), (n + 303, [1.0]), (n + 304, [3.0]), (n + 305, [-1.0]), (n + 306, [1e-320] * 64), (n + 307, [1e308] * 64)]
    assert run(spark, rows, chunk=32, hot=10) == brute(rows)


def test_single_precision_vectors(spark):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in planted(20)]
    assert run(spark, rows, kind="float") == brute(rows)


def test_empty_table_and_one_row(spark):
    assert run(spark, []) == []
    assert run(spark, [(7, [1.0, 2.0])]) == [(7, 0, 7, True)]


@pytest.mark.parametrize("n, d", [(2_000, 64), (50_000, 64), (10**8, 64), (10**6, 300)])
def test_pairs_at_the_threshold_share_a_filter(n, d):
    code = near_vectors.Code(n, d, 0.95)
    a = unit(3000, d)
    b = near(a, 0.95)
    met = np.zeros(len(a), bool)
    for k in range(code.codes):
        x, y = code.decode(a, k), code.decode(b, k)
        met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    assert met.all()


def test_decoding_lists_the_best_directions():
    code = near_vectors.Code(64, 16, 0.95)
    rotation, words = code.parts(2)
    v = unit(50, 16)
    turned = v @ rotation
    all_sums = (turned[:, : code.width] @ words[0])[:, :, None] + (turned[:, code.width :] @ words[1])[:, None, :]
    best = np.argsort(-all_sums.reshape(50, -1), axis=1)[:, : code.passed]
    found = code.decode(v, 2) - 2 * code.words**2
    assert (np.sort(best) == np.sort(found)).all()


def test_bitmaps_meet_where_rows_of_a_bucket_share_an_earlier_filter():
    bucket, row, earlier = (rng.integers(0, 9, 4000), None, rng.integers(0, 150, 4000))
    row = bucket * 20 + rng.integers(0, 20, 4000)
    order = np.argsort(row, kind="stable")
    maps = near_vectors._bitmaps(bucket[order], row[order], earlier[order], 180)
    sets = [set(earlier[row == i]) for i in range(180)]
    for b in range(9):
        for i in range(b * 20, b * 20 + 20):
            for j in range(i + 1, b * 20 + 20):
                assert bool((maps[i] & maps[j]).any()) == bool(sets[i] & sets[j])
