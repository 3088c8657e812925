"""The n-gram join, decontamination, and the pipeline's stages that use them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same, views
from pyspark.sql import functions as F

from gristmill.llm import decontamination, ngram_join, queries, textops
from gristmill.llm.components import connected_components

random.seed(5)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(t, rate):
    return " ".join(random.choice(WORDS) if random.random() < rate else w for w in t.split(" "))


def brute(rows, k=5):
    sets = {}
    for i, t in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def collection():
    rows, base = [], text(120)
    for i in range(60):
        rows.append(edited(base, 0.01 * (i % 9)))  # a large group of near copies, some too far apart
    rows += [base] * 12
    for n in (1, 2, 3, 4, 5, 6, 7, 30, 200):
        t = text(n)
        rows += [t, t.upper(), t.replace(" ", "\n"), edited(t, 0.03), t + " " + text(max(1, n // 10))]
    rows += ["", None, "  \n ", "w", "W", text(3000)]
    passage = text(40)
    rows += [text(20) + " " + passage + " " + text(20) for _ in range(15)]
    rows += [text(50) for _ in range(20)]
    order = list(range(len(rows)))
    random.shuffle(order)
    return [(int(i) * 3 + 1, rows[i]) for i in order]


@pytest.mark.parametrize("block", [6, 512])
def test_join_equals_brute_force(spark, block):
    rows = collection()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, block=block).collect()}
    assert got == brute(rows)


def test_join_edges(spark):
    schema = "doc_id long, text string, n long, sid string"
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f", 1, "x"), (7, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"), (None, None, 1, "x"), (3, "A b C d e\tf", 1, "y"), (9, "", 1, "z")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["class_copies"]) for r in ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 2, 3, 4), (7, 2, 3, 4), (None, 2, 3, 4), (None, 0, None, 1), (3, 2, 3, 4), (9, 0, 9, 1)], key=str)


def test_null_ids_link_and_bridge(spark):
    base = [f"w{i}" for i in range(60)]
    far = [*base[12:], *(f"v{i}" for i in range(12))]  # too far from the first, near enough to the one between
    between = [*base[6:], *(f"v{i}" for i in range(6))]
    rows = [(9, " ".join(base)), (None, " ".join(between)), (None, " ".join(between)), (4, " ".join(far)), (None, text(30)), (12, text(30))]
    assert brute([(1, rows[0][1]), (2, rows[3][1])])[2][1] == 2
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["leads"]) for r in got), key=str) == sorted([(9, 4, False), (None, 4, False), (None, 4, False), (4, 4, True), (None, None, True), (12, 12, True)], key=str)


def test_pages_of_a_template_that_do_not_link_go_to_no_trie(spark, monkeypatch):
    sent = []
    blocks = ngram_join._block_links
    monkeypatch.setattr(ngram_join, "_block_links", lambda df, percent: sent.append(df.count()) or blocks(df, percent))
    template = text(100)
    for n in (200, 400):
        rows = [(i, template + " " + " ".join(f"u{i}x{j}" for j in range(25 + i % 7))) for i in range(n)] + [(n, far := text(60)), (n + 1, far + " x")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(df, block=32).collect()}
        assert got == {i: min(i, n) for i in range(n + 2)}
    assert max(sent) <= 2


def test_trie_prunes_but_finds_all():
    rng = np.random.default_rng(2)
    lists = [sorted(rng.choice(60, rng.integers(3, 30), replace=False).tolist()) for _ in range(60)]
    lists += [sorted({*lists[0], 61}), lists[1]]
    sizes = [len(x) for x in lists]
    trie = ngram_join.Trie(lists, sizes)
    for i, probe in enumerate(lists):
        got = {trie.order[place] for place, _ in trie.walk(probe, sizes[i], 75, lambda lo, hi: False)}
        want = {j for j, x in enumerate(lists) if 100 * len({*x} & {*probe}) >= 75 * len({*x} | {*probe})}
        assert got == want


@pytest.mark.parametrize("task_edges", [9, 1 << 18])
def test_components(spark, task_edges):
    edges = [(i, i + 1) for i in range(50)] + [(100, 90), (90, 95), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(40)] + [(500 - i, 300) for i in range(40)]
    random.shuffle(edges)
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), task_edges=task_edges).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100, 90), (95, 90), (90, 90)} | {(200 + i, 200) for i in range(41)} | {(500 - i, 300) for i in range(40)} | {(300, 300)}


def test_words_of_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(textops, "PIECE", 64)
    data = np.frombuffer(text(200).encode(), np.uint8)
    offsets = np.array([0, 100, 100, len(data)])
    cut = textops.words(data, offsets)
    monkeypatch.setattr(textops, "PIECE", 1 << 20)
    whole = textops.words(data, offsets)
    assert all((a == b).all() for a, b in zip(cut, whole, strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small), queries.ORACLES[name], views(small))


def items(n=30):
    return [(i, text(random.randint(15, 50))) for i in range(n)]


def test_leaks_are_found_and_clean_documents_are_not(spark):
    bench = items()
    rows, want = [], set()
    for k, (i, t) in enumerate(bench):
        for change in (t, t.upper(), t.replace(" ", ", "), edited(t, 0.12)):
            d = len(rows)
            rows.append((d, text(30) + " " + change + " " + text(30)))
            want.add((d, i))
    clean = len(rows)
    rows += [(clean + k, text(80)) for k in range(100)]
    rows += [(clean + 100 + k, text(30) + " " + " ".join(t.split()[:6]) + " " + text(30)) for k, (_, t) in enumerate(bench)]
    rows += [(clean + 200, None), (clean + 201, ""), (clean + 202, bench[0][1])]
    want.add((clean + 202, 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got <= want
    exact = {(d, i) for d, i in want if d % 4 != 3 or d >= clean}
    assert exact <= got and len(got) >= 0.95 * len(want)


def numbered(bench, texts=()):
    """The vocabulary of some items, and the items and other texts as word numbers."""
    hashes = lambda t: textops.words(*textops.raw(textops.text_column(pa.array([t]))), letters=True)[0]
    v = decontamination.Vocabulary(np.unique(np.concatenate([hashes(t) for _, t in bench])))
    return v, [v.numbers(hashes(t)).astype(np.int64) for _, t in bench], [v.numbers(hashes(t)) for t in texts]


def accepted(rule, words):
    """Whether some region of a text holds an item: tried at every place."""
    words = words.tolist()
    regions = (words[max(0, b - rule.slack) : max(0, b + len(rule.goal) + rule.slack)] for b in range(-rule.slack, len(words) + 1))
    return any(rule.kind(decontamination.lcs_mask(r, rule.goal)[0], r) for r in regions)


@pytest.mark.parametrize("times", [1, 10**6])
@pytest.mark.parametrize("every, least", [(5, 1.0), (3, 0.9), (2, 0.0)])
def test_all_that_the_rule_accepts_is_found_however_large_the_corpus(times, every, least):
    bench = items(40)
    rng = np.random.default_rng(every)
    v, goals, _ = numbered(bench)
    n = len(v.hashes)
    texts = []
    for k, goal in enumerate(goals):
        leak = goal.copy()
        place = np.arange(len(leak)) % every == every - 1
        # replaced by words of the benchmark, or by words that no item has
        leak[place] = rng.integers(1, n + 1, place.sum()) if k % 2 else 0
        texts.append(np.concatenate([rng.integers(0, n + 1, 40), leak, rng.integers(0, n + 1, 40)]).astype(v.kind))
    weights = decontamination.Weights(v, np.full(n, 5.0 * times), 1000.0 * times)
    matcher = decontamination.Matcher(goals, v, weights, np.eye(n))
    found = {(t, i) for t, i, *_ in matcher.find(texts)}
    want = {(t, i) for t in range(len(texts)) for i in range(len(goals)) if accepted(matcher.rules[i], texts[t])}
    assert found <= want and len(found) >= 0.95 * len(want)
    assert sum((k, k) in found for k in range(40)) >= least * 40


def test_projection_by_products_equals_that_by_passages(spark, monkeypatch):
    v, _, _ = numbered(items(5))
    n = len(v.hashes)
    texts = [np.random.default_rng(k).integers(0, n + 1, 5 + k).astype(np.uint16) for k in range(60)] + [np.full(9, 3, np.uint16)]
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "words binary").repartition(3)
    weights, basis = decontamination.Weights(v, np.arange(n) % 9.0, 100.0), np.random.default_rng(1).normal(size=(n, 6))
    found = decontamination._projected(rows, v, weights, basis)
    monkeypatch.setattr(decontamination, "GRAM_WORDS", 0)
    assert np.allclose(found, decontamination._projected(rows, v, weights, basis), rtol=1e-4, atol=1e-4)


def test_leaks_of_long_items_ids_of_any_type_and_shared_latent_rows(spark, monkeypatch):
    bench = [(1, text(1500)), (2, text(40)), (3, "ΑΒΓΔ ЖИЗНЬ Ёлка ÀÉ łódź ŻÓŁW один два три")]
    rows = [("a", text(2000) + " " + edited(bench[0][1], 0.1) + " " + text(5000)), ("b", bench[1][1].upper()), ("b", bench[1][1].upper()), (None, bench[2][1].lower()), ("c", None), ("d", text(30_000))]
    docs = spark.createDataFrame([(i, t, 5.0, "x") for i, t in rows], "doc_id string, text string, hash double, words string")
    for kind in ("smallint", "decimal(9,0)", "string"):
        own = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, item int").withColumn("item_id", F.col("item_id").cast(kind))
        got = decontamination.leaks(docs, own)
        assert dict(got.dtypes)["item_id"] == kind
        assert sorted(((r["doc_id"], int(r["item_id"])) for r in got.collect()), key=str) == sorted([("a", 1), ("b", 2), ("b", 2), (None, 3)], key=str)
        monkeypatch.setattr(decontamination, "LATENT_ROWS", 150)
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 10)


def test_leaks_edges(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (None, "ONE, two three -- four five!")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs, none).count() == 0
    assert decontamination.leaks(docs, spark.createDataFrame([(5, None), (6, "?!")], "item_id long, text string")).count() == 0
    assert decontamination.leaks(docs.where("false"), spark.createDataFrame([(5, "a b")], "item_id long, text string")).count() == 0
    bench = spark.createDataFrame([(5, "one two three four five"), (8, "one two three four five"), (9, "six seven eight nine")], "item_id long, text string")
    found = lambda: sorted(((r["doc_id"], r["item_id"], r["kind"]) for r in decontamination.leaks(docs, bench).collect()), key=str)
    want = sorted([(d, i, "verbatim") for d in (1, 1, None) for i in (5, 8)], key=str)
    assert found() == want
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 1)  # the benchmark in blocks
    assert found() == want


def test_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b):
                row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
        return row[-1]

    for _ in range(50):
        a, b = [random.randrange(5) for _ in range(random.randrange(40))], [random.randrange(5) for _ in range(random.randrange(1, 90))]
        assert decontamination.lcs_mask(a, b)[0] == plain(a, b)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    bench = items(5)
    near = text(60)
    rows = [(i, text(40) + ".", "en", f"s{i % 3}") for i in range(200)]
    rows += [(300, near, "en", "s"), (301, near, "en", "s"), (302, edited(near, 0.01), "en", "s"), (302, near, "en", "s"), (303, text(30) + " " + bench[2][1] + " " + text(9), "en", "s"), (304, "", "en", "s"), (None, text(20), "en", "s")]
    # rows that share an id, or have none, are each judged by their own text
    rows += [(None, text(25), "en", "s"), (None, near, "en", "s"), (None, near, "en", "s"), (305, text(25), "en", "s"), (305, text(26), "en", "s"), (306, text(30), "en", "s"), (306, text(31) + " " + bench[1][1], "en", "s")]
    rows += [(400 + i, " ".join(f"{w}###" for w in text(40).split()), "en", "s") for i in range(60)]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(400 + i, 0, 0) for i in range(50)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert sorted(kept.columns) == sorted(docs.columns)
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        if name == "quality":
            assert set(range(200)) <= set(ids) and not any(i is not None and i >= 400 for i in ids)
        if name == "near_duplicates":
            assert ids.count(300) == 1 and not {301, 302} & set(ids) and ids.count(None) == 2 and ids.count(305) == 2 and ids.count(304) == 1
        if name == "decontamination":
            assert 303 not in ids and set(range(200)) <= set(ids) and ids.count(None) == 2
    last = cp.run(spark, str(tmp_path))
    assert last.where("not round_trip").count() == 0
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == set(ids)
