"""Importance resampling and the audit of filters, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import assert_same, views
from gristmill.llm import filter_audit, importance, textops
from gristmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", ["op11_importance", "op12_filter_audit"])
def test_equals_sql(spark, small, name):
    assert_same(QUERIES[name](spark, small), ORACLES[name], views(small))


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]).encode() for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_composed_crcs_are_those_of_the_strings():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab cdÉé漢😀ß ,.A Z9-\n\x7f\x00'") for _ in range(rng.randint(0, 120))) for _ in range(200)]
    texts += ["", None, "x" * 300 + " y " + "é" * 500 + " z", "one", "one two", " ", "W" * 255 + " " + "w" * 254 + " " + "w" * 256]
    n_words, grams = importance.gram_crcs(*textops.raw(textops.text_column(pa.array(texts))))
    for i, t in enumerate(texts):
        assert n_words[i] == len(words_of(t))
        assert Counter(np.concatenate([crc[owner == i] for owner, crc in grams]).tolist()) == Counter(map(zlib.crc32, grams_of(t)))


def test_very_long_texts():
    for text in ("ab " * 400_000, "x" * 1_000_000):
        n_words, grams = importance.gram_crcs(*textops.raw(textops.text_column(pa.array([text]))))
        assert n_words.tolist() == [len(text.split())]
        assert set(grams[-1][1].tolist() or grams[0][1].tolist()) == {zlib.crc32(b"ab ab ab") if " " in text else zlib.crc32(text.encode())}


def brute_resample(docs, target):
    s, t = (np.bincount([zlib.crc32(g) % 10000 for _, text in rows for g in grams_of(text)], minlength=10000) if rows else np.zeros(10000, int) for rows in (docs, target))
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s.tolist(), t.tolist())]
    out = []
    for i, text in docs:
        g = grams_of(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(x) % 10000] for x in g)
        out.append([i, len(words_of(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    full = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for k, r in enumerate(full[: 5 * len(full) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resample_equals_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(5)
    vocabulary = ["red", "Blue", "été", "x1", "--", "漢字", "green", "a"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 19, 20, 21, 60])))) for i in range(400)]
    docs += [(None, "red " * 30), (7, docs[7][1]), (7, "other words " * 15), (900, None), (901, ""), (902, "... !!!")]
    target = [(1, "red green red green"), (2, None), (3, "été x1 x1")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit(1), "rank": F.lit(2), "weight": F.lit(3), "range": F.lit(4)})
    got = importance.resample(df, spark.createDataFrame(target, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(docs, target)


def test_ranks_of_equal_scores_over_many_ranges(spark):
    rows = spark.range(5000).select("id", F.lit(9).cast("long").alias("score"))
    got = importance.ranked(rows, 1234, rank_rows=100).where("rank is not null").orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in got] == [(i, i + 1) for i in range(1234)]


def test_resample_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    assert [r["rank"] for r in importance.resample(some, none).collect()] == [None]


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        parts.setdefault(lang or "", []).append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = [], Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone, left = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in rows)
                out.append([part, order, k + 1, f, len(left), len(gone), failing - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)])
                shapley[part, f] += len(gone)
    return sorted((*r, shapley[r[0], r[3]]) for r in out)


def test_audit_equals_brute_force_with_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(150):
        w = rng.sample(words, rng.choice([20, 110, 130])) if rng.random() < 0.7 else rng.choices(words[:40], k=120)
        text = " ".join(w) + rng.choice(["", "", " #", " | %"])
        docs.append((i, text.upper() if rng.random() < 0.2 else text, rng.choice(["en", "de", "fr"])))
    docs += [(200 + k, docs[k % 5][1], "en") for k in range(10)] + [(3, docs[3][1], docs[3][2]), (None, docs[0][1], "en"), (301, None, None), (302, "", ""), (303, "A\t#\x0b" * 5, "de"), (304, "x", "only")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 210, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "E": F.lit(1), "good": F.lit(2), "digest": F.lit(3), "quality": F.lit(1)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    got = filter_audit.audit(df, marks)
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)


def test_hot_texts_are_looked_up_apart(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_COPIES", 3)
    docs = [(i, f"text {i % 3}" if i < 30 else f"own {i // 2}", "en") for i in range(60)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit(df, marks).collect())) == brute_audit(docs, [])


def test_audit_of_an_empty_table_and_of_very_long_texts(spark):
    none, marks = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, marks).collect() == []
    docs = [(1, "word " * 200_000, "en"), (2, "x" * 1_000_000, "en"), (3, "A" * 1_000_000, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sorted(map(tuple, filter_audit.audit(df, marks).collect())) == brute_audit(docs, [(1, 1, 0)])


def test_states_are_visited_once(spark):
    rows = spark.createDataFrame([("p", True, False, True, False, False, True, False)], "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean")
    edges = filter_audit.walk(rows).collect()
    assert len({(e["state"], e["filter"]) for e in edges}) == len(edges)
    assert len(edges) == 5 + 3 * 4 + 3 * 3 + 2  # states reached by a row: those without A and C
