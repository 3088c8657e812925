"""Upserts that survive retries, failures and other writers; admission by Bloom filters."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gristmill.operators import decisions as dc
from gristmill.sources.collections import Collection, Conflict, SchemaViolation
from gristmill.streaming import admission, bus


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, kind string, n long")


def all_of(c):
    return sorted(map(tuple, c.read().select("id", "kind", "n").collect()))


@pytest.fixture
def collection(spark, tmp_path):
    return Collection(spark, str(tmp_path / "audits"), ["id"], {"kind": "string"}, buckets=3)


def test_a_batch_that_comes_again_changes_nothing(spark, collection):
    assert collection.read() is None
    assert collection.upsert(docs(spark, [("a", "x", 1), ("b", "x", 1)]), "w", 0)
    assert collection.upsert(docs(spark, [("b", "y", 2), ("c", "y", 2), ("c", "y", 1)]), "w", 1)
    want = [("a", "x", 1), ("b", "y", 2), ("c", "y", 2)]
    assert all_of(collection) == want
    assert not collection.upsert(docs(spark, [("a", "z", 9)]), "w", 1)
    assert not collection.upsert(docs(spark, [("a", "z", 9)]), "w", 0)
    assert all_of(collection) == want
    assert collection.versions() == [1, 2]
    assert collection.upsert(docs(spark, [("a", "z", 9)]), "other", 0)
    assert all_of(collection)[0] == ("a", "z", 9)


def test_a_failed_write_leaves_the_snapshot(spark, collection):
    collection.upsert(docs(spark, [("a", "x", 1)]), "w", 0)
    bad = docs(spark, [("a", "y", 2), ("b", "y", 0)]).withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        collection.upsert(bad, "w", 1)
    assert all_of(collection) == [("a", "x", 1)]
    assert collection.upsert(docs(spark, [("a", "y", 2)]), "w", 1)
    assert all_of(collection) == [("a", "y", 2)]


@pytest.mark.parametrize(
    "schema, row",
    [("id string, n long", ("a", 1)), ("id string, kind long, n long", ("a", 1, 1)), ("id string, kind string, n string", ("a", "x", "1")), ("kind string, n long", ("x", 1)), ("id string, kind string, n long", (None, "x", 1))],
)
def test_rows_that_break_the_schema_are_refused(spark, collection, schema, row):
    collection.upsert(docs(spark, [("a", "x", 1)]))
    with pytest.raises(SchemaViolation):
        collection.upsert(spark.createDataFrame([row], schema))
    assert all_of(collection) == [("a", "x", 1)]


def test_a_writer_starts_again_from_the_others_snapshot(spark, collection, monkeypatch):
    collection.upsert(docs(spark, [("a", "x", 1)]))
    stale, entry = collection.entry(), collection.entry
    collection.upsert(docs(spark, [("b", "other", 1)]))
    seen = iter([stale, stale])
    monkeypatch.setattr(collection, "entry", lambda: next(seen, None) or entry())
    assert collection.upsert(docs(spark, [("a", "mine", 2)]))
    assert all_of(collection) == [("a", "mine", 2), ("b", "other", 1)]


def test_a_dead_writers_claim_can_be_given_back(spark, collection, monkeypatch):
    collection.upsert(docs(spark, [("a", "x", 1)]))
    target, fs = collection._fs(f"{collection.path}/claims/{2:020d}.json")
    fs.createNewFile(target)
    with pytest.raises(Conflict):
        collection.upsert(docs(spark, [("a", "y", 2)]), retries=2)
    assert all_of(collection) == [("a", "x", 1)]
    assert collection.abandon(2) and not collection.abandon(1)
    assert collection.upsert(docs(spark, [("a", "y", 2)]))


def test_the_newest_stays(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "last"), ["id"], newest="n")
    c.upsert(docs(spark, [("a", "x", 5), ("b", "x", 1)]))
    c.upsert(docs(spark, [("a", "old", 3), ("b", "new", 2)]))
    assert all_of(c) == [("a", "x", 5), ("b", "new", 2)]


def test_audits_are_kept_by_id(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "audits"), ["symbol", "date"], {"result": "string"})
    audits = spark.createDataFrame([("s", "2000-01-03", "FAIL", "x"), ("s", "2000-01-04", "PASS", "")], "symbol string, date string, result string, failed string")
    for batch in (0, 0, 1):
        c.upsert(audits, "audit", batch)
    assert sorted(map(tuple, c.read().collect())) == sorted(map(tuple, audits.collect()))
    assert len(c.versions()) == 2


def test_false_positives_are_as_expected():
    rng, bits, places = np.random.default_rng(3), 1 << 12, 4
    words, old = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
    ids = rng.integers(0, bits, (800, places))
    assert admission.add_if_absent(words, old, ids).mean() > 0.99
    assert not admission.add_if_absent(words, old, ids).any()
    refused = ~admission.add_if_absent(words.copy(), old, rng.integers(0, bits, (20_000, places)))
    # the same filter for all of them: new ids are added as one batch, after all were looked up
    assert refused.mean() == pytest.approx(admission.expected_rate(800, bits, places), rel=0.2)


def test_batches_share_filters_and_full_ones_turn_over(spark, tmp_path):
    path = str(tmp_path / "log")
    for k, ids in enumerate(([*range(200), *range(50)], [*range(100, 400)], [*range(1000)])):
        spark.createDataFrame(pd.DataFrame({"event_id": ids, "batch": k})).coalesce(1).write.mode("append").parquet(path)
    schema = "event_id long, batch long"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    judged = bus.drain(admission.admit(stream, filters=2, bits=1 << 14), str(tmp_path / "out"))
    report = admission.admission_report(judged, filters=2, bits=1 << 14).first()
    assert tuple(report)[:4] == (1550, 1000, 0, 0) and report["as_expected"]
    small = bus.drain(admission.admit(stream, filters=1, bits=1 << 14, capacity=100), str(tmp_path / "out2"))
    # ids from more than two turns ago are forgotten, later ones are not
    assert small.where("admitted").count() > 1000


def test_full_filters_forget_nothing_and_refuse_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    for k, ids in enumerate(([*range(2000), *range(50)], [*range(1000, 4000)], [*range(9000), None, None], [*range(9000), None])):
        spark.createDataFrame([(i, k) for i in ids], "event_id long, batch long").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("event_id long, batch long").option("maxFilesPerTrigger", 1).parquet(path)
    sizes = {"filters": 2, "bits": 1 << 10}  # far too small, so that most new ids look old
    judged = bus.drain(admission.admit_exactly(stream, capacity=100, **sizes), str(tmp_path / "out"))
    assert tuple(admission.admission_report(judged, **sizes).first())[:4] == (23053, 9001, 0, 0)


def test_the_streams_sample_is_the_batchs(spark, small):
    from gristmill.plans.streaming_queries import reservoir_k, reservoir_stream

    stream, batch = ({r["event_id"] for r in q(spark, small).collect()} for q in (reservoir_stream, reservoir_k))
    assert stream == batch and len(stream) == 500
