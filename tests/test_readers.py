"""Sources of our own: pieces of logs, offsets after a restart, pushed filters, feeds, and the choice of a bus."""

import datetime as dt
import json
import socket

import pytest

from gristmill.sources import readers
from gristmill.streaming import bus

SCHEMA = "id long, kind string, x double"


@pytest.fixture
def log(spark, tmp_path):
    readers.register(spark)
    folder = tmp_path / "log"
    folder.mkdir()

    def add(name, rows, mode="a"):
        with open(folder / name, mode) as f:
            f.writelines(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows)

    return folder, add


def test_odd_lines_and_small_pieces(spark, log, monkeypatch):
    folder, add = log
    rows = [{"id": i, "kind": "é" * (i % 7), "x": i / 3} for i in range(200)]
    add("a.json", [*rows[:90], "\n", "not json\n", '["list"]\n', '{"id": "text", "kind": 7, "x": true}\n', '{"id": 5.0, "other": 1}\n', *rows[90:]])
    add("_mark", ["x"])
    monkeypatch.setattr(readers, "SPLIT", 37)
    got = [tuple(r) for r in spark.read.format("json_log").schema(SCHEMA).load(f"file://{folder}").collect()]
    assert sorted(got, key=str) == sorted([(r["id"], r["kind"], r["x"]) for r in rows] + [(None, "7", None), (5, None, None)], key=str)


def test_filters_reach_the_reader(spark, log):
    folder, add = log
    add("a.json", [{"id": i, "kind": "ab"[i % 2], "x": float(i)} for i in range(50)])
    df = spark.read.format("json_log").schema(SCHEMA).load(str(folder)).where("kind = 'a' and id >= 40 and x + 1 < 48")
    assert sorted(r["id"] for r in df.collect()) == [40, 42, 44, 46]
    reader = readers.LogReader(str(folder), spark.createDataFrame([], SCHEMA).schema)
    left = list(reader.pushFilters([readers.EqualTo(("kind",), "a"), readers.GreaterThan(("nested", "x"), 1)]))
    assert len(left) == 1 and reader.filters == [("kind", readers.EqualTo, "a")]


def test_an_empty_folder(spark, log):
    assert spark.read.format("json_log").schema(SCHEMA).load(str(log[0])).collect() == []
    assert spark.read.format("feed").load(str(log[0])).collect() == []


def test_a_stream_goes_on_after_a_restart(spark, log, tmp_path):
    folder, add = log
    add("a.json", [{"id": 1}, {"id": 2}])
    add("b.json", [{"id": 3}])

    def run():
        stream = spark.readStream.format("json_log").schema(SCHEMA).option("mostFiles", 1).load(str(folder))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == sorted(set(first)) and set(first) <= {1, 2, 3}
    add("a.json", [{"id": 4}])
    add("c.json", [{"id": 5}])
    for _ in range(4):
        ids = run()
    assert ids == [1, 2, 3, 4, 5]


def test_feeds(spark, log):
    folder, _ = log
    (folder / "one.xml").write_text(
        "<rss><channel><title>Harbour news</title><item><title>Tides &amp; wind</title><link>http://x/1</link><pubDate>Mon, 03 Jan 2000 10:00:00 +0200</pubDate><source url='u'>Port</source></item>"
        "<item><title>No date</title><pubDate>soon</pubDate></item><item><link>untitled</link></item></channel></rss>"
    )
    (folder / "broken.xml").write_text("<rss><channel><title>B</title><item><title>kept</title></item><item><title>lost")
    (folder / "empty.xml").write_text("")
    got = sorted(map(tuple, spark.read.format("feed").load(str(folder)).collect()), key=str)
    assert [(r[0], r[1], r[3]) for r in got] == [("No date", None, "Harbour news"), ("Tides & wind", "http://x/1", "Port"), ("kept", None, "B")]
    assert got[1][2] == dt.datetime(2000, 1, 3, 8, 0) and got[0][2] is None


def test_a_bus_that_does_not_answer_falls_back_and_says_so(spark, log, monkeypatch):
    folder, add = log
    add("a.json", [{"id": 1}])
    _, how = bus.choose(spark, SCHEMA, str(folder))
    assert how["mode"] == "log" and "no servers" in how["reason"]
    _, how = bus.choose(spark, SCHEMA, str(folder), "localhost:1", "t")
    assert how["mode"] == "log" and "package" in how["reason"]
    monkeypatch.setattr(bus, "kafka_here", lambda spark: True)
    stream, how = bus.choose(spark, SCHEMA, str(folder), "localhost:1,bad", "t")
    assert how == {"mode": "log", "place": str(folder), "reason": "no server of localhost:1,bad answers"}
    assert stream.isStreaming
    with socket.socket() as server:
        server.bind(("localhost", 0))
        server.listen()
        monkeypatch.setattr(bus, "kafka", lambda *a: "topic")
        assert bus.choose(spark, SCHEMA, str(folder), f"localhost:{server.getsockname()[1]}", "t")[1]["mode"] == "kafka"
