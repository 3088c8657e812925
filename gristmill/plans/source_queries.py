"""Bars from three tables, the lake, files and documents."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.expr import r6
from gristmill.plans.base_sql import BARS
from gristmill.sources import lake as lk
from gristmill.sources import readers
from gristmill.sources import tables as tb
from gristmill.streaming import bus


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share."""
    path = f"{lk.shared_folder(spark)}/lake-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def bars_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.bars(spark, sf_dir)


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.bars_from_lineitem(spark, sf_dir)


def bars_from_events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tb.hourly_bars_from_events(spark, sf_dir)
    return bars.select("symbol", F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "open", "high", "low", "close", "volume")


def _stored(spark: SparkSession, sf_dir: str) -> lk.Lake:
    lake = lk.Lake(spark, scratch(spark))
    lake.write(tb.bars(spark, sf_dir), "curated", "ohlcv")
    return lake


def lake_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written by symbol and year, read back with columns and partitions pruned."""
    return _stored(spark, sf_dir).read("curated", "ohlcv", ["symbol", "date", "close"], "symbol = '2-HIGH' and year = 1997")


def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _stored(spark, sf_dir)
    lake.write(tb.read(spark, sf_dir, "events").select("event_id", "value"), "raw", "events", ())
    parts = lake.manifest("curated", "ohlcv").unionByName(lake.manifest("raw", "events"))
    return parts.select("zone", "dataset", "rows", F.array_join("columns", ",").alias("columns"))


def text_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars through CSV, TSV with malformed lines left out, and JSON lines."""
    bars = tb.bars(spark, sf_dir).select("symbol", "date", "close")
    root, schema = scratch(spark), "symbol string, date date, close double"
    bars.write.csv(f"{root}/csv", header=True)
    bars.select(F.concat_ws("\t", "symbol", "date", F.col("close").cast("string")).alias("value")).union(spark.sql("select 'broken\tline'")).write.text(f"{root}/tsv")
    bars.write.json(f"{root}/json")
    frames = {
        "csv": spark.read.csv(f"{root}/csv", schema=schema, header=True),
        "tsv": spark.read.csv(f"{root}/tsv", schema=schema, sep="\t", mode="DROPMALFORMED").na.drop(),
        "json": spark.read.schema(schema).json(f"{root}/json"),
    }
    out = None
    for name, df in frames.items():
        part = df.groupBy("symbol").agg(F.count("*").alias("n"), r6(F.sum("close"), 2).alias("total")).select(F.lit(name).alias("format"), "*")
        out = part if out is None else out.union(part)
    return out


def file_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a stored dataset equals that of a copy under other file names, and differs from that of a dataset
    with one other value."""
    lake = _stored(spark, sf_dir)
    lake.copy("curated", "ohlcv", "curated", "renamed")
    bars = tb.bars(spark, sf_dir)
    first = bars.agg(F.min(F.struct("symbol", "date")).alias("first"))
    lake.write(bars.crossJoin(first).withColumn("close", F.when(F.struct("symbol", "date") == F.col("first"), F.col("close") + 1).otherwise(F.col("close"))).drop("first"), "curated", "changed")  # one row
    a, b, c = (lake.fingerprint("curated", d).select(F.col("digest").alias(n)) for n, d in (("a", "ohlcv"), ("b", "renamed"), ("c", "changed")))
    return a.crossJoin(b).crossJoin(c).select(((F.col("a") == F.col("b")) & (F.col("a") != F.col("c"))).alias("same"))  # one row each


def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tb.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    fresh = stored.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0.0)).union(stored.where("c_custkey <= 5").withColumn("c_custkey", -F.col("c_custkey")))
    return lk.upsert(stored, fresh, ["c_custkey"])


def document_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.find(tb.read(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING"}, [("c_acctbal", -1), ("c_custkey", 1)], 25).select("c_custkey", "c_acctbal")


def document_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.read(spark, sf_dir, "supplier")
    old = rows.where("s_suppkey <= 60").select(F.concat(F.lit("s."), F.col("s_suppkey").cast("string")).alias("path"), F.lit("old").alias("value"))
    new = rows.where("s_suppkey > 40").select(F.concat(F.lit("s."), F.col("s_suppkey").cast("string")).alias("path"), F.lit("new").alias("value"))
    return lk.merge_documents(old, new)


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def xml_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an XML feed, one a nation, parsed with a schema."""
    items = tb.read(spark, sf_dir, "nation").select(F.format_string("<item><title>%s &amp; co</title><id>%d</id></item>", "n_name", "n_nationkey").alias("x"))
    return items.select(F.from_xml("x", "title string, id int").alias("i")).select("i.id", "i.title")


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed files with an item an event, written and read back: title, source and day of publication."""
    readers.register(spark)
    events = tb.read(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss").alias("at"))
    folder = scratch(spark)

    def feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<rss version='2.0'><channel><title>events</title>"]})
        for b in batches:
            items = "<item><title>" + b["event_type"] + " &amp; " + b["event_id"].astype(str) + "</title><pubDate>" + b["at"] + " +0000</pubDate>"
            yield pd.DataFrame({"value": items + np.where(b["event_id"] % 2 == 0, "<source url='x'>even</source></item>", "</item>")})
        yield pd.DataFrame({"value": ["</channel></rss>"]})

    events.repartition(3, "event_id").mapInPandas(feed, "value string").write.text(folder)
    return spark.read.format("feed").load(folder).select("title", F.to_date("published_at").alias("day"), "source")


def _event_log(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch(spark)
    events = tb.read(spark, sf_dir, "events").select("event_id", "event_type", "value").withColumn("line", F.to_json(F.struct("*")))
    broken = F.when(F.col("event_id") % 100 == 0, F.array(F.lit(""), F.lit('{"event_id": '), F.col("line"))).otherwise(F.array("line"))
    events.select("event_id", F.explode(broken).alias("value")).repartition(3, "event_id").select("value").write.text(folder)
    return folder


def json_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines, blank and broken ones among them, read with a filter that reaches the reader."""
    readers.register(spark)
    log = spark.read.format("json_log").schema("event_id long, event_type string, value double").load(_event_log(spark, sf_dir))
    return log.where("event_type = 'click' and value > 50").select("event_id", "value")


def json_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream, by bytes of each file."""
    readers.register(spark)
    log = spark.readStream.format("json_log").schema("event_id long, event_type string, value double").load(_event_log(spark, sf_dir))
    return bus.drain(log, scratch(spark)).groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


def map_reduce_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest price of each symbol and year, combined in tasks before the shuffle."""
    key = F.concat_ws("/", "symbol", F.year("date").cast("string"))
    return tb.bars(spark, sf_dir).groupBy(key.alias("key")).agg(F.max("high").alias("value"))


QUERIES = {f.__name__: f for f in (bars_from_orders, bars_from_lineitem, bars_from_events_hourly, lake_roundtrip, inventory_counts, text_formats, file_fingerprint, document_upsert, document_find, document_merge, provenance, xml_feed, feed_items, json_log_scan, json_log_stream, map_reduce_volume)}
ORACLES = {
    "bars_from_orders": f"WITH {BARS} SELECT * FROM bars",
    "bars_from_lineitem": """WITH x AS (SELECT *, l_extendedprice / l_quantity AS pr, {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey} AS k FROM lineitem)
      SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS date, arg_min(pr, k) AS open, max(pr) AS high, min(pr) AS low, arg_max(pr, k) AS close, count(*) AS volume FROM x GROUP BY 1, 2""",
    "bars_from_events_hourly": "WITH x AS (SELECT *, {'a': ts, 'b': event_id} AS k FROM events) SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, arg_min(value, k) AS open, max(value) AS high, min(value) AS low, arg_max(value, k) AS close, count(*) AS volume FROM x GROUP BY 1, 2",
    "lake_roundtrip": f"WITH {BARS} SELECT symbol, date, close FROM bars WHERE symbol = '2-HIGH' AND year(date) = 1997",
    "inventory_counts": f"WITH {BARS} SELECT 'curated' AS zone, 'ohlcv' AS dataset, count(*) AS rows, 'close,date,high,low,open,sector,symbol,volume,year' AS columns FROM bars UNION ALL SELECT 'raw', 'events', count(*), 'event_id,value' FROM events",
    "text_formats": f"WITH {BARS}, g AS (SELECT symbol, count(*) AS n, round(sum(close), 2) AS total FROM bars GROUP BY 1) SELECT unnest(['csv', 'tsv', 'json']) AS format, * FROM g",
    "file_fingerprint": "SELECT true AS same",
    "document_upsert": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END::DOUBLE AS c_acctbal FROM customer UNION ALL SELECT -c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey <= 5",
    "document_find": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25",
    "document_merge": "SELECT 's.' || s_suppkey AS path, CASE WHEN s_suppkey > 40 THEN 'new' ELSE 'old' END AS value FROM supplier",
    "provenance": f"WITH {BARS} SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1",
    "xml_feed": "SELECT n_nationkey AS id, n_name || ' & co' AS title FROM nation",
    "feed_items": "SELECT event_type || ' & ' || event_id AS title, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'events' END AS source FROM events",
    "json_log_scan": "SELECT event_id, value FROM events WHERE event_type = 'click' AND value > 50",
    "json_log_stream": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1",
    "map_reduce_volume": f"WITH {BARS} SELECT symbol || '/' || year(date) AS key, max(high) AS value FROM bars GROUP BY 1",
}
