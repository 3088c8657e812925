"""The input tables as the operators want them: dates and UTC timestamps instead of zoneless ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; zoneless timestamps become timestamps, read as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def sector_of(symbol: Column) -> Column:
    return F.when(symbol < "3", "FAST").otherwise("SLOW")


def _bars(df: DataFrame, keys: dict[str, Column], key: str, price: Column) -> DataFrame:
    """open, high, low, close, volume by keys: the first and last price by row key."""
    return df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("volume")
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, open, high, low, close, volume, sector): daily bars of order prices by priority."""
    orders = read(spark, sf_dir, "orders")
    out = _bars(orders, {"symbol": F.col("o_orderpriority"), "date": F.to_date("o_orderdate")}, "o_orderkey", F.col("o_totalprice"))
    return out.withColumn("sector", sector_of(F.col("symbol")))


def benchmark_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all orders of a day."""
    return _bars(read(spark, sf_dir, "orders"), {"date": F.to_date("o_orderdate")}, "o_orderkey", F.col("o_totalprice"))


def bars_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    keys = {"symbol": F.concat("l_returnflag", "l_linestatus"), "date": F.to_date("l_shipdate")}
    return _bars(items, keys, "k", F.col("l_extendedprice") / F.col("l_quantity"))


def hourly_bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("k", F.struct("ts", "event_id"))
    return _bars(events, {"symbol": F.col("event_type"), "hour": F.date_trunc("hour", "ts")}, "k", F.col("value"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(news_id, symbol, published_at, sentiment, strength): clicks stand for headlines about their users."""
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 250 - 1))
    return clicks.select(F.col("event_id").alias("news_id"), F.col("user_id").alias("symbol"), F.col("ts").alias("published_at"), score.alias("sentiment"), F.abs(score).alias("strength"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date): days on which a user has views."""
    return read(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date")).distinct()
