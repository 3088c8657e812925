"""Sketches and online statistics as batch twins of the stream operators: mergeable group-bys and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import by, lowest_bit, r6, safe_div

PHI = 0.77351


def event_tape(events: DataFrame, every: int = 50) -> DataFrame:
    """Events in order within their type, with returns, and every k-th again as ``replayed``."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    tape = events.select("event_id", "ts", "event_type", "value", (safe_div(F.col("value"), F.lag("value", 1).over(w)) - 1).alias("ret"), F.row_number().over(w).alias("n"))
    again = tape.where(F.col("n") % every == 1)
    return tape.withColumn("replayed", F.lit(False)).unionByName(again.withColumn("replayed", F.lit(True))).drop("n")


def fm_distinct(df: DataFrame, column: str, registers: int = 256) -> DataFrame:
    """Flajolet-Martin with stochastic averaging: each register ors the lowest bits of its hashes."""
    h = F.xxhash64(column)
    slot, rest = F.pmod(h, F.lit(registers)), F.shiftrightunsigned(h, 16)
    bits = df.select(slot.alias("slot"), F.least(lowest_bit(rest), F.lit(62)).alias("rho")).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, rho)")).alias("bits"))
    # the place of the lowest 0 of each register; registers without values have place 0
    sums = bits.agg(F.sum(lowest_bit(F.bitwise_not("bits"))).alias("s"))
    return sums.select(r6(registers / PHI * F.pow(F.lit(2.0), F.col("s") / registers), 3).alias("estimate"))


def bloom_bits(df: DataFrame, column: str, bits: int = 1 << 20, hashes: int = 7) -> DataFrame:
    """(word, mask): the set bits of a Bloom filter, 32 to a word; double hashing."""
    h1, h2 = F.pmod(F.xxhash64(column), F.lit(bits)), F.pmod(F.xxhash64(column, F.lit(17)), F.lit(bits))
    places = F.explode(F.array(*(F.pmod(h1 + F.lit(i) * h2, F.lit(bits)) for i in range(hashes))))
    rows = df.select(places.alias("p")).select(F.floor(F.col("p") / 32).alias("word"), (F.col("p") % 32).cast("int").alias("b"))
    return rows.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("mask"))


def bloom_stats(df: DataFrame, column: str, bits: int = 1 << 20, hashes: int = 7) -> DataFrame:
    """Fill of the filter and the share of false positives to expect."""
    words = bloom_bits(df, column, bits, hashes).agg(F.sum(F.bit_count("mask")).alias("ones"))
    n = df.agg(F.approx_count_distinct(column).alias("n"))
    return words.crossJoin(n).select((F.col("ones") / bits).alias("fill_ratio"), F.pow(1 - F.exp(-hashes * F.col("n") / bits), hashes).alias("expected_fp"))  # one row each


def reservoir(df: DataFrame, key: str, k: int = 500, seed: int = 7) -> DataFrame:
    """A uniform sample of k rows: the least hashes. Partitions keep k each, then k of those."""
    return df.withColumn("__h", F.xxhash64(key, F.lit(seed))).orderBy("__h", key).limit(k).drop("__h")


def welford_anomalies(events: DataFrame, key: str = "event_type", least: int = 30, threshold: float = 3.0) -> DataFrame:
    """The batch twin: z against all earlier values of the key."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    z = safe_div(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    rows = events.withColumns({"n": F.count("value").over(w), "z": z})
    return rows.where((F.col("n") >= least) & (F.abs("z") >= threshold)).select(key, "event_id", r6(F.col("z")).alias("z"))


def exact_window_ones(bits: DataFrame, window: int) -> DataFrame:
    """Ones among the last ``window`` bits, at each bit."""
    return bits.withColumn("ones", F.sum("bit").over(by("key", order="at").rowsBetween(1 - window, 0)))


def decayed_counts(events: DataFrame, key: str = "event_type", half_life_s: float = 86_400.0) -> DataFrame:
    """Closed form of the decayed count as of each key's last event."""
    last = events.groupBy(key).agg(F.max("ts").alias("last"))
    age = (F.unix_micros("last") - F.unix_micros("ts")) / 1e6
    return events.join(last, key).groupBy(key).agg(r6(F.sum(F.pow(F.lit(2.0), -age / half_life_s)), 6).alias("attention"))
