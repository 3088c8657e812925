"""Backward-looking features of a panel of bars, its cross-section, its benchmark, and forward labels.

One partitioning by symbol serves all time windows; Spark sorts once for them. Rolling values are null until their
window is full. The cross-section is a window by date, not a join with an aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import by, r6, rolling, safe_div
from gristmill.operators.order_statistics import COUNTS, rolling_counts

ANNUAL = math.sqrt(252.0)
#: Rows of a block of the exponential average: weights inside a block and the one before stay in range.
EMA_BLOCK = 1000
#: Features by family.
FAMILIES = {
    "returns": ["ret_1", "ret_5", "ret_20"],
    "log_return_gap_range": ["log_ret_1", "gap_pct", "range_pct"],
    "realised_vol": ["vol_20", "vol_60", "vol_ratio"],
    "sma_gaps": ["sma_10_gap", "sma_50_gap", "trend_strength"],
    "bollinger": ["bb_pos", "bb_width"],
    "volume_z": ["volume_z", "rel_volume", "dollar_volume_log"],
    "high_low_gaps": ["close_to_high_20", "close_to_low_20"],
    "rsi_14": ["rsi_14"],
    "ema_macd": ["ema_12_gap", "macd", "macd_signal", "macd_hist"],
    "beta_corr_60": ["beta_60", "corr_bench_60"],
    "excess_return": ["bench_ret_1", "bench_ret_5", "bench_vol_20", "excess_ret_1"],
    "sector_context": ["sector_ret_1", "sector_breadth"],
    "market_breadth_ctx": ["market_breadth"],
    "vol_percentile_252": ["regime_vol_percentile"],
}
FEATURES = [c for family in FAMILIES.values() for c in family]
FUTURE_PREFIXES = ("fwd_", "label_", "future_", "target_", "outcome_", "next_")


def W():  # noqa: N802
    """The time order of each symbol."""
    return by("symbol")


def forbid_future(columns: list[str]) -> None:
    """Raise if a column's name says that it comes from the future."""
    bad = [c for c in columns if c.startswith(FUTURE_PREFIXES)]
    if bad:
        raise ValueError(f"columns from the future among the features: {', '.join(bad)}")


def emas(df: DataFrame, *series: tuple[str, int, str]) -> DataFrame:
    """Exponential averages (source, span, to) with weight 2 / (span + 1), begun at the first value, by symbol and
    row number ``i`` from 0. Within a block a prefix sum has it; the block before comes in by its own sum, and
    what lies before that weighs less than a double can hold for spans up to 26. All series of a call share
    one sort."""
    block, at = F.floor(F.col("i") / EMA_BLOCK), F.col("i") % EMA_BLOCK
    df = df.withColumn("block", block)
    inside = Window.partitionBy("symbol", "block").orderBy("i")
    last = Window.partitionBy("symbol").orderBy("block").rangeBetween(-1, -1)
    out = {}
    for source, span, to in series:
        b = 1 - 2 / (span + 1)
        scaled = F.when(F.col("i") == 0, 1.0).otherwise(1 - b) * F.col(source) * F.pow(F.lit(b), -at)
        carried = F.coalesce(F.sum(scaled).over(last), F.lit(0.0)) * b**EMA_BLOCK
        out[to] = F.pow(F.lit(b), at) * (F.sum(scaled).over(inside) + carried)
    return df.withColumns(out).drop("block")


def price_features(bars: DataFrame) -> DataFrame:
    close, lag = F.col("close"), F.lag("close", 1).over(W())
    base = bars.withColumns(
        {
            "i": F.row_number().over(W()) - 1,
            **{f"ret_{n}": safe_div(close, F.lag("close", n).over(W())) - 1 for n in (1, 5, 20)},
            "log_ret_1": F.ln(safe_div(close, lag)),
            "gap_pct": safe_div(F.col("open"), lag) - 1,
            "range_pct": safe_div(F.col("high") - F.col("low"), close),
            "chg": close - lag,
        }
    )
    base = base.withColumns({"gain": F.when(F.col("chg") > 0, F.col("chg")).otherwise(F.when(F.col("chg").isNotNull(), 0.0)), "loss": F.when(F.col("chg") < 0, -F.col("chg")).otherwise(F.when(F.col("chg").isNotNull(), 0.0))})
    rolled = base.withColumns(
        {
            "vol_20": rolling(F.stddev_samp, "log_ret_1", 20, W()) * ANNUAL,
            "vol_60": rolling(F.stddev_samp, "log_ret_1", 60, W()) * ANNUAL,
            **{f"sma_{n}": rolling(F.avg, "close", n, W()) for n in (10, 20, 50)},
            "std_20": rolling(F.stddev_samp, "close", 20, W()),
            "vol_mean_20": rolling(F.avg, "volume", 20, W()),
            "vol_std_20": rolling(F.stddev_samp, "volume", 20, W()),
            "high_20": rolling(F.max, "high", 20, W()),
            "low_20": rolling(F.min, "low", 20, W()),
            "avg_gain": rolling(F.avg, "gain", 14, W()),
            "avg_loss": rolling(F.avg, "loss", 14, W()),
        }
    )
    rolled = emas(rolled, ("close", 12, "ema_12"), ("close", 26, "ema_26"))
    rolled = emas(rolled.withColumn("macd", F.col("ema_12") - F.col("ema_26")), ("macd", 9, "macd_signal"))
    c = F.col
    return rolled.withColumns(
        {
            "vol_ratio": safe_div(c("vol_20"), c("vol_60")),
            "sma_10_gap": safe_div(c("close"), c("sma_10")) - 1,
            "sma_50_gap": safe_div(c("close"), c("sma_50")) - 1,
            "trend_strength": safe_div(c("sma_10") - c("sma_50"), c("sma_50")),
            "bb_pos": safe_div(c("close") - c("sma_20"), 2 * c("std_20")),
            "bb_width": safe_div(4 * c("std_20"), c("sma_20")),
            "volume_z": safe_div(c("volume") - c("vol_mean_20"), c("vol_std_20")),
            "rel_volume": safe_div(c("volume"), c("vol_mean_20")),
            "dollar_volume_log": F.log1p(c("close") * c("volume")),
            "close_to_high_20": safe_div(c("close"), c("high_20")) - 1,
            "close_to_low_20": safe_div(c("close"), c("low_20")) - 1,
            "rsi_14": 100 - 100 / (1 + c("avg_gain") / F.when(c("avg_loss") == 0, 1e-9).otherwise(c("avg_loss"))),
            "ema_12_gap": safe_div(c("close"), c("ema_12")) - 1,
            "macd_hist": c("macd") - c("macd_signal"),
        }
    )


def benchmark_features(bench: DataFrame) -> DataFrame:
    """Features of the benchmark's own series by date. It is one series, so one partition holds it; its rows are
    days, not records."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    lag = lambda n: F.lag("close", n).over(w)
    out = bench.select("date", (safe_div(F.col("close"), lag(1)) - 1).alias("bench_ret_1"), (safe_div(F.col("close"), lag(5)) - 1).alias("bench_ret_5"), (safe_div(F.col("close"), lag(20)) - 1).alias("bench_trend_20"), F.ln(safe_div(F.col("close"), lag(1))).alias("bench_log_ret_1"))
    return out.withColumns({f"bench_vol_{n}": rolling(F.stddev_samp, "bench_log_ret_1", n, w) * ANNUAL for n in (20, 60)})


def context_features(features: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark, sector and market columns. A missing return counts as not advancing."""
    up = F.coalesce(F.col("ret_1") > 0, F.lit(False)).cast("double")
    df = features.join(benchmark_features(bench), "date", "left")
    df = df.withColumns(
        {
            "excess_ret_1": F.col("ret_1") - F.col("bench_ret_1"),
            "sector_ret_1": F.avg("ret_1").over(Window.partitionBy("date", "sector")),
            "sector_breadth": F.avg(up).over(Window.partitionBy("date", "sector")),
            "market_breadth": F.avg(up).over(Window.partitionBy("date")),
        }
    )
    both = F.when(F.col("log_ret_1").isNotNull(), F.col("bench_log_ret_1"))
    own = F.when(F.col("bench_log_ret_1").isNotNull(), F.col("log_ret_1"))
    frame = W().rowsBetween(-59, 0)
    # moments instead of corr(), which raises on a constant series
    mean = lambda x: F.avg(x).over(frame)
    full = F.count(both).over(frame) == 60
    cov = F.covar_samp(own, both).over(frame)
    df = df.withColumns({"__cov": F.when(full, cov), "__var_b": F.when(full, F.var_samp(both).over(frame)), "__var_o": F.when(full, F.var_samp(own).over(frame)), "__m": mean(own)})
    return df.withColumns({"beta_60": safe_div(F.col("__cov"), F.col("__var_b")), "corr_bench_60": safe_div(F.col("__cov"), F.sqrt(F.col("__var_b") * F.col("__var_o")))}).drop("__cov", "__var_b", "__var_o", "__m")


def vol_percentile(df: DataFrame, n: int = 252, least: int = 60) -> DataFrame:
    """``df`` with the rank of its volatility among the symbol's last n, ties averaged, as a share; null below ``least``
    values."""
    share = (F.col("below") + (F.col("same") + 1) / 2) / F.col("seen")
    counted = rolling_counts(df, ["symbol"], "date", "vol_20", n)
    return counted.withColumn("regime_vol_percentile", F.when(F.col("vol_20").isNotNull() & (F.col("seen") >= least), share)).drop(*COUNTS)


def feature_matrix(bars: DataFrame, bench: DataFrame, percentile: bool = False) -> DataFrame:
    """All features; the volatility's percentile, which is counted by itself, where it is asked for."""
    df = context_features(price_features(bars), bench)
    return vol_percentile(df) if percentile else df


def select_features(df: DataFrame, columns: list[str]) -> DataFrame:
    forbid_future(columns)
    return df.select("symbol", "date", *(r6(F.col(c)).alias(c) for c in columns))


def forward_labels(bars: DataFrame, horizons: tuple[int, ...] = (1, 3, 5, 20)) -> DataFrame:
    """For each horizon the return to the h-th next session, its direction, and the date it is known."""
    out = [F.col("symbol"), F.col("date")]
    for h in horizons:
        ret = safe_div(F.lead("close", h).over(W()), F.col("close")) - 1
        out += [r6(ret).alias(f"fwd_ret_{h}"), F.when(ret.isNotNull(), (ret > 0).cast("double")).alias(f"label_dir_{h}"), F.lead("date", h).over(W()).alias(f"label_known_at_{h}")]
    return bars.select(*out)


def lagged(df: DataFrame, columns: list[str], n: int = 1) -> DataFrame:
    return df.select("symbol", "date", *(r6(F.lag(c, n).over(W())).alias(f"{c}_lag{n}") for c in columns))


def truncation_offenders(bars: DataFrame, bench: DataFrame, until: Column, columns: list[str]) -> DataFrame:
    """Rows whose features change when data after ``until`` is taken away: there should be none."""
    percentile = "regime_vol_percentile" in columns
    full = feature_matrix(bars, bench, percentile).where(F.col("date") <= until).select("symbol", "date", F.array(*(F.col(c).cast("double") for c in columns)).alias("a"))
    cut = feature_matrix(bars.where(F.col("date") <= until), bench.where(F.col("date") <= until), percentile).select("symbol", "date", F.array(*(F.col(c).cast("double") for c in columns)).alias("b"))
    differs = F.exists(F.arrays_zip("a", "b"), lambda x: ~(x["a"].eqNullSafe(x["b"]) | F.coalesce(F.abs(x["a"] - x["b"]) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x["a"])), F.lit(False))))
    return full.join(cut, ["symbol", "date"]).where(differs).select("symbol", "date")
