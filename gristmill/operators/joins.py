"""Interval and as-of joins over time, as windows over a union instead of inequality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import r6, safe_div
from gristmill.operators.features import W


def cutoff(date: str | object):
    """The information cutoff of a session: its day at 23:59."""
    day = F.col(date) if isinstance(date, str) else date
    return day.cast("timestamp") + F.expr("INTERVAL '23:59' HOUR TO MINUTE")


def news_window(sessions: DataFrame, news: DataFrame, days: int = 5) -> DataFrame:
    """For each (symbol, date) the news from ``days`` days before the cutoff to it, both included: count, mean
    sentiment and strength (0 without news), and whether there is any. News are summed first by symbol and minute, one
    on the minute's beginning apart from those inside it: windows begin and end where a minute begins, so none cuts a
    sum. Sessions and sums go through one shuffle and one range window, whose rows per symbol the minutes bound; no
    session is paired with each of its news."""
    minute = F.date_trunc("minute", "published_at")
    at = F.when(minute == F.col("published_at"), minute).otherwise(minute + F.expr("INTERVAL 30 SECONDS"))
    values = {"s": F.col("sentiment").cast("double"), "strength": F.abs("sentiment").cast("double")}
    parts = {}
    for c, x in values.items():  # sums of decimals are the same in any order; values that are none, such as NaN, are summed apart
        fits = x.try_cast("decimal(18,12)")
        parts |= {c: F.sum(fits), f"{c}_odd": F.sum(F.when(fits.isNull(), x))}
    sums = news.groupBy("symbol", at.alias("t")).agg(F.count("sentiment").alias("n"), *(x.alias(c) for c, x in parts.items()))
    asks = sessions.select("symbol", cutoff("date").alias("t"), "date")
    told = sums.withColumn("date", F.lit(None).cast("date"))
    w = Window.partitionBy("symbol").orderBy(F.unix_micros("t")).rangeBetween(-days * 86_400_000_000, 0)
    total = asks.unionByName(told, allowMissingColumns=True).select("symbol", "date", *(F.sum(c).over(w).alias(c) for c in ("n", *parts))).where("date is not null")
    mean = lambda c: F.try_divide(F.coalesce(F.col(c).cast("double") + F.col(f"{c}_odd"), F.col(c).cast("double"), F.col(f"{c}_odd")), F.col("n"))
    out = total.select("symbol", "date", F.coalesce("n", F.lit(0).cast("long")).alias("news_count"), mean("s").alias("s"), mean("strength").alias("st"))
    return out.select("symbol", "date", "news_count", r6(F.coalesce("s", F.lit(0.0))).alias("news_sentiment"), r6(F.coalesce("st", F.lit(0.0))).alias("news_strength"), (F.col("news_count") > 0).cast("double").alias("news_available"))


def news_slice(news: DataFrame, date: str, days: int = 5) -> DataFrame:
    end = cutoff(F.lit(date).cast("date"))
    return news.where((F.col("published_at") <= end) & (F.col("published_at") >= end - F.make_dt_interval(F.lit(days))))


def direct_coverage(sessions: DataFrame, news: DataFrame) -> DataFrame:
    """Share of sessions with news on their own day."""
    days = news.select("symbol", F.to_date("published_at").alias("date"), F.lit(1).alias("hit")).distinct()
    return sessions.join(days, ["symbol", "date"], "left").agg(F.count("*").alias("sessions"), F.count("hit").alias("covered"), r6(100 * F.count("hit") / F.count("*")).alias("coverage_pct"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], tie: str) -> DataFrame:
    """Each row of ``left`` with ``columns`` of the last row of ``right`` with the same keys and no later time;
    of equal times the greatest ``tie``. Null columns if there is none."""
    extra = [c for c in left.columns if c not in (*keys, time)]
    rows = left.withColumns({"__r": F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType), "__left": F.lit(1), "__tie": F.lit(None).cast(right.schema[tie].dataType)})
    seen = right.select(*keys, time, *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in extra), F.struct(*columns).alias("__r"), F.lit(0).alias("__left"), F.col(tie).alias("__tie"))
    w = Window.partitionBy(*keys).orderBy(time, "__left", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.unionByName(seen).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__left = 1")
    return out.select(*left.columns, *(F.col("__r")[c].alias(c) for c in columns))


def replay(bars: DataFrame, every: int, horizon: int, cost: float = 0.0018) -> DataFrame:
    """Every k-th session of each symbol as an anchor: a verdict from what was known then, and its grade by
    what came ``horizon`` sessions later. All anchors at once."""
    past, future = F.lag("close", horizon).over(W()), F.lead("close", horizon).over(W())
    rows = bars.select("symbol", "date", "close", past.alias("past"), future.alias("future"), F.row_number().over(W()).alias("n")).where(F.col("n") % every == 1)
    move = safe_div(F.col("close"), F.col("past")) - 1
    verdict = F.when(move.isNull() | (F.abs(move) < 0.25), "NO ACTION").when(F.col("close") > F.col("past"), "POSITIVE").otherwise("NEGATIVE")
    rows = rows.select("symbol", "date", verdict.alias("verdict"), (F.tanh(safe_div(F.col("future"), F.col("close")) - 1) / 50).alias("ret"))
    abstained = F.when(F.abs("ret") < cost, "GOOD_ABSTENTION").when(F.col("ret") > 0, "MISSED_OPPORTUNITY").otherwise("AVOIDED_LOSS")
    grade = F.when(F.col("ret").isNull(), "PENDING").when(F.col("verdict") == "NO ACTION", abstained).when((F.col("verdict") == "POSITIVE") == (F.col("ret") > 0), "CORRECT").otherwise("INCORRECT")
    return rows.select("symbol", "date", "verdict", r6(F.col("ret")).alias("realised"), grade.alias("grade"))
