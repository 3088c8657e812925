"""Profiles, breadth, inverted indexes, and the triage of bars. Group-bys combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import by, r6, safe_div, tags
from gristmill.operators.features import W
from gristmill.operators.order_statistics import exact_quantiles
from gristmill.sources.lake import written

#: Stop lists of the two presets of the inverted index.
STOP_LOCAL = (
    "the a an to of in on for and is at as by with from share shares stock nse bse india its after this that be it news update live price".split()
)
STOP_STRICT = (
    "the a an to of in on for and is as at by with from its it be has have will after over that this are was new says say amid may but not up down".split()
)


def symbol_year_profile(bars: DataFrame) -> DataFrame:
    span = 100 * (F.col("year_high") - F.col("year_low")) / F.greatest("year_low", F.lit(1e-9))
    out = bars.groupBy("symbol", F.year("date").alias("year")).agg(
        F.count("*").alias("sessions"), F.round(F.avg("close"), 4).alias("avg_close"), F.sum("volume").cast("long").alias("total_volume"), F.max("high").alias("year_high"), F.min("low").alias("year_low")
    )
    return out.withColumn("range_pct", F.round(span, 2))


def breadth(bars: DataFrame, dead_band: float = 0.0) -> DataFrame:
    """Per day how many symbols closed above, below or at their open; returns within the dead band are
    unchanged. Rows without a positive open are left out."""
    ret = F.col("close") / F.col("open") - 1
    rows = bars.where("open > 0 and close is not null").withColumn("ret", ret)
    up, down = F.count_if(F.col("ret") > dead_band), F.count_if(F.col("ret") < -dead_band)
    return rows.groupBy("date").agg(
        up.alias("advancers"), down.alias("decliners"), (F.count("*") - up - down).alias("unchanged"), r6(up / F.count("*")).alias("breadth_ratio"), (up - down).alias("net_breadth"), r6(F.avg("ret")).alias("mean_session_return"), F.sum("volume").cast("long").alias("session_volume")
    )


def terms_local(text: Column) -> Column:
    """Distinct words: split at white space and apostrophes, letters only, four or more, no stop words."""
    # all but letters and white space goes in one pass over the text, not word by word
    words = F.split(F.regexp_replace(F.lower(F.replace(text, F.lit("'"), F.lit(" "))), r"[^\p{L}\s]", ""), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_LOCAL)))


def terms_strict(text: Column) -> Column:
    """Distinct tokens of a letter and letters, digits or '&.-, without . - ' at the ends, three or more."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9'&.-]+"), 0)
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[.'-]+|[.'-]+$", ""))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_STRICT)))


def inverted_index(docs: DataFrame, terms: Column, symbol: str, least: int = 3) -> DataFrame:
    """(term, documents, symbols, postings): for terms of ``least`` documents or more, the documents of each
    symbol as canonical text ``symbol:count``. Counts are combined by (term, symbol) before terms meet."""
    pairs = docs.select(F.col(symbol).alias("symbol"), F.explode(terms).alias("term")).groupBy("term", "symbol").count()
    out = pairs.groupBy("term").agg(F.sum("count").alias("documents"), F.count("*").alias("symbols"), F.sort_array(F.collect_list(F.concat_ws(":", "symbol", F.col("count").cast("string")))).alias("p"))
    return out.where(F.col("documents") >= least).select("term", "documents", "symbols", F.array_join("p", ",").alias("postings"))


#: Reasons in the order they are looked for.
INVALID = ("missing_values", "negative_values", "non_positive_price", "high_below_low", "impossible_ohlc", "duplicate_rows", "future_timestamp")
SUSPICIOUS = ("weekend_timestamp", "extreme_return", "calendar_gap", "zero_volume", "stale_price_run", "return_outlier_mad")


def _sliding(df: DataFrame) -> DataFrame:
    ret = safe_div(F.col("close"), F.lag("close", 1).over(W())) - 1
    diff = F.col("close") - F.lag("close", 1).over(W())
    df = df.withColumns({"ret": ret, "gap": F.datediff("date", F.lag("date", 1).over(W())), "flat": F.sum(F.when(diff == 0, 1).otherwise(0)).over(W().rowsBetween(-4, 0)) == 5})
    df = written(df, "sliding")
    median = exact_quantiles(df, ["symbol"], "ret", [0.5]).select("symbol", F.col("q")[0].alias("median"))
    df = df.join(median, "symbol", "left").withColumn("dev", F.abs(F.col("ret") - F.col("median"))).drop("median")
    spread = exact_quantiles(df, ["symbol"], "dev", [0.5]).select("symbol", (1.4826 * F.col("q")[0]).alias("mad"))
    return df.join(spread, "symbol", "left").withColumn("z", safe_div(F.col("dev"), F.when(F.col("mad") > 0, F.col("mad")))).drop("mad")


def triage(bars: DataFrame, as_of: str, extreme: float = 0.35, gap_days: int = 12, z: float = 12.0) -> DataFrame:
    """bars with ``invalid`` and ``suspicious`` (arrays of reasons), ``status`` and ``reasons``. A row that is
    invalid isn't suspicious besides: its reasons are the invalid ones. ``as_of`` stands for the clock."""
    c, eps = F.col, 1e-6
    copies = F.row_number().over(Window.partitionBy("symbol", "date").orderBy("open", "high", "low", "close", "volume"))
    rows = _sliding(bars.withColumn("nth", copies))
    prices = [c(x) for x in ("open", "high", "low", "close")]
    any_of = lambda conditions: F.exists(F.array(*conditions), lambda x: F.coalesce(x, F.lit(False)))
    invalid = tags(
        (any_of([p.isNull() for p in (*prices, c("volume"), c("date"))]), "missing_values"),
        (any_of([p < 0 for p in (*prices, c("volume"))]), "negative_values"),
        (any_of([p <= 0 for p in prices]), "non_positive_price"),
        (c("high") < c("low"), "high_below_low"),
        (any_of([c("high") < F.greatest("open", "close") - eps, c("low") > F.least("open", "close") + eps]), "impossible_ohlc"),
        (c("nth") > 1, "duplicate_rows"),
        (c("date") > F.lit(as_of).cast("date"), "future_timestamp"),
    )
    suspicious = tags(
        (F.weekday("date") >= 5, "weekend_timestamp"),
        (F.abs("ret") > extreme, "extreme_return"),
        (c("gap") > gap_days, "calendar_gap"),
        (c("volume") == 0, "zero_volume"),
        (c("flat"), "stale_price_run"),
        (c("z") > z, "return_outlier_mad"),
    )
    rows = rows.withColumns({"invalid": invalid, "suspicious": suspicious})
    status = F.when(F.size("invalid") > 0, "INVALID").when(F.size("suspicious") > 0, "SUSPICIOUS").otherwise("VALID")
    reasons = F.array_join(F.when(F.size("invalid") > 0, c("invalid")).otherwise(c("suspicious")), "|")
    return rows.withColumns({"status": status, "reasons": reasons})


def reason_counts(triaged: DataFrame) -> DataFrame:
    """Every hit counts, also a suspicion about an invalid row."""
    return triaged.select(F.explode(F.concat("invalid", "suspicious")).alias("reason")).groupBy("reason").agg(F.count("*").alias("hits"))


def quality_by_symbol(triaged: DataFrame, least_rows: int = 250, stale_days: int = 10) -> DataFrame:
    """Counts by status, share usable, days behind the last date of all, and whether the contract is broken."""
    last = triaged.agg(F.max("date").alias("last"))
    out = triaged.groupBy("symbol").agg(F.count("*").alias("n_rows"), *(F.count_if(F.col("status") == s).alias(n) for s, n in (("VALID", "valid"), ("SUSPICIOUS", "quarantined"), ("INVALID", "rejected"))), F.max("date").alias("own_last"))
    out = out.crossJoin(F.broadcast(last))  # one row
    usable = F.col("valid") + F.col("quarantined")
    stale = F.datediff("last", "own_last")
    return out.select("symbol", "n_rows", "valid", "quarantined", "rejected", stale.alias("staleness_days"), r6(100 * usable / F.col("n_rows")).alias("coverage_score"), ((usable < least_rows) | (stale > stale_days)).alias("violated"))


def quality_score(triaged: DataFrame) -> DataFrame:
    n = F.count("*")
    score = 100 * (F.count_if(F.col("status") == "VALID") + 0.5 * F.count_if(F.col("status") == "SUSPICIOUS")) / n
    return triaged.agg(n.alias("rows_in"), F.count_if(F.col("status") == "INVALID").alias("rejected"), r6(score).alias("score"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def event_clusters(events: DataFrame, top: int = 60) -> DataFrame:
    """Events of a day and sector: who, how severe, how many, which kinds; the ``top`` most severe."""
    out = events.groupBy("date", "sector").agg(F.array_join(F.sort_array(F.collect_set("symbol")), ",").alias("symbols"), r6(F.max("severity")).alias("severity"), r6(F.avg("severity")).alias("mean_severity"), F.count("*").alias("n_events"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return out.orderBy(F.desc("severity"), F.desc("n_events"), "date", "sector").limit(top)


def trailing(df: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The last n rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))).where(F.col("__n") <= n).drop("__n")


def every_kth(df: DataFrame, k: int, key: str = "symbol") -> DataFrame:
    return df.withColumn("__n", F.row_number().over(by(key))).where(F.col("__n") % k == 1).drop("__n")
