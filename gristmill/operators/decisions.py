"""Gates, stress tests, backtests, risk and ranking: expressions over columns, and group-bys by date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.expr import clip, r6, safe_div, tags
from gristmill.operators.features import W
from gristmill.operators.order_statistics import exact_quantiles, expanding_counts
from gristmill.sources.lake import written

TRADING_DAYS = 252


@dataclass(frozen=True)
class Costs:
    """One-way costs in basis points."""

    commission: float = 3.0
    slippage: float = 5.0
    impact: float = 1.0

    @property
    def one_way(self) -> float:
        return self.commission + self.slippage + self.impact

    @property
    def round_trip(self) -> float:
        return 2 * self.one_way


COSTS = Costs()
MIN_EDGE, BAND = 12.0, 0.055


# Names, limits and weights of the checks.
def gate_checks(costs: Costs = COSTS) -> list[tuple[str, Column, float]]:
    """(name, passed, weight) of the checks, in order, over the columns of a forecast."""
    c = F.col
    edge = 2 * F.abs(c("probability") - 0.5) * F.abs("expected_move") * 10_000
    return [
        ("DATA QUALITY", c("data_quality") >= 85.0, 0.15),
        ("FORECAST CONVICTION", F.abs(c("probability") - 0.5) >= BAND, 0.20),
        ("MODEL AGREEMENT", c("model_agreement") >= 0.55, 0.15),
        ("UNCERTAINTY", c("uncertainty") <= 0.62, 0.15),
        ("CALIBRATION", c("calibration_ece") <= 0.06, 0.08),
        ("MODEL HEALTH", c("drift_state").isin("HEALTHY", "WATCH"), 0.10),
        ("MARKET STABILITY", (c("regime_confidence") >= 0.45) & (c("regime") != "TRANSITION"), 0.07),
        ("RISK", c("risk_score") <= 75.0, 0.05),
        ("COST ADVANTAGE", edge - costs.round_trip >= MIN_EDGE, 0.05),
    ]


def gate(forecasts: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """forecasts with ``net_edge_bps``, ``trust``, ``blocking`` (failed checks in order) and ``verdict``. An unknown
    value fails its check."""
    checks = [(name, F.coalesce(passed, F.lit(False)), weight) for name, passed, weight in gate_checks(costs)]
    weight = sum((F.when(passed, w).otherwise(0.0) for _, passed, w in checks), F.lit(0.0))
    trust = clip(weight * 100 * (0.85 + 0.15 * clip(F.col("stability_score"), 0, 1)) * (0.9 + 0.1 * clip(F.col("modality_coverage"), 0, 1)), 0, 100)
    edge = 2 * F.abs(F.col("probability") - 0.5) * F.abs("expected_move") * 10_000 - costs.round_trip
    out = forecasts.withColumns({"net_edge_bps": edge, "trust": trust, "blocking": tags(*((~passed, name) for name, passed, _ in checks))})
    verdict = F.when(F.size("blocking") > 0, "NO ACTION").when(F.col("probability") >= 0.5, "POSITIVE").otherwise("NEGATIVE")
    return out.withColumn("verdict", verdict)


#: What each scenario does to a forecast: column -> new value. Names and amounts are fixed values.
def scenarios() -> dict[str, dict[str, Column]]:
    c, up = F.col, lambda x, d: F.least(F.lit(1.0), F.col(x) + d)
    toward = lambda k: 0.5 + (c("probability") - 0.5) * k
    return {
        "VOLATILITY_X2": {"expected_move": c("expected_move") * 2, "risk_score": F.least(F.lit(100.0), c("risk_score") * 1.6), "uncertainty": up("uncertainty", 0.12)},
        "NEGATIVE_SENTIMENT": {"probability": toward(0.6), "uncertainty": up("uncertainty", 0.1)},
        "SECTOR_REVERSAL": {"model_agreement": F.greatest(F.lit(0.0), c("model_agreement") - 0.25), "probability": toward(0.7)},
        "MARKET_SHOCK": {"regime": F.lit("TRANSITION"), "regime_confidence": F.least(c("regime_confidence"), F.lit(0.4)), "risk_score": F.least(F.lit(100.0), c("risk_score") + 25), "expected_move": c("expected_move") * 1.5},
        "MODEL_REMOVED": {"probability": c("probability_without"), "model_agreement": c("agreement_without"), "uncertainty": up("uncertainty", 0.08)},
        "NEWS_MISSING": {"modality_coverage": F.greatest(F.lit(0.0), c("modality_coverage") - 0.2), "uncertainty": up("uncertainty", 0.05)},
        "DELAYED_DATA": {"data_quality": F.greatest(F.lit(0.0), c("data_quality") - 18), "uncertainty": up("uncertainty", 0.07)},
    }


def stress(forecasts: DataFrame) -> DataFrame:
    """Every forecast under every scenario: each row becomes an array of variants, exploded in place, and goes
    through the gate again. ``changed`` tells whether the verdict did."""
    plain = gate(forecasts).withColumnRenamed("verdict", "base_verdict").drop("net_edge_bps", "trust", "blocking")
    columns = [c for c in plain.columns if c != "base_verdict"]
    variants = [F.struct(F.lit(name).alias("scenario"), *((change[c].cast(plain.schema[c].dataType) if c in change else F.col(c)).alias(c) for c in columns)) for name, change in scenarios().items()]
    rows = plain.select("base_verdict", F.explode(F.array(*variants)).alias("v")).select("base_verdict", "v.*")
    return gate(rows).withColumn("changed", F.col("verdict") != F.col("base_verdict"))


def forecasts_of(panel: DataFrame, risk: DataFrame, regime: DataFrame) -> DataFrame:
    """The panel as forecasts: with risk by symbol and the market's state by date."""
    c = F.col
    kept = [m for m in ("p2", "p3")]  # without the strongest member
    up = sum((c(m) >= 0.5).cast("int") for m in kept)
    rows = panel.join(risk.select("symbol", "risk_score"), "symbol", "left").join(regime, "date", "left")
    return rows.select(
        "symbol",
        "date",
        c("p").alias("probability"),
        c("day_move").alias("expected_move"),
        F.lit(96.0).alias("data_quality"),
        c("agreement").alias("model_agreement"),
        (0.3 * (1 - c("agreement")) + 0.4 * F.least(c("spread") / 0.2, F.lit(1.0))).alias("uncertainty"),
        F.lit(0.02).alias("calibration_ece"),
        F.when(F.year("date") % 5 == 0, "DEGRADED").otherwise("HEALTHY").alias("drift_state"),
        F.coalesce("regime", F.lit("TRANSITION")).alias("regime"),
        F.coalesce("regime_confidence", F.lit(0.0)).alias("regime_confidence"),
        F.coalesce("risk_score", F.lit(50.0)).alias("risk_score"),
        F.lit(0.7).alias("stability_score"),
        F.lit(0.8).alias("modality_coverage"),
        ((c("p2") + c("p3")) / 2).alias("probability_without"),
        F.greatest(up / 2, 1 - up / 2).alias("agreement_without"),
    )


def calibration_and_health(panel: DataFrame, sessions: int = 120, bins: int = 10) -> DataFrame:
    """(date, calibration_ece, drift_state): the calibration error of all outcomes known on that date, and the health by
    the Brier score of the last ``sessions`` dates on which outcomes became known against those before. Outcomes are
    summed by date first, so the windows run over a row a day."""
    p, y = F.col("p"), F.col("y")
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(p * bins).cast("int")))
    daily = panel.where("known_at is not null").groupBy(F.col("known_at").alias("date")).agg(
        F.count("*").alias("n"), F.sum(F.pow(p - y, 2)).alias("loss"), F.count_if((p >= 0.5).cast("double") == y).alias("hits"), *(F.sum(F.when(place == i, p - y).otherwise(0.0)).alias(f"gap_{i}") for i in range(bins))
    )
    days = Window.partitionBy(F.lit(0)).orderBy("date")
    ever = lambda c: F.sum(c).over(days.rowsBetween(Window.unboundedPreceding, 0))
    late = lambda c: F.sum(c).over(days.rowsBetween(1 - sessions, 0))
    rows = daily.select("date", (sum(F.abs(ever(f"gap_{i}")) for i in range(bins)) / ever("n")).alias("ece"), (late("hits") / late("n")).alias("accuracy"), (late("loss") / late("n") - safe_div(ever("loss") - late("loss"), ever("n") - late("n"))).alias("worse"))
    state = F.when(F.col("accuracy") < 0.45, "UNRELIABLE").when(F.col("worse") > 0.02, "DEGRADED").when(F.col("worse") > 0.008, "WATCH").otherwise("HEALTHY")
    return rows.select("date", r6(F.col("ece")).alias("calibration_ece"), state.alias("drift_state"))


def quality_to_date(triaged: DataFrame) -> DataFrame:
    """(symbol, date, data_quality, quarantine_rate): valid rows of the symbol up to the date, suspicious ones by half,
    in percent; and the share that isn't valid."""
    worth = F.sum(F.when(F.col("status") == "VALID", 1.0).when(F.col("status") == "SUSPICIOUS", 0.5).otherwise(0.0))
    daily = triaged.groupBy("symbol", "date").agg(worth.alias("worth"), F.count("*").alias("n"), F.count_if(F.col("status") != "VALID").alias("out"))
    past = W().rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("symbol", "date", r6(100 * F.sum("worth").over(past) / F.sum("n").over(past)).alias("data_quality"), r6(F.sum("out").over(past) / F.sum("n").over(past)).alias("quarantine_rate"))


def measured_forecasts(forecasts: DataFrame, panel: DataFrame, quality: DataFrame, n: int = 10) -> DataFrame:
    """``forecasts_of`` with each input as measured on its date: data quality from the triage, calibration error and
    health from the outcomes known by then, stability from the symbol's last n forecasts, coverage as the share of the
    inputs volatility, market correlation and breadth that are there. Where nothing is known yet: quality 50, error
    0.05, HEALTHY, stability 0.5."""
    back = lambda k: W().rowsBetween(1 - k, 0)
    before = F.lag("p", 1).over(W())
    steps = panel.withColumns({"step": F.col("p") - before, "flip": F.coalesce((F.col("p") >= 0.5) != (before >= 0.5), F.lit(False)).cast("int")})
    steps = steps.withColumns({"k": F.count("p").over(back(n)), "flips": F.sum("flip").over(back(n - 1)), "sd": F.stddev_pop("step").over(back(n - 1))})
    score = clip(1 - F.col("flips") / (F.col("k") - 1) - F.least(F.col("sd") / 0.08, F.lit(1.0)) * 0.5, 0, 1)
    inputs = ("day_move", "corr_bench_60", "market_breadth")
    own = steps.select("symbol", "date", r6(F.when(F.col("k") >= 3, score).otherwise(0.5)).alias("stability_score"), (sum(F.col(c).isNotNull().cast("int") for c in inputs) / len(inputs)).alias("modality_coverage"))
    known = calibration_and_health(panel)
    plain = forecasts.drop("data_quality", "calibration_ece", "drift_state", "stability_score", "modality_coverage")
    rows = plain.join(own, ["symbol", "date"]).join(quality.select("symbol", "date", "data_quality"), ["symbol", "date"], "left").join(known, "date", "left")
    default = {"data_quality": 50.0, "calibration_ece": 0.05, "drift_state": "HEALTHY"}
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()})


def position_risk(features: DataFrame, max_vol: float = 0.045) -> DataFrame:
    """By symbol, from its last row and the drawdown of its last 60 returns."""
    recent = features.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("k <= 60")
    log = F.log1p(F.tanh("ret_1") / 50)
    curve = recent.withColumn("c", F.sum(log).over(W())).withColumn("d", F.exp(F.col("c") - F.max("c").over(W().rowsBetween(Window.unboundedPreceding, 0))) - 1)
    last = curve.groupBy("symbol").agg(F.max_by("vol_20", "date").alias("vol_20"), F.max_by("beta_60", "date").alias("beta_60"), F.min("d").alias("drawdown"))
    daily = F.tanh(F.col("vol_20") / 100) / 25
    score = clip(100 * (0.5 * F.least(daily / max_vol, F.lit(2.0)) / 2 + 0.25 * F.least(F.abs(F.coalesce("beta_60", F.lit(1.0))) / 1.8, F.lit(1.0)) + 0.25 * F.least(F.abs("drawdown") / 0.25, F.lit(1.0))), 0, 100)
    return last.select("symbol", r6(F.col("drawdown")).alias("drawdown_60"), r6(score).alias("risk_score"), F.when(score < 35, "LOW").when(score < 62, "MEDIUM").otherwise("HIGH").alias("label"))


def regimes(states: DataFrame) -> DataFrame:
    """(date, regime, regime_confidence) by rules on the market's trend and volatility."""
    trend, ratio = F.col("bench_trend_20"), F.col("bench_vol_20") / F.col("bench_vol_60")
    regime = F.when(ratio > 1.25, "HIGH_VOLATILITY").when(trend > 0.2, "BULL").when(trend < -0.2, "BEAR").otherwise("SIDEWAYS")
    confidence = F.least(F.lit(1.0), 0.4 + F.abs(F.tanh(trend)) / 2)
    return states.where(trend.isNotNull() & ratio.isNotNull()).select("date", F.when(confidence < 0.42, "TRANSITION").otherwise(regime).alias("regime"), confidence.alias("regime_confidence"))


def strategy_signals(panel: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """(strategy, date, signal, ret) of every strategy, exploded from each row."""
    p, one = F.col("p"), lambda up, down: F.when(up, 1.0).when(down, -1.0).otherwise(0.0)
    ok = F.coalesce((F.abs(p - 0.5) >= BAND) & (F.col("agreement") >= 0.55) & (F.col("spread") <= 0.62) & (F.col("edge_bps") >= costs.round_trip + MIN_EDGE), F.lit(False))
    gated = one(ok & (p >= 0.5), ok & (p < 0.5))
    later = F.lead("fwd_ret", 1).over(W())
    signals = [("BUY_AND_HOLD", F.lit(1.0), F.col("fwd_ret")), ("ALWAYS_LONG_SIGNAL", one(p >= 0.5, p < 0.5), F.col("fwd_ret")), ("MODEL", one(p >= 0.5 + BAND, p <= 0.5 - BAND), F.col("fwd_ret")), ("ADAPTIVE_GATE", gated, F.col("fwd_ret")), ("ADAPTIVE_GATE_T1", gated, F.col("later"))]
    rows = panel.withColumn("later", later)
    return rows.select("date", F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), s.cast("double").alias("signal"), r.alias("ret")) for n, s, r in signals))).alias("x")).select("date", "x.*")


def backtest_daily(panel: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """Per strategy and date: equal-weight return net of costs (buy and hold pays none), exposure; 0 on dates
    without a position."""
    traded = (F.col("signal") != 0) & F.col("ret").isNotNull()
    gross = F.avg(F.when(traded, F.col("signal") * F.col("ret")))
    exposure = F.avg(F.when(traded, F.abs("signal")))
    cost = F.when(F.col("strategy") == "BUY_AND_HOLD", 0.0).otherwise(2 * F.col("exposure") * costs.one_way / 10_000)
    out = strategy_signals(panel, costs).groupBy("strategy", "date").agg(gross.alias("gross"), exposure.alias("exposure"))
    return out.select("strategy", "date", F.coalesce(F.col("gross") - cost, F.lit(0.0)).alias("net"), F.coalesce("exposure", F.lit(0.0)).alias("exposure"))


def equity_curve(daily: DataFrame) -> DataFrame:
    """Growth of 1 and the drawdown from its peak, for each strategy."""
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("g", F.sum(F.log1p("net")).over(w))
    return curve.select("strategy", "date", r6(F.exp("g")).alias("equity"), r6(F.exp(F.col("g") - F.max("g").over(w)) - 1).alias("drawdown"))


def performance(daily: DataFrame, rf: float = 0.065, confidence: float = 0.95) -> DataFrame:
    """One row for each strategy. Value at risk needs more than 20 sessions, volatility more than 2; the tail mean
    takes a second look at the rows, joined with one number a strategy."""
    daily = written(daily, "daily")
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = daily.withColumn("g", F.sum(F.log1p("net")).over(w)).withColumn("dd", F.exp(F.col("g") - F.max("g").over(w)) - 1)
    var = exact_quantiles(daily, ["strategy"], "net", [1 - confidence]).select("strategy", F.when(F.col("n") > 20, F.col("q")[0]).otherwise(0.0).alias("var"))
    rows = rows.join(F.broadcast(var), "strategy")  # a handful of strategies
    down = F.when(F.col("net") < 0, F.col("net"))
    out = rows.groupBy("strategy").agg(
        F.count("*").alias("n_sessions"), F.sum(F.log1p("net")).alias("g"), F.stddev_samp("net").alias("sd"), F.stddev_samp(down).alias("dsd"), F.count(down).alias("n_down"), F.min("dd").alias("max_drawdown"), F.max("var").alias("var"),
        F.avg(F.when(F.col("net") <= F.col("var"), F.col("net"))).alias("cvar"), F.avg((F.col("net") > 0).cast("double")).alias("hit"), F.avg("exposure").alias("mean_exposure"), F.count_if(F.col("exposure") > 0).alias("sessions_traded"),
    )
    annual = F.exp(F.col("g") * TRADING_DAYS / F.col("n_sessions")) - 1
    vol = F.when(F.col("n_sessions") > 2, F.col("sd") * TRADING_DAYS**0.5).otherwise(0.0)
    dvol = F.when(F.col("n_down") > 2, F.col("dsd") * TRADING_DAYS**0.5).otherwise(0.0)
    ratio = lambda v: F.when(v > 1e-9, (annual - rf) / v).otherwise(0.0)
    return out.select(
        "strategy", "n_sessions", r6(100 * (F.exp("g") - 1)).alias("total_return_pct"), r6(100 * annual).alias("annualised_return_pct"), r6(100 * vol).alias("annualised_vol_pct"), r6(ratio(vol)).alias("sharpe"), r6(ratio(dvol)).alias("sortino"), r6(100 * F.col("max_drawdown")).alias("max_drawdown_pct"),
        r6(100 * F.col("var")).alias("var_95_pct"), r6(100 * F.coalesce("cvar", "var")).alias("cvar_95_pct"), r6(100 * F.col("hit")).alias("hit_rate_pct"), r6(F.col("mean_exposure")).alias("mean_exposure"), "sessions_traded",
    )


def decided(panel: DataFrame, costs: Costs = COSTS) -> DataFrame:
    """The panel with ``acted``, ``correct``, ``net`` (as if traded) and ``category``."""
    threshold = costs.round_trip + MIN_EDGE
    p = F.col("p")
    acted = (F.abs(p - 0.5) >= BAND) & (F.col("agreement") >= 0.55) & (F.col("edge_bps") >= threshold)
    rows = panel.withColumns({"acted": acted, "correct": (p >= 0.5).cast("double") == F.col("y"), "net": F.signum(p - 0.5) * F.col("fwd_ret") - costs.round_trip / 10_000})
    edge = F.col("edge_bps") >= threshold
    category = F.when(F.col("acted") & edge & F.col("correct"), "ACTED_WITH_EDGE_CORRECT").when(F.col("acted") & edge, "ACTED_WITH_EDGE_INCORRECT").when(F.col("acted"), "ACTED_WITHOUT_EDGE").when(~edge, "ABSTAINED_BELOW_EDGE").otherwise("ABSTAINED_DESPITE_EDGE")
    return rows.withColumn("category", category)


def decision_quality(rows: DataFrame) -> DataFrame:
    a, net = F.col("acted"), F.col("net") * 10_000
    hit = F.col("correct").cast("double")
    rows = written(rows.select("acted", "net", "correct"), "decided")
    median = exact_quantiles(rows.where("acted").select((F.col("net") * 10_000).alias("bps")), [], "bps", [0.5]).agg(F.max(F.col("q")[0]).alias("med"))  # one row, also without trades
    out = rows.agg(
        F.count("*").alias("n"), F.avg(hit).alias("acc"), F.avg(F.when(a, hit)).alias("sel"), F.avg(a.cast("double")).alias("cov"), F.coalesce(F.avg(F.when(a, net)), F.lit(0.0)).alias("m"), F.coalesce(F.avg(F.when(~a, net)), F.lit(0.0)).alias("m0"),
        F.avg(F.when(a, (net > 0).cast("double"))).alias("win"), F.min(F.when(a, net)).alias("worst"), F.max(F.when(a, net)).alias("best"), F.count_if(a).alias("trades"),
    ).crossJoin(F.broadcast(median))
    c = F.col
    return out.select(
        "n", r6(100 * c("acc")).alias("forecast_accuracy_pct"), r6(100 * c("sel")).alias("selective_accuracy_pct"), r6(100 * c("cov")).alias("action_coverage_pct"), r6(100 * (1 - c("cov"))).alias("abstention_rate_pct"), r6(c("m")).alias("mean_net_bps"),
        r6(c("cov") * c("m")).alias("decision_utility_bps"), r6(-c("m0")).alias("downside_avoidance_bps"), r6(c("m") - c("m0")).alias("abstention_value_bps"), r6(100 * c("win")).alias("net_win_rate_pct"), r6(c("med")).alias("median_net_bps"), r6(c("worst")).alias("worst_bps"), r6(c("best")).alias("best_bps"), "trades",
    )


def failure_tags(panel: DataFrame) -> DataFrame:
    """Misses with the conditions that held; volatility is ranked against the symbol's own past only."""
    share = safe_div(F.col("below") + F.col("same"), F.col("seen"))
    panel = expanding_counts(panel, ["symbol"], "date", "day_move")
    flip = (F.col("p") >= 0.5) != (F.lag("p", 1).over(W()) >= 0.5)
    rows = panel.withColumns({"vol_share": F.when(F.col("day_move").isNotNull(), share), "flip": F.coalesce(flip, F.lit(False)).cast("int")})
    rows = rows.withColumn("flips", F.sum("flip").over(W().rowsBetween(-2, 0)))
    conviction = F.abs(F.col("p") - 0.5)
    found = tags(
        (F.col("vol_share") >= 0.9, "VOLATILITY_SHOCK"),
        (conviction < BAND, "INSUFFICIENT_EVIDENCE"),
        (F.col("agreement") < 0.7, "MODEL_DISAGREEMENT"),
        ((F.col("agreement") >= 0.7) & (conviction > 0.08), "MODEL_OVERCONFIDENCE"),
        (F.col("flips") > 1, "FORECAST_INSTABILITY"),
    )
    missed = rows.where((F.col("p") >= 0.5).cast("double") != F.col("y"))
    return missed.select("symbol", "date", conviction.alias("conviction"), F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("UNEXPLAINED"))).alias("tags"))


def vol_deciles(panel: DataFrame) -> DataFrame:
    """(symbol, date, pct_rank, decile): the move expected of a day, ranked among the symbol's own so far, ties averaged,
    as a share and in tenths, halves to the even one."""
    rows = expanding_counts(panel.select("symbol", "date", "day_move"), ["symbol"], "date", "day_move")
    share = F.when(F.col("day_move").isNotNull(), safe_div(F.col("below") + (F.col("same") + 1) / 2, F.col("seen")))
    return rows.select("symbol", "date", r6(share).alias("pct_rank"), F.bround(clip(share * 10, 0, 10)).cast("int").alias("decile"))


def failure_causes(panel: DataFrame, regime: DataFrame, quality: DataFrame, quarantine: float = 0.05) -> DataFrame:
    """``failure_tags`` and what was around the forecast: the regime changed on the date, an input was missing, or more
    than ``quarantine`` of the symbol's rows up to then aren't valid."""
    days = Window.partitionBy(F.lit(0)).orderBy("date")  # one row a day
    shifts = regime.select("date", F.coalesce(F.col("regime") != F.lag("regime", 1).over(days), F.lit(False)).alias("shift"))
    missing = panel.select("symbol", "date", (F.col("day_move").isNull() | F.col("corr_bench_60").isNull()).alias("missing"))
    rows = failure_tags(panel).join(missing, ["symbol", "date"]).join(quality.select("symbol", "date", "quarantine_rate"), ["symbol", "date"], "left").join(shifts, "date", "left")
    more = tags((F.col("shift"), "REGIME_SHIFT"), (F.col("missing"), "MISSING_MODALITY"), (F.col("quarantine_rate") > quarantine, "DATA_QUALITY"))
    every = F.when(F.size(more) == 0, F.col("tags")).otherwise(F.concat(F.array_remove("tags", "UNEXPLAINED"), more))
    return rows.select("symbol", "date", "conviction", every.alias("tags"))


#: Fixed values, weights of the risk profiles: trust, edge, risk, penalty on volatility.
PROFILES = {"CONSERVATIVE": (0.45, 0.20, 0.35, 1.0), "BALANCED": (0.35, 0.35, 0.30, 0.6), "AGGRESSIVE": (0.25, 0.55, 0.20, 0.25)}


def recommend(spark: SparkSession, gated: DataFrame, top: int = 6) -> DataFrame:
    """The best of each profile; those whose gate is closed are to be watched only."""
    profiles = spark.createDataFrame([(n, *w) for n, w in PROFILES.items()], "profile string, wt double, we double, wr double, wv double")
    c = F.col
    edge = clip((c("net_edge_bps") + 40) / 80, 0, 1)
    score = 100 * (c("wt") * c("trust") / 100 + c("we") * edge + c("wr") * (1 - c("risk_score") / 100) - c("wv") * 0.15 * F.least(c("expected_move") * 10, F.lit(1.0)))
    rows = gated.crossJoin(F.broadcast(profiles)).select("profile", "symbol", "date", "verdict", r6(score).alias("score"))  # three rows
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("score"), "symbol", "date")))
    return rows.where(c("place") <= top).withColumn("status", F.when(c("verdict") != "NO ACTION", "CANDIDATE").otherwise("WATCH ONLY"))


def audit(gated: DataFrame) -> DataFrame:
    """Checks of each forecast against itself: all passed is PASS, one or two failed PARTIAL, more FAIL."""
    c = F.col
    checks = [
        ("probability_range", c("probability").between(0, 1)),
        ("edge_known", c("net_edge_bps").isNotNull()),
        ("trust_range", c("trust").between(0, 100)),
        ("direction", (c("verdict") == "NO ACTION") | ((c("verdict") == "POSITIVE") == (c("probability") >= 0.5))),
        ("blocked_if_no_action", (c("verdict") == "NO ACTION") == (F.size("blocking") > 0)),
        ("costs_cleared", (c("verdict") == "NO ACTION") | (c("net_edge_bps") >= MIN_EDGE)),
        ("regime_resolved", c("regime") != "TRANSITION"),
        ("healthy", c("drift_state").isin("HEALTHY", "WATCH")),
        ("risk_range", c("risk_score").between(0, 100)),
    ]
    failed = tags(*((~F.coalesce(ok, F.lit(False)), name) for name, ok in checks))
    rows = gated.withColumn("failed", failed)
    n = F.size("failed")
    return rows.select("symbol", "date", F.when(n == 0, "PASS").when(n <= 2, "PARTIAL").otherwise("FAIL").alias("result"), F.array_join("failed", "|").alias("failed"))


def leaderboard(panel: DataFrame, members: tuple[str, ...], sharpness: float = 12.0) -> DataFrame:
    """Members with their Brier score, a health from it, and weights that halve at DEGRADED and drop at UNRELIABLE."""
    rows = panel.select("y", F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.col(m).alias("p")) for m in members))).alias("x")).select("y", "x.*")
    scores = rows.groupBy("member").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    health = F.when(F.col("brier") < 0.25, "HEALTHY").when(F.col("brier") < 0.27, "WATCH").when(F.col("brier") < 0.3, "DEGRADED").otherwise("UNRELIABLE")
    penalty = F.when(health == "HEALTHY", 1.0).when(health == "WATCH", 0.85).when(health == "DEGRADED", 0.4).otherwise(0.0)
    raw = F.exp(-sharpness * F.col("brier")) * penalty
    everyone = Window.partitionBy(F.lit(0))  # one row a member
    total = F.sum(raw).over(everyone)
    return scores.select("member", r6(F.col("brier")).alias("brier"), health.alias("health"), F.round(F.when(total > 0, raw / total).otherwise(1 / F.count("*").over(everyone)), 4).alias("weight"))


def market_pressure(gated: DataFrame) -> DataFrame:
    """Per date 0 to 100: few forecasts act, the expected move is large, the regime is unsure."""
    out = gated.groupBy("date").agg(F.avg((F.col("verdict") != "NO ACTION").cast("double")).alias("part"), F.avg("expected_move").alias("move"), F.any_value("regime_confidence").alias("conf"))
    value = 100 * (0.5 * (1 - F.col("part")) + 0.3 * F.least(F.coalesce(F.col("move"), F.lit(0.0)) * 25, F.lit(1.0)) + 0.2 * (1 - F.col("conf")))
    return out.select("date", r6(F.col("part")).alias("participation"), r6(value, 4).alias("pressure"))
