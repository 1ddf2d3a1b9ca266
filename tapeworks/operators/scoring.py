"""Scoring a universe, profile scores, signal history and result summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions import scalars as S
from tapeworks.functions import signals as G
from tapeworks.operators import cross_section as X
from tapeworks.operators import ordering as O


def with_prior(scored: DataFrame, prior: DataFrame) -> DataFrame:
    """Left join of the last signal per ticker (ticker, prior_signal, prior_score, prior_date)."""
    return scored.join(prior, "ticker", "left")


def score_universe(features: DataFrame, prob: str, risk: str = "medium", prior: DataFrame | None = None,
                   thresholds: dict | None = None) -> DataFrame:
    """One result row per ticker from features, a probability and optional prior signals.

    ``features`` holds the 21 filled features, ratings, ownership, sector, market,
    last_price. Row expressions only, apart from the join with ``prior``.
    """
    df = features
    if prior is not None:
        df = with_prior(df, prior)
    for c in ("prior_signal", "prior_date"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumns({"composite": G.composite_score(prob, risk), "bull_": G.bull_points(), "bear_": G.bear_points()})
    df = df.withColumn("held_", G.after_hysteresis(
        G.signal_of("composite", thresholds), "composite", "prior_signal", "prior_date", thresholds))
    signal = F.col("held_.signal")
    tier = G.size_tier(signal, "vol_60d", F.coalesce(F.nullif("beta", F.lit(0.0)), F.lit(1.0)))
    state = G.stability("composite", thresholds)
    return df.select(
        "ticker", "sector", "market", S.rounded(F.coalesce("last_price", F.lit(0.0))).alias("last_price"),
        signal.alias("signal"), G.is_buy(signal).alias("is_buy"), "composite",
        F.bround(F.col("composite") * 100, 1).alias("composite_score"),
        F.bround(F.col(prob) * 100, 1).alias("fundamental_score"),
        tier["tier"].alias("size_tier"), tier["note"].alias("size_note"),
        state.alias("signal_stability"), G.stability_note(state).alias("stability_note"),
        G.action_note(signal).alias("action_note"), "prior_signal", "prior_date",
        F.col("held_.note").alias("hysteresis_note"), F.col("held_.applied").alias("hysteresis_applied"),
        S.percent("inst_ownership").alias("inst_ownership_pct"),
        S.percent("insider_ownership").alias("insider_ownership_pct"),
        F.when(F.col("market").isin("UK", "IE"), K.BETA_NOTE).alias("beta_note"),
        G.factor_profile().alias("factor_profile"), G.reasons(signal, F.col("bull_"), F.col("bear_")).alias("buy_reasons"),
        G.thesis(F.col("bull_"), F.col("bear_")).alias("thesis"), "analyst_buy", "analyst_hold", "analyst_sell",
        F.struct(
            *[S.rounded(c).alias(c) for c in ("pe_ratio", "pb_ratio", "debt_equity", "beta", "rsi_14")],
            *[S.percent(c).alias(c) for c in ("roe", "net_margin", "revenue_growth", "dividend_yield",
                                              "mom_12m", "mom_3m", "vol_60d")],
        ).alias("fundamentals"),
    )


def ranked_results(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("composite_score"), "ticker")


def placed_results(results: DataFrame) -> DataFrame:
    """Adds ``place``, the position in ``ranked_results``, of every row; no task holds the whole universe."""
    return O.row_numbers(results, [], {"composite_score": False, "ticker": True}, spread=True, name="place")


def profile_scores(stocks: DataFrame, risk: str = "medium", lam: float = 0.10, use_factors: bool = True) -> DataFrame:
    """(profile, ticker, fund_score, quant_score, score) for all seven profiles.

    ``stocks``: ticker, pe, pb, roe, de, dy, rg, mg, m12, m3, beta, mc (billions).
    Weights are a fixed table of seven rows, exploded next to each stock.
    """
    scaled = X.min_max(stocks, [], K.PROFILE_COLUMNS)
    weights = F.array(*[
        F.struct(F.lit(name).alias("profile"), *[F.lit(w).alias(c) for c, w in zip(K.PROFILE_COLUMNS, ws)])
        for name, ws in K.PROFILE_WEIGHTS.items()])
    rows = scaled.withColumn("w", F.explode(weights))
    raw: Column = F.lit(0.0)
    for c in K.PROFILE_COLUMNS:
        raw = raw + F.col(f"w.{c}") * F.coalesce(F.col(f"{c}_mm"), F.lit(0.5))
    bp, mb = K.RISK_BETA[risk]
    penalty = bp * F.greatest(F.lit(0.0), F.col("beta") - mb)
    fund = S.clip(raw - penalty - lam * 0.05 + 0.42, 0.0, 1.0)
    pe, mg, rg, mc, m12 = [F.col(c) for c in ("pe", "mg", "rg", "mc", "m12")]
    parts = {
        "value": F.when((pe > 0) & (1 / pe > 0.06), 0.03).when((pe > 0) & (1 / pe < 0.02), -0.02).otherwise(0.0),
        "quality": F.when(mg > 0.20, 0.025).when(mg < 0.08, -0.015).otherwise(0.005),
        "investment": F.when(rg < 0.05, 0.015).when(rg > 0.20, -0.020).otherwise(0.0),
        "size": F.when(mc < 100, 0.04).when(mc < 400, 0.01).otherwise(-0.01),
        "momentum": F.when(m12 > 0.20, 0.03).when(m12 < -0.05, -0.025).otherwise(0.005),
    }
    tilt = parts["value"] + parts["quality"] + parts["investment"] + parts["momentum"]
    rows = rows.withColumns({"fund_": fund, "tilt_": tilt, "all_": tilt + parts["size"]})
    score = F.col("fund_") + (F.col("tilt_") * 0.35 if use_factors else F.lit(0.0))
    return rows.select(
        F.col("w.profile").alias("profile"), "ticker", F.round("fund_", 3).alias("fund_score"),
        F.round(F.col("all_") * 100 / 5 + 50, 1).alias("quant_score"), S.clip(score, 0.04, 0.97).alias("score"))


# --- signal history --------------------------------------------------------------

def signal_payloads(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, payload): one JSON map ticker -> {signal, score} per run (a request's universe)."""
    entry = F.struct("ticker", F.struct("signal", F.col("composite_score").alias("score")))
    rows = results.filter("ticker IS NOT NULL AND signal IS NOT NULL")
    return rows.groupBy(*keys).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("signals"))).alias("payload"))


def parse_payloads(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Explode payloads: adds ticker, signal, score."""
    kind = "struct<signals:map<string,struct<signal:string,score:double>>>"
    rows = events.withColumn("p_", F.from_json(payload, kind))
    rows = rows.select(*[c for c in events.columns if c != payload], F.explode("p_.signals").alias("ticker", "e_"))
    return rows.select(*[c for c in rows.columns if c != "e_"], "e_.signal", "e_.score").filter("signal IS NOT NULL")


def recent_events(events: DataFrame, user: str, ts: str, tie: str, last: int = K.MAX_PRIOR_EVENTS) -> DataFrame:
    """The latest ``last`` events per user (limited per partition before the exchange)."""
    newest = Window.partitionBy(user).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("rn_", F.row_number().over(newest)).filter(F.col("rn_") <= last).drop("rn_")


def prior_signals(entries: DataFrame, user: str, ts: str, tie: str) -> DataFrame:
    """(user, ticker, signal, score, date): the most recent signal, combined map-side."""
    best = F.max_by(F.struct("signal", "score", F.col(ts).alias("at_")), F.struct(ts, tie)).alias("e_")
    return entries.groupBy(user, "ticker").agg(best).select(
        user, "ticker", "e_.signal", "e_.score", S.day_label(F.col("e_.at_")).alias("date"))


# --- summaries -------------------------------------------------------------------

def headline(results: DataFrame) -> DataFrame:
    """One row: top pick, counts by signal, mean score."""
    n = lambda *s: F.sum(F.col("signal").isin(*s).cast("bigint"))
    best = F.min_by(F.struct("ticker", "signal"), F.struct(-F.col("composite_score"), F.col("ticker")))
    return results.agg(
        best.alias("top_"), n("STRONG BUY", "BUY").alias("buys"), n("HOLD").alias("holds"), n("SELL").alias("sells"),
        F.count(F.lit(1)).alias("stocks"), F.bround(F.avg("composite_score"), 0).alias("avg_score"),
    ).select("top_.ticker", "top_.signal", "buys", "holds", "sells", "stocks", "avg_score")


def factor_means(results: DataFrame) -> DataFrame:
    parts = ("value", "quality", "investment", "size", "momentum")
    return results.agg(*[F.round(F.avg(f"factor_profile.{p}"), 2).alias(p) for p in parts])


def exposure(results: DataFrame) -> DataFrame:
    """(bucket, n): names per market and sector (first twelve letters)."""
    bucket = F.concat_ws(":", "market", F.substring("sector", 1, 12))
    return results.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def scaled_importance(importance: DataFrame, top: int = 10) -> DataFrame:
    """Importance as a share of the largest, best first."""
    rows = importance.orderBy(F.desc("importance"), "feature").limit(top)
    peak = F.max("importance").over(Window.partitionBy(F.lit(1)))      # at most ``top`` rows
    return rows.withColumn("pct", F.round(F.try_divide(F.col("importance"), peak) * 100, 0))


def showcase(results: DataFrame, buys: int = 4, sells: int = 2) -> DataFrame:
    """The best buys and the last sells."""
    order = [F.desc("composite_score"), F.col("ticker")]
    first = results.filter(F.col("signal").isin("STRONG BUY", "BUY")).orderBy(*order).limit(buys)
    last = results.filter("signal = 'SELL'").orderBy("composite_score", F.desc("ticker")).limit(sells)
    return first.unionByName(last)


def insights(results: DataFrame, bands: DataFrame, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(theses with the hit rate of their confidence band, track record)."""
    labelled = results.withColumn("band", S.confidence_band("composite_score"))
    theses = labelled.join(bands.select("band", F.col("hit_rate").alias("band_hit_rate")), "band", "left").select(
        "ticker", "sector", "market", "signal", "composite_score", F.col("band").alias("confidence_label"),
        "band_hit_rate", "thesis.bull", "thesis.bear")
    record = report.select("hit_rate", F.col("ic_mean").alias("ic"), F.col("ann_alpha_net").alias("ann_alpha"),
                           F.col("sharpe_ratio").alias("sharpe"), "max_drawdown", "n_periods", "interpretation")
    return theses, record
