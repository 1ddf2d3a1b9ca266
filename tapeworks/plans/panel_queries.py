"""Queries on prices, features, cross-sections, labels and books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions import scalars as S
from tapeworks.operators import asof as J
from tapeworks.operators import books as B
from tapeworks.operators import cross_section as X
from tapeworks.operators import labels as L
from tapeworks.operators import ordering as O
from tapeworks.operators import timeseries as TS
from tapeworks.plans import market as M
from tapeworks.session import durable
from tapeworks.sources import prices as P

RANKS = [f"{c}_rank" for c in K.PRICE_FEATURES]


def six(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six digits, integers to bigint: the form the oracle compares.

    Statistics of large numbers compare fewer digits: theirs end earlier.
    """
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append((F.round(F.col(name).cast("double"), digits) + 0.0).alias(name))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def as_of():
    return F.to_timestamp(F.lit(M.AS_OF))


def q01_price_panel(spark: SparkSession, sf: str) -> DataFrame:
    px = M.prices(spark, sf)
    return six(TS.with_bars(L.enough_history(TS.with_bars(px), K.MIN_BARS_FETCH).drop("bar")))


def q02_coverage(spark, sf):
    return six(P.coverage(M.prices(spark, sf), as_of()))


def q03_momentum(spark, sf):
    out = TS.price_features(M.bars(spark, sf), "snapshot")
    return six(out.select("ticker", "dt", "mom_1m", "mom_3m", "mom_6m", "mom_12m"))


def q04_vol_52w(spark, sf):
    out = TS.price_features(M.bars(spark, sf), "snapshot")
    return six(out.select("ticker", "dt", "vol_60d", "price_vs_52w_high"))


def q05_rsi(spark, sf):
    out = TS.price_features(M.bars(spark, sf), "label")
    return six(out.select("ticker", "dt", "rsi_14"))


VOLUME_CHANNELS = ["logret", "vol", "rel_volume", "log_dollar_vol"]


def volume_channels(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("logret", TS.channel_returns())
    rows = rows.withColumn("vol", TS.trailing_std("logret", 20, TS.by_date()))
    rows = rows.withColumn("median_", TS.trailing_median("volume", 20, TS.by_date()))
    return rows.withColumns({
        "rel_volume": TS.relative_volume(F.col("volume"), F.col("median_")),
        "log_dollar_vol": TS.log_dollar_volume(F.col("close"), F.col("volume"))})


def q06_channels_volume(spark, sf):
    return six(volume_channels(M.bars(spark, sf)).select("ticker", "dt", *VOLUME_CHANNELS))


def q07_excess_return(spark, sf, ranged=False):
    px = durable(M.prices(spark, sf)).select("ticker", "dt", "close")
    sectors = M.industries(spark, sf).select("ticker", "sector")
    market = M.market_series(px).withColumnRenamed("close", "market_close")
    by_sector = M.sector_series(px, sectors).withColumnRenamed("close", "sector_close")
    # The references are matched to the dates (and sectors) that occur, which the calendar bounds; the
    # matches are broadcast when measured to be small, so the panel itself moves once, by ticker.
    panel = px.join(O.checked_broadcast(sectors), "ticker", "left")
    days = J.asof_ffill(px.select("dt").distinct(), market, [], "dt", ["market_close"], ranged)
    sector_days = J.asof_ffill(panel.select("sector", "dt").distinct(), by_sector, ["sector"], "dt", ["sector_close"], ranged)
    rows = O.attach(panel.join(O.checked_broadcast(days), "dt"), O.checked_broadcast(sector_days), ["sector", "dt"], "left")
    own = TS.channel_returns("close")
    return six(rows.select(
        "ticker", "dt",
        (own - TS.channel_returns("market_close")).alias("excess_ret_vs_market"),
        F.when(F.col("sector_close").isNotNull(), own - TS.channel_returns("sector_close"))
        .otherwise(0.0).alias("rel_strength_vs_sector")))


def earnings_pulse(probe: DataFrame, events: DataFrame, ranged: bool | int = False) -> DataFrame:
    hit = J.asof_latest(probe, events.withColumn("value_", S.clip(F.col("surprise_pct") / 50, -1.0, 1.0)),
                        ["ticker"], "dt", "announce_date", ["value_"], K.PULSE_MAX_AGE_DAYS, ranged)
    decay = F.exp(-F.date_diff("dt", "announce_date") / K.PULSE_DECAY_DAYS)
    return hit.withColumn("earn_surprise_pulse", F.coalesce(F.col("value_") * decay, F.lit(0.0))).drop("value_")


def analyst_net(probe: DataFrame, ratings: DataFrame) -> DataFrame:
    total = F.col("buy") + F.col("hold") + F.col("sell")
    net = F.coalesce(F.try_divide(F.col("buy") - F.col("sell"), total), F.lit(0.0))
    hit = J.asof_latest(probe, ratings.withColumn("net_", net), ["ticker"], "dt", "period", ["net_"])
    return hit.withColumn("analyst_net_buy_ts", F.coalesce("net_", F.lit(0.0))).drop("net_")


def q08_earnings_pulse(spark, sf, ranged=False):
    days = durable(M.daily(spark, sf))
    out = earnings_pulse(days.select("ticker", "dt"), M.earnings(spark, sf, days), ranged)
    return six(out.select("ticker", "dt", "announce_date", "earn_surprise_pulse"))


def q09_analyst_net(spark, sf):
    days = durable(M.daily(spark, sf))
    out = analyst_net(days.select("ticker", "dt"), M.analyst(spark, sf, days))
    return six(out.select("ticker", "dt", "analyst_net_buy_ts"))


def q10_pct_rank(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    rows, _ = M.ranked(spark, sf, limit=limit)
    return six(rows.select("period", "ticker", *RANKS))


def q11_winsor_fill(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    """Snapshot features (with gaps) every 63 bars, winsorised and median-filled."""
    feats = TS.price_features(M.bars(spark, sf), "snapshot")
    rows = durable(feats.filter("bar % 63 = 62").select(
        ((F.col("bar") - 62) / 63).cast("bigint").alias("period"), "ticker", *K.PRICE_FEATURES))
    spread = O.needs_spread(rows, ["period"], limit)
    out = X.winsorise(rows, ["period"], K.PRICE_FEATURES, spread=spread)
    return six(X.median_fill(out, ["period"], K.PRICE_FEATURES, spread=spread))


def q12_reference_rank(spark, sf):
    """Features of 63 bars ago ranked against the panel of latest features."""
    feats = durable(TS.price_features(M.bars(spark, sf), "panel"))
    panel = X.reference_panel(TS.last_bar(feats))
    live = TS.last_bar(feats, 63).select("ticker", "dt", *K.PRICE_FEATURES)
    return six(X.reference_ranks(live, panel, ["ticker"], K.PRICE_FEATURES).select("ticker", "dt", *RANKS))


def q13_emb_zscore(spark, sf):
    emb = M.table(spark, sf, "embeddings").withColumnRenamed("label", "grp")
    return six(X.standardized_embeddings(emb, ["grp"], ["vec_id"]))


def q14_forward_label(spark, sf):
    rows, _ = M.ranked(spark, sf)
    return six(rows.select("period", "ticker", "start_dt", "end_dt", "fwd_ret", "median_ret", "bench_ret", "label"))


def q15_multi_horizon(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    bars = durable(M.bars(spark, sf))
    # a window start holds each ticker once at most
    spread = O.needs_spread(bars, ["bar"], limit)
    return six(L.multi_horizon_labels(bars, spread=bool(spread)))


def q16_cv_folds(spark, sf):
    periods = durable(M.panel(spark, sf).select("period").distinct())
    return six(L.period_folds(periods, 5, embargo=4))


def q17_spearman_ic(spark, sf):
    rows, spread = M.scored(spark, sf)
    return six(B.spearman_ic(rows, ["period"], ["ticker"], spread=spread))


def q18_pooled_ic(spark, sf):
    rows, _ = M.scored(spark, sf)
    return six(B.pooled_ic(rows, ["period", "ticker"]))


def q19_hit_rate(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    rows, spread = M.scored(spark, sf, limit)
    return six(B.hit_rate(rows, spread=spread))


def top(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    rows, spread = M.scored(spark, sf, limit)
    return durable(B.top_quantile(rows, spread=spread)), rows, spread


def q20_equal_book(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    return six(B.equal_weight_book(top(spark, sf, limit)[0]))


def q21_sized_book(spark, sf):
    return six(B.sized_book(top(spark, sf)[0]))


def q22_hysteresis_book(spark, sf):
    return six(B.hysteresis_book(top(spark, sf)[0]))


def q23_book_stats(spark, sf):
    return six(B.book_stats(B.all_books(top(spark, sf)[0])))


def bench(rows: DataFrame) -> DataFrame:
    return rows.groupBy("period").agg(F.max("bench_ret").alias("bench_ret"))


def q24_beta_alpha(spark, sf):
    best, rows, spread = top(spark, sf)
    ics = B.spearman_ic(rows, ["period"], ["ticker"], spread=spread)
    out = B.backtest_report(best, ics, B.hit_rate(rows, spread=spread), bench(rows))
    return six(out.select("*", *[F.col(f"interpretation.{c}").alias(f"says_{c}")
                                 for c in ("hit_rate", "ic", "sharpe", "drawdown", "alpha")]).drop("interpretation"))


def q25_period_examples(spark, sf):
    rows, spread = M.scored(spark, sf)
    return six(B.period_examples(rows, spread=spread))


def q26_band_hit(spark, sf):
    rows, spread = M.scored(spark, sf)
    return six(B.band_hit_rates(B.period_examples(rows, spread=spread)))


def q43_window_zscore(spark, sf):
    chans = TS.base_window_channels(TS.window_rows(M.bars(spark, sf).select("ticker", "dt", "close", "bar")))
    z = TS.standardized_windows(chans, K.BASE_CHANNELS)
    return six(z.groupBy("ticker", "end_bar").agg(
        F.count(F.lit(1)).alias("steps"),
        F.max_by("logret_z", "bar").alias("last_logret_z"), F.max_by("vol_z", "bar").alias("last_vol_z"),
        F.min("logret_z").alias("min_logret_z"), F.max("vol_z").alias("max_vol_z")))


def q45_thresholds(spark, sf):
    rows, _ = M.scored(spark, sf)
    out = O.percentiles(rows, [], "model_score", K.THRESHOLD_PERCENTILES)
    n = rows.agg(F.count("model_score").alias("n_scores"))
    return six(X.join_small(out, n, []).filter("n_scores >= 10"))


def q59_stitch_chunks(spark, sf):
    """Two overlapping price chunks (by line status); the later chunk wins a shared day."""
    rows = M.sales(spark, sf, "l_shipdate", "l_linestatus", "l_extendedprice", "l_quantity")
    chunk = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    daily = rows.groupBy("ticker", F.to_date("l_shipdate").alias("dt"), chunk.alias("chunk")).agg(
        F.sum(M.hundredths("l_extendedprice")).alias("cents"), F.sum("l_quantity").alias("volume"))
    chunks = daily.withColumn("close", M.close_of(F.col("cents"), F.col("volume")))
    return six(P.stitch_chunks(chunks))


def q60_ic_summary(spark, sf):
    rows, spread = M.scored(spark, sf)
    return six(B.ic_summary(B.spearman_ic(rows, ["period"], ["ticker"], spread=spread)))


def q61_walk_forward_pairs(spark, sf):
    periods = durable(M.panel(spark, sf).select("period").distinct())
    return six(L.walk_forward_pairs(periods, embargo=4))


def q62_window_embedding(spark, sf):
    chans = TS.base_window_channels(TS.window_rows(M.bars(spark, sf).select("ticker", "dt", "close", "bar")))
    e = TS.window_embedding(chans)
    return six(e.select("ticker", "end_bar", *[F.col("embedding")[i].alias(f"emb_{i}") for i in range(4)]))


def q63_lookback(spark, sf):
    return six(B.lookback(M.bars(spark, sf)))


def q71_pct_rank_large(spark, sf):
    """q10 with the plan for groups of any size; so do the next four."""
    return q10_pct_rank(spark, sf, 0)


def q72_winsor_fill_large(spark, sf):
    return q11_winsor_fill(spark, sf, 0)


def q73_multi_horizon_large(spark, sf):
    return q15_multi_horizon(spark, sf, 0)


def q74_hit_rate_large(spark, sf):
    return q19_hit_rate(spark, sf, 0)


def q75_equal_book_large(spark, sf):
    return q20_equal_book(spark, sf, 0)


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
