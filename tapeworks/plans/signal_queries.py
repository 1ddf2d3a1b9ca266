"""Queries on signals, portfolios, monitoring, histories and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions import scalars as S
from tapeworks.functions import signals as G
from tapeworks.operators import drift_state as DS
from tapeworks.operators import labels as L
from tapeworks.operators import monitoring as N
from tapeworks.operators import ordering as O
from tapeworks.operators import portfolio as D
from tapeworks.operators import scoring as R
from tapeworks.plans import market as M
from tapeworks.plans.panel_queries import six
from tapeworks.session import durable
from tapeworks.sources import prices as P
from tapeworks.sources import tables as T

NOW = "2000-12-31"


def q27_composite_signal(spark, sf):
    r = M.results(spark, sf)
    return six(r.select("ticker", "composite_score", "fundamental_score", "signal", "is_buy", "size_tier", "size_note",
                        "signal_stability", "stability_note", "action_note", "prior_signal", "hysteresis_note",
                        "hysteresis_applied"))


def q28_factor_profile(spark, sf):
    feats, _ = M.universe(spark, sf)
    return six(feats.withColumn("f", G.factor_profile()).select("ticker", "f.*"))


def q29_thesis(spark, sf):
    r = M.results(spark, sf)
    return six(r.select("ticker", "signal", F.array_join("buy_reasons", " | ").alias("reasons"),
                        F.array_join("thesis.bull", " | ").alias("bull"), F.array_join("thesis.bear", " | ").alias("bear")))


def q30_profile_score(spark, sf):
    feats, _ = M.universe(spark, sf)
    stocks = feats.select(
        "ticker", F.col("pe_ratio").alias("pe"), F.col("pb_ratio").alias("pb"), "roe", F.col("debt_equity").alias("de"),
        F.col("dividend_yield").alias("dy"), F.col("revenue_growth").alias("rg"), F.col("net_margin").alias("mg"),
        F.col("mom_12m").alias("m12"), F.col("mom_3m").alias("m3"), "beta", (F.col("market_cap") / 1e9).alias("mc"))
    return six(R.profile_scores(stocks))


def q31_prior_signals(spark, sf):
    ev = R.recent_events(M.signal_events(spark, sf), "user_id", "ts", "event_id")
    return six(R.prior_signals(R.parse_payloads(ev), "user_id", "ts", "event_id"))


def q32_composition(spark, sf):
    return six(D.composition(M.holdings(spark, sf)))


def q33_flags(spark, sf):
    return six(D.concentration_flags(durable(D.composition(M.holdings(spark, sf)))))


def q34_recommend(spark, sf):
    held = durable(M.holdings(spark, sf))
    cands = durable(M.results(spark, sf).select("ticker", "sector", "composite_score", "signal"))
    return six(D.recommend_additions(D.composition(held), held.select("portfolio_id", "ticker"), cands))


def q35_build_portfolio(spark, sf):
    cands = durable(M.results(spark, sf).select("ticker", "sector", "composite_score", "signal"))
    return six(D.build_portfolio(cands))


def q36_dist_stats(spark, sf):
    rows, weight = DS.counted(M.drift_rows(spark, sf), ["feature"])
    return six(N.distribution_stats(rows, ["feature"], max_groups=len(M.DRIFT_FEATURES), weight=weight), 4)


def drift_parts(spark, sf) -> tuple[DataFrame, DataFrame, str | None]:
    """The baseline, the live rows or value counts of them, and their weight column: one scan where values repeat."""
    rows, weight = counted_quarters(M.drift_lines(spark, sf))
    return drift_base(rows, weight), rows.filter("quarter >= '1998'"), weight


def counted_quarters(lines: DataFrame) -> tuple[DataFrame, str | None]:
    rows, weight = DS.counted(M.melted(lines), ["quarter_no", "feature"])
    return M.named_quarters(rows), weight


def drift_base(rows: DataFrame, weight: str | None) -> DataFrame:
    """The baseline from the quarters before the live ones."""
    early = rows.filter("quarter < '1998'")
    return durable(N.baseline(early, ["feature"], max_groups=len(M.DRIFT_FEATURES), weight=weight))


def feature_drift(spark, sf, newest: bool = False) -> DataFrame:
    """``newest``: of each feature's last quarter only."""
    base, live, weight = drift_parts(spark, sf)
    if newest:
        live = N.latest_period(live, ["feature"], "quarter")
    return N.feature_drift(live, base, ["quarter"], weight=weight)


def q37_feature_psi(spark, sf):
    return six(feature_drift(spark, sf).drop("n"), 4)


def matured(spark, sf, rows: DataFrame | None = None, spread: int = 0, ranged: bool = False,
            series: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Predictions with their realised returns; ``rows`` and ``series``: scored rows and bars, where a caller has them."""
    if series is None:
        series = durable(M.bars(spark, sf))
    if rows is None:
        rows, spread = M.scored(spark, sf, series=series)
    preds = durable(M.predictions(rows))
    return N.mature_labels(preds, series, F.to_date(F.lit(NOW)), ranged), spread


def q38_mature_labels(spark, sf):
    return six(matured(spark, sf)[0])


def rolling(spark, sf, *scored, series: DataFrame | None = None) -> DataFrame:
    rows, spread = matured(spark, sf, *scored, series=series)
    return N.rolling_ic(N.period_ics(durable(rows), spread=spread))


def q39_rolling_ic(spark, sf):
    return six(rolling(spark, sf))


BASE_PERIODS = 6      # the periods whose predictions and correlations form the captured baseline


def quarter_of(d: str):
    return F.concat_ws("-Q", F.year(d).cast("string"), F.quarter(d).cast("string"))


def states(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(verdict rows per quarter, rolling rows, drift rows, prediction drift rows).

    Every quarter sees the correlation and the prediction drift as they stood then, next to its own
    feature drift; the correlation is held against the mean of the baseline periods.
    """
    series = durable(M.bars(spark, sf))
    rows, spread = M.scored(spark, sf, series=series)
    roll = durable(rolling(spark, sf, rows, spread, series=series))
    first = roll.filter((F.col("window") == K.IC_PRIMARY_WINDOW) & (F.col("period_key") <= BASE_PERIODS))
    train_ic = first.agg(F.avg("spearman")).first()[0]
    roll = durable(N.classify_ic(roll.withColumn("train_ic", F.lit(train_ic).cast("double"))))
    ic = roll.filter(F.col("window") == K.IC_PRIMARY_WINDOW).select(
        "model_version", quarter_of("ts").alias("quarter"), F.struct("ts", "period_key").alias("at"), F.struct(
            F.col("period_key").alias("ic_period"), F.col("ic_mean").alias("rolling_ic"), F.col("level").alias("ic_level"),
            F.col("ratio").alias("ic_ratio")).alias("s"))
    begun = rows.groupBy("period").agg(F.min("start_dt").alias("began"))
    drifted = durable(prediction_drift(spark, sf, rows))
    pred = drifted.join(begun, "period").select(
        F.lit(_version()).alias("model_version"), quarter_of("began").alias("quarter"), F.struct("began", "period").alias("at"), F.struct(
            F.col("status").alias("prediction_status"), F.col("psi").alias("prediction_psi")).alias("s"))
    drift = durable(feature_drift(spark, sf))
    out = N.evaluate_drift(drift, ["quarter"]).withColumn("model_version", F.lit(_version()))
    for events in (ic, pred):
        out = N.as_of(out, events, "quarter", "at", "s", ("model_version",))
    return N.decide(out), roll, drift, drifted


def _version() -> str:
    return M.MODEL + "+enc:v1"


def q40_alert_decide(spark, sf):
    out = states(spark, sf)[0]
    return six(out.select(
        "model_version", "quarter", "ic_period", "rolling_ic", "ic_level", "ic_ratio", "max_psi", "status", "confidence",
        F.array_join("critical_features", ",").alias("critical"), F.array_join("warning_features", ",").alias("warning"),
        F.array_join("reasons", " | ").alias("reasons")))


def q44_sector_norm(spark, sf):
    c = M.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return six(c.select("c_custkey", "c_mktsegment", S.sector_of("c_mktsegment").alias("sector")))


def q58_sector_etf(spark, sf):
    c = M.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return six(c.select("c_custkey", "c_mktsegment", S.sector_benchmark("c_mktsegment").alias("benchmark")))


def q46_paging(spark, sf):
    ev = M.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    return six(T.page(ev, [F.desc("ts"), F.desc("event_id")], limit=50, offset=100))


def q47_summaries(spark, sf):
    r = durable(M.results(spark, sf))
    h = R.headline(r)
    head = h.select(F.explode(F.array(*[
        F.struct(F.lit("headline").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("x"))
        for c in ("buys", "holds", "sells", "stocks", "avg_score")])).alias("e")).select("e.*")
    top = h.select(F.lit("top_pick").alias("section"), F.concat_ws("/", "ticker", "signal").alias("name"),
                   F.lit(1.0).alias("x"))
    f = R.factor_means(r)
    means = f.select(F.explode(F.array(*[
        F.struct(F.lit("factor").alias("section"), F.lit(c).alias("name"), F.col(c).alias("x")) for c in f.columns
    ])).alias("e")).select("e.*")
    expo = R.exposure(r).select(F.lit("exposure").alias("section"), F.col("bucket").alias("name"),
                                F.col("n").cast("double").alias("x"))
    show = R.showcase(r).select(F.lit("showcase").alias("section"), F.col("ticker").alias("name"),
                                F.col("composite_score").alias("x"))
    return six(head.unionByName(top).unionByName(means).unionByName(expo).unionByName(show))


def q48_clean_fundamentals(spark, sf):
    f = M.fundamentals(spark, sf)
    return six(f.withColumns({
        "market": S.market_of("ticker"), "log_mktcap": S.log_market_cap("market_cap"),
        "analyst_consensus": S.analyst_consensus("analyst_buy", "analyst_hold", "analyst_sell")}))


def q49_holdings_clean(spark, sf):
    """Each order as a portfolio request with untidy tickers and weights."""
    li = M.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    part = M.table(spark, sf, "part").select("p_partkey", M.ticker_of().alias("t"))
    rows = li.join(part, li.l_partkey == part.p_partkey)
    raw = rows.select(
        F.col("l_orderkey").alias("portfolio_id"),
        (F.col("l_linenumber") * 100000000000 + F.col("l_partkey") * 1000 + F.col("l_quantity")).cast("bigint").alias("pos"),
        F.when(F.col("l_partkey") % 17 == 0, F.col("l_partkey").cast("string"))
        .when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit(" "), F.lower("t"), F.lit("  "))).otherwise(F.col("t")).alias("ticker"),
        F.when(F.col("l_suppkey") % 7 == 0, F.lit(None).cast("string")).when(F.col("l_partkey") % 13 == 0, "abc")
        .when(F.col("l_partkey") % 11 == 0, "-5").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("weight"))
    clean, bad = T.clean_holdings(raw)
    return six(clean.select("portfolio_id", "pos", "ticker", F.lit("ok").alias("outcome"), "weight").unionByName(
        bad.select("portfolio_id", "pos", "ticker", F.col("reason").alias("outcome"),
                   F.col("weight").try_cast("double").alias("weight"))))


def q50_symbol_search(spark, sf):
    p = M.table(spark, sf, "part")
    symbols = p.select(
        F.concat(F.when(F.col("p_type") == "PROMO", "X:").otherwise(""), F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_type").isin("SMALL", "LARGE", "PROMO"), "Common Stock").when(F.col("p_type") == "MEDIUM", "ETF")
        .otherwise("ADR").alias("type"))
    return six(T.search_symbols(symbols, " RING "))


def q51_flat_record(spark, sf):
    days = durable(M.daily(spark, sf))
    info = T.clean_fundamentals(M.raw_fundamentals(spark, sf, days)).select(
        "ticker", "pe_ratio", "pb_ratio", "beta", "market_cap")
    return six(P.flat_records(M.bars(spark, sf, days), info))


def q52_freshness(spark, sf):
    ev = M.table(spark, sf, "events").select("user_id", "event_id", "ts")
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return six(P.freshest(ev, ["user_id"], "ts", at, ttl_hours=2, tie="event_id"))


def prediction_rows(rows: DataFrame) -> DataFrame:
    return rows.select("period", F.lit("prediction").alias("feature"), F.col("model_score").alias("value"))


def prediction_drift(spark, sf, rows: DataFrame | None = None, newest: bool = False) -> DataFrame:
    """``newest``: of the last period only."""
    rows = prediction_rows(M.scored(spark, sf)[0] if rows is None else rows)
    base = durable(N.baseline(rows.filter(F.col("period") <= BASE_PERIODS), ["feature"], max_groups=1))
    live = rows.filter(F.col("period") > BASE_PERIODS)
    return N.prediction_drift(N.latest_period(live, ["feature"], "period") if newest else live, base, ["period"])


def q53_prediction_drift(spark, sf):
    out = prediction_drift(spark, sf)
    return six(out.select("period", "feature", "psi", "status", "mean", "std", "p5", "p25", "p50", "p75", "p95", "lo", "hi",
                          F.array_join(F.col("counts").cast("array<string>"), ",").alias("hist")), 4)


def q54_latest_state(spark, sf):
    """Newest drift row per feature and newest prediction drift, in one long table."""
    drift = feature_drift(spark, sf, newest=True).withColumn("model_version", F.lit(_version()))
    a = N.latest_per_key(drift, ["model_version", "feature"], ["quarter"])
    pred = prediction_drift(spark, sf, newest=True).withColumn("model_version", F.lit(_version()))
    b = N.latest_per_key(pred, ["model_version", "feature"], ["period"])
    cols = ["model_version", "feature", "psi", "status", "mean", "std"]
    return six(a.select(*cols, F.col("quarter").alias("period_key")).unionByName(
        b.select(*cols, F.col("period").cast("string").alias("period_key"))), 4)


def q76_snapshot_features_large(spark, sf):
    """q55 with the plan for universes of any size."""
    return q55_snapshot_features(spark, sf, 0)


def q55_snapshot_features(spark, sf, limit=O.GROUP_ROWS_IN_ONE_TASK):
    feats, _ = M.universe(spark, sf, limit)
    return six(feats.select("ticker", *K.FEATURES, *[f"{c}_rank" for c in K.FEATURES]))


def q56_snapshot_labels(spark, sf):
    feats, _ = M.universe(spark, sf)
    feats = durable(feats)
    spread = O.needs_spread(feats, [])
    out = L.snapshot_labels(feats, [], spread=spread)
    return six(out.select("ticker", *[f"{c}_rank" for c in K.PRICE_FEATURES], "fwd_ret", "label", "is_snapshot",
                          L.momentum_label(out).alias("fallback_label")))


def q57_ownership_earnings(spark, sf):
    """Top-20 suppliers as holders; announcement dates as the earnings calendar."""
    rows = M.sales(spark, sf, "l_suppkey", "l_quantity")
    held = rows.groupBy("ticker", F.col("l_suppkey").alias("holder")).agg(F.sum("l_quantity").alias("u"))
    total = held.groupBy("ticker").agg(F.sum("u").alias("all_u"))
    holders = held.join(total, "ticker").withColumn("pct", F.col("u") / F.col("all_u") * 100)
    own = T.institutional_ownership(holders)
    calendar = M.earnings(spark, sf).select("ticker", F.col("announce_date").alias("date"))
    ahead = T.next_earnings(calendar, F.to_date(F.lit("2001-10-01")))
    return six(own.join(ahead, "ticker", "left"))


def q64_retention(spark, sf):
    o = M.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    kept = P.retained(o, "o_orderdate", F.lit(M.AS_OF).cast("timestamp_ntz"), K.RETENTION_DAYS)
    return six(kept)


def q65_training_universe(spark, sf):
    """Customers of one segment as requests, another as anchors, buyers as stored names."""
    c = M.table(spark, sf, "customer").select(F.col("c_name").alias("ticker"), "c_custkey", "c_mktsegment")
    buyers = M.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    stored = T.restrict_universe(c, buyers, "c_custkey")
    return six(L.training_universe(c.filter("c_mktsegment = 'MACHINERY'"), c.filter("c_mktsegment = 'BUILDING'"), stored))


def q66_market_histogram(spark, sf):
    out = N.histogram(M.drift_rows(spark, sf), ["feature"])
    return six(out.select("feature", "lo", "hi", F.array_join(F.col("counts").cast("array<string>"), ",").alias("hist")))


def q67_signal_payload(spark, sf):
    """Signals of the scored universe written to and read back from JSON payloads, dealt out by ticker."""
    r = M.results(spark, sf).select("ticker", "signal", "composite_score", F.lit("run").alias("run"),
                                    F.pmod(F.xxhash64("ticker"), F.lit(4096)).alias("part"))
    return six(R.parse_payloads(R.signal_payloads(r, ["run", "part"])).drop("part"))


def q68_insights(spark, sf):
    """Theses with the realised hit rate of their confidence band."""
    from tapeworks.operators import books as B
    rows, spread = M.scored(spark, sf)
    bands = B.band_hit_rates(B.period_examples(rows, spread=spread))
    r = M.results(spark, sf).withColumn("band", S.confidence_band("composite_score"))
    out = r.join(bands.select("band", F.col("hit_rate").alias("band_hit_rate")), "band", "left")
    return six(out.select("ticker", "signal", "composite_score", "band", "band_hit_rate",
                          F.array_join("thesis.bull", " | ").alias("bull"), F.array_join("thesis.bear", " | ").alias("bear")))


QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
