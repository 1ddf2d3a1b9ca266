"""Queries over sources, sinks, logs, streams and small report operators.

Each writes to and reads back from fresh folders inside the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.operators import books as B
from tapeworks.operators import cross_section as X
from tapeworks.operators import labels as L
from tapeworks.operators import monitoring as N
from tapeworks.operators import ordering as O
from tapeworks.operators import portfolio as D
from tapeworks.operators import scoring as R
from tapeworks.operators import timeseries as TS
from tapeworks.plans import market as M
from tapeworks.plans import panel_queries as PQ
from tapeworks.plans import signal_queries as Q
from tapeworks.plans.panel_oracle import BARS, MONTHLY, PANEL, PX, REF, SCORED, TICKER, WINDOWS, features, r6, with_
from tapeworks.plans.panel_oracle import SQL as PANEL_SQL
from tapeworks.plans.panel_queries import six
from tapeworks.plans.signal_oracle import DRIFT, MATURED, RESULTS
from tapeworks.plans.signal_oracle import SQL as SIGNAL_SQL
from tapeworks.session import checkpoint_dir, durable
from tapeworks.sources import prices as P
from tapeworks.sources import tables as T
from tapeworks.sources import versions as V
from tapeworks.streaming import jobs


def folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


FOREIGN = "7203.T"
REFERENCE = ["BRAND-12"]


def q77_price_store(spark, sf):
    """Prices published clustered by ticker, twice, and read back; all held names (a foreign one is no US name) and
    the reference symbol."""
    path = folder(spark, "prices")
    prices = durable(M.prices(spark, sf))
    P.publish_prices(prices.limit(10), path, 0)
    P.publish_prices(prices, path, 1)
    held = M.line_holdings(spark, sf).select("ticker").distinct()
    wanted = held.unionByName(spark.createDataFrame([(FOREIGN,)], "ticker string"))
    return six(P.corpus(P.published_prices(spark, path), wanted, REFERENCE).select("ticker", "dt", "close", "volume"))


def q78_history_store(spark, sf):
    """Earnings and analyst histories as JSON documents per ticker, read back and unfolded."""
    months = durable(M.monthly(spark, sf))
    surprise = M.earnings(spark, sf).select("ticker", F.struct(
        "period", F.lit(None).cast("date").alias("announce_date"), F.col("surprise_pct").alias("surprisePercent")).alias("e"))
    ratings = months.select("ticker", F.struct(
        "period", (F.col("buy") % 3).cast("int").alias("strongBuy"), (F.col("buy") - F.col("buy") % 3).cast("int").alias("buy"),
        F.col("hold").cast("int").alias("hold"), F.col("sell").cast("int").alias("sell"), F.lit(0).alias("strongSell")).alias("a"))
    docs = surprise.groupBy("ticker").agg(F.collect_list("e").alias("earnings")).join(
        ratings.groupBy("ticker").agg(F.collect_list("a").alias("analyst")), "ticker", "full")
    path = folder(spark, "histories")
    T.publish_report(docs, path)
    back = V.read(spark, path)
    e = T.earnings_rows(back).select("ticker", F.lit("earnings").alias("kind"), "period", F.round("surprise_pct", 4).alias("x"), "announce_date")
    a = T.analyst_rows(back).select("ticker", F.lit("analyst").alias("kind"), "period",
                                    (F.col("buy") * 10000 + F.col("hold") * 100 + F.col("sell")).cast("double").alias("x"),
                                    F.lit(None).cast("date").alias("announce_date"))
    return six(T.union_sets(e, a), 4)


def q79_prediction_log(spark, sf):
    """Predictions of two scored universes appended to the partitioned log; repeated rows are dropped on reading."""
    path = folder(spark, "predictions")
    r = durable(M.results(spark, sf))
    at = F.lit("2001-11-10").cast("date")
    for version, period in (("v1", 1), ("v2", 2), ("v2", 2)):
        T.append_table(N.log_predictions(r, version, F.lit(period), at), path)
    rows = spark.read.parquet(path)
    return six(T.union_sets(rows, rows.limit(0), distinct=True).select(
        "model_version", "period_key", "predicted_at", "ticker", "prediction", "horizon_days"))


def q80_recorded_signals(spark, sf):
    """Analysis payloads appended to the activity log; the signals each user saw last."""
    path = folder(spark, "activity")
    events = M.signal_events(spark, sf).withColumn("half", F.col("event_id") % 2)
    for half in (0, 1):
        T.append_table(events.where(F.col("half") == half), path, by="half")
    back = R.recent_events(spark.read.parquet(path).drop("half"), "user_id", "ts", "event_id")
    return six(R.prior_signals(R.parse_payloads(back), "user_id", "ts", "event_id"))


def q81_ranked_results(spark, sf):
    """Scored names best first, with their place."""
    r = durable(M.results(spark, sf).select("ticker", "composite_score", "signal"))
    return six(R.placed_results(r))


def q82_varied_periods(spark, sf):
    """Periods whose scores differ."""
    rows, _ = M.scored(spark, sf)
    return six(B.has_variation(rows, ["period"], "model_score"))


def q83_neutral_fill(spark, sf):
    """Snapshot features with every gap filled by the neutral value."""
    rows = TS.price_features(M.bars(spark, sf), "snapshot").select("ticker", "dt", *K.PRICE_FEATURES)
    return six(X.neutral_fill(rows.withColumn("emb_0", F.col("mom_12m"))))


def q84_row_folds(spark, sf):
    """Expanding splits on row order."""
    rows, _ = M.scored(spark, sf)
    return six(L.row_folds(rows, ["period", "ticker"], 5))


def q85_scaled_importance(spark, sf):
    """Shares of the largest: the ten brands with most units stand for features."""
    units = M.sales(spark, sf, "l_quantity").groupBy("ticker").agg(F.sum("l_quantity").cast("double").alias("importance"))
    return six(R.scaled_importance(units.withColumnRenamed("ticker", "feature")))


def q86_display_numbers(spark, sf):
    """The rounded fundamentals shown next to a signal."""
    return six(M.results(spark, sf).select("ticker", "fundamentals.*"))


def q87_drift_stream(spark, sf):
    """Feature drift of the live quarters from the state that a stream keeps; lines of a quarter arrive in several batches."""
    lines = M.drift_lines(spark, sf)
    base = Q.drift_base(*Q.counted_quarters(lines.filter(~M.is_live())))
    arriving, out, state = (folder(spark, n) for n in ("lines", "counts", "state"))
    stream = jobs.arrivals(lines.filter(M.is_live()), arriving, 3)
    jobs.drift_state_stream(M.melted(stream), ["quarter_no", "feature"], out, state).awaitTermination()
    counts = M.named_quarters(jobs.read_drift_state(spark, out, ["quarter_no", "feature"]))
    return six(N.feature_drift(counts, base, ["quarter"], weight="c").drop("n"), 4)


def q88_maturation_stream(spark, sf):
    """Predictions matured by a stream over arriving bars; delisted names mature from the bars already there."""
    series = durable(M.bars(spark, sf))
    rows, _ = Q.matured(spark, sf)
    preds, bars, arriving, done, state = (folder(spark, n) for n in ("preds", "bars", "arriving", "matured", "state"))
    rows.drop("realized_return", "matured").write.parquet(preds)
    series.write.parquet(bars)
    series.where("ticker <= 'BRAND-2'").write.parquet(arriving)
    stream = spark.readStream.schema(series.schema).parquet(arriving)
    jobs.maturation_stream(stream, preds, done, lambda s: s.read.parquet(bars), F.to_date(F.lit(Q.NOW)), state).awaitTermination()
    return six(spark.read.parquet(done).select(
        "pred_id", "model_version", "period_key", "predicted_at", "ticker", "prediction", "horizon_days", "realized_return"))


def q89_alert_log(spark, sf):
    """Alert rows of the latest state, appended to the alert table and read back."""
    states, roll, drift, pred = Q.states(spark, sf)
    last = states.withColumn("top_", F.max("quarter").over(Window.partitionBy("model_version"))).where("quarter = top_")
    pred = N.latest_per_key(pred.withColumn("model_version", F.lit(Q._version())), ["model_version"], ["period"])
    path = folder(spark, "alerts")
    T.append_table(N.alert_rows(N.evaluate_ic(roll), last, pred), path)
    return spark.read.parquet(path).select("model_version", "level", "kind")


def q90_dashboard(spark, sf):
    """The dashboard payload, opened again: its sizes and the verdict."""
    states, roll, drift, pred = Q.states(spark, sf)
    last = states.withColumn("top_", F.max("quarter").over(Window.partitionBy("model_version"))).where("quarter = top_")
    version = F.lit(Q._version())
    pred = pred.withColumn("model_version", version).withColumnRenamed("period", "period_key")
    payload = N.dashboard(drift.withColumn("model_version", version).withColumnRenamed("quarter", "period_key"), pred, roll, last)
    p = lambda path: F.get_json_object("payload", path)
    return six(payload.select(
        "model_version", F.json_array_length(p("$.rolling_ic")).alias("ic_rows"), F.json_array_length(p("$.feature_psi")).alias("features"),
        p("$.prediction_drift.status").alias("prediction_status"), p("$.recommendation.status").alias("verdict")))


ALL_CHANNELS = [*K.BASE_CHANNELS, *K.MARKET_CHANNELS, *K.EVENT_CHANNELS]


def q93_channel_windows(spark, sf):
    """All eight channels of each window, standardised; the values of the last bar, and a ninth without a source."""
    days = durable(M.daily(spark, sf))
    bars = durable(M.bars(spark, sf, days))
    sectors = M.industries(spark, sf).select("ticker", "sector")
    px = bars.select("ticker", "dt", "close")
    # every bar is one of the days that the reference series are made of, so the match is by day; the series
    # are one row per date (and sector), broadcast when measured to be small
    market = O.checked_broadcast(M.market_series(px).withColumnRenamed("close", "market_close"))
    by_sector = O.checked_broadcast(M.sector_series(px, sectors).withColumnRenamed("close", "sector_close"))
    events = PQ.earnings_pulse(px.select("ticker", "dt"), M.earnings(spark, sf, days)).select(
        "ticker", "dt", F.col("earn_surprise_pulse").alias("pulse"))
    ratings = PQ.analyst_net(px.select("ticker", "dt"), M.analyst(spark, sf, days)).select(
        "ticker", "dt", F.col("analyst_net_buy_ts").alias("net_buy"))
    rows = (bars.join(events, ["ticker", "dt"]).join(ratings, ["ticker", "dt"])
            .join(O.checked_broadcast(sectors), "ticker", "left").join(market, "dt", "left").join(by_sector, ["sector", "dt"], "left"))
    spec = [*ALL_CHANNELS, "absent"]
    z = TS.standardized_windows(TS.window_channels(TS.window_rows(rows), spec), spec)
    return six(z.groupBy("ticker", "end_bar").agg(
        F.count(F.lit(1)).alias("steps"), *[F.max_by(f"{c}_z", "bar").alias(c) for c in spec]))


def q94_panel_embeddings(spark, sf):
    """Window embeddings of the bar before each period, standardised in the period, next to the panel's returns."""
    bars = durable(M.bars(spark, sf))
    panel = durable(L.period_panel(bars).select("period", "ticker", "fwd_ret"))
    rows = TS.window_rows(bars.select("ticker", "dt", "close", "bar"), step=63, first=62)
    emb = TS.window_embedding(TS.base_window_channels(rows))
    return six(L.with_embeddings(panel, emb, 4))


def q95_track_record(spark, sf):
    """The record shown with the insights, from the backtest report."""
    best, rows, spread = PQ.top(spark, sf)
    report = B.backtest_report(best, B.spearman_ic(rows, ["period"], ["ticker"], spread=spread), B.hit_rate(rows, spread=spread), PQ.bench(rows))
    bands = B.band_hit_rates(B.period_examples(rows, spread=spread))
    _, record = R.insights(M.results(spark, sf), bands, report)
    return six(record.drop("interpretation"))


def q96_holdings_report(spark, sf):
    """Scored holdings, composition, flags and additions of every portfolio, from candidates with enough history."""
    raw = M.latest_raw(spark, sf).select("ticker", (F.col("bar") + 1).alias("bars"))
    scored = M.results(spark, sf).select("ticker", "sector", "composite_score", "signal").join(raw, "ticker")
    return six(D.holdings_report(durable(M.holdings(spark, sf)), durable(D.eligible(durable(scored)).drop("bars"))))


def q97_own_panel(spark, sf):
    """The training panel in which every series ends with itself."""
    rows = L.period_panel(M.bars(spark, sf), until="own")
    return six(rows.select("period", "ticker", "start_dt", "end_dt", "fwd_ret", "vol"))


def q98_recent_state(spark, sf):
    """What the monitoring store serves: the baseline captured last, and the ten newest correlations and alerts."""
    path, log = folder(spark, "baselines"), folder(spark, "alerts")
    base, _, _ = Q.drift_parts(spark, sf)
    for version, shift in ((1, 1.0), (2, 0.0)):     # a later capture replaces the earlier one
        captured = base.select("feature", (F.col("mean") + shift).alias("mean"), F.lit(version).alias("captured"),
                               F.lit(Q._version()).alias("model_version"))
        T.append_table(captured, path)
    newest = N.latest_per_key(spark.read.parquet(path), ["model_version", "feature"], ["captured"])
    _, roll, drift, _ = Q.states(spark, sf)
    alerts = drift.where("status <> 'stable'").withColumn("model_version", F.lit(Q._version()))
    T.append_table(alerts.select("model_version", "quarter", "feature", "psi"), log)
    ics = roll.where(F.col("window") == K.IC_PRIMARY_WINDOW)
    recent_ic = T.page(ics, [F.desc("ts"), F.desc("period_key")], 10)
    recent_alerts = T.page(spark.read.parquet(log), [F.desc("quarter"), F.col("feature")], 10)
    out = newest.select(F.lit("baseline").alias("kind"), F.col("feature").alias("name"), F.col("mean").alias("x")).unionByName(
        recent_ic.select(F.lit("ic").alias("kind"), F.col("period_key").cast("string").alias("name"), F.col("spearman").alias("x"))).unionByName(
        recent_alerts.select(F.lit("alert").alias("kind"), F.concat_ws("/", "quarter", "feature").alias("name"), F.col("psi").alias("x")))
    return six(out, 4)


def q99_encoded_windows(spark, sf):
    """Embeddings from a user's own encoder: where a window's return and volatility peak, and how many returns are above their mean."""
    import numpy as np

    def encode(m):
        return np.array([m[:, 0].argmax(), m[:, 1].argmax(), (m[:, 0] > 0).sum()], dtype=float)

    chans = TS.base_window_channels(TS.window_rows(M.bars(spark, sf).select("ticker", "dt", "close", "bar")))
    e = TS.encoded_windows(chans, K.BASE_CHANNELS, encode, 3)
    return six(e.select("ticker", "end_bar", *[F.col("embedding")[i].alias(n) for i, n in enumerate(("ret_peak", "vol_peak", "above"))]))


SNAPSHOT = features("bars", "snapshot")
SQL = {
    "q77_price_store": f"""WITH {PX}, held AS (
        SELECT DISTINCT upper(replace(p_brand, '#', '-')) AS ticker FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
        SELECT ticker, dt, close, volume FROM px WHERE (ticker IN (SELECT ticker FROM held) AND ticker <> '{FOREIGN}') OR ticker IN ('{REFERENCE[0]}')""",
    "q78_history_store": with_(MONTHLY, """SELECT ticker, 'earnings' AS kind, period, round(round(surprise_pct, 4), 4) AS x, announce_date FROM earnings
        UNION ALL SELECT ticker, 'analyst', period, CAST(buy * 10000 + hold * 100 + sell AS DOUBLE), NULL FROM monthly"""),
    "q79_prediction_log": with_(RESULTS, f"""SELECT v AS model_version, p AS period_key, DATE '2001-11-10' AS predicted_at, ticker,
        round(coalesce(round_even(prob * 100, 1), composite_score) / 100, 6) AS prediction, {K.LABEL_HORIZON_BARS} AS horizon_days
        FROM res CROSS JOIN (VALUES ('v1', 1), ('v2', 2)) AS t(v, p)"""),
    "q80_recorded_signals": SIGNAL_SQL["q31_prior_signals"],
    "q81_ranked_results": with_(RESULTS, """SELECT ticker, composite_score, signal, row_number() OVER (ORDER BY composite_score DESC, ticker) AS place
        FROM res"""),
    "q82_varied_periods": with_(SCORED, "SELECT period FROM scored GROUP BY 1 HAVING count(DISTINCT model_score) > 1"),
    "q83_neutral_fill": with_(BARS + "," + SNAPSHOT, f"""SELECT ticker, dt, {', '.join(f'round(coalesce({c}, 0.5), 6) AS {c}' for c in K.PRICE_FEATURES)},
        round(coalesce(mom_12m, 0.0), 6) AS emb_0 FROM feats"""),
    "q84_row_folds": with_(SCORED + """, o AS (SELECT period, ticker, row_number() OVER (ORDER BY period, ticker) - 1 AS i, count(*) OVER () AS n FROM scored),
        z AS (SELECT *, n // 6 AS size, n - n // 6 * 5 AS lead_ FROM o)""",
        "SELECT period, ticker, CASE WHEN i < lead_ THEN 0 ELSE (i - lead_) // size + 1 END AS part FROM z"),
    "q85_scaled_importance": f"""WITH u AS (SELECT {TICKER} AS feature, CAST(sum(l_quantity) AS DOUBLE) AS importance FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT feature, importance, round(importance / max(importance) OVER () * 100, 0) AS pct FROM u""",
    "q86_display_numbers": with_(RESULTS, "SELECT ticker, " + ", ".join(
        [f"round_even({c}, 2) AS {c}" for c in ("pe_ratio", "pb_ratio", "debt_equity", "beta", "rsi_14")]
        + [f"round_even({c} * 100, 1) AS {c}" for c in ("roe", "net_margin", "revenue_growth", "dividend_yield", "mom_12m", "mom_3m", "vol_60d")])
        + " FROM res"),
    "q87_drift_stream": SIGNAL_SQL["q37_feature_psi"],
    "q88_maturation_stream": with_(MATURED, """SELECT pred_id, model_version, period_key, predicted_at, ticker, prediction, horizon_days,
        round(realized_return, 6) AS realized_return FROM mt WHERE realized_return IS NOT NULL"""),
}
_Z = ", ".join(f"({c} - avg({c}) OVER p) / CASE WHEN stddev_pop({c}) OVER p < 1e-8 THEN 1 ELSE stddev_pop({c}) OVER p END AS {c}_z" for c in ALL_CHANNELS)
SQL["q93_channel_windows"] = with_(REF + f""",
  ev AS ({PANEL_SQL['q08_earnings_pulse'].replace('round(coalesce(', '(coalesce(').replace(', 0), 6) AS earn', ', 0)) AS earn')}),
  an AS ({PANEL_SQL['q09_analyst_net'].replace('round(coalesce(', '(coalesce(').replace(', 0), 6) AS analyst', ', 0)) AS analyst')}),
  src AS (SELECT refs.ticker, refs.dt, refs.bar, close, volume, mk, sc, earn_surprise_pulse, analyst_net_buy_ts
    FROM refs JOIN ev USING (ticker, dt) JOIN an USING (ticker, dt)),
  wr AS (SELECT e.ticker, e.bar AS end_bar, b.* EXCLUDE (ticker) FROM src e JOIN src b ON b.ticker = e.ticker
    AND b.bar BETWEEN e.bar - 252 AND e.bar WHERE e.bar >= 252 AND (e.bar - 252) % 21 = 0),
  wl AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS logret, coalesce(ln(mk) - ln(lag(mk) OVER w), 0) AS mret,
    coalesce(ln(sc) - ln(lag(sc) OVER w), 0) AS sret, lag(bar) OVER w AS pb FROM wr WINDOW w AS (PARTITION BY ticker, end_bar ORDER BY bar)),
  wm AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(logret) OVER w ELSE 0 END AS vol, median(volume) OVER w AS m FROM wl WHERE pb IS NOT NULL
    WINDOW w AS (PARTITION BY ticker, end_bar ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  wc AS (SELECT ticker, end_bar, bar, logret, vol, CASE WHEN volume > 0 AND m > 0 THEN ln(volume / m) ELSE 0 END AS rel_volume,
    CASE WHEN close * volume > 0 THEN ln(close * volume) ELSE 0 END AS log_dollar_vol, logret - mret AS excess_ret_vs_market,
    logret - sret AS rel_strength_vs_sector, earn_surprise_pulse, analyst_net_buy_ts FROM wm),
  z AS (SELECT ticker, end_bar, bar, {_Z} FROM wc WINDOW p AS (PARTITION BY ticker, end_bar))""",
  f"""SELECT ticker, end_bar, count(*) AS steps, {', '.join(f'round(arg_max({c}_z, bar), 6) + 0.0 AS {c}' for c in ALL_CHANNELS)}, 0.0 AS absent FROM z GROUP BY 1, 2""")
_E = ["avg(logret)", "stddev_pop(logret)", "arg_max(logret, bar)", "count(*)::DOUBLE"]
SQL["q94_panel_embeddings"] = with_(PANEL + """,
  wr AS (SELECT e.ticker, e.bar AS end_bar, b.bar, b.close FROM bars e JOIN bars b ON b.ticker = e.ticker
    AND b.bar BETWEEN e.bar - 252 AND e.bar WHERE (e.bar + 1) % 63 = 0),
  wl AS (SELECT *, coalesce(ln(close) - ln(lag(close) OVER w), 0) AS logret, lag(bar) OVER w AS pb FROM wr WINDOW w AS (PARTITION BY ticker, end_bar ORDER BY bar)),
  em AS (SELECT ticker, (end_bar + 1) // 63 AS period, """ + ", ".join(f"{e} AS e{i}" for i, e in enumerate(_E)) + """ FROM wl WHERE pb IS NOT NULL GROUP BY 1, 2),
  pe AS (SELECT panel.period, panel.ticker, fwd_ret, e0, e1, e2, e3 FROM panel JOIN em USING (period, ticker))""",
  "SELECT period, ticker, round(fwd_ret, 6) AS fwd_ret, " + ", ".join(
      f"round(CASE WHEN stddev_samp(e{i}) OVER g >= 1e-8 THEN (e{i} - avg(e{i}) OVER g) / stddev_samp(e{i}) OVER g ELSE 0 END, 6) AS emb_{i}"
      for i in range(4)) + " FROM pe WINDOW g AS (PARTITION BY period)")
SQL["q95_track_record"] = f"""SELECT hit_rate, ic_mean AS ic, ann_alpha_net AS ann_alpha, sharpe_ratio AS sharpe, max_drawdown, n_periods
  FROM ({PANEL_SQL['q24_beta_alpha']})"""
SQL["q96_holdings_report"] = f"""WITH c AS ({SIGNAL_SQL['q32_composition']}), f AS ({SIGNAL_SQL['q33_flags']}), a AS ({SIGNAL_SQL['q34_recommend']}),
  r AS ({SQL['q81_ranked_results']}), h AS (SELECT DISTINCT o_custkey AS portfolio_id, {TICKER} AS ticker
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT portfolio_id, 'holding' AS section, ticker AS item, composite_score AS value, signal AS text FROM h LEFT JOIN r USING (ticker)
UNION ALL SELECT portfolio_id, 'sector', sector, pct, NULL FROM c UNION ALL SELECT portfolio_id, 'flag', sector, pct, message FROM f
UNION ALL SELECT portfolio_id, 'addition', ticker, composite_score, rationale FROM a"""
_SHORTEST = "bar + 1 + 252 < (SELECT min(n) FROM gate)"
assert _SHORTEST in PANEL
SQL["q97_own_panel"] = with_(PANEL.replace(_SHORTEST, "bar + 1 + 252 < (SELECT g.n FROM gate g WHERE g.ticker = fwd.ticker)"),
                             f"SELECT period, ticker, start_dt, end_dt, {r6('fwd_ret vol')} FROM panel")
_LAST = f"""WITH s AS (SELECT * FROM ({SIGNAL_SQL['q40_alert_decide']}) QUALIFY quarter = max(quarter) OVER ()),
  p AS (SELECT * FROM ({SIGNAL_SQL['q53_prediction_drift']}) ORDER BY period DESC LIMIT 1)"""
SQL["q89_alert_log"] = _LAST + """ SELECT model_version, ic_level AS level, 'ic' AS kind FROM s WHERE ic_level <> 'ok'
  UNION ALL SELECT model_version, CASE WHEN critical <> '' THEN 'CRITICAL' ELSE 'WARNING' END, 'psi' FROM s WHERE critical <> '' OR warning <> ''
  UNION ALL SELECT s.model_version, 'CRITICAL', 'pred_drift' FROM s, p WHERE p.status = 'critical'"""
SQL["q90_dashboard"] = _LAST + f""" SELECT s.model_version, (SELECT count(*) FROM ({SIGNAL_SQL['q39_rolling_ic']})) AS ic_rows,
  (SELECT count(*) FROM ({SIGNAL_SQL['q37_feature_psi']}) d WHERE d.quarter = s.quarter) AS features, p.status AS prediction_status, s.status AS verdict FROM s, p"""
SQL["q98_recent_state"] = f"""WITH d AS ({SIGNAL_SQL['q37_feature_psi']}), i AS ({SIGNAL_SQL['q39_rolling_ic']}), b AS ({with_(DRIFT,
    "SELECT feature, avg(value) AS mean FROM dr WHERE quarter < '1998' GROUP BY 1")})
SELECT 'baseline' AS kind, feature AS name, round(mean, 4) AS x FROM b
UNION ALL (SELECT 'ic', CAST(period_key AS VARCHAR), round(spearman, 4) FROM i WHERE "window" = {K.IC_PRIMARY_WINDOW} ORDER BY ts DESC, period_key DESC LIMIT 10)
UNION ALL (SELECT 'alert', quarter || '/' || feature, psi FROM d WHERE status <> 'stable' ORDER BY quarter DESC, feature LIMIT 10)"""
SQL["q99_encoded_windows"] = with_(WINDOWS + """,
  z AS (SELECT ticker, end_bar, bar - end_bar + 251 AS step, vol, logret, logret - avg(logret) OVER (PARTITION BY ticker, end_bar) AS d FROM wc)""",
  """SELECT ticker, end_bar, arg_max(step, logret)::DOUBLE AS ret_peak, arg_max(step, vol)::DOUBLE AS vol_peak, count(*) FILTER (d > 0)::DOUBLE AS above FROM z GROUP BY 1, 2""")
QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
