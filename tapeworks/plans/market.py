"""The analytics inputs, derived from the given tables.

ticker = brand of the part, price = revenue per unit sold that day, volume =
units. Money is summed in whole cents, so results do not depend on the order in
which tasks finish. The lineitem-part join carries no hint: Spark broadcasts
``part`` while its statistics say it is small, and otherwise shuffles both sides
with adaptive skew splitting for hot parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions import scalars as S
from tapeworks.functions import signals as G
from tapeworks.operators import cross_section as X
from tapeworks.operators import labels as L
from tapeworks.operators import ordering as O
from tapeworks.operators import scoring as R
from tapeworks.operators import timeseries as TS
from tapeworks.session import durable
from tapeworks.sources import prices as P
from tapeworks.sources import tables as T

AS_OF = "2001-11-10 00:00:00"
# part type -> the industry text a data vendor would send (fixture values)
INDUSTRY = {
    "ECONOMY": "Beverages", "SMALL": "Utilities", "PROMO": "Media",
    "LARGE": "Machinery", "STANDARD": "Banking", "MEDIUM": "Pharmaceuticals",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticker_of(brand: str = "p_brand") -> Column:
    return F.upper(F.replace(F.col(brand), F.lit("#"), F.lit("-")))


def rounded(x: Column) -> Column:
    """``round(x)`` of doubles, half away from zero, without a decimal number per row: the same number for every double."""
    even = F.rint(x)                                       # x - even is exact, so a tie is known for sure
    return F.when(F.abs(x - even) == 0.5, x + F.signum(x) * 0.5).otherwise(even) + 0.0      # no negative zero


def hundredths(c: str) -> Column:
    return rounded(F.col(c) * 100).cast("bigint")


def sales(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """lineitem columns with the ticker of the part."""
    li = table(spark, sf, "lineitem").select("l_partkey", *cols)
    part = table(spark, sf, "part").select("p_partkey", ticker_of().alias("ticker"))
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select("ticker", *cols)


def close_of(cents: Column, units: Column) -> Column:
    """Price per unit to four digits, rounded half up in whole numbers."""
    n = units.cast("bigint")
    return F.floor((cents * 200 + n) / (n * 2)) / 10000.0


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-number totals per (ticker, dt): the one pass over lineitem all views share.

    Sums a query does not use are pruned from the aggregation and the scan.
    """
    rows = sales(spark, sf, "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    flag = lambda f: F.sum((F.col("l_returnflag") == f).cast("bigint"))
    return rows.groupBy("ticker", F.to_date("l_shipdate").alias("dt")).agg(
        F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("volume"),
        F.sum(hundredths("l_extendedprice")).alias("cents"), F.sum(hundredths("l_tax")).alias("t"),
        F.sum(hundredths("l_discount")).alias("d"), flag("A").alias("ra"), flag("N").alias("rn"), flag("R").alias("rr"))


def prices(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    days = daily(spark, sf) if days is None else days
    return P.clean_prices(days.select(
        "ticker", "dt", close_of(F.col("cents"), F.col("volume")).alias("close"), "volume"))


def bars(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    return TS.with_bars(prices(spark, sf, days))


def industries(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, industry, sector): the most frequent part type of the brand."""
    n = table(spark, sf, "part").groupBy(ticker_of().alias("ticker"), "p_type").count()
    top = n.groupBy("ticker").agg(F.min_by("p_type", F.struct(-F.col("count"), F.col("p_type"))).alias("p_type"))
    text = F.create_map(*[F.lit(v) for kv in INDUSTRY.items() for v in kv])
    return top.select("ticker", F.try_element_at(text, F.col("p_type")).alias("industry")).withColumn(
        "sector", S.sector_of("industry"))


def totals(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """Whole-number totals per ticker, the seed of the stand-in fundamentals."""
    days = daily(spark, sf) if days is None else days
    return days.groupBy("ticker").agg(
        F.sum("c").alias("c"), F.sum(F.col("volume").cast("bigint")).alias("q"), F.sum("cents").alias("v"),
        *[F.sum(x).alias(x) for x in ("t", "d", "ra", "rn", "rr")])


# Stand-in ratios spread over the ranges where the rules change (fixture values).
# Plain arithmetic that Spark and DuckDB read alike; n/a marks missing data.
FUNDAMENTAL_TEXT = {
    "pe": "CASE WHEN c % 11 = 0 THEN 'n/a' ELSE CAST(5 + (v % 6000) / 1e2 AS STRING) END",
    "forward_pe": "CAST(5 + (v % 5400) / 1e2 AS STRING)",
    "pb": "CAST(5e-1 + (q % 900) / 1e2 AS STRING)",
    "roe": "CAST(((v + 7 * q) % 450 - 50) / 1e3 AS STRING)",
    "net_margin": "CAST((t * 7 + c) % 350 / 1e3 - 2e-2 AS STRING)",
    "fcf_yield_pct": "CASE WHEN d % 9 = 0 THEN NULL ELSE CAST((d * 5 + q) % 120 / 1e1 - 2 AS STRING) END",
    "ev_ebitda_annual": "CASE WHEN q % 5 = 0 THEN '0' ELSE CAST(4 + (v + 3 * q) % 300 / 1e1 AS STRING) END",
    "ev_ebitda": "CAST(5 + (v + q) % 250 / 1e1 AS STRING)",
    "revenue_growth": "CAST((c * 17 + q) % 400 / 1e3 - 1e-1 AS STRING)",
    "debt_equity": "CAST((q + t) % 300 / 1e2 AS STRING)",
    "dividend_yield_pct": "CAST((t + d) % 60 / 1e1 AS STRING)",
    "beta": "CAST(5e-1 + (v + c) % 170 / 1e2 AS STRING)",
    "cap_millions": "CAST((v % 1000 + 1) * 100 AS STRING)",
}
RATING_COUNTS = {"analyst_buy": "ra % 20", "analyst_hold": "rn % 12", "analyst_sell": "rr % 15"}


def raw_fundamentals(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    t = totals(spark, sf, days)
    return t.select(
        "ticker", *[F.expr(e).alias(k) for k, e in FUNDAMENTAL_TEXT.items()],
        *[F.expr(e).cast("int").alias(k) for k, e in RATING_COUNTS.items()],
        (F.col("c") * 13 % 70 / F.lit(100.0) + 0.2).alias("prior_score"),
        ((F.col("v") + F.col("q")) % 100 / F.lit(100.0)).cast("double").alias("inst_ownership"),
        ((F.col("c") + F.col("d")) % 30 / F.lit(100.0)).cast("double").alias("insider_ownership"))


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    raw = raw_fundamentals(spark, sf)
    return T.clean_fundamentals(raw)


def market_series(px: DataFrame) -> DataFrame:
    """(dt, close): mean close of all tickers that day."""
    return px.groupBy("dt").agg(_mean_close())


def sector_series(px: DataFrame, sectors: DataFrame) -> DataFrame:
    return px.join(sectors.select("ticker", "sector"), "ticker").groupBy("sector", "dt").agg(_mean_close())


def _mean_close() -> Column:
    units = F.sum(F.round(F.col("close") * 10000).cast("bigint"))
    return (units / (F.count(F.lit(1)) * 10000.0)).alias("close")


def monthly(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    days = daily(spark, sf) if days is None else days
    return days.groupBy("ticker", F.last_day("dt").alias("period")).agg(
        F.sum("cents").alias("cents"), F.sum("ra").alias("buy"), F.sum("rn").alias("hold"), F.sum("rr").alias("sell"))


def earnings(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """(ticker, period, announce_date, surprise_pct): monthly revenue change in percent."""
    w = Window.partitionBy("ticker").orderBy("period")      # one row per month
    rows = monthly(spark, sf, days).withColumn(
        "surprise_pct", (F.col("cents") / F.lag("cents").over(w) - 1) * 100)
    return T.with_announcements(rows.select("ticker", "period", "surprise_pct"))


def analyst(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    return monthly(spark, sf, days).select("ticker", "period", "buy", "hold", "sell")


def mean_rank() -> Column:
    """Deterministic stand-in score: the mean of the seven price ranks."""
    total = None
    for c in K.PRICE_FEATURES:
        r = F.coalesce(F.col(f"{c}_rank"), F.lit(0.5))
        total = r if total is None else total + r
    return F.round(total / 7, 6)


def panel(spark: SparkSession, sf: str, *, forward: int = 252, rebalance: int = 63,
          series: DataFrame | None = None) -> DataFrame:
    """``series``: the bars, where a caller has them written."""
    return L.period_panel(durable(bars(spark, sf)) if series is None else series, forward=forward, rebalance=rebalance)


def ranked(spark: SparkSession, sf: str, *, forward: int = 252, rebalance: int = 63,
           limit: int = O.GROUP_ROWS_IN_ONE_TASK, series: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``limit``: rows of a period from which the form for large groups is planned."""
    rows = durable(panel(spark, sf, forward=forward, rebalance=rebalance, series=series))
    spread = O.needs_spread(rows, ["period"], limit)
    return L.ranked_panel(rows, spread=spread), spread


def scored(spark: SparkSession, sf: str, limit: int = O.GROUP_ROWS_IN_ONE_TASK,
           series: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(period, ticker, dates, model_score, fwd_ret, vol, bench_ret) and the size flag."""
    rows, spread = ranked(spark, sf, limit=limit, series=series)
    return durable(rows.select(
        "period", "ticker", "start_dt", "end_dt", mean_rank().alias("model_score"),
        "fwd_ret", "vol", "bench_ret")), spread


def latest_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw 21 features and metadata of each ticker's last bar.

    ``high_any`` keeps the 52-week high of short series for the reference panel.
    """
    days = durable(daily(spark, sf))
    last = TS.last_bar(TS.price_features(bars(spark, sf, days), "panel"))
    last = last.select(
        "ticker", "dt", "bar", F.col("close").alias("last_price"),
        *[c for c in K.PRICE_FEATURES if c != "price_vs_52w_high"],
        F.col("price_vs_52w_high").alias("high_any"),
        F.when(F.col("bar") + 1 >= TS.HIGH_BARS, F.col("price_vs_52w_high")).alias("price_vs_52w_high"),
        F.col("mom_12m").alias("trailing_ret"))
    raw = raw_fundamentals(spark, sf, days)
    info = T.clean_fundamentals(raw).join(
        raw.select("ticker", "inst_ownership", "insider_ownership", "prior_score"), "ticker")
    surprise = T.surprise_average(earnings(spark, sf, days))
    out = last.join(info, "ticker", "left").join(surprise, "ticker", "left").join(
        industries(spark, sf), "ticker", "left")
    return out.withColumns({
        "log_mktcap": S.log_market_cap("market_cap"),
        "analyst_consensus": S.analyst_consensus("analyst_buy", "analyst_hold", "analyst_sell"),
        "market": S.market_of("ticker"),
    })


def universe(spark: SparkSession, sf: str, limit: int = O.GROUP_ROWS_IN_ONE_TASK) -> tuple[DataFrame, DataFrame]:
    """(features, raw): 21 filled features with ranks inside one universe, and the raw rows."""
    raw = durable(latest_raw(spark, sf))
    spread = O.needs_spread(raw, [], limit)
    return X.snapshot_features(raw, [], ["ticker"], spread=spread), raw


def priors(raw: DataFrame) -> DataFrame:
    """A stand-in for the signals shown earlier (fixture)."""
    return raw.select("ticker", G.signal_of("prior_score").alias("prior_signal"), F.lit("30 Sep 2001").alias("prior_date"))


def results(spark: SparkSession, sf: str, risk: str = "medium") -> DataFrame:
    """Scored universe: reference ranks -> stand-in probability -> signals."""
    feats, raw = universe(spark, sf)
    panel = X.reference_panel(raw.drop("price_vs_52w_high").withColumnRenamed("high_any", "price_vs_52w_high"))
    live = X.reference_ranks(durable(feats), panel, ["ticker"], K.PRICE_FEATURES)
    live = live.withColumn("prob", mean_rank())
    return R.score_universe(live, "prob", risk, priors(raw))


def line_holdings(spark: SparkSession, sf: str) -> DataFrame:
    """(portfolio_id, ticker, units): what each customer bought, by ticker."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = table(spark, sf, "part").select("p_partkey", ticker_of().alias("ticker"))
    rows = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey)
    return rows.groupBy(F.col("o_custkey").alias("portfolio_id"), "ticker").agg(F.sum("l_quantity").alias("units"))


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings with sector; one brand has no weight in every third portfolio."""
    rows = line_holdings(spark, sf).join(industries(spark, sf).select("ticker", "sector"), "ticker", "left")
    gap = (F.col("portfolio_id") % 3 == 0) & (F.col("ticker") == "BRAND-7")
    return rows.select("portfolio_id", "ticker", "sector", F.when(~gap, F.col("units")).alias("weight"))


MODEL = "2001-06-30T00:00:00"


def predictions(rows: DataFrame) -> DataFrame:
    """One prediction per scored row, made up to two days before the window start."""
    version = S.model_version(F.lit(MODEL), F.lit("v1"))
    early = (F.col("period") % 3).cast("int")
    return rows.select(
        F.concat_ws(":", F.col("period").cast("string"), "ticker").alias("pred_id"), version.alias("model_version"),
        F.col("period").alias("period_key"), F.date_sub("start_dt", early).alias("predicted_at"), "ticker",
        F.col("model_score").alias("prediction"), F.lit(63).alias("horizon_days"))


DRIFT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def drift_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(quarter_no, four line columns), one row per line; two quarters are shifted (fixture).

    Money and rates are in whole hundredths, so their sums are exact in any order. Quarters are numbers here: rows are
    counted by them, and their text (``named_quarters``) is made for the few rows that are left.
    """
    li = table(spark, sf, "lineitem").select("l_shipdate", *DRIFT_FEATURES)
    li = li.withColumn("quarter_no", F.year("l_shipdate") * 4 + F.quarter("l_shipdate") - 1)
    no = F.col("quarter_no")
    factor = F.when(no == 2000 * 4 + 1, 1.25).when(no == 2001 * 4, 2.0).otherwise(1.0)
    whole = {c: rounded(F.col(c) * 100) for c in DRIFT_FEATURES if c != "l_quantity"}
    li = li.withColumns({"l_quantity": F.col("l_quantity") * factor, **whole})
    return li.select("quarter_no", *DRIFT_FEATURES)


def melted(lines: DataFrame) -> DataFrame:
    """(quarter_no, feature, value) of ``drift_lines``."""
    return O.melt(lines, ["quarter_no"], DRIFT_FEATURES)


def quarter_text(no: str = "quarter_no") -> Column:
    """1998-Q3 of a quarter's number; empty for null."""
    return F.concat_ws("-Q", F.floor(F.col(no) / 4).cast("string"), (F.pmod(F.col(no), F.lit(4)) + 1).cast("string"))


def is_live(no: str = "quarter_no") -> Column:
    """``quarter_text`` is '1998' or later; the text is made only of years that have not four digits."""
    n = F.col(no)
    return F.when(n.between(1000 * 4, 9999 * 4 + 3), n >= 1998 * 4).otherwise(quarter_text(no) >= "1998")


def named_quarters(rows: DataFrame) -> DataFrame:
    return rows.select(quarter_text().alias("quarter"), *[c for c in rows.columns if c != "quarter_no"])


def drift_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(quarter, feature, value) of four line columns."""
    return O.melt(named_quarters(drift_lines(spark, sf)), ["quarter"], DRIFT_FEATURES)


def as_payload(events: DataFrame) -> DataFrame:
    """(user_id, event_id, ts, payload): each event as a one-ticker analysis payload."""
    v = F.col("value")
    k = F.get_json_object("props", "$.k")
    signal = F.when(v > 80, "STRONG BUY").when(v > 50, "BUY").when(v > 20, "HOLD").otherwise("SELL")
    entry = F.struct(signal.alias("signal"), F.least(v, F.lit(100.0)).alias("score"))
    body = F.struct(F.create_map(F.concat(F.lit("T"), k), entry).alias("signals"))
    return events.select("user_id", "event_id", "ts", F.to_json(body).alias("payload"))


def signal_events(spark: SparkSession, sf: str) -> DataFrame:
    return as_payload(table(spark, sf, "events"))
