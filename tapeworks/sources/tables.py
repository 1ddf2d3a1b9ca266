"""Fundamentals, histories, symbols, holdings, activity logs and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.scalars import clean_ticker, clip, finite, first_nonzero, valid_ticker
from tapeworks.sources import versions as V

HISTORY_SCHEMA = (
    "ticker string, earnings array<struct<period:date,announce_date:date,surprisePercent:double>>, "
    "analyst array<struct<period:date,strongBuy:int,buy:int,hold:int,sell:int,strongSell:int>>"
)


def clean_fundamentals(raw: DataFrame) -> DataFrame:
    """Vendor row -> model units: percent yields to decimals, cap in millions to units."""
    return raw.select(
        "ticker",
        finite("pe").alias("pe_ratio"), finite("forward_pe").alias("forward_pe"), finite("pb").alias("pb_ratio"),
        finite("roe").alias("roe"), finite("net_margin").alias("net_margin"),
        (finite("fcf_yield_pct") / 100).alias("fcf_yield"),
        first_nonzero(finite("ev_ebitda_annual"), finite("ev_ebitda")).alias("ev_ebitda"),
        finite("revenue_growth").alias("revenue_growth"), finite("debt_equity").alias("debt_equity"),
        (finite("dividend_yield_pct") / 100).alias("dividend_yield"), finite("beta").alias("beta"),
        (F.coalesce(finite("cap_millions"), F.lit(0.0)) * 1000000).alias("market_cap"),
        "analyst_buy", "analyst_hold", "analyst_sell",
    )


def read_histories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).json(path)


def earnings_rows(histories: DataFrame, lag_days: int = K.ANNOUNCE_LAG_DAYS) -> DataFrame:
    """(ticker, period, announce_date, surprise_pct) of the complete entries."""
    e = histories.select("ticker", F.explode("earnings").alias("e"))
    return with_announcements(e.select(
        "ticker", "e.period", "e.announce_date", F.col("e.surprisePercent").alias("surprise_pct")), lag_days)


def with_announcements(rows: DataFrame, lag_days: int = K.ANNOUNCE_LAG_DAYS) -> DataFrame:
    """Period end plus a lag where no announcement date is known."""
    known = F.col("announce_date") if "announce_date" in rows.columns else F.lit(None).cast("date")
    return rows.filter("period IS NOT NULL AND surprise_pct IS NOT NULL").withColumn(
        "announce_date", F.coalesce(known, F.date_add("period", lag_days)))


def analyst_rows(histories: DataFrame) -> DataFrame:
    """(ticker, period, buy, hold, sell) with strong ratings added in."""
    a = histories.select("ticker", F.explode("analyst").alias("a")).filter("a.period IS NOT NULL")
    n = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0))
    return a.select("ticker", "a.period", (n("buy") + n("strongBuy")).alias("buy"), n("hold").alias("hold"),
                    (n("sell") + n("strongSell")).alias("sell"))


def surprise_average(earnings: DataFrame, last: int = 4) -> DataFrame:
    """Mean of the non-null surprises among the latest four quarters, /50, in [-1, 1]."""
    newest = Window.partitionBy("ticker").orderBy(F.desc("period"))
    rows = earnings.withColumn("rn_", F.row_number().over(newest)).filter(F.col("rn_") <= last)
    return rows.groupBy("ticker").agg(clip(F.avg("surprise_pct") / 50, -1.0, 1.0).alias("earnings_surprise"))


def institutional_ownership(holders: DataFrame, top: int = 20) -> DataFrame:
    """Sum of the ``top`` largest holder percentages, as a share of at most 1."""
    biggest = Window.partitionBy("ticker").orderBy(F.desc("pct"), "holder")
    rows = holders.withColumn("rn_", F.row_number().over(biggest)).filter(F.col("rn_") <= top)
    share = F.sum(F.nullif("pct", F.lit(0.0))) / 100
    return rows.groupBy("ticker").agg(clip(share, 0.0, 1.0).alias("inst_ownership"))


def next_earnings(calendar: DataFrame, today: Column, within: int = 90) -> DataFrame:
    """(ticker, next_earnings_date, days_to_earnings) within the coming days."""
    ahead = calendar.filter(F.col("date").between(today, F.date_add(today, within)))
    out = ahead.groupBy("ticker").agg(F.min("date").alias("next_earnings_date"))
    return out.withColumn("days_to_earnings", F.date_diff("next_earnings_date", today))


def search_symbols(symbols: DataFrame, query: str, types: str = "stock", limit: int = 15) -> DataFrame:
    """First ``limit`` plain symbols whose ticker or name contains the text."""
    q = query.strip().lower()
    text = F.lower(F.col("symbol")).contains(q) | F.lower(F.col("name")).contains(q)
    hits = symbols.filter(text & F.col("type").isin(K.ACCEPTED_TYPES.get(types, K.ACCEPTED_TYPES["stock"])))
    hits = hits.filter(~F.col("symbol").contains(":") & F.upper("symbol").rlike(K.TICKER_PATTERN))
    return hits.select(F.upper("symbol").alias("ticker"), "name", "type").orderBy("ticker", "name").limit(limit)


def clean_holdings(raw: DataFrame, max_holdings: int = 40) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected). First duplicate wins; bad tickers and weights are rejected.

    ``raw``: portfolio_id, pos, ticker, weight. A row is rejected for its own
    fault or, like the whole request, because the portfolio is too long.
    """
    weight = F.col("weight").try_cast("double")
    tagged = raw.withColumns({"clean_": clean_ticker("ticker"), "number_": weight})
    reason = (
        F.when(~valid_ticker("ticker") | F.col("ticker").isNull(), "invalid ticker")
        .when(F.col("weight").isNotNull() & F.col("number_").isNull(), "weight is not a number")
        .when((F.col("number_") < 0) | (F.col("number_") > 100) | F.isnan("number_"), "weight out of range")
    )
    tagged = tagged.withColumn("reason", reason)
    size = F.count(F.lit(1)).over(Window.partitionBy("portfolio_id"))     # one exchange serves this and the grouping below
    tagged = tagged.withColumn("size_", size).withColumn(
        "reason", F.when(F.col("size_") > max_holdings, "too many holdings").otherwise(F.col("reason")))
    first = F.min_by("number_", "pos").alias("weight")
    clean = (
        tagged.filter("reason IS NULL").groupBy("portfolio_id", F.col("clean_").alias("ticker"))
        .agg(F.min("pos").alias("pos"), first)
    )
    bad = tagged.filter("reason IS NOT NULL").select("portfolio_id", "pos", "ticker", "weight", "reason")
    return clean, bad


def page(df: DataFrame, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page in a given order (a top-k, not a full sort)."""
    return df.orderBy(*order).offset(offset).limit(limit)


def restrict_universe(df: DataFrame, available: DataFrame, key: str = "ticker") -> DataFrame:
    return df.join(available.select(key).distinct(), key, "left_semi")


def union_sets(a: DataFrame, b: DataFrame, distinct: bool = False) -> DataFrame:
    out = a.unionByName(b)
    return out.distinct() if distinct else out


def append_table(df: DataFrame, path: str, by: str = "model_version") -> None:
    """Append to a partitioned parquet table (monitoring logs)."""
    df.write.mode("append").partitionBy(by).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON snapshot in a plain folder. Overwriting removes the old files first: ``publish_report`` does not."""
    df.write.mode("overwrite").json(path)


def publish_report(df: DataFrame, path: str) -> None:
    """JSON snapshot that readers (``versions.read``) see replaced as a whole."""
    V.replace(df, path, form="json")


def append_once(df: DataFrame, path: str, batch: int, writer: str) -> None:
    """Append to a log under a batch number; a repeated batch adds nothing."""
    V.append(df, path, batch, writer)
