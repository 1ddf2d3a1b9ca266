"""Price tables: scanning, stitching, coverage, freshness, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.scalars import finite
from tapeworks.operators import timeseries as TS
from tapeworks.sources import versions as V

PRICE_SCHEMA = "ticker string, dt date, close double, volume double"


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """All series of a price directory; rows without a finite close go."""
    raw = spark.read.schema(PRICE_SCHEMA).parquet(path)
    return clean_prices(raw)


def clean_prices(raw: DataFrame) -> DataFrame:
    """NaN and infinities become null; one such close would spoil the running sums of all later bars."""
    return raw.withColumns({"close": finite("close"), "volume": finite("volume")}).filter(
        F.col("close").isNotNull())


def stitch_chunks(chunks: DataFrame, order: str = "chunk") -> DataFrame:
    """One row per (ticker, dt): the row of the latest chunk. Combines on the map side."""
    last = F.max_by(F.struct("close", "volume"), F.col(order)).alias("row_")
    return chunks.groupBy("ticker", "dt").agg(last).select("ticker", "dt", "row_.*")


def min_history(prices: DataFrame, min_bars: int = K.MIN_BARS_FETCH) -> DataFrame:
    """Prices of tickers with at least ``min_bars`` rows."""
    long_enough = prices.groupBy("ticker").count().filter(F.col("count") >= min_bars)
    return prices.join(long_enough, "ticker", "left_semi")


def coverage(prices: DataFrame, as_of: Column, ttl_hours: int = K.PRICE_TTL_HOURS) -> DataFrame:
    """Bars, first and last date, age in hours and freshness per ticker."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp(F.col("last_dt").cast("timestamp"))) / 3600
    return (
        prices.groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("bars"), F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"))
        .withColumn("age_hours", F.round(age, 1))
        .withColumn("fresh", age < ttl_hours)
    )


def freshest(rows: DataFrame, keys: list[str], ingest_ts: str, as_of: Column, ttl_hours: int = K.PRICE_TTL_HOURS,
             tie: str | None = None) -> DataFrame:
    """Latest row per key, fresh if one is, else the newest stale one; adds ``fresh``."""
    cols = [c for c in rows.columns if c not in keys]
    rank = F.struct(ingest_ts, tie) if tie else F.col(ingest_ts)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank).alias("row_")).select(*keys, "row_.*")
    return best.withColumn("fresh", F.col(ingest_ts) >= as_of - F.expr(f"INTERVAL {int(ttl_hours)} HOURS"))


def retained(rows: DataFrame, ts: str, as_of: Column, days: int = K.RETENTION_DAYS) -> DataFrame:
    """Rows not older than ``days`` (a pushed-down range filter)."""
    return rows.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def price_marks(bars: DataFrame) -> DataFrame:
    """(ticker, last_price, price_1y_ago, price_3m_ago): last, 252nd and 63rd from the end."""
    left = F.max("bar").over(TS.by_ticker()) - F.col("bar")
    tagged = bars.withColumn("left_", left).filter(F.col("left_").isin(0, 62, 251))
    at = lambda k: F.max(F.when(F.col("left_") == k, F.col("close")))
    return tagged.groupBy("ticker").agg(
        at(0).alias("last_price"), at(251).alias("price_1y_ago"), at(62).alias("price_3m_ago"))


def flat_records(bars: DataFrame, info: DataFrame) -> DataFrame:
    """One flat row per ticker: fundamentals with last price and simple returns."""
    gain = lambda p: F.round(F.try_divide(F.col("last_price"), F.col(p)) - 1, 4)
    return (
        price_marks(bars).join(info, "ticker", "left")
        .withColumn("momentum_12m", gain("price_1y_ago"))
        .withColumn("momentum_3m", gain("price_3m_ago"))
        .withColumn("market_cap_bn", F.round(F.coalesce("market_cap", F.lit(0.0)) / 1e9, 1))
        .drop("price_1y_ago", "price_3m_ago")
    )


def corpus(prices: DataFrame, tickers: DataFrame, reference: list[str]) -> DataFrame:
    """Prices of the wanted US tickers and, always, of the reference symbols."""
    from tapeworks.functions.scalars import is_us
    ticker = F.col("ticker")
    wanted = tickers.select("ticker").filter(is_us(ticker))
    fixed = prices.select("ticker").filter(ticker.isin(reference))
    return prices.join(wanted.unionByName(fixed).distinct(), "ticker", "left_semi")


def write_prices(prices: DataFrame, path: str) -> None:
    """Parquet clustered by ticker in a plain folder. Overwriting removes the old files first: ``publish_prices`` does not."""
    prices.repartition("ticker").sortWithinPartitions("ticker", "dt").write.mode("overwrite").parquet(path)


def publish_prices(prices: DataFrame, path: str, batch: int | None = None) -> None:
    """The price store replaced as a whole, clustered by ticker: readers see the old or the new one, and a job that
    dies leaves the old one."""
    V.replace(prices.repartition("ticker").sortWithinPartitions("ticker", "dt"), path, batch, "prices")


def published_prices(spark: SparkSession, path: str) -> DataFrame:
    return clean_prices(V.read(spark, path))
