"""Per-series features for series too long for one task.

``timeseries`` gives a series one window partition, which the calendar bounds for daily bars. Here a series of any
length is numbered in ranges (``ranges.numbered``) and cut into slices of ``size`` bars. A slice brings the last
``HALO`` bars of the one before it, enough for every bounded frame (the longest looks back 252 bars), and the Wilder
average, whose memory has no bound, enters a slice as a state: each slice maps the state before it as ``a * x + b``,
and a scan over the slices composes these maps. Slices are whole multiples of the 252 bars of the 52-week high, whose
blocks therefore fall together with those of an uncut series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import ordering as O
from tapeworks.operators import ranges as R
from tapeworks.operators import timeseries as TS
from tapeworks.session import written

HALO = TS.HIGH_BARS
SLICE_BARS = 400 * TS.HIGH_BARS


def with_bars(prices: DataFrame, ranged: bool | int = True) -> DataFrame:
    """``timeseries.with_bars`` for series of any length: written once, numbered in ranges."""
    return R.numbered(written(prices), ["ticker"], "dt", "bar", ranged)


def sliced(bars: DataFrame, size: int = SLICE_BARS) -> DataFrame:
    """Every bar in its slice, and the last ``HALO`` bars of a slice also in the next one (``halo_``).

    ``ticker`` becomes struct(ticker, range_), so that windows by ticker are windows by slice. ``start_`` is the
    first bar of the slice.
    """
    if size % TS.HIGH_BARS or size <= 0:
        raise ValueError(f"size must be a multiple of {TS.HIGH_BARS}")
    own = F.floor(F.col("bar") / size).cast("int")
    next_too = F.when(F.col("bar") % size >= size - HALO, F.array(own, own + 1)).otherwise(F.array(own))
    rows = bars.withColumn("own_", own).withColumn("range_", F.explode(next_too))
    width = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(
        F.struct("ticker", "range_").alias("ticker"), *[c for c in bars.columns if c != "ticker"],
        (F.col("range_") > F.col("own_")).alias("halo_"), (F.col("range_").cast("bigint") * size).alias("start_"),
    ).repartition(width, "ticker")


def unsliced(rows: DataFrame, cols: list[str]) -> DataFrame:
    """The rows without their halo, under their own ticker."""
    return rows.filter(~F.col("halo_")).select(F.col("ticker.ticker").alias("ticker"), *[c for c in cols if c != "ticker"])


def in_slices(bars: DataFrame, make: Callable[[DataFrame], DataFrame], cols: list[str], size: int = SLICE_BARS) -> DataFrame:
    """(ticker, ``cols``) of ``make``, a projection with windows by ticker that look back at most ``HALO`` bars."""
    return unsliced(make(sliced(bars, size)), cols)


def wilder_states(rows: DataFrame, size: int) -> DataFrame:
    """(ticker, up_in_, down_in_): the Wilder averages at the bar before each slice; 0 for the first slice.

    A slice of ``size`` steps maps a state x to ``keep^size * x + b``, where b is the average it would reach from 0;
    sums per slice are combined on the map side, and the scan is over one row a slice.
    """
    alpha, keep = 1.0 / TS.RSI_PERIOD, 1.0 - 1.0 / TS.RSI_PERIOD
    change = F.col("close") - F.lag("close").over(TS.by_date())
    share = F.when(F.col("bar") == 1, 1.0).otherwise(alpha) * F.pow(
        F.lit(keep), (F.col("start_") + (size - 1) - F.col("bar")).cast("double"))
    own = rows.select("ticker", "halo_", change.alias("up_"), share.alias("share_")).filter(~F.col("halo_"))
    reached = lambda x: F.coalesce(F.sum(F.greatest(x, F.lit(0.0)) * F.col("share_")), F.lit(0.0))
    maps = own.groupBy("ticker").agg(
        F.lit(keep ** size).alias("a_"), reached(F.col("up_")).alias("up_in_"), reached(-F.col("up_")).alias("down_in_"))
    flat = written(maps.select("ticker.*", "a_", "up_in_", "down_in_"))
    states = R.carry_affine(flat, ["ticker"], "a_", ["up_in_", "down_in_"])
    return states.select(F.struct("ticker", "range_").alias("ticker"), *[
        F.coalesce(c, F.lit(0.0)).alias(c) for c in ("up_in_", "down_in_")])


def price_features(bars: DataFrame, rule: str, size: int = SLICE_BARS) -> DataFrame:
    """The rows of ``timeseries.price_features``, computed slice by slice."""
    rows = sliced(written(bars), size)
    states = O.checked_broadcast(wilder_states(rows, size))
    out = TS.price_features(rows.join(states, "ticker"), rule, carried=True)
    return unsliced(out, [*bars.columns, *out.columns[-7:]])
