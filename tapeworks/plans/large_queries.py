"""Queries with the plans for keys of any size: ranges of time, slices of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import asof as J
from tapeworks.operators import slices as SL
from tapeworks.operators import timeseries as TS
from tapeworks.plans import market as M
from tapeworks.plans import panel_queries as PQ
from tapeworks.plans import signal_queries as SQ
from tapeworks.plans.panel_queries import six

SLICE = 4 * TS.HIGH_BARS      # a year to a slice and its halo: every series of the given tables has several


def q100_excess_return_ranges(spark, sf):
    """q07 with references matched range by range; the market series has no key at all."""
    return PQ.q07_excess_return(spark, sf, ranged=True)


def q101_earnings_pulse_ranges(spark, sf):
    return PQ.q08_earnings_pulse(spark, sf, ranged=True)


def q102_mature_labels_ranges(spark, sf):
    return six(SQ.matured(spark, sf, ranged=True)[0])


def q103_last_purchase(spark, sf):
    """Every event with the newest purchase of anyone up to its time: one series, as fine as the events are."""
    ev = M.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = J.keep_last(ev.filter("event_type = 'purchase'"), [], "ts", ["event_id", "value"], F.col("event_id"))
    bought = bought.select("ts", F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value"))
    out = J.asof_latest(ev.select("event_id", "user_id", "ts"), bought.withColumnRenamed("ts", "bought_at"), [], "ts",
                        "bought_at", ["purchase_id", "purchase_value"], ranged=True)
    return six(out)


def sliced_features(spark, sf, rule):
    return SL.price_features(SL.with_bars(M.prices(spark, sf)), rule, SLICE)


def q104_momentum_slices(spark, sf):
    return six(sliced_features(spark, sf, "snapshot").select("ticker", "dt", "mom_1m", "mom_3m", "mom_6m", "mom_12m"))


def q105_vol_52w_slices(spark, sf):
    return six(sliced_features(spark, sf, "snapshot").select("ticker", "dt", "vol_60d", "price_vs_52w_high"))


def q106_rsi_slices(spark, sf):
    return six(sliced_features(spark, sf, "label").select("ticker", "dt", "rsi_14"))


def q107_channels_slices(spark, sf):
    return six(SL.in_slices(SL.with_bars(M.prices(spark, sf)), PQ.volume_channels, ["dt", *PQ.VOLUME_CHANNELS], SLICE))


# Rows of the same names under the plan for one key per task.
SAME_ROWS = {
    "q100_excess_return_ranges": "q07_excess_return", "q101_earnings_pulse_ranges": "q08_earnings_pulse",
    "q102_mature_labels_ranges": "q38_mature_labels", "q104_momentum_slices": "q03_momentum",
    "q105_vol_52w_slices": "q04_vol_52w", "q106_rsi_slices": "q05_rsi", "q107_channels_slices": "q06_channels_volume",
}
SQL = {
    "q103_last_purchase": """
WITH bought AS (
  SELECT ts, max(event_id) AS purchase_id, arg_max(value, event_id) AS purchase_value
  FROM events WHERE event_type = 'purchase' GROUP BY ts)
SELECT e.event_id, e.user_id, e.ts, b.ts AS bought_at, purchase_id, round(purchase_value, 6) AS purchase_value
FROM events e ASOF LEFT JOIN bought b ON e.ts >= b.ts""",
}
QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
