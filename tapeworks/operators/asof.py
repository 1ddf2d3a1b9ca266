"""As-of joins.

Each join first reduces the probes to their distinct (key, time) pairs, matches
those, and joins the answer back with an equi-join, a plain join that adaptive
execution may split. With date columns a key's matching is bounded by the calendar
and done in one window per key. ``ranged`` cuts keys into ranges of time that are
matched each by itself, with the last row of every range carried into the next ones
(``ranges.nearest``): for fine-grained times, or with no key at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import ranges as R


def _latest(probe: DataFrame, ref: DataFrame, by: list[str], ts: str, payload: list[str], ref_ts: str,
            ranged: bool | int) -> DataFrame:
    """(by, ts) of the probes with ``hit_`` = latest struct(ref_ts, payload) at or before ts."""
    types = dict(ref.dtypes)
    shape = "struct<since_:%s,%s>" % (types[ref_ts], ",".join(f"{c}:{types[c]}" for c in payload))
    entry = F.struct(F.col(ref_ts).alias("since_"), *[F.col(c) for c in payload]).cast(shape)
    asked = probe.select(*by, F.col(ts).alias("at_")).distinct()
    known = ref.select(*by, F.col(ref_ts).alias("at_"), entry.alias("hit_"))
    return R.nearest(asked, known, by, "at_", "hit_", ranged=ranged).withColumnRenamed("at_", ts)


def keep_last(ref: DataFrame, by: list[str], ts: str, cols: list[str], order: Column) -> DataFrame:
    """One row per (by, ts): the one with the highest ``order`` (map-side combined)."""
    best = F.max_by(F.struct(*cols), order).alias("row_")
    return ref.groupBy(*by, ts).agg(best).select(*by, ts, "row_.*")


def asof_ffill(probe: DataFrame, ref: DataFrame, by: list[str], ts: str, cols: list[str],
               ranged: bool | int = False) -> DataFrame:
    """Left join of the latest reference row with the same ``by`` at or before ``ts``.

    ``ref`` has one row per (by, ts); see ``keep_last``.
    """
    found = _latest(probe, ref, by, ts, cols, ts, ranged)
    flat = found.select(*by, ts, *[F.col(f"hit_.{c}").alias(c) for c in cols])
    return probe.join(flat, [*by, ts], "left")


def asof_latest(
    probe: DataFrame, events: DataFrame, by: list[str], ts: str, event_ts: str, cols: list[str],
    max_age_days: int | None = None, ranged: bool | int = False,
) -> DataFrame:
    """As ``asof_ffill`` for events; adds ``event_ts`` and drops hits that are too old."""
    found = _latest(probe, events, by, ts, cols, event_ts, ranged)
    fresh = F.lit(True)
    if max_age_days is not None:
        fresh = F.date_diff(F.col(ts), F.col("hit_.since_")) <= max_age_days
    flat = found.select(
        *by, ts, F.when(fresh, F.col("hit_.since_")).alias(event_ts),
        *[F.when(fresh, F.col(f"hit_.{c}")).alias(c) for c in cols])
    return probe.join(flat, [*by, ts], "left")


def asof_next_bar(predictions: DataFrame, bars: DataFrame, at: str, offset: str, ranged: bool | int = False) -> DataFrame:
    """First bar on or after ``at`` and the close ``offset`` bars later, both may be null.

    Adds ``start_bar``, ``p0`` and ``p1``.
    """
    asked = predictions.select("ticker", F.to_date(at).alias("at_")).distinct()
    known = bars.select("ticker", F.col("dt").alias("at_"), F.col("bar").alias("start_bar"))
    starts = R.nearest(asked, known, ["ticker"], "at_", "start_bar", backwards=True, ranged=ranged)
    closes = bars.select("ticker", "bar", "close")
    return (
        predictions.withColumn("at_", F.to_date(at))
        .join(starts, ["ticker", "at_"], "left")
        .withColumn("end_bar", F.col("start_bar") + F.col(offset))
        .join(closes.select("ticker", F.col("bar").alias("start_bar"), F.col("close").alias("p0")),
              ["ticker", "start_bar"], "left")
        .join(closes.select("ticker", F.col("bar").alias("end_bar"), F.col("close").alias("p1")),
              ["ticker", "end_bar"], "left")
        .drop("at_", "end_bar")
    )
