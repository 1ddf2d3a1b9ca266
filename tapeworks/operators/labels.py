"""Training panels, forward labels and time-respecting folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.operators import cross_section as X
from tapeworks.operators import ordering as O
from tapeworks.operators import timeseries as TS


def enough_history(df: DataFrame, min_bars: int) -> DataFrame:
    """Rows of tickers with at least ``min_bars`` bars (needs ``bar``)."""
    n = F.max("bar").over(TS.by_ticker()) + 1
    return df.withColumn("n_", n).filter(F.col("n_") >= min_bars).drop("n_")


def shortest_series(bars: DataFrame, min_bars: int) -> int:
    """Length of the shortest series that passes the gate (one number, 0 if none)."""
    lengths = bars.groupBy("ticker").agg((F.max("bar") + 1).alias("n")).filter(F.col("n") >= min_bars)
    return lengths.agg(F.min("n")).first()[0] or 0


def period_panel(
    bars: DataFrame, *, forward: int = 252, rebalance: int = 63, align: str = "bar", until: str = "shortest",
) -> DataFrame:
    """Point-in-time rows per rebalance: features of the bar before, return after.

    Columns: period, ticker, start_dt, end_dt, seven features, fwd_ret, vol.
    All bars get features in one pass of windows; the rebalance bars are then
    filtered. Period 0 has no history before it and is left out. ``align='bar'``
    counts bars from each series' own start; ``align='calendar'`` numbers the
    dates of the whole market instead. ``until='shortest'`` ends the panel for all with
    the shortest series that passes the gate, as the published backtest does;
    ``until='own'`` ends each series with itself, so one young listing empties nothing.
    """
    if until not in ("shortest", "own"):
        raise ValueError("until is 'shortest' or 'own'")
    gate = forward + rebalance + 30
    usable = enough_history(bars, gate)
    feats = TS.price_features(usable, "backtest")
    if align == "calendar":
        # One row per date of the market: bounded by the calendar.
        days = usable.select("dt").distinct().withColumn(
            "day_", (F.row_number().over(Window.orderBy("dt")) - 1).cast("bigint"))
        feats = feats.join(days, "dt")
        clock, limit = F.lead("day_", 1).over(TS.by_date()), days.count()
    else:
        clock = F.col("bar") + 1
        limit = shortest_series(bars, gate) if until == "shortest" else F.max("bar").over(TS.by_ticker()) + 1
    feats = (
        feats.withColumn("start_", clock).withColumn("limit_", F.lit(limit) if isinstance(limit, int) else limit)
        .withColumn("fwd_ret", TS.forward_return(forward, 1))
        .withColumn("start_dt", F.lead("dt", 1).over(TS.by_date()))
        .withColumn("end_dt", F.lead("dt", 1 + forward).over(TS.by_date()))
    )
    return (
        feats.filter((F.col("start_") % rebalance == 0) & (F.col("start_") + forward < F.col("limit_")))
        .filter((F.col("bar") + 1 >= 5) & F.col("fwd_ret").isNotNull())
        .select((F.col("start_") / rebalance).cast("bigint").alias("period"), "ticker",
                "start_dt", "end_dt", *K.PRICE_FEATURES, "fwd_ret",
                F.coalesce(F.nullif("vol_60d", F.lit(0.0)), F.lit(0.20)).alias("vol"))
    )


def with_embeddings(panel: DataFrame, emb: DataFrame, dims: int, rebalance: int = 63, vector: str = "embedding") -> DataFrame:
    """Panel rows with ``emb_0 .. emb_<dims-1>``: the embedding of the bar before the period's start, each
    dimension standardised within the period. ``emb``: (ticker, end_bar, embedding); without one, zeros."""
    rows = emb.withColumn("period", ((F.col("end_bar") + 1) / rebalance).cast("bigint")).filter(
        (F.col("end_bar") + 1) % rebalance == 0)
    held = rows.join(panel.select("period", "ticker"), ["period", "ticker"], "left_semi")
    z = X.standardized_embeddings(held, ["period"], ["ticker"], vector)
    wide = z.groupBy("period", "ticker").agg(*[
        F.max(F.when(F.col("dim") == i, F.col("z"))).alias(f"emb_{i}") for i in range(dims)])
    return X.neutral_fill(panel.join(wide, ["period", "ticker"], "left").select(
        "period", "ticker", *[f"emb_{i}" for i in range(dims)])).join(panel, ["period", "ticker"])


def ranked_panel(panel: DataFrame, *, spread: bool | int, min_names: int = 2) -> DataFrame:
    """Ranks per period (0.5 where a column has none), median label, benchmark."""
    out = X.pct_ranks(panel, ["period"], ["ticker"], K.PRICE_FEATURES, spread=spread)
    out = out.fillna(0.5, [f"{c}_rank" for c in K.PRICE_FEATURES])
    out = X.median_labels(out, ["period"], spread=spread, inclusive=True)
    return out.filter(F.col("names_") >= min_names).drop("names_")


def multi_horizon_labels(bars: DataFrame, horizons=None, *, spread: bool | int = False, min_names: int = 3) -> DataFrame:
    """Non-overlapping windows of each horizon: ranks at the start, strict label.

    Columns: horizon, t_start, ticker, seven ranks, fwd_ret, label. A horizon uses
    tickers with at least two horizons of bars and stops with the shortest of them.
    Features are computed once; each bar is then copied to the horizons it starts.
    """
    horizons = list(horizons or K.LABEL_HORIZONS)
    lengths = bars.groupBy("ticker").agg((F.max("bar") + 1).alias("n"))
    shortest = lengths.agg(*[F.min(F.when(F.col("n") >= 2 * h, F.col("n"))).alias(str(h)) for h in horizons]).first()
    length = F.max("bar").over(TS.by_ticker()) + 1
    feats = TS.price_features(bars, "label").withColumns(
        {"n_": length, **{f"fwd_{h}": TS.forward_return(h) for h in horizons}})
    starts = []
    for h in horizons:
        windows = ((shortest[str(h)] or 0) - h) // h
        ok = (F.col("n_") >= 2 * h) & (F.col("bar") % h == 0) & (F.col("bar") >= 4) & (F.col("bar") < windows * h)
        starts.append(F.when(ok, F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("fwd_ret"))))
    rows = feats.withColumn("s_", F.explode(F.array_compact(F.array(*starts)))).select(
        "s_.horizon", F.col("bar").alias("t_start"), "ticker", *K.PRICE_FEATURES, "s_.fwd_ret")
    keys = ["horizon", "t_start"]
    out = X.pct_ranks(rows, keys, ["ticker"], K.PRICE_FEATURES, spread=spread)
    out = out.fillna(0.5, [f"{c}_rank" for c in K.PRICE_FEATURES]).filter("fwd_ret IS NOT NULL")
    out = X.median_labels(out, keys, spread=spread, inclusive=False)
    return out.filter(F.col("names_") >= min_names).select(
        *keys, "ticker", *[f"{c}_rank" for c in K.PRICE_FEATURES], "fwd_ret", "label")


def snapshot_labels(latest: DataFrame, keys: list[str], *, spread: bool | int, min_names: int = 3,
                    trailing: str = "trailing_ret") -> DataFrame:
    """Today's ranks labelled with the trailing 252-bar return (strictly above median)."""
    rows = latest.filter(F.col(trailing).isNotNull()).withColumn("fwd_ret", F.col(trailing))
    out = X.median_labels(rows, keys, spread=spread, inclusive=False).filter(F.col("names_") >= min_names)
    return out.drop("names_").fillna(0.5, [f"{c}_rank" for c in K.PRICE_FEATURES]).withColumn("is_snapshot", F.lit(True))


def momentum_label(df: DataFrame):
    """Fallback label: the longest momentum rank that exists is at least 0.5."""
    have = [c for c in ("mom_12m_rank", "mom_6m_rank", "mom_3m_rank") if c in df.columns]
    return (F.coalesce(F.col(have[0]), F.lit(0.5)) >= 0.5).cast("int")


def training_universe(requested: DataFrame, anchors: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested tickers plus anchors, restricted to names with stored history."""
    both = requested.select("ticker").unionByName(anchors.select("ticker")).distinct()
    return both.join(stored.select("ticker").distinct(), "ticker", "left_semi")


def period_folds(periods: DataFrame, n_splits: int, embargo: int = 0, col: str = "period") -> DataFrame:
    """(fold, period): test periods in contiguous chunks after the first period.

    The window runs over distinct periods only, which the calendar bounds.
    ``train_below`` is the exclusive upper end of the training periods.
    """
    order = Window.orderBy(col)
    distinct = periods.select(col).distinct().withColumn("pos_", F.row_number().over(order))
    first = distinct.agg(F.min(col).alias("first_"), (F.count(F.lit(1)) - 1).alias("n_")).first()
    k = min(n_splits, first["n_"] or 0)
    if k < 1:
        return periods.sparkSession.createDataFrame([], f"fold int, {col} bigint, train_below bigint")
    folds = distinct.filter("pos_ > 1").withColumn("fold", F.ntile(k).over(order))
    starts = F.min(col).over(Window.partitionBy("fold"))
    out = folds.withColumn("train_below", starts - embargo)
    return out.filter(F.col("train_below") > first["first_"]).select("fold", col, "train_below")


def row_folds(rows: DataFrame, order: list[str], n_splits: int) -> DataFrame:
    """Plain expanding splits on row order, for fewer than three groups.

    Fold f tests rows with ``part = f + 1`` and trains on ``part <= f``. Parts
    are equal runs of rows in order; the remainder goes to the first part.
    """
    tagged = O.running_weight(
        rows.withColumn("order_", F.struct(*order)).withColumn("n_", F.lit(1)), [], "order_", ["n_"])
    size = F.floor(F.col("n__total") / (n_splits + 1))
    lead = F.col("n__total") - size * n_splits
    part = F.when(F.col("n__before") < lead, 0).otherwise(
        F.floor((F.col("n__before") - lead) / size) + 1)
    return tagged.select("order_.*", part.cast("int").alias("part"))


def walk_forward_pairs(periods: DataFrame, embargo: int, min_train: int = 3, col: str = "period") -> DataFrame:
    """(test, train) period pairs with train <= test - embargo - 1.

    Works on distinct periods. Each train period is sent to the tests that may
    use it by exploding a range of integers, so no pair is built and dropped.
    """
    distinct = periods.select(col).distinct()
    top = F.max(col).over(Window.partitionBy(F.lit(1)))
    reach = F.sequence(F.col(col) + embargo + 1, F.greatest(F.col("top_"), F.col(col) + embargo + 1))
    pairs = distinct.withColumn("top_", top).select(
        F.explode(reach).alias("test"), F.col(col).alias("train"))
    pairs = pairs.join(distinct.select(F.col(col).alias("test")), "test", "left_semi")
    enough = F.count(F.lit(1)).over(Window.partitionBy("test"))
    return pairs.withColumn("n_", enough).filter(F.col("n_") >= min_train).drop("n_")
