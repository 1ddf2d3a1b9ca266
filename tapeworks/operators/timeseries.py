"""Per-instrument windows.

A price series holds one row per (ticker, date), so a ticker's partition is
bounded by the calendar (about 250 rows a year) however many tickers there are.
All windows are partitioned by ticker: one exchange serves every feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K

EWM_BLOCK = 4000       # (14/13)**4000 is 1e128: far from overflow, and from mattering
HIGH_BARS = 252
RSI_PERIOD = 14


def by_ticker():
    return Window.partitionBy("ticker")


def by_date():
    return by_ticker().orderBy("dt")


def with_bars(prices: DataFrame) -> DataFrame:
    """Add ``bar``: the 0-based position of the row in its own series.

    The one exchange by ticker that all per-ticker windows share. Its width is
    explicit because the windows after it cost far more than their bytes suggest,
    so adaptive execution should not merge the partitions by size.
    """
    width = int(prices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prices = prices.repartition(width, "ticker")
    return prices.withColumn("bar", (F.row_number().over(by_date()) - 1).cast("bigint"))


def log_return(close: str = "close") -> Column:
    """ln(p/p_prev); non-positive prices and the first bar give null."""
    return F.ln(close) - F.ln(F.lag(close).over(by_date()))


def momentum(k: int) -> Column:
    return F.try_divide(F.col("close"), F.lag("close", k).over(by_date())) - 1


def price_features(bars: DataFrame, rule: str, carried: bool = False) -> DataFrame:
    """Add the seven price features as known at the close of each bar.

    ``rule`` selects the edge handling:
    ``snapshot`` nulls for short history, rounded, 52-week high needs a year;
    ``panel``    as snapshot, but the high is taken over what there is;
    ``label``    60 returns of volatility, nulls for short history;
    ``backtest`` as label, with neutral numbers instead of nulls.

    Every feature costs constant time per row. Three idioms replace frames that
    would re-read up to 252 rows for each row:

    * volatility: differences of running sums of the returns and their squares;
    * RSI: the Wilder recursion in closed form, ``b**k * sum(x_j * w_j * b**-j)``.
      Powers start anew every 4,000 bars, and the state at the end of a block
      enters the next one with weight ``b**(k + 1)``, so long series stay finite;
    * 52-week high: a window of 252 rows is the right end of one block of 252
      and the left end of the next, and both have running maxima.

    ``carried`` is for pieces of series (``slices``): rows with ``halo_`` only serve
    frames that look back, and the averages start from ``up_in_`` and ``down_in_``,
    their values before bar ``start_``.
    """
    live = rule in ("snapshot", "panel")
    span = 59 if live else 60                   # returns in the volatility
    n = F.col("bar") + 1
    step = F.col("bar") - 1                     # number of the price change
    alpha, keep = 1.0 / RSI_PERIOD, 1.0 - 1.0 / RSI_PERIOD
    block = F.greatest(F.floor(step / EWM_BLOCK), F.lit(0)).cast("int")
    change = F.col("close") - F.lag("close").over(by_date())
    if carried:
        change = F.when(~F.col("halo_"), change)
    short = F.lit(0.0) if rule == "backtest" else F.lit(None).cast("double")

    first = {"lr_": log_return(), "up_": change, "down_": -change, "block_": block,
             "slab_": F.floor(F.col("bar") / HIGH_BARS)}
    for name, k in K.MOMENTUM_BARS.items():
        value = momentum(k)
        first[name] = F.when(n > k, F.round(value, 6) if live else value).otherwise(short)
    df = bars.withColumns(first)

    k = (step - F.col("block_") * EWM_BLOCK).cast("double")
    weight = F.when(step == 0, 1.0).otherwise(alpha) * F.pow(F.lit(keep), -k)
    in_block = Window.partitionBy("ticker", "block_").orderBy("bar")
    slab = Window.partitionBy("ticker", "slab_")
    upto = by_date().rowsBetween(Window.unboundedPreceding, 0)

    def wilder(x: str) -> Column:
        part = F.when(F.col(x).isNotNull(), F.greatest(F.col(x), F.lit(0.0)))
        return F.pow(F.lit(keep), k) * F.sum(part * weight).over(in_block)

    df = df.withColumns({
        "n_": F.count("lr_").over(upto), "s_": F.sum("lr_").over(upto),
        "q_": F.sum(F.col("lr_") * F.col("lr_")).over(upto),
        "gain_": wilder("up_"), "loss_": wilder("down_"),
        "from_left_": F.max("close").over(slab.orderBy("bar")),
        "from_right_": F.max("close").over(slab.orderBy(F.col("bar").desc())),
    })
    along_blocks = by_ticker().orderBy("block_", "bar")      # same sort as in_block

    def in_span(c: str) -> Column:
        return F.col(c) - F.coalesce(F.lag(c, span).over(by_date()), F.lit(0))

    df = df.withColumns({
        "n_": in_span("n_"), "s_": in_span("s_"), "q_": in_span("q_"),
        "gain_prev_": F.lag("gain_").over(along_blocks), "loss_prev_": F.lag("loss_").over(along_blocks),
        "high_": F.greatest(
            F.col("from_left_"), F.lag("from_right_", HIGH_BARS - 1).over(by_ticker().orderBy("slab_", "bar"))),
    })

    def from_last_block(own: str) -> Column:
        carry = F.when(F.col("block_") > 0, F.first(f"{own}prev_").over(in_block))
        return F.col(own) + F.coalesce(carry * F.pow(F.lit(keep), k + 1), F.lit(0.0))

    df = df.withColumns({"gain_": from_last_block("gain_"), "loss_": from_last_block("loss_")})
    if carried:
        fade = F.pow(F.lit(keep), (F.col("bar") - F.col("start_") + 1).cast("double"))
        df = df.withColumns({"gain_": F.col("gain_") + F.col("up_in_") * fade, "loss_": F.col("loss_") + F.col("down_in_") * fade})
    variance = (F.col("q_") - F.col("s_") * F.col("s_") / F.col("n_")) / (F.col("n_") - 1)
    spread = F.when(F.col("n_") > 1, F.sqrt(F.greatest(variance, F.lit(0.0)) * 252))
    gain, loss = F.col("gain_"), F.col("loss_")
    high = F.when(F.col("high_") > 0, F.try_divide(F.col("close"), F.col("high_")) - 1)
    if live:
        vol = F.when(n >= 61, F.round(spread, 6))
        rsi = F.when(n >= 2, F.when(loss == 0, 100.0).otherwise(
            F.round(100 - 100 / (1 + F.try_divide(gain, loss)), 2)))
    else:
        vol = F.when(n > 10, spread)
        rsi = F.when(n > 15, 100 - 100 / (1 + gain / (loss + 1e-9)))
    if rule == "snapshot":
        high = F.when(n >= HIGH_BARS, high)
    if rule == "backtest":
        vol, rsi, high = F.coalesce(vol, F.lit(0.20)), F.coalesce(rsi, F.lit(50.0)), F.coalesce(high, F.lit(0.0))
    return df.select(
        *bars.columns, *K.MOMENTUM_BARS, vol.alias("vol_60d"), rsi.alias("rsi_14"), high.alias("price_vs_52w_high"))


def forward_return(h: int, offset: int = 0) -> Column:
    """Return from the bar ``offset`` ahead to ``h`` bars after that; null if p0 <= 0."""
    p0 = F.lead("close", offset).over(by_date()) if offset else F.col("close")
    p1 = F.lead("close", offset + h).over(by_date())
    return F.when(p0 > 0, F.try_divide(p1, p0) - 1)


def last_bar(df: DataFrame, back: int = 0) -> DataFrame:
    """The row ``back`` bars before the end of each series."""
    left = F.count(F.lit(1)).over(by_ticker()) - 1 - F.col("bar")
    return df.withColumn("left_", left).filter(F.col("left_") == back).drop("left_")


# --- channels ------------------------------------------------------------------

def channel_returns(close: str = "close", order=None) -> Column:
    """Log return with every undefined value set to zero."""
    order = order or by_date()
    return F.coalesce(F.ln(close) - F.ln(F.lag(close).over(order)), F.lit(0.0))


def trailing_std(x: str, win: int, order) -> Column:
    """Population deviation of the last ``win`` values; fewer than two give zero."""
    frame = order.rowsBetween(-(win - 1), 0)
    return F.when(F.count(x).over(frame) >= 2, F.stddev_pop(x).over(frame)).otherwise(0.0)


def trailing_median(x: str, win: int, order) -> Column:
    return F.coalesce(F.percentile(F.col(x), 0.5).over(order.rowsBetween(-(win - 1), 0)), F.lit(0.0))


def relative_volume(volume: Column, median: Column) -> Column:
    return F.when((volume > 0) & (median > 0), F.ln(volume / median)).otherwise(0.0)


def log_dollar_volume(close: Column, volume: Column) -> Column:
    dollars = close * volume
    return F.when(dollars > 0, F.ln(dollars)).otherwise(0.0)


def window_ends(bars: DataFrame, window: int = 252, step: int = 21, cutoff=None) -> DataFrame:
    """(ticker, end_bar): every ``step``-th bar from ``window`` on, up to a cutoff date."""
    ends = bars.filter((F.col("bar") >= window) & ((F.col("bar") - window) % step == 0))
    if cutoff is not None:
        ends = ends.filter(F.col("dt") <= F.lit(cutoff))
    return ends.select("ticker", F.col("bar").alias("end_bar"))


def window_rows(bars: DataFrame, window: int = 252, step: int = 21, cutoff=None, first: int | None = None) -> DataFrame:
    """Each bar once per window that holds it: (ticker, end_bar, bar, dt, close, ...).

    A bar b is in the windows ending in [b, b + window]. Their ends follow from
    arithmetic, so the rows are exploded in place: no range join. The first
    bar of a window only serves the first return. Windows end at ``first`` (default:
    ``window``, the first full one) and every ``step`` bars later.
    """
    first = window if first is None else first
    last = F.max("bar").over(by_ticker())
    first_end = F.greatest(
        F.lit(first), F.ceil((F.col("bar") - first) / step) * step + first)
    top_end = F.least(F.col("bar") + window, last)
    ends = F.when(first_end <= top_end, F.sequence(first_end, top_end, F.lit(step).cast("bigint")))
    out = bars.withColumn("ends_", ends).withColumn("end_bar", F.explode("ends_")).drop("ends_")
    if cutoff is not None:
        allowed = window_ends(bars, window, step, cutoff)
        out = out.join(allowed, ["ticker", "end_bar"], "left_semi")
    return out


def base_window_channels(rows: DataFrame, std_win: int = 20) -> DataFrame:
    """Channels ``logret`` and ``vol`` for window rows; statistics restart at the cut."""
    order = Window.partitionBy("ticker", "end_bar").orderBy("bar")
    out = rows.withColumn("first_", F.lag("bar").over(order).isNull())
    out = out.withColumn("logret", channel_returns("close", order)).filter(~F.col("first_"))
    return out.withColumn("vol", trailing_std("logret", std_win, order)).drop("first_")


SOURCE_OF = {"rel_volume": "volume", "log_dollar_vol": "volume", "excess_ret_vs_market": "market_close",
             "rel_strength_vs_sector": "sector_close", "earn_surprise_pulse": "pulse", "analyst_net_buy_ts": "net_buy"}


def window_channels(rows: DataFrame, spec: list[str], win: int = 20) -> DataFrame:
    """The channels of ``spec`` for window rows: (ticker, end_bar, bar, <spec>...).

    Bars bring their sources as columns: ``close``, ``volume``, reference closes known that day
    (``market_close``, ``sector_close``), and the event values ``pulse`` and ``net_buy``. A channel whose
    source column is missing, or that is not known here, is zero. Statistics restart at the cut.
    """
    order = Window.partitionBy("ticker", "end_bar").orderBy("bar")
    have = {c for c in spec if SOURCE_OF.get(c, "close") in rows.columns}
    own = {"logret": channel_returns("close", order), "first_": F.lag("bar").over(order).isNull()}
    for c in ("market_close", "sector_close"):
        if c in rows.columns and any(SOURCE_OF.get(x) == c for x in have):
            own[f"{c}_ret"] = channel_returns(c, order)
    out = rows.withColumns(own).filter(~F.col("first_"))
    if "rel_volume" in have:
        out = out.withColumn("median_", trailing_median("volume", win, order))
    made = {
        "logret": lambda: F.col("logret"), "vol": lambda: trailing_std("logret", win, order),
        "rel_volume": lambda: relative_volume(F.col("volume"), F.col("median_")),
        "log_dollar_vol": lambda: log_dollar_volume(F.col("close"), F.col("volume")),
        "excess_ret_vs_market": lambda: F.col("logret") - F.col("market_close_ret"),
        "rel_strength_vs_sector": lambda: F.when(F.col("sector_close").isNotNull(), F.col("logret") - F.col("sector_close_ret")),
        "earn_surprise_pulse": lambda: F.col("pulse"), "analyst_net_buy_ts": lambda: F.col("net_buy"),
    }
    zero = F.lit(0.0)
    return out.select("ticker", "end_bar", "bar", *[
        (F.coalesce(made[c](), zero) if c in have and c in made else zero).alias(c) for c in spec])


def standardized_windows(channels: DataFrame, cols: list[str]) -> DataFrame:
    """Z-score per window and channel (population deviation, below 1e-8 counts as one)."""
    per = Window.partitionBy("ticker", "end_bar")
    scaled = {}
    for c in cols:
        sd = F.stddev_pop(c).over(per)
        z = (F.col(c) - F.avg(c).over(per)) / F.when(sd < 1e-8, 1.0).otherwise(sd)
        scaled[f"{c}_z"] = F.coalesce(z, F.lit(0.0))
    return channels.withColumns(scaled)


def window_embedding(channels: DataFrame) -> DataFrame:
    """Built-in encoder: (mean, std, last, length) of the log returns of each window."""
    x = F.col("logret")
    return channels.groupBy("ticker", "end_bar").agg(
        F.array(
            F.avg(x), F.stddev_pop(x), F.max_by(x, F.col("bar")), F.count(x).cast("double")
        ).alias("embedding")
    )


def encoded_windows(channels: DataFrame, spec: list[str], encode, dim: int, window: int = 252) -> DataFrame:
    """Embeddings from a user function ``encode(matrix[T, C]) -> vector``.

    ``encode`` sees one standardized window, left-padded with zeros to ``window``
    rows, and must return ``dim`` numbers. A window is at most ``window`` rows, so a
    group is always small; windows reach Python many to an Arrow batch.
    """
    import numpy as np
    import pyarrow as pa

    names = [f"{c}_z" for c in spec]
    z = standardized_windows(channels, spec).select("ticker", "end_bar", F.struct("bar", *names).alias("row_"))
    packed = z.groupBy("ticker", "end_bar").agg(F.array_sort(F.collect_list("row_")).alias("rows_"))

    def run(batches):
        for batch in batches:
            rows = batch.column(2)
            flat = rows.flatten()
            every = np.column_stack([flat.field(n).to_numpy(zero_copy_only=False) for n in names]).astype(np.float32)
            cuts = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            vectors = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mat = every[lo:hi][-window:]
                vec = np.asarray(encode(np.pad(mat, ((window - len(mat), 0), (0, 0)))), dtype=np.float64)
                if vec.shape != (dim,):
                    raise ValueError(f"the encoder gave shape {vec.shape}, not ({dim},)")
                vectors.append(vec.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(vectors, pa.list_(pa.float64()))], names=["ticker", "end_bar", "embedding"])

    return packed.mapInArrow(run, "ticker string, end_bar bigint, embedding array<double>")
