"""Evaluation of a scored panel: IC, hit rates, three books, their statistics.

``scored`` holds (period, ticker, model_score, fwd_ret, vol). After the per-row
work everything is one row per period, and periods are bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.scalars import confidence_band, month_span
from tapeworks.operators import cross_section as X
from tapeworks.operators import ordering as O
from tapeworks.operators import selection as SE
from tapeworks.session import written


def valid_periods(scored: DataFrame) -> DataFrame:
    """(period, n, idx): at least two rows and two distinct scores, numbered densely.

    min < max is the same test as two distinct values and combines on the map side.
    """
    sizes = scored.groupBy("period").agg(
        F.count(F.lit(1)).alias("n"), (F.min("model_score") < F.max("model_score")).alias("varied_"))
    good = sizes.filter("n >= 2 AND varied_").drop("varied_")
    return good.withColumn("idx", F.row_number().over(Window.orderBy("period")) - 1)


def has_variation(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Keys with at least two distinct values of ``col``."""
    return df.groupBy(*keys).agg(F.min(col).alias("a_"), F.max(col).alias("b_")).filter("a_ < b_").select(*keys)


def spearman_ic(df: DataFrame, keys: list[str], ids: list[str], *, spread: bool | int,
                score: str = "model_score", ret: str = "fwd_ret", pearson: bool = False) -> DataFrame:
    """(keys, n, ic): rank correlation per key.

    Keys with under two rows or a constant side are left out before ``corr``,
    which raises on them.
    """
    rows = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull()).select(*keys, *ids, score, ret)
    sizes = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(score).alias("a_"), F.max(score).alias("b_"),
        F.min(ret).alias("c_"), F.max(ret).alias("d_"))
    good = sizes.filter("n >= 2 AND a_ < b_ AND c_ < d_").select(*keys)
    if keys:
        rows = rows.join(O.checked_broadcast(good), keys, "left_semi")
    ranked = O.average_ranks(rows, keys, ids, [score, ret], spread=spread, pct=False)
    aggs = [F.count(F.lit(1)).alias("n"), F.corr(f"{score}_rank", f"{ret}_rank").alias("ic")]
    if pearson:
        aggs.append(F.corr(score, ret).alias("pearson"))
    return ranked.groupBy(*keys).agg(*aggs)


def pooled_ic(scored: DataFrame, ids: list[str]) -> DataFrame:
    """One row: rank correlation over all rows, without a global sort in one task."""
    return spearman_ic(scored, [], ids, spread=True)


def hit_rate(scored: DataFrame, *, spread: bool | int) -> DataFrame:
    """(period, top_ret, bottom_ret, hit): upper half by score against the rest."""
    med = X.column_percentiles(scored, ["period"], ["model_score"], {"med_": 0.5}, spread=spread)
    up = F.col("model_score") >= F.col("model_score_med_")
    out = scored.join(O.checked_broadcast(med), "period").groupBy("period").agg(
        F.avg(F.when(up, F.col("fwd_ret"))).alias("top_ret"),
        F.avg(F.when(~up, F.col("fwd_ret"))).alias("bottom_ret"))
    return out.filter("top_ret IS NOT NULL AND bottom_ret IS NOT NULL").withColumn(
        "hit", (F.col("top_ret") > F.col("bottom_ret")).cast("int"))


def top_quantile(scored: DataFrame, parts: int = 5, *, spread: bool | int) -> DataFrame:
    """Scored rows of valid periods with idx, n_top, in_top and above (score >= median).

    Top = the max(1, n // parts) best scores, ties by ticker.
    """
    rows = scored.join(O.checked_broadcast(valid_periods(scored)), "period")
    med = O.checked_broadcast(X.column_percentiles(scored, ["period"], ["model_score"], {"med_": 0.5}, spread=spread))
    rows = rows.withColumn("n_top", F.greatest(F.lit(1), F.floor(F.col("n") / parts)).cast("int"))
    if spread:      # the cut is found from counts: rows are neither moved nor ordered
        rows = written(rows)
        wanted = rows.groupBy("period").agg(F.max("n_top").alias("k_"))
        rows = SE.mark_best(rows, ["period"], "model_score", "ticker", wanted, "in_top", max_groups=O.bound_of(spread))
    else:
        rows = O.row_numbers(rows, ["period"], {"model_score": False, "ticker": True}, spread=False)
        rows = rows.withColumn("in_top", F.col("rn") <= F.col("n_top")).drop("rn")
    return (
        rows.join(med, "period")
        .withColumn("above", F.col("model_score") >= F.col("model_score_med_"))
        .drop("model_score_med_")
    )


def _follows(idx: str = "idx") -> Column:
    """The ticker's previous row is from the period just before."""
    prev = F.lag(idx).over(Window.partitionBy("ticker").orderBy(idx))
    return F.coalesce(prev == F.col(idx) - 1, F.lit(False))


def set_delta(held: DataFrame) -> DataFrame:
    """(idx, size, entered, stayed) of consecutive holding sets.

    A ticker's own previous row tells whether it stayed: no ticker x period grid.
    """
    return held.withColumn("stays_", _follows()).groupBy("idx").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.when(~F.col("stays_"), 1).otherwise(0)).alias("entered"),
        F.sum(F.col("stays_").cast("int")).alias("stayed"))


def equal_weight_book(top: DataFrame, cost_bps: float = K.COST_BPS) -> DataFrame:
    """(idx, period, gross, net, turnover) of the equal-weight top book."""
    held = top.filter("in_top")
    gross = held.groupBy("idx", "period").agg(F.avg("fwd_ret").alias("gross"))
    out = gross.join(set_delta(held), "idx")
    cost = F.col("entered") / F.col("size") * cost_bps / 10000
    return out.select(
        "idx", "period", "gross", (F.col("gross") - cost).alias("net"),
        F.when(F.col("idx") > 0, 1 - F.col("stayed") / F.col("size")).alias("turnover"))


def sized_weights(top: DataFrame, cap: float = 0.25) -> DataFrame:
    """Top rows with ``w``: conviction over volatility, capped and renormalised once."""
    held = top.filter("in_top")
    raw = F.greatest(F.col("model_score") - 0.5, F.lit(0.0)) * (1 / F.greatest(F.col("vol"), F.lit(0.05)))
    held = held.withColumn("raw_", raw)
    sums = held.groupBy("period").agg(F.sum("raw_").alias("sum_"), F.count(F.lit(1)).alias("k_"))
    share = F.when(F.col("sum_") <= 0, 1 / F.col("k_")).otherwise(F.col("raw_") / F.nullif("sum_", F.lit(0.0)))
    held = held.join(sums, "period").withColumn("capped_", F.least(share, F.lit(cap)))
    total = held.groupBy("period").agg(F.sum("capped_").alias("total_"))
    return held.join(total, "period").withColumn("w", F.col("capped_") / F.col("total_")).drop(
        "raw_", "sum_", "k_", "capped_", "total_")


def sized_book(top: DataFrame, cost_bps: float = K.COST_BPS, cap: float = 0.25) -> DataFrame:
    """(idx, period, gross, net, turnover); cost on all traded weight, exits included."""
    held = sized_weights(top, cap)
    mine = Window.partitionBy("ticker").orderBy("idx")
    before = F.when(_follows(), F.lag("w").over(mine)).otherwise(0.0)
    leaves = F.coalesce(F.lead("idx").over(mine) != F.col("idx") + 1, F.lit(True))
    held = held.withColumn("moved_", F.abs(F.col("w") - before)).withColumn("leaves_", leaves)
    moves = held.select("idx", F.col("moved_").alias("traded")).unionByName(
        held.filter("leaves_").select((F.col("idx") + 1).alias("idx"), F.col("w").alias("traded")))
    traded = moves.groupBy("idx").agg(F.sum("traded").alias("traded"))
    gross = held.groupBy("idx", "period").agg(F.sum(F.col("w") * F.col("fwd_ret")).alias("gross"))
    return gross.join(traded, "idx").select(
        "idx", "period", "gross", (F.col("gross") - F.col("traded") * cost_bps / 10000).alias("net"),
        (F.col("traded") / 2).alias("turnover"))


def hysteresis_members(top: DataFrame) -> DataFrame:
    """Rows held when a name stays until its score drops below the period median.

    A name is held iff its latest entry into the top is newer than its latest
    exit. A row below the median is an exit at that period; a missing period is
    an exit just before the next row. Both are running maxima per ticker.
    """
    upto = Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    exit_at = F.when(~F.col("above"), F.col("idx")).when(~_follows(), F.col("idx") - 1)
    rows = top.withColumn("exit_", exit_at)
    entered = F.max(F.when(F.col("in_top"), F.col("idx"))).over(upto)
    left = F.coalesce(F.max("exit_").over(upto), F.lit(-1))
    return rows.withColumn("held_", F.coalesce(entered > left, F.lit(False))).filter("held_").drop("exit_", "held_")


def hysteresis_book(top: DataFrame, cost_bps: float = K.COST_BPS) -> DataFrame:
    held = hysteresis_members(top)
    gross = held.groupBy("idx", "period").agg(F.avg("fwd_ret").alias("gross"))
    out = gross.join(set_delta(held), "idx")
    cost = F.col("entered") / F.col("size") * cost_bps / 10000
    return out.select(
        "idx", "period", "gross", (F.col("gross") - cost).alias("net"),
        F.when(F.col("idx") > 0, 1 - F.col("stayed") / F.col("size")).alias("turnover"))


def all_books(top: DataFrame, cost_bps: float = K.COST_BPS) -> DataFrame:
    parts = {
        "equal_weight": equal_weight_book(top, cost_bps),
        "sized": sized_book(top, cost_bps),
        "hysteresis": hysteresis_book(top, cost_bps),
    }
    out = None
    for name, book in parts.items():
        book = book.withColumn("book", F.lit(name))
        out = book if out is None else out.unionByName(book)
    return out


# --- statistics of return series (aggregates over one row per period) ----------

def annualised(ret: str, ppy: float) -> Column:
    return F.pow(F.product(1 + F.col(ret)), ppy / F.count(ret)) - 1


def sharpe(ret: str, ppy: float) -> Column:
    rf = K.RISK_FREE / ppy
    return (F.avg(ret) - rf) / (F.stddev_pop(ret) + 1e-9) * (ppy ** 0.5)


def with_drawdown(rows: DataFrame, keys: list[str], order: str, ret: str, include_start: bool = False) -> DataFrame:
    """Add ``drawdown``: distance of the cumulative product from its running maximum."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum_", F.product(1 + F.col(ret)).over(upto))
    peak = F.max("cum_").over(upto)
    if include_start:
        peak = F.greatest(peak, F.lit(1.0))
    return rows.withColumn("drawdown", (F.col("cum_") - peak) / (peak + 1e-9)).drop("cum_")


def calmar(ann: Column, dd: Column) -> Column:
    return F.when(dd < -1e-6, ann / F.abs(dd))


def beta(net: str, bench: str) -> Column:
    """Sample covariance over population variance, as the definition mixes them."""
    varied = (F.count(bench) > 1) & (F.stddev_pop(bench) > 0)
    return F.when(varied, F.covar_samp(net, bench) / (F.var_pop(bench) + 1e-9)).otherwise(1.0)


def book_stats(books: DataFrame, rebalance_months: int = 3) -> DataFrame:
    """One row per book: return, Sharpe, drawdown, Calmar, turnover."""
    ppy = 12 / rebalance_months
    rows = with_drawdown(books, ["book"], "idx", "net")
    out = rows.groupBy("book").agg(
        F.count("net").alias("n_periods"), annualised("net", ppy).alias("ann_"),
        sharpe("net", ppy).alias("sharpe_"), F.min("drawdown").alias("dd_"), F.avg("turnover").alias("turn_"))
    return out.select(
        "book", "n_periods",
        F.round(F.col("ann_") * 100, 2).alias("ann_return_pct"), F.round("sharpe_", 3).alias("sharpe"),
        F.round(F.col("dd_") * 100, 2).alias("max_drawdown_pct"),
        F.round(calmar(F.col("ann_"), F.col("dd_")), 3).alias("calmar"),
        F.round(F.col("turn_") * 100, 1).alias("avg_turnover_pct"))


def ic_summary(ics: DataFrame, keys: list[str] = ()) -> DataFrame:
    std = F.when(F.count("ic") > 1, F.stddev_pop("ic")).otherwise(0.0)
    return ics.groupBy(*keys).agg(
        F.count("ic").alias("n_ic"), F.coalesce(F.avg("ic"), F.lit(0.0)).alias("ic_mean"), std.alias("ic_std"),
    ).withColumn("icir", F.col("ic_mean") / (F.col("ic_std") + 1e-9))


def interpret(hit: Column, ic: Column, sh: Column, dd: Column, alpha: Column) -> Column:
    """Verdict labels. The texts and edges are fixed values."""
    return F.struct(
        F.when(hit > 0.55, "Strong").when(hit > 0.45, "Moderate").otherwise("Weak").alias("hit_rate"),
        F.when(ic > 0.10, "Strong (>0.10)").when(ic > 0.05, "Good (0.05–0.10)")
        .when(ic > 0, "Weak (<0.05)").otherwise("Negative").alias("ic"),
        F.when(sh > 2, "Excellent (>2)").when(sh > 1, "Good (1–2)")
        .when(sh > 0, "Acceptable").otherwise("Poor (<0)").alias("sharpe"),
        F.when(dd > -0.10, "Low (<10%)").when(dd > -0.20, "Moderate").otherwise("High (>20%)").alias("drawdown"),
        F.when(alpha > 0, "Positive — model adding value")
        .otherwise("Negative — model underperforming equal-weight").alias("alpha"))


def backtest_report(top: DataFrame, ics: DataFrame, hits: DataFrame, bench: DataFrame,
                    rebalance_months: int = 3, cost_bps: float = K.COST_BPS) -> DataFrame:
    """One row with the headline figures of the equal-weight book.

    ``status`` is ``ok`` or the reason why there is nothing to report.
    """
    ppy = 12 / rebalance_months
    rows = equal_weight_book(top, cost_bps).join(bench.select("period", "bench_ret"), "period")
    rows = with_drawdown(rows.withColumn("all_", F.lit(1)), ["all_"], "idx", "net")
    core = rows.agg(
        F.count(F.lit(1)).alias("n_periods"), annualised("gross", ppy).alias("ann_gross"),
        annualised("net", ppy).alias("ann_net"), annualised("bench_ret", ppy).alias("ann_bench"),
        sharpe("net", ppy).alias("sharpe_"), F.min("drawdown").alias("dd_"),
        beta("net", "bench_ret").alias("beta_"), F.coalesce(F.avg("turnover"), F.lit(0.5)).alias("turn_"))
    hit = hits.agg(F.coalesce(F.avg("hit"), F.lit(0.5)).alias("hit_"))
    out = X.join_small(X.join_small(core, ic_summary(ics), []), hit, [])
    alpha_net = F.col("ann_net") - F.col("ann_bench")
    says = interpret(F.col("hit_"), F.col("ic_mean"), F.col("sharpe_"), F.col("dd_"), alpha_net)
    return out.select(
        F.when(F.col("n_periods") > 0, "ok").otherwise("No valid test periods").alias("status"),
        "n_periods",
        F.round(F.col("ann_gross") * 100, 2).alias("ann_portfolio_return"),
        F.round(F.col("ann_net") * 100, 2).alias("ann_portfolio_net"),
        F.round(F.col("ann_bench") * 100, 2).alias("ann_benchmark_return"),
        F.round((F.col("ann_gross") - F.col("ann_bench")) * 100, 2).alias("ann_alpha"),
        F.round(alpha_net * 100, 2).alias("ann_alpha_net"),
        F.round("sharpe_", 3).alias("sharpe_ratio"), F.round(F.col("dd_") * 100, 2).alias("max_drawdown"),
        F.round(calmar(F.col("ann_gross"), F.col("dd_")), 3).alias("calmar_ratio"),
        F.round(F.col("hit_") * 100, 1).alias("hit_rate"),
        F.round("ic_mean", 4).alias("ic_mean"), F.round("ic_std", 4).alias("ic_std"),
        F.round("icir", 3).alias("icir"), F.round("beta_", 3).alias("beta_vs_benchmark"),
        F.round(F.col("turn_") * 100, 1).alias("avg_turnover"), says.alias("interpretation"))


def lookback(bars: DataFrame) -> DataFrame:
    """One row: shortest history in years, and whether two years are there."""
    years = F.round(F.min("n") / 252, 1)
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min("n").alias("min_bars"), years.alias("lookback_years"),
        F.when(years < 2.0, "short history").otherwise("ok").alias("status"))


def period_examples(scored: DataFrame, last: int = 6, *, spread: bool | int) -> DataFrame:
    """Rows of the latest ``last`` periods with prediction, outcome and hit share.

    ``scored`` also needs start_dt and end_dt.
    """
    ends = scored.select("period").distinct().orderBy(F.desc("period")).limit(last)
    rows = scored.join(F.broadcast(ends), "period", "left_semi")
    med = X.column_percentiles(rows, ["period"], ["fwd_ret"], {"med_": 0.5}, spread=spread)
    rows = rows.join(med, "period").withColumns({
        "predicted_top": F.col("model_score") >= 0.5,
        "actual_top": F.col("fwd_ret") >= F.col("fwd_ret_med_")})
    rows = rows.withColumn("correct", F.col("predicted_top") == F.col("actual_top"))
    rate = rows.groupBy("period").agg(
        F.count(F.lit(1)).alias("n_stocks"),
        F.bround(F.avg(F.col("correct").cast("int")) * 100, 1).alias("hit_rate_pct"))
    return rows.join(rate, "period").select(
        "period", month_span(F.col("start_dt"), F.col("end_dt")).alias("date_range"), "n_stocks", "hit_rate_pct",
        "ticker", F.bround(F.col("model_score") * 100, 1).alias("model_score"), "predicted_top",
        F.bround(F.col("fwd_ret") * 100, 1).alias("actual_return_pct"), "actual_top", "correct")


def band_hit_rates(examples: DataFrame) -> DataFrame:
    """(band, n, hit_rate): all four bands, null rate where a band is empty."""
    spark = examples.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b, _ in K.BANDS])).alias("band"))
    seen = examples.groupBy(confidence_band("model_score").alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg(F.col("actual_top").cast("int")) * 100, 1).alias("hit_rate"))
    return names.join(seen, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
