"""Sector composition, concentration, and diversifying additions, for many portfolios at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.signals import fixed
from tapeworks.session import durable


def composition(holdings: DataFrame) -> DataFrame:
    """(portfolio_id, sector, pct). Given weights count only if all are positive.

    Rows are first combined to one per (portfolio, sector); the window that
    follows sees at most one row per sector, however long the portfolio.
    """
    good = F.coalesce(F.col("weight") > 0, F.lit(False))
    parts = holdings.groupBy("portfolio_id", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(
        F.sum("weight").alias("w_"), F.count(F.lit(1)).alias("n_"), F.min(good.cast("int")).alias("ok_"))
    whole = Window.partitionBy("portfolio_id")
    given = F.min("ok_").over(whole) == 1
    share = F.when(given, F.col("w_") / F.sum("w_").over(whole)).otherwise(F.col("n_") / F.sum("n_").over(whole))
    return parts.select("portfolio_id", "sector", F.bround(share * 100, 1).alias("pct"))


def _message(template: str, **slots: Column) -> Column:
    parts, rest = [], template
    for name, value in slots.items():
        head, rest = rest.split("{" + name + "}")
        parts += [F.lit(head), value]
    return F.concat(*parts, F.lit(rest))


def concentration_flags(comp: DataFrame) -> DataFrame:
    """(portfolio_id, type, sector, pct, message): heavy sectors and missing core sectors."""
    over = comp.filter((F.col("sector") != "Unknown") & (F.col("pct") > K.OVER_CONCENTRATION_PCT)).select(
        "portfolio_id", F.lit("over").alias("type"), "sector", "pct",
        _message(K.OVER_MESSAGE, pct=fixed(F.col("pct"), 0), sector=F.col("sector")).alias("message"))
    core = F.explode(F.array(*[F.lit(s) for s in K.CORE_SECTORS]))
    present = comp.filter("pct > 0").select("portfolio_id", "sector")
    gap = comp.select("portfolio_id").distinct().withColumn("sector", core).join(
        present, ["portfolio_id", "sector"], "left_anti").select(
        "portfolio_id", F.lit("gap").alias("type"), "sector", F.lit(0.0).alias("pct"),
        _message(K.GAP_MESSAGE, sector=F.col("sector")).alias("message"))
    return over.unionByName(gap)


def exclude_held(candidates: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that are not held; tickers compare in upper case without outer blanks."""
    plain = lambda c: F.upper(F.trim(c)) if c == "ticker" else F.col(c)
    owned = held.select(*[plain(k).alias(f"{k}_held") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [plain(k) == F.col(f"{k}_held") for k in keys])
    return candidates.join(owned, same, "left_anti")


def eligible(candidates: DataFrame, bars: str = "bars", min_bars: int = K.CANDIDATE_BARS, min_names: int = K.CANDIDATE_NAMES) -> DataFrame:
    """Candidates with enough history; none at all where too few names are left to rank against each other."""
    rows = candidates.filter(F.col(bars) >= min_bars)
    return rows if rows.count() >= min_names else rows.limit(0)


def holdings_report(held: DataFrame, scored: DataFrame, n: int = 5) -> DataFrame:
    """(portfolio_id, section, item, value, text): scored holdings, composition, flags and additions.

    ``held``: portfolio_id, ticker, sector, weight; ``scored``: ticker, sector, composite_score, signal.
    """
    parts = durable(composition(held))
    names = held.select("portfolio_id", F.upper(F.trim("ticker")).alias("ticker")).distinct()
    row = lambda section, item, value, text: ["portfolio_id", F.lit(section).alias("section"), F.col(item).alias("item"),
                                              F.col(value).cast("double").alias("value"), F.col(text).alias("text")]
    own = names.join(scored, "ticker", "left").select(*row("holding", "ticker", "composite_score", "signal"))
    comp = parts.withColumn("none", F.lit(None).cast("string")).select(*row("sector", "sector", "pct", "none"))
    flags = concentration_flags(parts).select(*row("flag", "sector", "pct", "message"))
    adds = recommend_additions(parts, names, scored, n).select(*row("addition", "ticker", "composite_score", "rationale"))
    return own.unionByName(comp).unionByName(flags).unionByName(adds)


def recommend_additions(comp: DataFrame, held: DataFrame, candidates: DataFrame, n: int = 5, per_sector: int = 2) -> DataFrame:
    """(portfolio_id, rank, ticker, sector, composite_score, rationale).

    ``held``: portfolio_id, ticker. ``candidates``: ticker, sector,
    composite_score, signal, one row per ticker. No portfolio x candidate pairs
    are built: a portfolio that holds h candidates of a sector finds its two
    best free names among the first h + 2 of that sector, and those are fetched
    by (sector, place). That is exact for any number of candidates.
    """
    known = candidates.filter(F.col("sector").isin(K.SECTORS))
    held = held.select("portfolio_id", F.upper(F.trim("ticker")).alias("ticker")).distinct()
    taken = (
        held.join(known.select("ticker", "sector"), "ticker")
        .groupBy("portfolio_id", "sector").agg(F.count(F.lit(1)).alias("taken_"))
    )
    # No portfolio looks further down a sector than this, so deeper places are
    # never needed and each task can drop them before the exchange.
    deepest = (taken.agg(F.max("taken_")).first()[0] or 0) + per_sector
    best = Window.partitionBy("sector").orderBy(F.desc("composite_score"), "ticker")
    listed = known.withColumn("place_", F.row_number().over(best)).filter(F.col("place_") <= deepest)
    target = 100.0 / len(K.SECTORS)
    all_sectors = F.explode(F.array(*[F.lit(s) for s in K.SECTORS]))
    wanted = (
        comp.select("portfolio_id").distinct().withColumn("sector", all_sectors)
        .join(comp, ["portfolio_id", "sector"], "left")
        .withColumn("pct", F.coalesce("pct", F.lit(0.0)))
        .withColumn("gap_", target - F.col("pct")).filter("gap_ > 0")
        .join(taken, ["portfolio_id", "sector"], "left")
        .withColumn("upto_", F.coalesce("taken_", F.lit(0)) + per_sector)
        .withColumn("place_", F.explode(F.sequence(F.lit(1), F.col("upto_").cast("int"))))
    )
    pool = exclude_held(wanted.join(listed, ["sector", "place_"]), held, ["portfolio_id", "ticker"])
    in_sector = Window.partitionBy("portfolio_id", "sector").orderBy("place_")
    overall = Window.partitionBy("portfolio_id").orderBy(F.desc("gap_"), F.desc("composite_score"), "ticker")
    picks = (
        pool.withColumn("s_", F.row_number().over(in_sector)).filter(F.col("s_") <= per_sector)
        .withColumn("rank", F.row_number().over(overall)).filter(F.col("rank") <= n)
    )
    says = F.when(F.col("signal").isNotNull(), F.concat(F.lit("; the model rates it "), F.col("signal"), F.lit(".")))
    rationale = F.concat(F.lit("Adds "), F.col("sector"), F.lit(" exposure (you hold "), fixed(F.col("pct"), 0),
                         F.lit("%)"), F.coalesce(says, F.lit(".")))
    return picks.select("portfolio_id", "rank", "ticker", "sector", "composite_score", rationale.alias("rationale"))


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per key; Spark limits each partition before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn_", F.row_number().over(w)).filter(F.col("rn_") <= k).drop("rn_")


def build_portfolio(candidates: DataFrame, size: int = 15, max_per_sector: int = 3) -> DataFrame:
    """(place, ticker, sector, composite_score, weight, rationale) of the strongest names.

    Names within the sector cap come first; if they are too few, the best of the
    rest are appended. Top-k steps only: the universe is never ordered in one task.
    """
    order = [F.desc("composite_score"), F.col("ticker")]
    capped = top_k_per_group(candidates, ["sector"], order, max_per_sector).orderBy(*order).limit(size)
    rest = candidates.join(capped.select("ticker"), "ticker", "left_anti").orderBy(*order).limit(size)
    both = capped.withColumn("tier_", F.lit(0)).unionByName(rest.withColumn("tier_", F.lit(1)))
    picks = both.orderBy("tier_", *order).limit(size)
    all_rows = Window.partitionBy(F.lit(1))           # at most ``size`` rows
    rationale = F.coalesce(
        F.concat("signal", F.lit(" · "), "sector", F.lit(" — among the model's strongest current picks")),
        F.concat("sector", F.lit(" — model pick")))
    return picks.select(
        F.row_number().over(all_rows.orderBy("tier_", *order)).alias("place"), "ticker", "sector", "composite_score",
        F.bround(100.0 / F.count(F.lit(1)).over(all_rows), 1).alias("weight"), rationale.alias("rationale"))
