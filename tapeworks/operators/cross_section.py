"""Cross-sectional operators: one group per period (or other ``keys``).

Every operator takes ``spread``: False runs plain windows, one task per key,
for keys whose size was checked; True uses ``ordering`` and has no size limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.functions.scalars import clip
from tapeworks.operators import ordering as O
from tapeworks.operators import rank_index as RI


def join_small(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-key statistics. Without keys ``stats`` is one row: its numbers become literals."""
    if keys:
        return O.attach(df, stats, keys, "left")
    row = stats.first()
    return df.withColumns({name: F.lit(row[name]).cast(kind) for name, kind in stats.dtypes})


def column_percentiles(df: DataFrame, keys: list[str], cols: list[str], probs: dict[str, float], *, spread: bool | int) -> DataFrame:
    """(keys, <col>_<name>...) exact percentiles of several columns.

    Unspread groups use the built-in ``percentile`` aggregate.
    """
    if not spread:
        both = df.groupBy(*keys).agg(*[
            F.percentile(F.col(c), F.array(*map(F.lit, probs.values()))).alias(c) for c in cols])
        return both.select(*keys, *[F.col(c)[i].alias(f"{c}_{name}") for c in cols for i, name in enumerate(probs)])
    long = O.melt(df.select(*keys, *cols), keys, cols)
    per = O.percentiles(long, [*keys, "feature"], "value", probs, max_groups=O.bound_of(spread, len(cols)))
    return per.groupBy(*keys).agg(*[
        F.max(F.when(F.col("feature") == c, F.col(name))).alias(f"{c}_{name}") for c in cols for name in probs])


def winsorise(df: DataFrame, keys: list[str], cols: list[str], *, spread: bool | int, low=0.01, high=0.99) -> DataFrame:
    bounds = column_percentiles(df, keys, cols, {"lo_": low, "hi_": high}, spread=spread)
    out = join_small(df, bounds, keys)
    out = out.withColumns({c: clip(c, F.col(f"{c}_lo_"), F.col(f"{c}_hi_")) for c in cols})
    return out.drop(*[f"{c}_{s}" for c in cols for s in ("lo_", "hi_")])


def pct_ranks(df: DataFrame, keys: list[str], ids: list[str], cols: list[str], *, spread: bool | int) -> DataFrame:
    """Add ``<col>_rank`` in (0, 1]: average ties, nulls kept null and not counted.

    A column with at most one value in the group has no rank: it stays null.
    """
    out = O.average_ranks(df, keys, ids, cols, spread=spread)
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"{c}_cnt_") for c in cols]) if spread else None
    if spread:
        out = join_small(out, counts, keys)
        sizes = {c: F.col(f"{c}_cnt_") for c in cols}
    else:
        sizes = {c: F.count(c).over(Window.partitionBy(*keys)) for c in cols}
    out = out.withColumns({f"{c}_rank": F.when(sizes[c] > 1, F.col(f"{c}_rank")) for c in cols})
    return out.drop(*[f"{c}_cnt_" for c in cols])


def median_fill(df: DataFrame, keys: list[str], cols: list[str], *, spread: bool | int, empty: float = 0.5) -> DataFrame:
    med = column_percentiles(df, keys, cols, {"med_": 0.5}, spread=spread)
    out = join_small(df, med, keys)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}_med_"), F.lit(empty)) for c in cols})
    return out.drop(*[f"{c}_med_" for c in cols])


def neutral_fill(df: DataFrame) -> DataFrame:
    """0.0 for embedding columns, 0.5 for all other numbers."""
    numbers = [c for c, t in df.dtypes if t in ("double", "float")]
    emb = [c for c in numbers if c.startswith("emb_")]
    return df.fillna(0.0, emb).fillna(0.5, [c for c in numbers if c not in emb])


def reference_ranks(live: DataFrame, panel: DataFrame, ids: list[str], cols: list[str], *, min_values: int = 20) -> DataFrame:
    """Replace ``<col>_rank`` by the share of panel values <= the live value.

    Missing live values rank 0.5. A column with fewer than ``min_values`` panel
    values keeps whatever rank the live rows had. Counts come from a block index
    over the ordered panel (``rank_index``); live rows stay where they are.
    """
    out = RI.with_counts(live, panel, cols)
    ranks = {}
    for c in cols:
        old = F.col(f"{c}_rank") if f"{c}_rank" in live.columns else F.lit(None).cast("double")
        share = F.coalesce(F.try_divide(F.col(f"{c}_upto_"), F.col(f"{c}_n_")), F.lit(0.5))
        ranks[f"{c}_rank"] = F.when(F.col(f"{c}_n_") >= min_values, share).otherwise(old)
    return out.withColumns(ranks).drop(*[f"{c}_{s}" for c in cols for s in ("n_", "upto_")])


def standardized_embeddings(emb: DataFrame, keys: list[str], ids: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, ids, dim, z): z-score of each dimension in its group, sample deviation.

    Dimensions are combined on the map side to one vector of means and deviations per group. Those few
    vectors go to the rows, which are scaled where they are; a dimension below 1e-8 spread, or alone in
    its group, gives 0.
    """
    long = emb.select(*keys, F.posexplode(vector).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    stats = long.groupBy(*keys, "dim").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    packed = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd"))).alias("stats_"))

    def scaled(v, i):
        s = F.get("stats_", i)
        return F.coalesce(F.when(s["sd"] >= 1e-8, (v.cast("double") - s["mu"]) / s["sd"]), F.lit(0.0))

    rows = O.attach(emb.select(*keys, *ids, vector), O.checked_broadcast(packed), keys)
    return rows.select(*keys, *ids, F.posexplode(F.transform(vector, scaled)).alias("dim", "z"))


def median_labels(df: DataFrame, keys: list[str], *, spread: bool | int, inclusive: bool, value: str = "fwd_ret") -> DataFrame:
    """Add ``median_ret``, ``bench_ret`` (mean), ``names_`` (rows) and ``label`` (beats the median)."""
    mean = [F.avg(value).alias("bench_ret"), F.count(F.lit(1)).alias("names_")]
    if spread:
        med = column_percentiles(df, keys, [value], {"med_": 0.5}, spread=True)
        means = df.groupBy(*keys).agg(*mean)
        stats = O.attach(means, med, keys, "left") if keys else join_small(means, med, [])
    else:
        stats = df.groupBy(*keys).agg(F.percentile(F.col(value), 0.5).alias(f"{value}_med_"), *mean)
    out = join_small(df, stats, keys).withColumnRenamed(f"{value}_med_", "median_ret")
    beats = F.col(value) >= F.col("median_ret") if inclusive else F.col(value) > F.col("median_ret")
    return out.withColumn("label", beats.cast("int"))


def min_max(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Add ``<col>_mm`` scaled to [0, 1] in the group; a constant column gives 0.5."""
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mn_", F.min), ("mx_", F.max))])
    out = join_small(df, stats, keys)
    scaled = {}
    for c in cols:
        width = F.nullif(F.col(f"{c}_mx_") - F.col(f"{c}_mn_"), F.lit(0))
        part = F.coalesce((F.col(c) - F.col(f"{c}_mn_")) / width, F.lit(0.5))
        scaled[f"{c}_mm"] = F.when(F.col(c).isNotNull(), part)
    out = out.withColumns(scaled)
    return out.drop(*[f"{c}_{n}" for c in cols for n in ("mn_", "mx_")])


def snapshot_features(latest: DataFrame, keys: list[str], ids: list[str], *, spread: bool | int) -> DataFrame:
    """Winsorise, rank, then fill all 21 features of a raw snapshot."""
    out = winsorise(latest, keys, K.FEATURES, spread=spread)
    out = pct_ranks(out, keys, ids, K.FEATURES, spread=spread)
    return median_fill(out, keys, K.FEATURES, spread=spread)


def reference_panel(latest: DataFrame, min_names: int = K.MIN_PANEL_NAMES, min_bars: int = K.MIN_BARS_PANEL) -> DataFrame:
    """Price features of the latest bar per ticker; empty when too few names."""
    rows = latest.filter(F.col("bar") + 1 >= min_bars).select("ticker", *K.PRICE_FEATURES)
    names = rows.agg(F.count(F.lit(1)).alias("names_"))
    return join_small(rows, names, []).filter(F.col("names_") >= min_names).drop("names_")
