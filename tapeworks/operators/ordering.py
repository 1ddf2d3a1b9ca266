"""Exact ranks, percentiles and running sums for groups of any size.

A plain ``Window.partitionBy(key).orderBy(v)`` sorts a whole key in one task.
That is right while a key is known to be small, and wrong for a cross-section
of a hundred million names, a pooled statistic or a melted feature column. Here
each key is cut into a few hundred value ranges ("buckets") first:

* the cuts ("marks") are the distinct values whose hash falls below a threshold
  that lets about 512 of them through. That is a uniform sample of the distinct
  values and a function of the data alone, so a recomputed task cuts at the same
  places;
* per-bucket weights are map-side combined and summed along the buckets of a key
  (hundreds of rows), which says how much lies before each bucket;
* ``running_weight`` then orders inside (key, bucket); ``percentiles`` orders
  only the few buckets that hold a wanted rank, and never moves the other rows.

Ties are combined to one row per distinct value, so a value that fills a third
of the table is one row. Every row takes part; the sample only places the cuts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.session import durable

SAMPLE = 512
HASH_RANGE = 1 << 30
BROADCAST_LIMIT_BYTES = 64 << 20
GROUP_ROWS_IN_ONE_TASK = 2_000_000
FIXED_WIDTH = {"double", "float", "bigint", "int", "smallint", "tinyint", "date", "timestamp", "timestamp_ntz"}


def needs_spread(df: DataFrame, keys: list[str], limit: int = GROUP_ROWS_IN_ONE_TASK) -> int:
    """0 when every key fits one task; else the number of keys.

    One map-side combined count; two numbers come back. Operators take the result
    as ``spread``: the number of keys also bounds the per-key tables they may
    broadcast. ``spread=True`` asks for the spread form without such a bound.
    """
    sizes = df.groupBy(*(keys or [F.lit(1).alias("all")])).count()
    shape = sizes.agg(F.max("count").alias("largest"), F.count(F.lit(1)).alias("groups")).first()
    return shape["groups"] if (shape["largest"] or 0) > limit else 0


def bound_of(spread: bool | int, per_key: int = 1) -> int | None:
    """Bound on the groups behind a ``spread`` value, None when unknown."""
    return None if spread is True else int(spread) * per_key


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null, keeping one copy of the keys."""
    right = table.select(*[F.col(k).alias(f"{k}__r") for k in keys], *[c for c in table.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys])
    return df.join(right, same, how).drop(*[f"{k}__r" for k in keys])


def checked_broadcast(df: DataFrame, max_bytes: int = 32 << 20) -> DataFrame:
    """Broadcast a side whose rows, written as text, are measured to be small; otherwise leave it to Spark.

    The side is made durable first, so measuring it does not compute it twice.
    """
    df = durable(df)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def _few(df: DataFrame, max_groups: int | None, per_group: int = SAMPLE) -> DataFrame:
    """Broadcast a per-key table when the caller's bound on the keys makes it small."""
    if max_groups is not None and max_groups * per_group * 32 <= BROADCAST_LIMIT_BYTES:
        return F.broadcast(df)
    return df


def _marks(values: DataFrame, keys: list[str], value: str, sizes: DataFrame, max_groups: int | None) -> DataFrame:
    """(keys, marks_): sorted cut values. ``sizes``: (keys, d_) distinct values per key."""
    share = F.lit(float(SAMPLE * HASH_RANGE)) / F.col("d_")
    picked = attach(values, _few(sizes, max_groups, 1), keys).filter(F.pmod(F.xxhash64(value), F.lit(HASH_RANGE)) < share)
    return picked.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("marks_"))


def _bucketed(df: DataFrame, keys: list[str], value: str, marks: DataFrame, max_groups: int | None) -> DataFrame:
    """Add ``bucket_``: the number of marks <= value.

    Binary search over up to 2,047 marks, one projection per step, so it runs as
    generated code (a higher-order function would be interpreted for every row).
    """
    out = attach(df, _few(marks, max_groups), keys, "left").withColumn("bucket_", F.lit(0))
    for step in [1 << i for i in range(10, -1, -1)]:
        there = F.try_element_at("marks_", F.col("bucket_") + step) <= F.col(value)
        out = out.withColumn("bucket_", F.col("bucket_") + F.when(there, step).otherwise(0))
    return out.drop("marks_")


def _bases(cut: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """(keys, bucket_, <w>_base, <w>_total): weight of the earlier buckets and of the key."""
    per_key = Window.partitionBy(*keys)
    earlier = per_key.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    return cut.groupBy(*keys, "bucket_").agg(*[F.sum(w).alias(w) for w in weights]).select(
        *keys, "bucket_", *[F.col(w).alias(f"{w}_here") for w in weights],
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}_base") for w in weights],
        *[F.sum(w).over(per_key).alias(f"{w}_total") for w in weights])


def running_weight(
    df: DataFrame,
    keys: list[str],
    order: str,
    weights: list[str],
    *,
    spread: bool = True,
    max_groups: int | None = None,
) -> DataFrame:
    """One row per distinct (keys, order): its weights, what lies before, totals.

    Output columns per weight ``w``: ``w``, ``w_before``, ``w_total``.
    ``order`` must not be null. ``spread=False`` is for keys known to be small.
    ``max_groups`` is a bound on the number of keys; it allows the per-key tables
    to be broadcast when they fit the limit for that many keys.
    """
    local_keys = keys or ["one_group"]
    src = df if keys else df.withColumn("one_group", F.lit(1))
    groups = max_groups if keys else 1
    if dict(src.dtypes)[order] not in FIXED_WIDTH:      # the byte bound holds for numbers and dates only
        groups = None
    distinct = src.groupBy(*local_keys, order).agg(*[F.sum(w).alias(w) for w in weights])
    # Keeps the weights alive in every branch below, so that all of them read the
    # same exchange instead of each computing a narrower one.
    distinct = distinct.filter(F.col(weights[0]).isNotNull())
    if not spread:
        whole = Window.partitionBy(*local_keys)
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = distinct.select(
            *local_keys, order, *weights,
            *[(F.sum(w).over(upto) - F.col(w)).alias(f"{w}_before") for w in weights],
            *[F.sum(w).over(whole).alias(f"{w}_total") for w in weights],
        )
        return out if keys else out.drop("one_group")

    sizes = distinct.groupBy(*local_keys).agg(F.count(F.lit(1)).alias("d_"))
    marks = _marks(distinct.select(*local_keys, order), local_keys, order, sizes, groups)
    cut = _bucketed(distinct, local_keys, order, marks, groups)
    inside = (
        Window.partitionBy(*local_keys, "bucket_").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    runs = cut.select(
        *local_keys, "bucket_", order, *weights,
        *[F.sum(w).over(inside).alias(f"{w}_run") for w in weights],
    )
    out = attach(runs, _few(_bases(cut, local_keys, weights), groups), [*local_keys, "bucket_"]).select(
        *local_keys, order, *weights,
        *[(F.col(f"{w}_base") + F.col(f"{w}_run") - F.col(w)).alias(f"{w}_before") for w in weights],
        *[f"{w}_total" for w in weights],
    )
    return out if keys else out.drop("one_group")


def interpolated(prob: float, name: str, value: str) -> Column:
    """Aggregate giving the linear-interpolation percentile from running counts.

    Needs ``n_``, ``n__before`` and ``n__total`` (see ``percentiles``).
    """
    pos = F.lit(prob) * (F.col("n__total") - 1)
    low = F.floor(pos)
    high = F.ceil(pos)

    def at(rank: Column) -> Column:
        inside = (F.col("n__before") <= rank) & (rank < F.col("n__before") + F.col("n_"))
        return F.max(F.when(inside, F.col(value)))

    part = F.max(pos - low)
    return (at(low) + (at(high) - at(low)) * part).alias(name)


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    *,
    spread: bool | int = True,
    max_groups: int | None = None,
    sizes: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """(keys, <name>...): exact percentiles, linear between neighbours, nulls left out.

    ``df`` is read four times (sizes, marks, bucket counts, wanted buckets), so
    pass a scan or a durable result; its rows are not shuffled. ``sizes`` may
    bring (keys, d_), the approximate number of distinct values, if known.
    ``weight`` names a column that says how often each value occurs.
    """
    aggs = [interpolated(p, name, value) for name, p in probs.items()]
    local_keys = keys or ["one_group"]
    n = F.col(weight) if weight else F.lit(1)
    src = df.filter(F.col(value).isNotNull()).select(*keys, value, n.alias("n_"))
    src = src if keys else src.withColumn("one_group", F.lit(1))
    groups = max_groups if keys else 1
    if dict(src.dtypes)[value] not in FIXED_WIDTH:
        groups = None
    if not spread:
        ordered = running_weight(src, local_keys, value, ["n_"], spread=False)
        out = ordered.groupBy(*local_keys).agg(*aggs)
        return out if keys else out.drop("one_group")

    if sizes is None:
        sizes = src.groupBy(*local_keys).agg(F.approx_count_distinct(value).alias("d_"))
    marks = durable(_marks(src.drop("n_"), local_keys, value, sizes, groups))
    cut = _bucketed(src, local_keys, value, marks, groups)
    bases = _bases(cut, local_keys, ["n_"])
    ranks = [r for p in probs.values()
             for r in (F.floor(F.lit(p) * (F.col("n__total") - 1)), F.ceil(F.lit(p) * (F.col("n__total") - 1)))]
    holds = [(F.col("n__base") <= r) & (r < F.col("n__base") + F.col("n__here")) for r in ranks]
    wanted = bases.filter(reduce(lambda a, b: a | b, holds)).drop("n__here")
    inside = (
        Window.partitionBy(*local_keys, "bucket_").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        attach(cut, _few(wanted, groups, 2 * len(probs)), [*local_keys, "bucket_"])
        .groupBy(*local_keys, "bucket_", "n__base", "n__total", value).agg(F.sum("n_").alias("n_"))
        .withColumn("n__before", F.col("n__base") + F.sum("n_").over(inside) - F.col("n_"))
    )
    out = found.groupBy(*local_keys).agg(*aggs)
    return out if keys else out.drop("one_group")


def melt(df: DataFrame, ids: list[str], cols: list[str], name="feature", value="value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def average_ranks(
    df: DataFrame, keys: list[str], ids: list[str], cols: list[str], *, spread: bool | int,
    pct: bool = True, suffix: str = "_rank",
) -> DataFrame:
    """Add the average-tie rank of each column within ``keys``; nulls stay null.

    ``pct`` divides by the number of non-null values of the key. Null keys form a
    group; ids may be null or repeated: rows are told apart by a number of their own.
    """
    if not spread:
        # Every window is partitioned by the keys alone: one exchange for all columns.
        outs = []
        whole = Window.partitionBy(*keys)
        for c in cols:
            by_value = whole.orderBy(F.col(c).asc_nulls_last())
            ties = F.count(F.lit(1)).over(by_value.rangeBetween(0, 0))
            rank = F.rank().over(by_value) + (ties - 1) / F.lit(2.0)
            if pct:
                rank = rank / F.count(c).over(whole)
            outs.append(F.when(F.col(c).isNotNull(), rank).alias(c + suffix))
        return df.select("*", *outs)

    rows = durable(df.withColumn("row_", F.monotonically_increasing_id()))
    long = melt(rows.select(*keys, "row_", *cols), [*keys, "row_"], cols).filter("value IS NOT NULL")
    counted = long.select(*keys, "feature", "value", F.lit(1).alias("n_"))
    bound = bound_of(spread, len(cols)) if keys else len(cols)
    ordered = running_weight(counted, [*keys, "feature"], "value", ["n_"], max_groups=bound)
    rank = F.col("n__before") + (F.col("n_") + 1) / F.lit(2.0)
    if pct:
        rank = rank / F.col("n__total")
    ranked = (
        attach(long, ordered.select(*keys, "feature", "value", rank.alias("rank_")), [*keys, "feature", "value"])
        .groupBy("row_")
        .agg(*[F.max(F.when(F.col("feature") == c, F.col("rank_"))).alias(c + suffix) for c in cols])
    )
    return rows.join(ranked, "row_", "left").drop("row_")


def row_numbers(
    df: DataFrame, keys: list[str], order: dict[str, bool], *, spread: bool | int, name: str = "rn",
) -> DataFrame:
    """Position within the key; ``order`` maps column -> ascending.

    Nulls come first in ascending and last in descending order, null keys form a
    group, and rows that ``order`` does not tell apart are numbered in any order.
    The spread form orders by one struct; descending columns must be numeric.
    """
    if not spread:
        by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order.items()]
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long"))
    parts = [p for c, up in order.items()
             for p in ([F.col(c)] if up else [F.col(c).isNull().alias(f"{c}_last"), (-F.col(c)).alias(c)])]
    tagged = df.withColumn("order_", F.struct(*parts)).withColumn("n_", F.lit(1))
    at = running_weight(tagged, keys, "order_", ["n_"], max_groups=bound_of(spread)).select(
        *keys, "order_", F.col("n__before").alias("before_")
    )
    alike = F.row_number().over(Window.partitionBy(*keys, "order_").orderBy("order_"))
    numbered = attach(tagged.drop("n_"), at, [*keys, "order_"]).withColumn(name, (F.col("before_") + alike).cast("long"))
    return numbered.drop("order_", "before_")
