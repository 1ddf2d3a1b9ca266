"""The best k rows of every group without ordering the rows.

Ordering a group to keep a fifth of it moves and sorts all its rows. Here the k-th value of a group is found from
counts: rows are counted in a few hundred value ranges where they are, the range that holds the k-th row is the only
one whose values are told apart, and what remains is a filter against one number per group. Rows that tie with that
number are settled by a second column in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators import ordering as O
from tapeworks.session import written


def kth_value(df: DataFrame, keys: list[str], value: str, wanted: DataFrame, *, largest: bool, max_groups: int | None = None) -> DataFrame:
    """(keys, cut_, beyond_, k_): the k-th largest (or smallest) value per key and the number of rows beyond it.

    ``wanted``: (keys, k_), k_ from 1. Keys with fewer than k_ values get no row. ``df`` is read four times, so pass
    a scan or a written table; its rows are not shuffled, only their counts. Nulls are left out.
    """
    src = df.filter(F.col(value).isNotNull()).select(*keys, value)
    groups = max_groups if dict(src.dtypes)[value] in O.FIXED_WIDTH else None
    sizes = src.groupBy(*keys).agg(F.approx_count_distinct(value).alias("d_"))
    marks = written(O._marks(src, keys, value, sizes, groups))
    cut = O._bucketed(src, keys, value, marks, groups)
    along = Window.partitionBy(*keys).orderBy(F.desc("bucket_") if largest else F.asc("bucket_"))
    counts = cut.groupBy(*keys, "bucket_").agg(F.count(F.lit(1)).alias("n_"))
    upto = F.sum("n_").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ranges = O.attach(counts.withColumn("upto_", upto), O.checked_broadcast(wanted), keys)
    held = ranges.filter((F.col("upto_") - F.col("n_") < F.col("k_")) & (F.col("k_") <= F.col("upto_"))).select(
        *keys, "bucket_", "k_", (F.col("upto_") - F.col("n_")).alias("base_"))       # one row a key
    inside = O.attach(cut, O.checked_broadcast(held), [*keys, "bucket_"]).groupBy(*keys, "bucket_", "k_", "base_", value).agg(
        F.count(F.lit(1)).alias("n_"))
    order = Window.partitionBy(*keys).orderBy(F.desc(value) if largest else F.asc(value))
    seen = F.col("base_") + F.sum("n_").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("seen_", seen).filter(
        (F.col("seen_") - F.col("n_") < F.col("k_")) & (F.col("k_") <= F.col("seen_"))).select(
        *keys, F.col(value).alias("cut_"), (F.col("seen_") - F.col("n_")).alias("beyond_"), "k_")


def mark_best(df: DataFrame, keys: list[str], score: str, tie: str, wanted: DataFrame, name: str, *,
              max_groups: int | None = None) -> DataFrame:
    """Add ``name``: whether the row is among the k_ highest scores of its key, ties by ascending ``tie``.

    ``wanted``: (keys, k_), null where none is. A score of null comes after all others; ``tie`` must not be null. Rows
    alike in key, score and tie are numbered only where the last places fall among them. A key with fewer rows than k_
    has all of them in, a key that ``wanted`` does not name none. ``df`` should be written: it is read several times.
    """
    columns = df.columns
    rows = df.withColumn("score_", F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))))
    first = kth_value(rows, keys, "score_", wanted, largest=True, max_groups=max_groups)
    first = written(first.select(*keys, "cut_", (F.col("k_") - F.col("beyond_")).alias("left_")))
    rows = O.attach(rows, O.checked_broadcast(wanted.select(*keys, "k_")), keys, "left")
    rows = O.attach(rows, O.checked_broadcast(first), keys, "left")
    tied = written(rows.filter("score_ = cut_").select(*keys, tie))
    second = kth_value(tied, keys, tie, first.select(*keys, F.col("left_").alias("k_")), largest=False)
    second = O.checked_broadcast(second.select(*keys, F.col("cut_").alias("tie_cut_"), (F.col("k_") - F.col("beyond_")).alias("places_")))
    rows = O.attach(rows, second, keys, "left")
    last = F.coalesce((F.col("score_") == F.col("cut_")) & (F.col(tie) == F.col("tie_cut_")), F.lit(False))
    inside = (F.col("score_") > F.col("cut_")) | ((F.col("score_") == F.col("cut_")) & (F.col(tie) < F.col("tie_cut_")))
    clear = rows.filter(~last).withColumn(name, F.when(F.col("cut_").isNull(), F.col("k_").isNotNull()).otherwise(inside))
    place = F.row_number().over(Window.partitionBy(*keys, "score_", tie).orderBy(tie))
    among = rows.filter(last).withColumn(name, place <= F.col("places_"))
    return clear.select(*columns, name).unionByName(among.select(*columns, name))
