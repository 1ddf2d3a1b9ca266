"""Keys cut into ranges, and what passes from one range to the next.

A window over a key runs in one task. Where a key can hold a large share of all rows, an ordered computation is done
in three steps: the key's order is cut into ranges of about equal weight, each range is worked on by itself, and a
table of one row per range carries the state that later ranges start from.

* ``cut``: the cut points are the distinct (key, order) values whose hash is a multiple of the wanted number of rows.
  That is a sample in proportion to a key's weight and a function of the data alone, so a recomputed task cuts at the
  same places, a small key is left whole and a large one gets as many ranges as it needs.
* ``carry_last``: the last value of the earlier ranges, for forward fills.
* ``carry_sum``: the sum of the earlier ranges, for counts and positions.
* ``carry_affine``: the state before a range where every range maps it as ``a * x + b``, for recursions.

``ranged`` is False (one range a key), True (ranges sized by the measured number of rows) or the rows of a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators import ordering as O
from tapeworks.session import written

ROWS_PER_RANGE = 1_000_000
RANGES_PER_PARTITION = 4


def rows_of(df: DataFrame, ranged: bool | int) -> int:
    """Rows of a range: as told, or the number of rows over a few ranges a shuffle partition, at most a million."""
    if ranged is not True:
        return int(ranged)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * RANGES_PER_PARTITION
    return max(1, min(ROWS_PER_RANGE, -(-df.count() // parts)))


def cut(df: DataFrame, keys: list[str], order: str, ranged: bool | int = True) -> DataFrame:
    """Add ``range_``: the number of cut points of the row's key that are <= ``order``.

    ``df`` is read twice (cut points, rows), so pass a scan or a written table. Equal (key, order) share a range;
    a null order is in range 0.
    """
    rows = rows_of(df, ranged)
    sampled = df.filter(F.col(order).isNotNull() & (F.pmod(F.xxhash64(*keys, order), F.lit(rows)) == 0))
    marks = written(sampled.groupBy(*keys).agg(F.sort_array(F.collect_set(order)).alias("marks_")))
    most = marks.agg(F.max(F.size("marks_"))).first()[0] or 0
    out = O.attach(df, O.checked_broadcast(marks), keys, "left").withColumn("range_", F.lit(0))
    for step in [1 << i for i in range(most.bit_length() - 1, -1, -1)]:
        there = F.try_element_at("marks_", F.col("range_") + step) <= F.col(order)
        out = out.withColumn("range_", F.col("range_") + F.when(there, step).otherwise(0))
    return out.drop("marks_")


def _along(keys: list[str], backwards: bool = False):
    at = F.col("range_")
    return Window.partitionBy(*keys).orderBy(at.desc() if backwards else at.asc())


def carry_last(tails: DataFrame, keys: list[str], value: str, backwards: bool = False) -> DataFrame:
    """(keys, range_, <value>): the nearest non-null value of the ranges before (after, when ``backwards``)."""
    before = _along(keys, backwards).rowsBetween(Window.unboundedPreceding, -1)
    return tails.select(*keys, "range_", F.last(value, ignorenulls=True).over(before).alias(value))


def carry_sum(totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, range_, <value>): the sum over the earlier ranges, 0 for the first."""
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, "range_", F.coalesce(F.sum(value).over(before), F.lit(0)).alias(value))


def carry_affine(maps: DataFrame, keys: list[str], factor: str, terms: list[str]) -> DataFrame:
    """(keys, range_, <terms>): the state that enters a range, null for the first.

    Row i maps a state x to ``factor * x + term``. Maps compose to maps, so the scan doubles its reach in every round:
    log2 of the largest number of ranges, each a window over the table of ranges.
    """
    order = _along(keys)
    most = maps.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    out, reach = maps.select(*keys, "range_", factor, *terms), 1
    while reach < most:
        before = {c: F.lag(c, reach).over(order) for c in (factor, *terms)}
        out = out.withColumns({f"{c}_b": x for c, x in before.items()}).select(
            *keys, "range_",
            (F.col(factor) * F.coalesce(f"{factor}_b", F.lit(1.0))).alias(factor),
            *[(F.col(t) + F.col(factor) * F.coalesce(f"{t}_b", F.lit(0.0))).alias(t) for t in terms])
        reach *= 2
    return out.select(*keys, "range_", *[F.lag(t).over(order).alias(t) for t in terms])


def numbered(df: DataFrame, keys: list[str], order: str, name: str, ranged: bool | int = True) -> DataFrame:
    """Add ``name``: the 0-based position of the row in its key. Rows of one key are numbered in many tasks.

    ``order`` must be unique within a key and not null.
    """
    rows = cut(df, keys, order, ranged)
    base = carry_sum(rows.groupBy(*keys, "range_").agg(F.count(F.lit(1)).alias("base_")), keys, "base_")
    rows = O.attach(rows, O.checked_broadcast(base), [*keys, "range_"])
    inside = F.row_number().over(Window.partitionBy(*keys, "range_").orderBy(order))
    return rows.withColumn(name, (F.col("base_") + inside - 1).cast("bigint")).drop("range_", "base_")


def nearest(asked: DataFrame, known: DataFrame, keys: list[str], at: str, hit: str, *, backwards: bool = False,
            ranged: bool | int = False) -> DataFrame:
    """(keys, at, hit) of the asked rows with the hit of the latest known row at or before ``at``.

    ``asked`` has distinct (keys, at); ``known`` (keys, at, hit), hit never null. ``backwards``: the first at or after.
    """
    nothing = F.lit(None).cast(known.schema[hit].dataType).alias(hit)
    both = asked.select(*keys, at, F.lit(1).alias("asked_"), nothing).unionByName(
        known.select(*keys, at, F.lit(0).alias("asked_"), hit))

    def filled(rows: DataFrame, parts: list[str]) -> DataFrame:
        when: Column = F.col(at).desc() if backwards else F.col(at).asc()
        order = Window.partitionBy(*parts).orderBy(when, "asked_").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(hit, F.last(hit, ignorenulls=True).over(order)).filter("asked_ = 1").drop("asked_")

    if ranged is False:
        return filled(both, keys)
    own = keys or ["all_"]
    both = written(both if keys else both.withColumn("all_", F.lit(1)))
    rows = cut(both, own, at, ranged)
    pick = F.min_by if backwards else F.max_by
    tails = rows.groupBy(*own, "range_").agg(pick(hit, F.when(F.col("asked_") == 0, F.col(at))).alias("carry_"))
    carry = O.checked_broadcast(carry_last(tails, own, "carry_", backwards))
    out = O.attach(filled(rows, [*own, "range_"]), carry, [*own, "range_"], "left")
    return out.select(*keys, at, F.coalesce(hit, "carry_").alias(hit))
