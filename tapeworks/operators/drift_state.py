"""Drift state: how often each value of a feature occurred, per period.

One scan of the rows gives all that drift needs. The counts are exact, adding them merges batches, quarters or
partitions in any order, and ``monitoring``'s statistics, frozen edges, shares and stability indices come from them
with ``weight="c"`` without touching the rows again: the state of a feature is as long as its distinct values, not as
its rows. For features whose values hardly repeat it would be as long as the rows; ``counted`` measures that first and
leaves such tables to the scans over value ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.monitoring import finite_or_null
from tapeworks.session import written

REPEATS = 2.0     # rows per distinct value from which counts are kept
TESTED = 1 << 20  # rows up to which the test for repeats looks at every value


def value_counts(long: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, c): rows per value, combined on the map side; null stands for missing and not finite values."""
    return long.select(*keys, finite_or_null().alias("value")).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))


def merge(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """The state of all rows behind several states, or of coarser ``keys`` (quarters to a baseline, say)."""
    every = reduce(DataFrame.unionByName, [s.select(*keys, "value", "c") for s in states])
    return every.groupBy(*keys, "value").agg(F.sum("c").alias("c"))


def counted(long: DataFrame, keys: list[str], repeats: float = REPEATS) -> tuple[DataFrame, str | None]:
    """(table, weight) for the statistics: written value counts where values repeat, else the rows as they are.

    The test hashes every row and estimates the distinct values among the hashes divisible by a number that grows with
    the table, so what passes the filter does not. It settles the form of the plan alone: either form takes every row.
    """
    n = long.count()
    step = max(1, n // TESTED)
    marks = long.select(F.xxhash64(*keys, "value").alias("mark_")).filter(F.pmod("mark_", F.lit(step)) == 0)
    d = step * marks.agg(F.approx_count_distinct("mark_")).first()[0]
    if n >= repeats * d:
        return written(value_counts(long, keys)), "c"
    return long, None
