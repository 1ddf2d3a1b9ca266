"""Counts of reference values up to a value, from a block index over the ordered reference.

The reference values of a column are put in order once and cut into blocks of ``BLOCK`` values. The index, the first
value of every block, is a thousandth of the reference and is broadcast; it says which block a value falls into. The
exact count is then looked up inside that block. Probing rows are not ordered or shuffled together with the
reference: while the blocks are measured to be small they are broadcast too, else a row meets the one block it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators import ordering as O
from tapeworks.session import written

BLOCK = 1024
SMALL_BYTES = 32 << 20


def ordered_blocks(reference: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """(feature, block_, first_, values_, upto_): distinct values in order and, for each, the rows up to it.

    Nulls are left out. Written; a block starts anew every ``block`` rows, so one value that fills the table is one
    entry, and no block holds more than ``block`` values.
    """
    long = O.melt(reference.select(*cols), [], cols).filter("value IS NOT NULL").withColumn("n_", F.lit(1))
    spread = bool(O.needs_spread(long, ["feature"]))
    order = O.running_weight(long, ["feature"], "value", ["n_"], spread=spread, max_groups=len(cols))
    entry = F.struct("value", (F.col("n__before") + F.col("n_")).alias("upto"))
    packed = order.groupBy("feature", F.floor(F.col("n__before") / block).alias("at_")).agg(
        F.array_sort(F.collect_list(entry)).alias("e_"))
    return written(packed.select(
        "feature", F.col("at_").alias("block_"), F.col("e_.value")[0].alias("first_"), F.col("e_.value").alias("values_"),
        F.col("e_.upto").alias("upto_")))


def at_most(sorted_values: Column, value: Column, longest: int) -> Column:
    """How many of the values are <= ``value``; binary search over at most ``longest`` ones."""
    steps = F.array(*[F.lit(1 << i) for i in range(max(1, longest).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.try_element_at(sorted_values, at + step) <= value, at + step).otherwise(at))


def with_counts(rows: DataFrame, reference: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """Add ``<col>_upto_`` (reference rows <= the row's value, null for a null) and ``<col>_n_`` (reference rows)."""
    blocks = ordered_blocks(reference, cols, block)
    index = blocks.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("first_", "block_"))).alias("i_"), F.max(F.element_at("upto_", -1)).alias("n_"))
    index = written(index)
    most = index.agg(F.max(F.size("i_"))).first()[0] or 1
    whole = index.groupBy().agg(*[a for c in cols for a in (
        F.max(F.when(F.col("feature") == c, F.col("i_.first_"))).alias(f"{c}_firsts_"),
        F.max(F.when(F.col("feature") == c, F.col("i_.block_"))).alias(f"{c}_blocks_"),
        F.coalesce(F.max(F.when(F.col("feature") == c, F.col("n_"))), F.lit(0)).alias(f"{c}_n_"))])
    out = rows.withColumn("one_", F.lit(1)).join(O.checked_broadcast(whole.withColumn("one_", F.lit(1))), "one_").drop("one_")
    size = blocks.agg(F.sum(F.size("values_") * 16)).first()[0] or 0
    for c in cols:
        place = F.get(f"{c}_blocks_", at_most(F.col(f"{c}_firsts_"), F.col(c), most) - 1)
        own = blocks.filter(F.col("feature") == c).select(
            F.col("block_").alias(f"{c}_block_"), F.col("values_").alias(f"{c}_values_"), F.col("upto_").alias(f"{c}_in_"))
        own = F.broadcast(own) if size <= SMALL_BYTES else own
        out = out.withColumn(f"{c}_block_", F.when(F.col(c).isNotNull(), place)).join(own, f"{c}_block_", "left")
        inside = F.get(f"{c}_in_", at_most(F.col(f"{c}_values_"), F.col(c), block) - 1)
        out = out.withColumn(f"{c}_upto_", F.when(F.col(c).isNotNull(), F.coalesce(inside, F.lit(0)))).drop(
            f"{c}_block_", f"{c}_values_", f"{c}_in_", f"{c}_firsts_", f"{c}_blocks_")
    return out
