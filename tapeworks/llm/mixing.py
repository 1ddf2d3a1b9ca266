"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of ``N`` rows and target share ``t`` should repeat at rate ``t * N / n``. Each row
gets a uniform number from a hash of its id and the seed, and the inverse of the Poisson distribution
with that rate turns it into a number of copies; the row is exploded by it. Counts are a function of
(seed, id, rate): recomputed tasks agree, no state crosses rows, and a hot source is never gathered.
The copies are then dealt to all partitions and ordered there by a hash of (seed, id, copy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import free_names, stash

SEED = 20_260_101
RATE_PER_DRAW = 32.0  # larger means are drawn as sums of this many independent parts, so exp(-mean) stays exact
TERMS = 160  # the distribution function of a mean of 32 is 1.0 in doubles well before this


def uniform(seed: int, draw: Column, key: Column) -> Column:
    """52 bits of MD5 as a number in [0, 1)."""
    text = F.concat_ws(":", F.lit(str(seed)), draw.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def distribution(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... of a Poisson variable."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k.cast("double")
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"),
                        F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: dict | None = None, power: float = 0.5) -> DataFrame:
    """Rows ``(source, n, rate, draws, cdf)``.

    ``weights`` maps a source to its target weight; a source it does not name has weight 0. Without it
    a source with ``n`` rows weighs ``n ** power``. A null source is a source. The expected number of
    rows stays that of the input. Written to the shared folder: Spark broadcasts it if its files are
    small and joins it otherwise.
    """
    counts, _ = stash(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for source, w in sorted(weights.items(), key=lambda x: str(x[0])):
            weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    total = weighed.agg(F.sum("n").alias("n"), F.sum("weight").alias("w")).first()
    rate = F.col("weight") / F.lit(float(total["w"] or 1.0)) * F.lit(float(total["n"] or 0)) / F.col("n")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_PER_DRAW).cast("int"))
    return stash(weighed.withColumn("rate", rate).withColumn("draws", draws)
                 .withColumn("cdf", distribution(F.col("rate") / F.col("draws")))
                 .select("source", "n", "rate", "draws", "cdf"))[0]


def replicate(docs: DataFrame, rate_table: DataFrame, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Every row as often as its Poisson count, in globally shuffled order, with ``copy`` (from 1) and
    ``order_key``; columns of these names are replaced.

    Null ids hash as the empty text and null sources are a source of their own; repeated rows draw
    alike; rows of weight 0 draw no copy. Texts are carried unread, an empty table gives no rows.
    """
    plain = docs.drop("copy", "order_key")
    source, draws, cdf, u, n = free_names(plain, "_mix_source", "_mix_draws", "_mix_cdf", "_mix_u", "_mix_n")
    own = rate_table.select(F.col("source").alias(source), F.col("draws").alias(draws), F.col("cdf").alias(cdf))
    known = plain.join(own, plain["source"].eqNullSafe(own[source]))
    drawn = known.withColumn(u, F.transform(
        F.sequence(F.lit(0), F.col(draws) - 1), lambda d: uniform(seed, d, F.col(key))))
    count = F.aggregate(u, F.lit(0), lambda acc, x: acc + F.size(
        F.filter(F.col(cdf), lambda c: c <= x)))
    copied = (drawn.withColumn(n, count).where(F.col(n) > 0)
              .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n)))))
    text = F.concat_ws(":", F.lit(f"order:{seed}"), F.col("copy").cast("string"),
                       F.coalesce(F.col(key).cast("string"), F.lit("")))
    keyed = copied.withColumn("order_key", F.md5(text.cast("binary"))).select(*plain.columns, "copy", "order_key")
    return keyed.repartition("order_key").sortWithinPartitions("order_key")
