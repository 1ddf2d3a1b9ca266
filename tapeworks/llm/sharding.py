"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table: a start and a step
taken from hashes of its name. Shards take turns; at each turn a shard claims its most preferred free
slot. A row belongs to the shard that owns slot ``hash(key) mod size``. All shards own the same number
of slots (one apart), and adding or removing one shard moves few keys beside its own.

The table has ``size`` entries whatever the data, so it is filled in a loop here and broadcast: placing
a row is one hash and one array-like lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
HASH_HEX = 15  # hexadecimal digits of MD5 that make a non-negative long


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:HASH_HEX], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: list[str], size: int = SLOTS, turns: dict[str, int] | None = None) -> list[int]:
    """Owner (index into ``shards``) of every slot. ``turns``: turns a shard takes per round (default 1)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not is_prime(size) or size <= len(shards):
        raise ValueError("size must be a prime above the number of shards")
    each = [(turns or {}).get(s, 1) for s in shards]
    if min(each) < 0 or not any(each):
        raise ValueError("turns must not be negative, and one must be positive")
    owner = [-1] * size
    place = [_number(f"offset:{s}") % size for s in shards]
    step = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    left = size
    while left:
        for i, n in enumerate(each):
            for _ in range(min(n, left)):
                while owner[place[i]] >= 0:
                    place[i] = (place[i] + step[i]) % size
                owner[place[i]] = i
                left -= 1
    return owner


def table(spark: SparkSession, owner: list[int]) -> DataFrame:
    """The lookup table as rows ``(slot, shard)``."""
    text = F.split(F.lit(",".join(map(str, owner))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(text)).select(
        F.col("pos").cast("long").alias("slot"), F.col("col").alias("shard"))


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key; null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_HEX), 16, 10).cast("long") % size


def place(docs: DataFrame, owner: list[int], key: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names are replaced.

    A null key has the slot of the empty text; equal keys (repeated rows) share a shard; an empty table
    gives no rows. Texts and other columns are carried unread.
    """
    rows = docs.drop("shard").withColumn("slot", slot_of(F.col(key), len(owner)))
    return rows.join(F.broadcast(table(docs.sparkSession, owner)), "slot", "left")


def write_shards(docs: DataFrame, owner: list[int], path: str, key: str = "doc_id", files: int = 1) -> None:
    """Write one folder per shard. ``files`` > 1 spreads each shard over as many writers."""
    placed = place(docs, owner, key)
    spread = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(files))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)
