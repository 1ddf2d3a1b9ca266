"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a common variant half way between them. So every fingerprint
emits its variants within half the radius, variants are shuffled, and fingerprints that meet at a variant
are linked after their distance is checked. For a radius of 3 half is 1 on one side and 2 on the other:
fingerprints at an odd distance differ in the parity of their bits, so those of even parity emit up to two
flips and those of odd parity one, and every pair within 3 bits still meets.

Three things keep this linear:

* Fingerprints are made distinct first; copies of a text take part once.
* The shuffle key is the leading part of a variant (its low bits). Variants of one fingerprint with the
  same key travel as one row (key, fingerprint); the task that receives the row flips the other bits.
* At a variant, all that came with at most one flip are within 2 bits of each other, and all that came with
  two are within 3 of any of those. Linking each to the first is enough: a group of thousands makes
  thousands of links, not their square. Each task then hands on a spanning forest of what it linked.

Spark's own joins find the connected components of the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import components, free_names, release, stash, with_package

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
AT_ONCE = 1 << 21  # variants that a task holds at a time
HOME_FINGERPRINTS = 1 << 11  # wanted per shuffle key


def fingerprint(text: str | None) -> int:
    """Fingerprint of a text: bit set where over half of its shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[SHINGLE_WORDS - 1:].tolist() or [len(joined)]
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for lo in range(0, len(ends), 1 << 16):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in
                           zip(starts[lo:lo + (1 << 16)], ends[lo:lo + (1 << 16)])])
        votes += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(ends)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), *batch.columns[2:]],
                                         names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """``doc_id, fp`` with the fingerprint's 64 bits as a long, and the ``carried`` columns of longs. Null and
    wordless texts have 0."""
    kind = "".join(f", {c} long" for c in carried)
    return with_package(docs).select("doc_id", "text", *carried).mapInArrow(_fingerprints, f"doc_id long, fp long{kind}")


class Forest:
    """Connected components over positions 0 .. n-1, joined in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _settle(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            self._settle()


def _flips(base: np.ndarray, who: np.ndarray, free: list[int], flips: int) -> tuple[np.ndarray, np.ndarray]:
    masks = np.array([sum(1 << i for i in c) for c in combinations(free, flips)], np.uint64)
    return (base[:, None] ^ masks).ravel(), np.repeat(who, len(masks))


def meet(fps: np.ndarray, used: np.ndarray, key_bits: int, forest: Forest, who: np.ndarray) -> None:
    """Link the fingerprints that meet at a variant with the given low ``key_bits`` bits.

    ``fps``: fingerprints with those bits already set to the key, ``used``: how many flips that took,
    ``who``: positions in the forest. Splits by the next bit when there are many.
    """
    free = list(range(key_bits, 64))
    near = used <= 1
    if free and near.sum() > 1 and (used == 0).sum() * (len(free) + 1) > AT_ONCE:
        bit = np.uint64(1 << key_bits)
        reach = forest.even[who] + 1
        for side in (np.uint64(0), bit):
            turned = (fps & bit) != side
            keep = used + turned <= reach
            meet(np.where(turned, fps ^ bit, fps)[keep], (used + turned)[keep], key_bits + 1, forest, who[keep])
        return
    inner = [(fps[near], who[near]), _flips(fps[used == 0], who[used == 0], free, 1)]
    variant, owner = np.concatenate([x[0] for x in inner]), np.concatenate([x[1] for x in inner])
    order = np.argsort(variant, kind="stable")
    variant, owner = variant[order], owner[order]
    if not len(variant):
        return
    start = np.concatenate(([True], variant[1:] != variant[:-1]))
    first = owner[np.maximum.accumulate(np.where(start, np.arange(len(variant)), 0))]
    forest.link(owner[~start], first[~start])
    points, hosts = variant[start], owner[start]

    marks = np.zeros(1 << max(10, int(len(points)).bit_length() + 4), bool)  # rules out nearly all that meet nobody
    shift = np.uint64(64 - (len(marks).bit_length() - 1))
    spot = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> shift
    marks[spot(points)] = True
    even = forest.even[who] == 1
    for flips in (0, 1, 2):
        own = np.flatnonzero(even & (used == 2 - flips))
        step = max(1, AT_ONCE // max(1, len(free) ** flips))
        for lo in range(0, len(own), step):
            part = own[lo:lo + step]
            v, o = _flips(fps[part], who[part], free, flips)
            hit = marks[spot(v)]
            v, o = v[hit], o[hit]
            at = np.minimum(np.searchsorted(points, v), len(points) - 1)
            met = points[at] == v
            forest.link(o[met], hosts[at[met]])


class Linked(Forest):
    """A forest of fingerprints that checks each link's distance."""

    def __init__(self, fps: np.ndarray):
        super().__init__(len(fps))
        self.fps = fps
        self.even = (np.bitwise_count(fps) % 2 == 0).astype(np.int64)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        close = np.bitwise_count(self.fps[a] ^ self.fps[b]) <= RADIUS
        self.join(a[close], b[close])


def _link_bucket(key_bits: int):
    low = np.uint64((1 << key_bits) - 1)

    def run(group: pa.Table) -> pa.Table:
        fps = group["fp"].to_numpy().view(np.uint64)
        key = np.uint64(group["key"][0].as_py())
        forest = Linked(fps)
        used = np.bitwise_count((fps ^ key) & low).astype(np.int64)
        meet((fps & ~low) | key, used, key_bits, forest, np.arange(len(fps)))
        moved = np.flatnonzero(forest.root != np.arange(len(fps)))
        return pa.table({"a": fps[moved].view(np.int64), "b": fps[forest.root[moved]].view(np.int64)})

    return run


def links(distinct: DataFrame, n: int) -> DataFrame:
    """Edges ``a, b`` between fingerprints (column ``fp``, distinct, ``n`` of them) whose connected components
    are those of all pairs within the radius. ``n`` only sets how finely variants are dealt out."""
    bits = min(24, max(4, (max(1, n) // HOME_FINGERPRINTS).bit_length()))
    low = (1 << bits) - 1
    one = [1 << i for i in range(bits)]
    two = [a | b for a, b in combinations(one, 2)]
    near, far = (F.array(*[F.lit(m) for m in masks]) for masks in ([0, *one], [0, *one, *two]))
    masks = F.when(F.bit_count("fp") % 2 == 0, far).otherwise(near)
    dealt = with_package(distinct).select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask").cast("long")).bitwiseAND(F.lit(low).cast("long")).alias("key"))
    return dealt.groupBy("key").applyInArrow(_link_bucket(bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints that differ in at most 3 bits. Rows
    with a null id get the component of their text; a component without any id has a null one. Null and
    empty texts have fingerprint zero and are linked like any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows, _ = stash(fingerprints(docs))
    ids, ids_path = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots, roots_path = components(links(ids.select("fp"), ids.count()))
    held = roots.join(ids, roots["node"] == ids["fp"])
    low = held.groupBy("root").agg(F.min("first_id").alias("low"))
    moved = roots.join(low, "root").select(F.col("node").alias("fp"), "low")
    final, _ = stash(ids.join(moved, "fp", "left").select("fp", F.coalesce("low", "first_id").alias("component_id")))
    release(spark, ids_path, roots_path)
    return rows.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, rows without an id last. Of rows
    with that id the smallest hash of the text decides; of rows with the same id and text one stays. Columns of
    any name pass through."""
    spark = docs.sparkSession
    row = free_names(docs, "_no_id", "_id", "_key_a", "_key_b")  # orders the rows of a component, and finds the chosen one again
    keyed = docs.withColumns(dict(zip(row, (
        F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)).cast("long"),
        F.xxhash64("text"), F.xxhash64(F.lit(1), "text")), strict=True)))
    rows, rows_path = stash(fingerprints(keyed, *row))
    firsts, firsts_path = stash(rows.groupBy("fp").agg(F.min(F.struct(*row)).alias("first")))
    roots, roots_path = components(links(firsts.select("fp"), firsts.count()))
    held = firsts.join(roots, firsts["fp"] == roots["node"], "left")
    best = held.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    stay, _ = stash(best.select("first.*"))
    release(spark, rows_path, firsts_path, roots_path)
    return keyed.join(stay, row, "left_semi").dropDuplicates(row).select(*docs.columns)
