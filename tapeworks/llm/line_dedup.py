"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

``LineIndex`` keeps two tables:

* ``refs`` - exact: one row per (line key, document) with the number of such lines. The documents that hold
  a key, and the last of them, are counted from it.
* ``filters`` - one cuckoo filter per shard of the key space over the keys found in at least ``min_docs``
  documents. Unlike a Bloom filter it forgets: when documents are deleted and a key falls below the bound
  its fingerprint is taken out again, so the same lines come back as if those documents had never been seen.

To find the lines to drop, references meet the filter of their shard; only those that may be frequent reach
the exact join, which has the last word. A shard with many references is dealt out over several tasks, each
with a copy of its filter, so the copies grow with the references and not with their square. Keys that a
filter has no room for are kept in it as they are.

A line key is 128 bits of XXH3 of the folded line. A line found in a third of all documents is combined
before it is shuffled, and the join with the few frequent keys is one that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import WHITE, free_names, stash, with_package

MIN_CHARS = 20
MIN_DOCS = 3
NO_ID = -(1 << 63)  # rows without an id come before all others
NO_IDS = 1 << 31  # they are told apart by a hash of their text, for the joins; ids this close to NO_ID count as null
TOGETHER = 500_000  # references that meet one copy of a filter
KEYS_PER_SHARD = 1 << 15
SLOTS = 4
ROUNDS = 200
MAX_SHARDS = 1 << 24

_WHITE = WHITE.encode()
_REFS = "k1 long, k2 long, doc long, n long"


def line_key(line: bytes) -> bytes | None:
    """128-bit key of a line, None if its folded form is under 20 code points."""
    folded = line.strip(_WHITE).lower()  # bytes fold A-Z only
    if len(folded) < MIN_CHARS:
        return None
    if len(folded) < 4 * MIN_CHARS and not folded.isascii() and len(folded.decode("utf-8", "surrogatepass")) < MIN_CHARS:
        return None
    return xxhash.xxh3_128_digest(folded)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, docs, counts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own: dict[bytes, int] = {}
            for line in _encoded(text).split(b"\n"):
                key = line_key(line)
                if key is not None:
                    own[key] = own.get(key, 0) + 1
            keys += own
            counts += own.values()
            docs += [doc] * len(own)
        halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(docs, pa.int64()), pa.array(counts, pa.int64())],
            names=["k1", "k2", "doc", "n"])


def _doc() -> Column:
    """The id, or for rows without one a place among ``NO_IDS``, so that they are not one hot key."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_IDS)))


def _named(doc: str) -> Column:
    return F.col(doc) >= NO_ID + NO_IDS


def references(docs: DataFrame) -> DataFrame:
    """One row per (key, document). Repeated rows of an id are one document; rows without an id count as one
    too, but are kept apart by their text."""
    return (with_package(docs).select(_doc().alias("doc"), "text").mapInArrow(_references, _REFS)
            .groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n")))


class Cuckoo:
    """Buckets of four 16-bit fingerprints; a key may lie in either of two buckets. Works on arrays of keys."""

    def __init__(self, buckets: int, table: bytes | None = None, extra: list[int] | None = None):
        self.mask = np.uint64(buckets - 1)
        self.table = (np.zeros((buckets, SLOTS), "<u2") if table is None
                      else np.frombuffer(table, "<u2").reshape(buckets, SLOTS).copy())
        self.extra = list(extra or [])

    @staticmethod
    def buckets_for(keys: int) -> int:
        return 1 << max(4, int(keys / (SLOTS * 0.8)).bit_length())

    def _at(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mark = (k >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (k >> np.uint64(8)) & self.mask

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return place ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & self.mask)

    def insert(self, keys: np.ndarray) -> None:
        mark, place = self._at(keys)
        for turn in range(ROUNDS):
            if not len(mark):
                return
            order = np.argsort(place, kind="stable")
            mark, place = mark[order], place[order]
            first = np.concatenate(([True], place[1:] != place[:-1]))
            at = np.arange(len(place))
            nth = at - np.maximum.accumulate(np.where(first, at, 0))
            taken = self.table[place] != 0
            fits = nth < SLOTS - taken.sum(axis=1)
            slot = np.argsort(taken, axis=1, kind="stable")[fits, nth[fits]]
            self.table[place[fits], slot] = mark[fits]
            mark, place, first = mark[~fits], place[~fits], first[~fits]
            if turn and len(mark):  # push a resident out; it goes on to its other bucket
                kick = np.concatenate(([True], place[1:] != place[:-1]))
                lot = (turn + place[kick].astype(np.int64)) % SLOTS
                pushed = self.table[place[kick], lot].copy()
                self.table[place[kick], lot] = mark[kick]
                mark[kick] = pushed
            place = self._other(place, mark)
        # no room: what is left over is kept as (bucket, mark), which is all that a test compares
        self.extra += (np.minimum(place, self._other(place, mark)).astype(np.int64) << 16 | mark).tolist()

    def _spare(self, mark: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.minimum(place, self._other(place, mark)).astype(np.int64) << 16 | mark

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, place = self._at(keys)
        other = self._other(place, mark)
        found = (self.table[place] == mark[:, None]).any(axis=1) | (self.table[other] == mark[:, None]).any(axis=1)
        return found | np.isin(self._spare(mark, place), self.extra) if self.extra else found

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that are in."""
        mark, place = self._at(keys)
        other, spare = self._other(place, mark), self._spare(mark, place)
        for m, a, b, s in zip(mark, place, other, spare.tolist(), strict=True):
            for row in (a, b):
                slot = np.flatnonzero(self.table[row] == m)
                if len(slot):
                    self.table[row, slot[0]] = 0
                    break
            else:
                self.extra.remove(s)


_HOT = "k1 long, k2 long, docs long, last long"
_FILTERS = "shard int, buckets int, cells binary, extra array<long>"


def _change(key: tuple, held: pa.Table, changed: pa.Table) -> pa.Table:
    """One shard's filter after keys became (``up``) or ceased to be frequent."""
    up = changed["up"].to_numpy(zero_copy_only=False) if changed.num_rows else np.zeros(0, bool)
    keys = changed["k1"].to_numpy() if changed.num_rows else np.zeros(0, np.int64)
    if held.num_rows:
        row = held.slice(0, 1).to_pylist()[0]
        cuckoo = Cuckoo(row["buckets"], row["cells"], row["extra"])
    else:
        cuckoo = Cuckoo(Cuckoo.buckets_for(int(up.sum())))
    cuckoo.delete(keys[~up])
    cuckoo.insert(keys[up])
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()), "buckets": pa.array([len(cuckoo.table)], pa.int32()),
        "cells": pa.array([cuckoo.table.tobytes()], pa.binary()), "extra": pa.array([cuckoo.extra], pa.list_(pa.int64()))})


@dataclass
class LineIndex:
    """Reference counts and filters of the documents seen so far; every change gives a new index."""

    refs: DataFrame
    hot: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int = MIN_DOCS

    @classmethod
    def empty(cls, spark, min_docs: int = MIN_DOCS) -> LineIndex:
        tables = (spark.createDataFrame([], kind) for kind in (_REFS, _HOT, _FILTERS))
        return cls(*tables, 0, min_docs)

    def _moved_to(self, refs: DataFrame, fresh: bool = False) -> LineIndex:
        """The index over ``refs``: frequent keys counted anew, their changes carried over to the filters."""
        named, last = _named("doc"), F.max("doc")
        docs = F.count_if(named) + F.max((~named).cast("long"))
        hot, _ = stash(refs.groupBy("k1", "k2").agg(
            docs.alias("docs"), F.when(last < NO_ID + NO_IDS, F.lit(NO_ID)).otherwise(last).alias("last"))
            .where(F.col("docs") >= self.min_docs))
        now, then = hot.select("k1", "k2"), self.hot.select("k1", "k2")
        if fresh:  # nothing was there before: all frequent keys are new; so many need so many shards
            shards = min(MAX_SHARDS, 1 << max(4, (hot.count() // KEYS_PER_SHARD).bit_length()))
            moved = now.withColumn("up", F.lit(True))
        else:
            shards = self.shards
            moved = now.join(then, ["k1", "k2"], "left_anti").withColumn("up", F.lit(True)).unionByName(
                then.join(now, ["k1", "k2"], "left_anti").withColumn("up", F.lit(False)))
        moved = moved.withColumn("shard", F.pmod("k2", F.lit(shards)).cast("int"))
        filters = self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(_change, _FILTERS)
        return LineIndex(refs, hot, stash(filters)[0], shards, self.min_docs)

    def insert(self, docs: DataFrame, fresh: bool = False) -> LineIndex:
        """Add documents. An id that is known gains the lines of the new row. ``fresh``: the index is empty."""
        more = references(docs)
        fresh = fresh or not self.shards
        if not fresh:
            more = self.refs.unionByName(more).groupBy("k1", "k2", "doc").agg(F.sum("n").alias("n"))
        return self._moved_to(stash(more)[0], fresh)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Forget whole documents (column ``doc_id``; a null forgets the rows without an id)."""
        gone = ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")).distinct()
        known = F.when(_named("doc"), F.col("doc")).otherwise(F.lit(NO_ID))
        kept = self.refs.join(gone.withColumnRenamed("doc", "gone"), known == F.col("gone"), "left_anti")
        return self._moved_to(stash(kept.select("k1", "k2", "doc", "n"))[0])

    def drops(self) -> DataFrame:
        """References whose lines go: ``k1, k2, doc`` of every frequent key but in its last document."""
        refs = self.refs.withColumn("shard", F.pmod("k2", F.lit(max(1, self.shards))).cast("int"))
        many, _ = stash(refs.groupBy("shard").count().where(F.col("count") > TOGETHER).select(
            "shard", F.ceil(F.col("count") / F.lit(TOGETHER)).cast("int").alias("copies")))
        one = F.coalesce("copies", F.lit(1))
        filters = self.filters.join(many, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), one - 1)))
        dealt = refs.join(many, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("doc"), one).cast("int"))
        maybe = (filters.select("shard", "copy", "buckets", "cells", "extra").groupBy("shard", "copy")
                 .cogroup(dealt.select("shard", "copy", "k1", "k2", "doc").groupBy("shard", "copy"))
                 .applyInArrow(_probe, "k1 long, k2 long, doc long"))
        return maybe.join(self.hot, ["k1", "k2"]).where("doc < last").select("k1", "k2", "doc")


def _probe(held: pa.Table, refs: pa.Table) -> pa.Table:
    """References that the filter of their shard may hold; none where the shard has no filter."""
    refs = refs.select(["k1", "k2", "doc"])
    if not held.num_rows or not refs.num_rows:
        return refs.slice(0, 0)
    row = held.slice(0, 1).to_pylist()[0]
    cuckoo = Cuckoo(row["buckets"], row["cells"], row["extra"])
    return refs.filter(pa.array(cuckoo.contains(refs["k1"].to_numpy())))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last two columns are the keys whose lines go."""
    for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
        names = batch.schema.names
        texts, total, dropped = [], [], []
        columns = [batch.column(i).to_pylist() for i in (names.index("text"), len(names) - 2, len(names) - 1)]
        for text, k1, k2 in zip(*columns, strict=True):
            if not k1:
                texts.append(text)
                total.append((text or "").count("\n") + 1)
                dropped.append(0)
                continue
            gone = set(np.column_stack([np.array(k1, "<i8"), np.array(k2, "<i8")]).view("V16").ravel().tolist())
            lines = _encoded(text).split(b"\n")
            kept = [line for line in lines if line_key(line) not in gone]
            same = len(kept) == len(lines)
            texts.append(text if same else b"\n".join(kept).decode("utf-8", "surrogatepass"))
            total.append(len(lines))
            dropped.append(len(lines) - len(kept))
        rest = [(n, batch.column(n)) for n in names[:-2] if n != "text"]
        yield pa.RecordBatch.from_pydict(dict(rest) | {
            "text": pa.array(texts, pa.string()), "n_lines": pa.array(total, pa.int64()),
            "n_dropped": pa.array(dropped, pa.int64())})


def drop_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``, and ``n_lines`` (before) and ``n_dropped``; columns of
    these names are replaced. A text that loses nothing is passed on as it is, null included."""
    plain = with_package(docs).drop("n_lines", "n_dropped")
    doc, k1, k2 = free_names(plain, "_doc", "_k1", "_k2")
    per_doc = drops.groupBy(F.col("doc").alias(doc)).agg(F.collect_list("k1").alias(k1), F.collect_list("k2").alias(k2))
    told = plain.join(per_doc, _doc() == F.col(doc), "left").select(*plain.columns, k1, k2)
    rest = [f for f in plain.schema if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return told.mapInArrow(_rewrite, f"{schema}, text string, n_lines long, n_dropped long").select(
        *plain.columns, "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Index all of ``docs``, then drop every line whose key is in at least ``min_docs`` documents, except in the
    document with the largest id.

    Ties: all lines of a key within that last document stay. Repeated rows of an id are one document and are
    all rewritten; rows without an id are one document that comes before all others. A null or empty text is
    one empty line, which has no key. An empty table gives no rows.
    """
    index = LineIndex.empty(docs.sparkSession, min_docs=min_docs).insert(docs, fresh=True)
    return drop_lines(docs, index.drops())
