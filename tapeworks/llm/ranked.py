"""Ranked lexical search: the ``TOP`` highest-scoring documents of each item, exactly, by a dual-tree search.

Documents are read once: each becomes a sparse row of the item terms it holds, written to the shared folder, from
which the corpus statistics (all documents) and the search are computed. Items travel in blocks of bounded size
(``CELLS``), each a pass of its own, so any number of items works.

In a task, the documents of a slice form a hierarchy (leaves of ``DOC_LEAF``, nodes of ``FAN``) and so do the items
of the block (leaves of ``ITEM_LEAF``). A node holds the coordinate maximum of what lies below it: the largest
impact a term has in any of its documents, the largest weight it has in any of its items. The dot product of two
nodes bounds every score between them; where it is below the weakest k-th score among the node's items, the whole
batch of pairs is left out, otherwise both sides split. A search of about ``SEED_ROWS`` documents comes first: its
k-th scores hold for the whole corpus from below, so every task prunes from its first slice on. Nothing is cut: equal
bounds are kept, and pairs that reach the leaves are scored in integers.

Defined results: null and term-free texts of items give no row, term-free documents are not counted; a null doc_id
comes after the others of its score, repeated doc_ids are documents of their own; items with equal id and text are
answered once, items with one id and several texts each get their own ranks. Only the id and text columns are read, so
other columns cannot clash. Ids of documents are integers. Empty tables give no row.

The copies in the shared folder are read by the returned frame; they stay until that folder's owner clears it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.shared import hashed_share, stash, with_package

# Fixed values of the contract.
TOP = 10
LENGTH_PERCENT = 75

CELLS = 4_000_000  # items x terms of a block, and half of it document leaves x terms of a slice
DOC_LEAF = 8
FAN = 4
ITEM_LEAF = 4
GROUPS = 8  # item nodes that documents are ordered by
SEED_ROWS = 20_000
PART = 1 << 20  # bytes of a text that are split into words together

# A byte of a term stays (letters lower-cased), any other becomes a blank. UTF-8 bytes from 0x80 belong to terms.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``PART`` bytes."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    start = 0
    while start < len(data):
        end = data.find(b" ", start + PART)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


@dataclass
class Block:
    """Items that are searched together: their ids, their vocabulary, and term counts as sparse rows."""

    ids: list = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    rows: list[dict[int, int]] = field(default_factory=list)

    def add(self, item_id, counts: dict[bytes, int]) -> None:
        self.ids.append(item_id)
        self.rows.append({self.vocabulary.setdefault(t, len(self.vocabulary)): c for t, c in counts.items()})

    def full(self, counts: dict[bytes, int]) -> bool:
        """Whether one more item would exceed the bound of a block."""
        size = len(self.vocabulary) + sum(t not in self.vocabulary for t in counts)
        return bool(self.ids) and (len(self.ids) + 1) * size > CELLS


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The items with at least one term, in blocks; the driver holds one block at a time."""
    block = Block()
    for item_id, text in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct().toLocalIterator():
        counts: dict[bytes, int] = {}
        for words in terms(text):
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        if not counts:
            continue
        if block.full(counts):
            yield block
            block = Block()
        block.add(item_id, counts)
    if block.ids:
        yield block


def _sparse(vocabulary: dict[bytes, int]):
    """Documents with a term: id, number of terms, and the item terms they hold with their counts."""
    unknown = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = vocabulary.get
        for batch in batches:
            kept, sizes, held, times = [], [], [], []
            for row, text in enumerate(batch.column(1)):
                n, counts = 0, None
                for words in terms(text.as_py()):
                    n += len(words)
                    found = np.bincount(np.fromiter((look(w, unknown) for w in words), np.int64, len(words)),
                                        minlength=unknown + 1)[:unknown]
                    counts = found if counts is None else counts + found
                if n:
                    own = np.flatnonzero(counts).astype(np.int32)
                    kept.append(row)
                    sizes.append(n)
                    held.append(own)
                    times.append(counts[own])
            ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *held]).astype(np.int32)
            tf = np.concatenate([np.empty(0, np.int64), *times]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(tf))], names=["doc_id", "n", "terms", "tf"])

    return run


def _statistics(size: int):
    """Documents per term of a task's rows; at term -1 the number of documents, at -2 their number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 2, np.int64)
        for batch in batches:
            df[:size] += np.bincount(np.asarray(batch.column(1).flatten()), minlength=size)
            df[-1] += batch.num_rows
            df[-2] += int(np.asarray(batch.column(0)).sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.where(at < size, at, at - size - 2), pa.int64()), pa.array(df[at])], names=["term", "df"])

    return run


class ItemTree:
    """Items by halves that share terms; ``peaks`` holds a node's coordinate maxima, ``below`` its items."""

    def __init__(self, block: Block, weight: np.ndarray):
        self.rows = np.zeros((len(block.rows), len(weight)), np.int64)
        for i, row in enumerate(block.rows):
            at = np.fromiter(row, np.int64, len(row))
            self.rows[i, at] = weight[at] * np.fromiter(row.values(), np.int64, len(row))
        self.below: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.held: list[np.ndarray] = []
        self.peaks: list[np.ndarray] = []
        unit = self.rows / np.maximum(1e-9, np.sqrt((self.rows.astype(float) ** 2).sum(1)))[:, None]
        self._grow(np.arange(len(self.rows)), unit)

    def _grow(self, items: np.ndarray, unit: np.ndarray) -> None:
        todo = [(items, -1)]
        while todo:
            own, parent = todo.pop()
            node = len(self.below)
            peak = self.rows[own].max(axis=0)
            held = np.flatnonzero(peak)
            self.below.append(own)
            self.children.append([])
            self.held.append(held)
            self.peaks.append(peak[held].astype(float))
            if parent >= 0:
                self.children[parent].append(node)
            if len(own) <= ITEM_LEAF:
                continue
            far = unit[own] @ unit[own[0]]
            one, other = own[far.argmin()], own[far.argmax()]
            side = unit[own] @ (unit[one] - unit[other])
            order = np.argsort(side, kind="stable")
            cut = int((side < 0).sum())
            if not ITEM_LEAF // 2 <= cut <= len(own) - ITEM_LEAF // 2:
                cut = len(own) // 2
            todo += [(own[order[:cut]], node), (own[order[cut:]], node)]

    def groups(self) -> list[int]:
        """Up to ``GROUPS`` nodes that together hold all items."""
        front = [0]
        while len(front) < GROUPS:
            wide = max(front, key=lambda x: len(self.below[x]) if self.children[x] else 0)
            if not self.children[wide]:
                break
            front = [x for x in front if x != wide] + self.children[wide]
        return front


class DocTree:
    """The documents of a slice, those that suit the same items next to each other; coordinate maxima by level."""

    def __init__(self, items: ItemTree, starts: np.ndarray, held: np.ndarray, impact: np.ndarray):
        n, width = len(starts) - 1, items.rows.shape[1]
        row = np.repeat(np.arange(n), np.diff(starts))
        affinity = np.empty((n, len(front := items.groups())))
        for g, node in enumerate(front):
            peak = np.zeros(width)
            peak[items.held[node]] = items.peaks[node]
            affinity[:, g] = np.bincount(row, peak[held] * impact, n)
        group = affinity.argmax(axis=1)
        self.order = np.lexsort((affinity[np.arange(n), group], group))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.starts, self.held, self.impact = starts, held, impact
        leaves = -(-n // DOC_LEAF)
        level = np.zeros((leaves, width))
        np.maximum.at(level, (place[row] // DOC_LEAF, held), impact)
        self.levels = [level]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def leaf_docs(self, leaves: np.ndarray) -> np.ndarray:
        at = (leaves[:, None] * DOC_LEAF + np.arange(DOC_LEAF)).ravel()
        return self.order[at[at < len(self.order)]]

    def scores(self, items: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Exact scores, one row an item."""
        size = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[docs] - (ends - size), size)
        out = np.zeros((len(items), len(docs)), np.int64)
        full = size > 0
        if full.any():
            out[:, full] = np.add.reduceat(items[:, self.held[at]] * self.impact[at], (ends - size)[full], axis=1)
        return out


class Best:
    """The ``top`` best documents per item so far, and the score that a further one has to reach."""

    def __init__(self, floor: np.ndarray, top: int):
        self.floor, self.top = floor.copy(), top
        self.rows = np.empty((0, 4), np.int64)  # item, score, null id, id

    def add(self, item: np.ndarray, score: np.ndarray, no_id: np.ndarray, doc_id: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([item, score, no_id, doc_id], axis=1)])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]] if len(rows) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        nth = np.arange(len(rows)) - begin
        last = nth == self.top - 1
        self.floor[rows[last, 0]] = np.maximum(self.floor[rows[last, 0]], rows[last, 1])
        self.rows = rows[nth < self.top]


def pairs(items: ItemTree, docs: DocTree, floor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, documents) whose bound reaches the floor of one of these items; every other pair is below it."""
    todo = [(0, len(docs.levels) - 1, np.arange(1))]
    while todo:
        node, level, nodes = todo.pop()
        bound = docs.levels[level][np.ix_(nodes, items.held[node])] @ items.peaks[node]
        weakest = floor[items.below[node]].min()
        nodes = nodes[bound * (1 + 1e-9) + 0.5 >= weakest]  # rounding of large sums never prunes
        if not len(nodes):
            continue
        deeper = items.children[node] or [node]
        if level:
            wide = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            wide = wide[wide < len(docs.levels[level - 1])]
            todo += [(child, level - 1, wide) for child in deeper]
        elif items.children[node]:
            todo += [(child, 0, nodes) for child in deeper]
        else:
            yield items.below[node], docs.leaf_docs(nodes)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Of every (document, term): how often the document has the term, against the document's own length."""
    if len(n) and int(n.max()) * LENGTH_PERCENT * documents >= 1 << 63:
        share = np.array([LENGTH_PERCENT * int(x) * documents // length for x in n], np.int64)
    else:
        share = LENGTH_PERCENT * n * documents // max(1, length)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - LENGTH_PERCENT + share))


def _search(block: Block, weight: np.ndarray, documents: int, length: int, floor: np.ndarray, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = ItemTree(block, weight), Best(floor, top)
        step = DOC_LEAF * max(1, CELLS // 2 // max(1, len(weight)))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                offsets = np.asarray(batch.column(2).offsets).astype(np.int64)
                held = np.asarray(batch.column(2).flatten()).astype(np.int64)
                n = np.asarray(batch.column(1))
                tf = np.asarray(batch.column(3).flatten())
                impact = impacts(tf, np.repeat(n, np.diff(offsets)), documents, length)
                tree = DocTree(items, offsets - offsets[0], held, impact)
                ids = batch.column(0)
                no_id = np.asarray(ids.is_null()).astype(np.int64)
                doc_id = np.asarray(ids.cast(pa.int64()).fill_null(0))
                for own, docs in pairs(items, tree, best.floor):
                    score = tree.scores(items.rows[own], docs)
                    i, d = np.nonzero(score >= best.floor[own][:, None])
                    best.add(own[i], score[i, d], no_id[docs[d]], doc_id[docs[d]])
        rows = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[:, 0], pa.int64()), pa.array(rows[:, 3], pa.int64(), mask=rows[:, 2] > 0),
             pa.array(rows[:, 1], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _top(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _ranked(docs: DataFrame, block: Block, item_type: T.DataType, top: int) -> DataFrame:
    spark, size = docs.sparkSession, len(block.vocabulary)
    rows, _ = stash(with_package(docs).mapInArrow(
        _sparse(block.vocabulary), "doc_id long, n long, terms array<int>, tf array<long>"))
    counted = rows.select("n", "terms").mapInArrow(_statistics(size), "term long, df long")
    stats = {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row a term
    documents, length = stats.pop(-1, 0), stats.pop(-2, 0)
    weight = np.zeros(size, np.int64)
    for term, df in stats.items():
        weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def search(part: DataFrame, floor: np.ndarray) -> DataFrame:
        return part.mapInArrow(_search(block, weight, documents, length, floor, top),
                               "item long, doc_id long, score long")

    share = min(1 / 8, SEED_ROWS / max(1, documents))
    seeds = _top(search(rows.where(hashed_share(F.struct("doc_id", "n"), 12, share)), np.ones(len(block.ids), np.int64)), top)
    floor = np.ones(len(block.ids), np.int64)
    for r in seeds.where(F.col("rank") == top).select("item", "score").collect():  # a row an item of the block
        floor[r.item] = r.score
    names = spark.createDataFrame(list(enumerate(block.ids)), T.StructType([
        T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
    return _top(search(rows, floor), top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): per item its ``top`` documents with a score above 0, ties by ascending id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(items, item_col, item_text_col):
        part = _ranked(docs, block, items.schema[item_col].dataType, top)
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = T.StructType([T.StructField("item_id", items.schema[item_col].dataType),
                             T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()),
                             T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], none)
    return out
