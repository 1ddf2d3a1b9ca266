"""Vector code compression: every vector becomes one codebook index per part.

Components become integers ``floor(256 * x)``; a vector is cut into ``PARTS`` consecutive parts, and each part has a
codebook of ``ENTRIES`` entries that is refined for ``ROUNDS`` rounds.

The distinct parts are counted once over all rows, dealt out by range and written in lexicographic order, so that
every task holds a slice of a trie whose levels are the components. A round is one pass over that table without any
shuffle of its rows: a depth-first walk (``nearest``) carries the vector of distances to all entries that has
accumulated along the path, so a common prefix is added up once for everything below it; the leaves take the
nearest entry and add their component sums, weighted by their count. What comes back per round is one sum a
component of the codebooks, whatever the number of rows. The last assignment walks the trie of each Arrow batch's
distinct parts, so that vectors are never exploded and joined back.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. Components are held
within +-2^27 so that errors stay longs. A vector whose length differs from that of the smallest id gets a null code
and a null error and takes part in nothing else; a length that the parts do not divide gives parts that differ by
one component (empty ones have distance 0). Null ids come last, equal ids in the order of their components; repeated
rows each get their row and each count. Fewer than ``ENTRIES`` vectors give a codebook of that many entries; an
empty table gives no row. Columns other than the three named ones are not read, so their names cannot clash.

The copies written to the shared folder are read by the returned frame; they stay until that folder's owner
clears it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.llm.shared import release, stash, with_package

# Fixed values of the contract.
PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256

LARGEST = 1 << 27  # of a component's absolute value
LEAVES = 4096  # below a node with at most so many leaves the walk goes level by level
CELLS = 1 << 20  # components of an Arrow batch that are looked at together


def integers(vector: Column) -> Column:
    """``floor(SCALE * x)`` per component, held within ``LARGEST``."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(
        F.lit(LARGEST), F.floor(F.lit(float(SCALE)) * x.cast("double")))).cast("int"))


def usable(vector: Column) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def bounds(width: int, parts: int) -> list[tuple[int, int]]:
    """First and end component of each part."""
    return [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]


def _levels(pieces: np.ndarray, entries: np.ndarray, depth: int, base: np.ndarray) -> np.ndarray:
    """Distances of sorted pieces to all entries, from ``base``, the distances up to ``depth``; one row a prefix."""
    n = len(pieces)
    at, rows = np.zeros(n, np.int64), base[None, :]
    new = np.zeros(n, bool)
    new[:1] = True
    for d in range(depth, pieces.shape[1]):
        new[1:] |= pieces[1:, d] != pieces[:-1, d]
        first = np.flatnonzero(new)
        step = pieces[first, d][:, None] - entries[None, :, d]
        rows = rows[at[first]] + step * step
        at = np.cumsum(new) - 1
    return rows[at]


def nearest(pieces: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equally near ones) and its squared distance for every piece.

    ``pieces`` are rows in lexicographic order. Depth first: a node with more than ``LEAVES`` rows hands each child
    its own distances plus those of one more component; smaller subtrees are walked level by level at once.
    """
    n, width = pieces.shape
    index, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    todo = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while todo:
        lo, hi, depth, base = todo.pop()
        if hi - lo <= LEAVES or depth >= width - 1:
            for at in range(lo, hi, LEAVES):
                end = min(at + LEAVES, hi)
                found = _levels(pieces[at:end], entries, depth, base)
                index[at:end] = found.argmin(axis=1)
                distance[at:end] = found.min(axis=1)
            continue
        cuts = [lo, *(lo + 1 + np.flatnonzero(pieces[lo + 1:hi, depth] != pieces[lo:hi - 1, depth])), hi]
        for a, b in reversed(list(zip(cuts, cuts[1:], strict=False))):
            step = pieces[a, depth] - entries[:, depth]
            todo.append((a, b, depth + 1, base + step * step))
    return index, distance


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The listed rows of a list column, all of one width."""
    offsets = np.asarray(column.offsets)
    values = np.asarray(column.values).astype(np.int64, copy=False)
    return values[offsets[rows].astype(np.int64)[:, None] + np.arange(width)]


def _sorted(pieces: np.ndarray) -> np.ndarray:
    """Lexicographic order of the rows; almost free where they come sorted."""
    if not pieces.shape[1]:
        return np.arange(len(pieces))
    return np.lexsort(pieces.T[::-1])


def distinct_parts(whole: DataFrame, width: int, parts: int = PARTS) -> tuple[DataFrame, str]:
    """(part, piece, n) for every distinct part, written in lexicographic order, slice by slice, and its path.

    ``whole`` has ``ints``, all of length ``width``. Equal parts are combined before they are shuffled, so a vector
    that a third of the rows share moves as one row a task.
    """
    cut = F.explode(F.array(*[
        F.struct(F.lit(p).alias("part"), F.slice("ints", a + 1, b - a).alias("piece"))
        for p, (a, b) in enumerate(bounds(width, parts))]))
    counted = whole.select(cut.alias("at")).groupBy("at.part", "at.piece").agg(F.count(F.lit(1)).alias("n"))
    return stash(counted.repartitionByRange("part", "piece").sortWithinPartitions("part", "piece"))


def _totals(books: list[np.ndarray]):
    """A round over a slice of the trie: component sums and row count (``at`` -1) of each entry that was nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(b) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            part = np.asarray(batch.column(0))
            column, weight = batch.column(1), np.asarray(batch.column(2)).astype(np.int64)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                pieces = _matrix(column, rows, books[p].shape[1])
                order = _sorted(pieces)
                pieces, n = pieces[order], weight[rows][order]
                index, _ = nearest(pieces, books[p])
                np.add.at(sums[p], index, pieces * n[:, None])
                np.add.at(counts[p], index, n)
        out = [(p, e, at, total)
               for p, (s, c) in enumerate(zip(sums, counts, strict=True)) for e in np.flatnonzero(c)
               for at, total in enumerate([int(c[e]), *map(int, s[e])], -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()),
             pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int64())],
            names=["part", "entry", "at", "total"])

    return run


def refine(trie: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: entries become the floored mean of their parts; unused ones stay."""
    found = with_package(trie).mapInArrow(_totals(books), "part int, entry int, at int, total long")
    sums = [np.zeros_like(b) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for r in found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect():  # one row a component
        if r.at < 0:
            counts[r.part][r.entry] = r.total
        else:
            sums[r.part][r.entry, r.at] = r.total
    return [np.where(c[:, None] > 0, s // np.maximum(c, 1)[:, None], b)
            for b, s, c in zip(books, sums, counts, strict=True)]


def _encode(books: list[np.ndarray], width: int, schema: T.StructType):
    cuts = np.cumsum([0, *(b.shape[1] for b in books)])

    def codes(matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
        index = np.empty((len(matrix), len(books)), np.uint8)
        error = np.zeros(len(matrix), np.int64)
        for p, book in enumerate(books):
            order = _sorted(piece := matrix[:, cuts[p]:cuts[p + 1]])
            near, distance = nearest(piece[order], book)
            index[order, p] = near
            error[order] += distance
        text = index.tobytes().hex()
        step = 2 * len(books)
        return [text[i:i + step] for i in range(0, len(text), step)], error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, CELLS // max(1, width))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                column = batch.column(2)
                size = np.diff(np.asarray(column.offsets))
                fit = np.flatnonzero(size == width)
                code: list[str | None] = [None] * batch.num_rows
                error: list[int | None] = [None] * batch.num_rows
                if len(fit):
                    for i, c, e in zip(fit, *codes(_matrix(column, fit, width)), strict=True):
                        code[i], error[i] = c, int(e)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                    names=schema.names)

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def fit(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one array of entries a part, from (id_, ints). Empty list: no vectors."""
    first = whole.orderBy(F.col("id_").asc_nulls_last(), F.col("ints"))
    start = [r.ints for r in first.select("ints").limit(entries).collect()]
    if not start:
        return []
    width = len(start[0])
    fits = whole.where(F.size("ints") == width)
    if any(len(x) != width for x in start):
        start = [r.ints for r in first.where(F.size("ints") == width).select("ints").limit(entries).collect()]
    matrix = np.array(start, np.int64).reshape(len(start), width)
    books = [matrix[:, a:b] for a, b in bounds(width, parts)]
    trie, path = distinct_parts(fits, width, parts)
    for _ in range(rounds):
        books = refine(trie, books)
    release(whole.sparkSession, path)
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) per usable vector, and the codebooks. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256")
    whole = vectors.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("id_"), F.col(label_col).alias("label_"), integers(F.col(vector_col)).alias("ints"))
    books = fit(whole, parts, entries, rounds)
    schema = T.StructType([whole.schema["id_"], whole.schema["label_"],
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    width = sum(b.shape[1] for b in books)
    coded = with_package(whole).mapInArrow(_encode(books, width, schema), schema)
    return coded.withColumnsRenamed({"id_": id_col, "label_": label_col}), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels, nulls together.

    The totals are combined before they are shuffled and written; their measured size decides whether they are
    broadcast, so a label that a third of the rows share needs no shuffle of its rows. Nulls count as zero.
    """
    rows, _ = stash(coded)
    totals, _ = stash(rows.groupBy(F.col(label_col).alias("label_")).agg(
        F.coalesce(F.sum("error"), F.lit(0)).alias("label_error")))
    return rows.join(totals, rows[label_col].eqNullSafe(totals["label_"]), "left").drop("label_")
