"""Substring dedup on the de Bruijn graph of word k-mers.

Every window of ``k`` words is an edge of the graph (between its first and its last ``k - 1`` words), with the
documents in which it starts. An edge that also starts in an earlier document is repeated there; runs of
consecutive repeated edges of a document are nonbranching paths and compact to one span of words each.

1. Each task hashes the edges of its documents (64 bits of a polynomial over XXH3 word hashes), combines equal
   edges - only the first document of a batch goes out per edge, later ones are already known to be repeats -
   and packs what is left by shard of the hash space: sorted differences and document ids in byte planes,
   under 8 bytes an edge. So an edge that a third of all documents share goes out once per batch.
2. Each shard sorts its edges and finds the first document of each. What starts earlier elsewhere comes back
   per document.
3. A join by document brings repeated edges to the text. They are located there again by hash, which gives
   their word coordinates; consecutive edges compact to paths, and the covered words are removed.

The number of shards follows the size of the texts, so a shard fits a task at any scale. Edges are compared by
their 64-bit hash: among N windows about N^2 / 2^65 pairs agree by chance (0.0003 for the 0.5 GB check).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import with_package

K = 13
NO_IDS = 1 << 31  # rows without an id are told apart by a hash of their text, for the joins
NO_ID = (1 << 63) - NO_IDS  # they come after all others; ids from here on count as null
BATCH_EDGES = 1_500_000
BYTES_PER_SHARD = 10 << 20
_STEP = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def edge_hashes(words: list[bytes], k: int = K) -> np.ndarray:
    """64-bit hash of every window of ``k`` words."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    each = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")
    out = each[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_STEP)
        out += each[j:j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def pack(hashes: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted hashes with their documents, compressed."""
    low = docs.min()
    gaps = np.diff(hashes, prepend=np.uint64(0))
    raw = np.int64(low).tobytes() + _planes(gaps) + _planes(docs.view(np.uint64) - low.astype(np.uint64))
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    half = (len(raw) - 8) // 2
    low = np.frombuffer(raw[:8], np.uint64)[0]
    return np.cumsum(_unplanes(raw[8:8 + half]), dtype=np.uint64), (_unplanes(raw[8 + half:]) + low).view(np.int64)


_EDGES = "shard int, repeat boolean, edges binary"


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _first_in_run(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts; the hashes and documents in that order, and the first document of each one's run."""
    order = np.argsort(hashes)
    hashes, docs = hashes[order], docs[order]
    start = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    lows = np.minimum.reduceat(docs, start)
    return hashes, docs, np.repeat(lows, np.diff(start, append=len(hashes)))


def _edges(shards: int, k: int):
    def flush(parts: list, owners: list) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(parts)
        docs = np.repeat(np.array(owners, np.int64), [len(p) for p in parts])
        hashes, docs, low = _first_in_run(hashes, docs)
        late = (docs > low) & (low < NO_ID)
        late_ones = hashes[late], docs[late]
        fresh = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        docs = np.where(fresh & (low < NO_ID), low, docs)  # rows without an id do not repeat each other: all go out
        first = fresh & (low < NO_ID) | (low >= NO_ID)
        rows = []
        for repeat, h, d in ((False, hashes[first], docs[first]), (True, *late_ones)):
            names, at = np.unique(_shard_of(h, shards), return_index=True)
            rows += [(int(s), repeat, pack(a, b)) for s, a, b in
                     zip(names, np.split(h, at[1:]), np.split(d, at[1:]), strict=True)] if len(h) else []
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows[lo:lo + 64], strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)],
                names=["shard", "repeat", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, owners, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                own = edge_hashes(words_of(text.as_py()), k)
                if len(own):
                    parts.append(np.unique(own))
                    owners.append(doc.as_py())
                    size += len(own)
                if size >= BATCH_EDGES:
                    yield from flush(parts, owners)
                    parts, owners, size = [], [], 0
        if parts:
            yield from flush(parts, owners)

    return run


def _repeats(group: pa.Table) -> pa.Table:
    """One shard: every (document, edge) whose edge starts in an earlier document too."""
    known = [unpack(b.as_py()) for b, r in zip(group["edges"], group["repeat"], strict=True) if not r.as_py()]
    found = [unpack(b.as_py()) for b, r in zip(group["edges"], group["repeat"], strict=True) if r.as_py()]
    if known:
        hashes, docs, low = _first_in_run(*(np.concatenate(x) for x in zip(*known, strict=True)))
        late = (docs > low) & (low < NO_ID)
        found.append((hashes[late], docs[late]))
    hashes, docs = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"doc": docs, "edge": hashes.view(np.int64)})


def _doc() -> Column:
    """The id, or for rows without one a place among ``NO_IDS``, so that they are not one hot key."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(NO_IDS)))


def repeated_edges(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc`` and ``edge`` (hash), a row for every distinct repeated edge of a document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // BYTES_PER_SHARD))
    return (with_package(docs).select(_doc().alias("doc"), "text").mapInArrow(_edges(shards, k), _EDGES)
            .groupBy("shard").applyInArrow(_repeats, "doc long, edge long"))


def paths(words: list[bytes], edges: np.ndarray, k: int = K) -> np.ndarray:
    """Spans of words (start, end exclusive) that the repeated edges of a document compact to."""
    hit = np.isin(edge_hashes(words, k), edges)
    turn = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.column_stack((np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + k - 1))


def _remove(k: int, digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, edges in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, spans = words_of(text.as_py()), []
                kept = words
                if edges.is_valid:
                    spans = paths(words, edges.values.to_numpy().view(np.uint64), k)
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, spans[:, 0], 1)
                    np.add.at(gone, spans[:, 1], -1)
                    stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                    kept = [words[i] for i in stay.tolist()]
                    spans = spans.tolist()
                body = b" ".join(kept)
                body = hashlib.sha256(body).hexdigest() if digest_only else body.decode("utf-8", "surrogatepass")
                rows.append((doc_id.as_py(), len(words), len(words) - len(kept), spans, body))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.string()),
                strict=True)], names=["doc_id", "n_words", "n_removed", "spans", "body"])

    return run


def remove_repeats(docs: DataFrame, k: int = K, digest_only: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` (or ``kept_sha256``), one row per row of ``docs``.

    Removes each word covered by a ``k``-word window whose word sequence also starts in a document with a smaller
    id; ``spans`` are the compacted repeated paths in word positions of the input. Repeated rows of an id do not
    repeat each other; rows without an id come after all others. Null, empty and short texts lose nothing. Other
    columns are ignored; an empty table gives no rows.
    """
    found = repeated_edges(docs, k).groupBy("doc").agg(F.collect_list("edge").alias("edges"))
    told = docs.select("doc_id", "text").join(found, _doc() == F.col("doc"), "left")
    out = told.select("doc_id", "text", "edges").mapInArrow(
        _remove(k, digest_only), "doc_id long, n_words long, n_removed long, spans array<array<int>>, body string")
    return out.withColumnRenamed("body", "kept_sha256" if digest_only else "kept")
