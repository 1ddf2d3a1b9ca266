"""Best-fit-decreasing packing of tokenized documents into sequences of fixed capacity.

Best fit decreasing takes pieces from long to short and puts each into the open bin with the least room
that still holds it. Bins with equal room are alike, and lengths are whole numbers up to the capacity, so
the plan needs only the *number* of pieces per length (``capacity`` numbers, whatever the data): a segment
tree over the remaining capacities finds the tightest class of open bins in logarithmic time, and a run of
equal pieces is placed there at once. The plan is the exact global best-fit-decreasing result; Spark then
ranks the pieces within their length and every piece reads its bin off the plan.

Tokenizing, counting, ranking and placing are distributed; no group is gathered. The plan has at most
``steps`` entries, bounded by the square of the capacity and in practice a few thousand.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.llm.shared import stash, with_package

CAPACITY = 2_048
END = 0  # the id after every document
TOKENIZER = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json
LONG_BLANK = 10_000  # blanks in a row that the rank pattern is not trusted with
RANKED_TOGETHER = 100_000  # pieces of one length that one task orders


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Ids of a text by the vocabulary file ``path``.

    ``.json`` is read by ``tokenizers``. ``.tiktoken`` holds the ranks of a byte-level vocabulary with the usual
    pattern and gives the same ids several times faster. What ranks cannot do comes from the ``.json`` file beside
    them: the ids of added tokens that a text spells out, and parts with a run of ``LONG_BLANK`` blanks or more, on
    which the pattern's look-ahead would overflow the stack.
    """
    if not path.endswith(".tiktoken"):
        return _json_encoder(path)
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={}).encode_ordinary
    whole = path.removesuffix(".tiktoken") + ".json"
    if not os.path.exists(whole):
        return fast
    with open(whole, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    names = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    blanks = re.compile(r"\s{%d}" % LONG_BLANK)

    def encode(text: str) -> list[int]:
        ids: list[int] = []
        for part in names.split(text) if names else [text]:
            if part in added:
                ids.append(added[part])
            elif len(part) >= LONG_BLANK and blanks.search(part):
                ids += _json_encoder(whole)(part)
            else:
                ids += fast(part)
        return ids

    return encode


@lru_cache(maxsize=2)
def _json_encoder(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    return lambda text: made.encode(text, add_special_tokens=False).ids


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("spread", pa.int64())])


def _cut(path: str, capacity: int, keep_ids: bool):
    schema = PIECES.append(pa.field("ids", pa.binary())) if keep_ids else PIECES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(path), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = array("I", encode(text or ""))
                    ids.append(END)
                    n = len(ids)
                    if sys.byteorder == "big":
                        ids.byteswap()
                    ids = ids.tobytes()
                    pieces = -(-n // capacity)
                    start = 0
                    for k in range(pieces):
                        stop = n - capacity * (pieces - 1 - k)
                        own = ids[4 * start: 4 * stop]
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(own), seen, *([own] if keep_ids else [])))
                        start, seen = stop, seen + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, little-endian 32-bit) plus ``spread``, a number
    that deals pieces evenly whatever their ids. A null text counts as empty: one piece, the end id."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"
    return with_package(docs).select("doc_id", "text").mapInArrow(
        _cut(path, capacity, keep_ids), schema + (", ids binary" if keep_ids else ""))


class Rooms:
    """Segment tree over remaining capacities; a leaf counts the open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[deque] = [deque() for _ in range(capacity + 1)]

    def add(self, room: int, first: int, count: int) -> None:
        self.bins[room].append((first, count))
        self._change(room, count)

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.tree[node] += by
            node >>= 1

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of a class, as (first bin, count)."""
        first, count = self.bins[room].popleft()
        got = min(count, most)
        if got < count:
            self.bins[room].appendleft((first + got, count - got))
        self._change(room, -got)
        return first, got

    def tightest(self, need: int) -> int:
        """Least room of at least ``need`` that an open bin has; -1 if none has."""
        node = self.size + need
        if self.tree[node]:
            return need
        while node > 1:  # climb until a right sibling holds bins, then descend to its first leaf
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.tree[2 * node])
                return node - self.size
            node >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Steps ``(length, first rank, first bin, pieces per bin, first offset)`` sorted by length and rank, and the
    number of bins. Pieces of a length are interchangeable; their ranks count from 0."""
    rooms, steps, opened = Rooms(capacity), [], 0
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a capacity of {capacity}")
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            each = (room if room >= 0 else capacity) // length
            if room < 0:
                room, first, got = capacity, opened, -(-left // each)
                opened += got
            else:
                first, got = rooms.take(room, -(-left // each))
            placed = min(left, got * each)
            steps.append((length, rank, first, each, capacity - room))
            full, rest = divmod(placed, each)
            if full and room - each * length:
                rooms.add(room - each * length, first, full)
            if rest:
                rooms.add(room - rest * length, first + full, 1)
            rank, left = rank + placed, left - placed
    return np.array(sorted(steps), dtype=np.int64).reshape(-1, 5), opened


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``cut`` is a settled table of ``pieces``.

    Ties are pieces of one length; they are ranked in an order of their own columns. Repeated rows are
    packed as often as they come; an empty table gives no rows.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # <= capacity rows
    steps, _ = plan(counts, capacity)
    lanes = max(1, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    dealt = cut.withColumn("lane", F.pmod("spread", F.lit(lanes)))
    sizes = dealt.groupBy("length", "lane").count()
    before = sizes.select("length", "lane", (F.sum("count").over(
        Window.partitionBy("length").orderBy("lane")) - F.col("count")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "lane").orderBy(
        "spread", "doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("within", within).join(before, ["length", "lane"])

    @F.pandas_udf("sequence_id long, offset long")
    def seat(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        # steps are sorted by (length, rank): one search finds the step that holds the rank
        scale = np.int64(1) << 50
        at = np.searchsorted(steps[:, 0] * scale + steps[:, 1], length.to_numpy() * scale + rank.to_numpy(), "right") - 1
        own = steps[at]
        j = rank.to_numpy() - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + j // own[:, 3],
                             "offset": own[:, 4] + j % own[:, 3] * length.to_numpy()})

    seated = ranked.withColumn("seat", seat("length", F.col("before") + F.col("within") - 1))
    return seated.select(*[c for c in cut.columns if c != "spread"], "seat.sequence_id", "seat.offset")


def best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null texts count as empty (one end id); null ids are carried; repeated rows are packed each; long texts
    are encoded whole, then cut from the end so that only the first piece is shorter; other columns of
    ``docs`` are ignored.
    """
    return pack(stash(pieces(docs, tokenizer, capacity, keep_ids))[0], capacity)
