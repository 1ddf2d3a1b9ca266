"""Quality rules: plain counts first, then a calibrated logistic regression on hashed n-grams.

Features are hashed word unigrams and bigrams and character trigrams (of the UTF-8 bytes, case kept), each family
as shares of its own total, so a text of any length is scored from all of it. The model is fitted on a bounded
sample of labelled rows, its margin is turned into a probability by Platt scaling on rows it was not fitted on, and
texts are scored in Arrow batches against fixed thresholds. The model is two tables of ``2**BITS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import hashed_share, with_package

# Fixed values of the contract.
MIN_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

KEEP_FROM = 0.1  # calibrated probability of good quality; only what is clearly bad goes
SAMPLE_ROWS = 2_000  # labelled rows that the model is fitted on, at most
HELD_OUT = 4  # one in so many of them calibrates
BITS = 16
ROUNDS = 80
RATE = 0.5
DECAY = 1e-5
SCALE = 20.0  # shares are small numbers
PART = 1 << 20  # bytes or words looked at together

_MIX32 = np.uint32(0x9E3779B1)
_MIX64 = np.uint64(0x9E3779B97F4A7C15)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), "<u8")


def _repeat_words(hashes: np.ndarray) -> int:
    """Words in windows of 8 that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    rolled = hashes[:n].copy()
    for j in range(1, WINDOW):
        rolled *= _MIX64
        rolled += hashes[j:j + n]
    _, at, times = np.unique(rolled, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[at] > 1)
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[hit] += 1
    np.subtract.at(cover, hit + WINDOW, 1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def counts(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words' hashes."""
    raw = _bytes(text)
    words = raw.split()
    hashes = _word_hashes(words)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(b"".join(words).decode("utf-8", "surrogatepass")), sum(raw.count(c) for c in SYMBOLS),
            len(lines) - len(set(lines)), _repeat_words(hashes), hashes)


def _trigrams(raw: bytes) -> Iterator[np.ndarray]:
    """Slots of the text's byte trigrams, part by part."""
    for lo in range(0, max(0, len(raw) - 2), PART):
        b = np.frombuffer(raw[lo:lo + PART + 2], np.uint8).astype(np.uint32)
        code = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
        yield (code * _MIX32) >> np.uint32(32 - BITS)


def _wordgrams(hashes: np.ndarray) -> np.ndarray:
    pairs = (hashes[:-1] * _MIX64 + hashes[1:]) * _MIX64
    return np.concatenate((hashes * _MIX64, pairs)) >> np.uint64(64 - BITS)


@dataclass
class Model:
    """Weights per slot of both families, and the line that turns a margin into log odds of good quality."""

    chars: np.ndarray
    words: np.ndarray
    bias: float
    slope: float
    level: float

    def margin(self, raw: bytes, hashes: np.ndarray) -> float:
        total = sum(float(self.chars[slots].sum(dtype=np.float64)) for slots in _trigrams(raw))
        out = self.bias + SCALE * total / max(1, len(raw) - 2)
        if len(hashes):
            slots = _wordgrams(hashes)
            out += SCALE * float(self.words[slots].sum(dtype=np.float64)) / len(slots)
        return out

    def probability(self, raw: bytes, hashes: np.ndarray) -> float:
        return float(_sigmoid(self.slope * self.margin(raw, hashes) + self.level))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _sparse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots (characters first, then words) and scaled shares."""
    size = 1 << BITS
    chars = sum((np.bincount(s, minlength=size) for s in _trigrams(raw)), np.zeros(size, np.int64))
    grams = np.bincount(_wordgrams(_word_hashes(raw.split())), minlength=size)
    both = np.concatenate((chars / max(1, chars.sum()), grams / max(1, grams.sum())))
    slots = np.flatnonzero(both)
    return slots.astype(np.int32), (SCALE * both[slots]).astype(np.float32)


def fit(texts: list[str | None], good: list[int]) -> Model:
    """Fit and calibrate. Without both classes every text is given probability 1."""
    size, y = 1 << BITS, np.array(good, np.float64)
    held = np.arange(len(y)) % HELD_OUT == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return Model(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, 40.0)
    parts = [_sparse(_bytes(t)) for t in texts]
    sizes = np.array([len(p[0]) for p in parts])
    row = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    slot, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    used = ~held[row]
    s, v, r = slot[used], value[used], row[used]
    share = y[~held].mean()
    weight = np.where(held, 0.0, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)))  # both classes count alike
    w, bias, seen = np.zeros(2 * size), 0.0, np.full(2 * size + 1, 1e-8)
    for _ in range(ROUNDS):  # full batches with a step per coordinate
        z = bias + np.bincount(r, v * w[s], len(y))
        error = weight * (_sigmoid(z) - y) / weight.sum()
        slope = np.append(np.bincount(s, v * error[r], 2 * size) + DECAY * w, error.sum())
        seen += slope * slope
        step = RATE * slope / np.sqrt(seen)
        w -= step[:-1]
        bias -= step[-1]
    margin = bias + np.bincount(row, value * w[slot], len(y))
    a, b = _platt(margin[held], y[held])
    return Model(w[:size].astype(np.float32), w[size:].astype(np.float32), float(bias), a, b)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the log odds by Newton steps, with targets pulled in by the class sizes."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, p = np.column_stack((z, np.ones(len(z)))), np.array([1.0, 0.0])
    for _ in range(50):
        q = _sigmoid(x @ p)
        curve = (x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (q - t))
        p -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the ``rows`` labelled documents (``labels``: doc_id, quality 0/1) whose hashed id is smallest.

    The sample is bounded, so one task fits the model and its two tables are all that returns.
    """
    share = hashed_share(F.col("doc_id"), 7, 2.0 * rows / max(1, labels.count()))
    wanted = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(share).groupBy("doc_id")
              .agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows))
    known = (with_package(docs).select("doc_id", "text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id")
             .agg(F.max("text").alias("text"), F.max("quality").alias("quality")))

    def task(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("doc_id")
        m = fit(ordered["text"].to_pylist(), ordered["quality"].to_pylist())
        return pa.table({"chars": pa.array([m.chars.tobytes()]), "words": pa.array([m.words.tobytes()]),
                         "rest": pa.array([[m.bias, m.slope, m.level]])})

    found = known.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(task, "chars binary, words binary, rest array<double>").collect()
    if not found:
        return fit([], [])
    return Model(np.frombuffer(found[0]["chars"], np.float32), np.frombuffer(found[0]["words"], np.float32), *found[0]["rest"])


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in _LONGS),
                     ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())])


def verdict(text: str | None, model: Model) -> tuple:
    *numbers, hashes = counts(text)
    failed = numbers[0] < MIN_WORDS or 100 * numbers[4] > REPEATED_PERCENT * numbers[0]
    probability = model.probability(_bytes(text), hashes)
    return *numbers, failed, not failed and probability >= KEEP_FROM, probability


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the five counts, ``base_failed``, ``kept`` and ``probability``, one row per row of ``docs``.

    Null and empty texts have no words and fail; repeated rows are judged alike; null ids are carried; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *verdict(t.as_py(), model)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    longs = ", ".join(f"{n} long" for n in _LONGS)
    return with_package(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id long, {longs}, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array([verdict(t.as_py(), model)[6] for t in text], pa.bool_())

    return with_package(docs).where(good("text"))
