"""Language identification by word-first backoff.

A known word scores by the logarithm of its frequency in each language. A word that was not learned is looked up by
its character n-grams: the longest length of which any n-gram was learned scores it, else the next shorter one. A
text's language is the one with the largest sum.

Nothing that was learned is left out. Counts of all words and all their n-grams stay in tables of the shared folder:

1. The most frequent words - at most ``LOCAL_WORDS`` and ``LOCAL_CELLS`` numbers, each of at most ``LOCAL_BYTES``
   bytes, whatever the corpus - travel to the tasks, which score them while they read the texts.
2. Every other word leaves the task with its document and count. The distinct ones among them are joined with the
   table of learned words, and those that are not in it, one n-gram length after the other, with the n-grams.
3. A sum per document adds both parts.

Scores are whole millionths of a logarithm, so which words travel and the order of the sums change no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import release, stash, with_package

LOCAL_WORDS = 200_000
LOCAL_CELLS = 1 << 20  # words times languages
LOCAL_BYTES = 64
LONGEST = 4
UNKNOWN = "und"
FLOOR = 0.5  # count of a word or n-gram in a language in which it was not seen
UNIT = 1_000_000
FLUSH_WORDS = 300_000  # distinct words a task counts before it hands them on
LETTERS = re.compile(r"[^\W\d_]+")
HELD_OUT = (4, 2)  # crc32 of the id modulo the first is the second
_COUNTS = "lang string, token string, n long"


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % HELD_OUT[0] == HELD_OUT[1]


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word, from two letters on with a mark at both ends."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _counted(batches: Iterator[pa.RecordBatch], add) -> Iterator[pa.RecordBatch]:
    """Run ``add(counts, row columns)`` over the batches and emit (lang, token, n) whenever there are many."""
    seen: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, c in seen.items():
            tokens, n = list(c.keys()), list(c.values())
            for lo in range(0, len(tokens), 50_000):
                yield pa.RecordBatch.from_pydict({
                    "lang": [lang] * len(tokens[lo:lo + 50_000]), "token": tokens[lo:lo + 50_000],
                    "n": pa.array(n[lo:lo + 50_000], pa.int64())})
        seen.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                add(seen.setdefault(row[0], Counter()), *row[1:])
            if sum(map(len, seen.values())) > FLUSH_WORDS:
                yield from flush()
    yield from flush()


def _count_words(batches):
    return _counted(batches, lambda c, text: c.update(LETTERS.findall(text.lower())))


def _count_grams(batches):
    def add(c: Counter, word: str, n: int) -> None:
        for size in range(1, LONGEST + 1):
            for g in grams(word, size):
                c[g] += n

    return _counted(batches, add)


@dataclass
class Model:
    """Counts in the shared folder, and what of them fits every task.

    ``words``, ``grams``: rows ``token, seen`` with an array of (language's place, score above that of an unseen
    one) per token. ``base[size]``: score of an unseen token per language, size 0 for words, else the n-gram length.
    ``local``: row of each travelling word in ``table``, which has a column per language.
    """

    languages: list[str]
    words: DataFrame
    grams: DataFrame
    base: np.ndarray
    local: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    paths: tuple[str, ...] = ()

    def release(self) -> None:
        """Delete the counts once no ``identify`` is to follow; its results do not read them."""
        release(self.words.sparkSession, *self.paths)


def _score(share: np.ndarray) -> np.ndarray:
    return np.floor(UNIT * np.log(share) + 0.5).astype(np.int64)


def _seen(counts: DataFrame, languages: list[str]) -> DataFrame:
    """One row per token; its array holds one entry per language at most."""
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1 if languages else F.lit(0)
    above = F.floor(UNIT * F.log(F.col("n") / F.lit(FLOOR)) + 0.5)
    return counts.groupBy("token").agg(
        F.sum("n").alias("n"),
        F.collect_list(F.struct(place.cast("int").alias("k"), above.cast("long").alias("above"))).alias("seen"))


def _local(words: DataFrame, languages: list[str], base: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """The words at or above a power of two that leaves no more than the bounds allow, with their whole scores."""
    room = min(LOCAL_WORDS, LOCAL_CELLS // max(1, len(languages)))
    short = words.where(F.octet_length("token") <= LOCAL_BYTES)
    power = F.floor(F.log2("n")).cast("int")
    least, total = None, 0
    for r in sorted(short.groupBy(power.alias("p")).count().collect(), reverse=True):  # at most 64 rows
        total += r["count"]
        if total > room:
            break
        least = r["p"]
    local: dict[str, int] = {}
    if least is None:
        return local, np.zeros((0, len(languages)))
    held = short.where(power >= least).select("token", "seen").toArrow().combine_chunks()
    local = {t: i for i, t in enumerate(held["token"].to_pylist())}
    table = np.repeat(base[:1], len(local), axis=0)
    seen = held["seen"].combine_chunks()
    row = np.repeat(np.arange(len(local)), pa.compute.list_value_length(seen).to_numpy())
    flat = seen.flatten()
    np.add.at(table, (row, flat.field("k").to_numpy()), flat.field("above").to_numpy())
    return local, table.astype(float)  # whole numbers, exact in float64


def learn(docs: DataFrame) -> Model:
    """Count words and n-grams of all rows of ``docs`` (``lang``, ``text``; nulls teach nothing).

    The driver sees one row per language and n-gram length and the words that travel.
    """
    rows = with_package(docs).where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    words, words_path = stash(rows.mapInArrow(_count_words, _COUNTS).groupBy("lang", "token").agg(F.sum("n").alias("n")))
    pieces, pieces_path = stash(words.mapInArrow(_count_grams, _COUNTS).groupBy("lang", "token").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    by_word, by_word_path = stash(_seen(words, languages))
    by_gram, by_gram_path = stash(_seen(pieces, languages).withColumn("size", F.length("token")))

    share = np.ones((LONGEST + 1, len(languages)))
    share[0] = [FLOOR / totals[x] for x in languages]
    distinct = {r["size"]: r["count"] for r in by_gram.groupBy("size").count().collect()}
    for r in pieces.groupBy("lang", F.length("token").alias("size")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("own")).collect():
        whole = r["n"] + FLOOR * (distinct[r["size"]] - r["own"])  # shares among n-grams of the same length
        share[r["size"], languages.index(r["lang"])] = FLOOR / whole
    for size, count in distinct.items():  # a language without any n-gram of this length has the floor for each
        share[size][share[size] == 1] = 1 / count
    base = _score(share)
    release(docs.sparkSession, words_path, pieces_path)
    return Model(languages, by_word, by_gram, base, *_local(by_word, languages, base), (by_word_path, by_gram_path))


_READ = "doc_id long, held_out boolean, letters boolean, sums array<long>, tail array<struct<token:string,n:long>>"


def _read(local: dict[str, int], table: np.ndarray):
    """Per document the sums over travelling words, and its other words."""
    none = np.zeros(table.shape[1], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            letters, sums, tokens, counts, ends = [], [], [], [], [0]
            for text in batch.column(2).to_pylist():
                found = Counter(LETTERS.findall((text or "").lower()))
                letters.append(any(c.isalpha() for w in found for c in w))
                at = [(local[w], n) for w, n in found.items() if w in local]
                if len(at) < len(found):
                    own = [(w, n) for w, n in found.items() if w not in local]
                    tokens += [w for w, _ in own]
                    counts += [n for _, n in own]
                ends.append(len(tokens))
                if at:
                    rows, weights = np.array(at).T
                    sums.append((weights.astype(float) @ table[rows]).astype(np.int64))
                else:
                    sums.append(none)
            tail = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], ["token", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(letters), pa.array(sums, pa.list_(pa.int64())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tail)],
                names=["doc_id", "held_out", "letters", "sums", "tail"])

    return run


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 2_000) for b in batches for lo in range(0, b.num_rows, 2_000)):
            rows = [(i, g, m) for i, word in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for g, m in Counter(grams(word, size)).items()]
            for lo in range(0, len(rows), 100_000):
                who, token, m = zip(*rows[lo:lo + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(who, pa.int64()), pa.array(token, pa.string()), pa.array(m, pa.int64())],
                    names=["word", "token", "m"])

    return run


def _word_scores(tail: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """``token, seen`` for the distinct words of ``tail``: scores above those of an unseen one and, under -1 - size,
    a 1 that stands for the score of an unseen one. Words without any learned n-gram have no row."""
    spark = tail.sparkSession
    one = lambda size: F.array(F.struct(F.lit(-1 - size).alias("k"), F.lit(1).cast("long").alias("above")))
    asked, asked_path = stash(tail.select("token").distinct().join(model.words.select("token", "seen"), "token", "left"))
    known = [asked.where("seen IS NOT NULL").select("token", F.concat("seen", one(0)).alias("seen"))]
    left, path = stash(asked.where("seen IS NULL").select(F.monotonically_increasing_id().alias("word"), "token"))
    paths = [asked_path, path]
    for size in range(LONGEST, 0, -1):
        if left.isEmpty():
            break
        learned = model.grams.where(F.col("size") == size).select("token", "seen")
        hits = left.mapInArrow(_pieces(size), "word long, token string, m long").join(learned, "token")
        each = hits.select("word", "m", F.explode(F.concat("seen", one(size))).alias("s"))
        sums = each.groupBy("word", "s.k").agg(F.sum(F.col("m") * F.col("s.above")).alias("above"))
        per_word = sums.groupBy("word").agg(F.collect_list(F.struct("k", "above")).alias("sums"))  # one entry a language
        weight = F.element_at(F.filter("sums", lambda s: s["k"] < 0), 1)["above"]
        mean = F.transform("sums", lambda s: F.struct(s["k"].alias("k"), F.floor(s["above"] / F.col("weight")).alias("above")))
        found, path = stash(per_word.withColumn("weight", weight).select("word", mean.alias("seen")).join(left, "word")
                            .select("token", "seen"))
        paths.append(path)
        known.append(found)
        left, path = stash(left.join(found, "token", "left_anti").select("word", "token"))
        paths.append(path)
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    final, path = stash(out)
    release(spark, *paths)
    return final, [path]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, one row per row of ``docs``, from ``text`` alone.

    ``und`` with score 0 for null texts and texts without a letter; of equal sums the language that comes first
    wins; null ids count as the empty text for ``held_out``. Other columns are ignored. An empty table gives no
    rows, an empty model ``und``.
    """
    plain = with_package(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    read, _ = stash(plain.mapInArrow(_read(model.local, model.table), _READ).withColumn("row", F.monotonically_increasing_id()))
    if not model.languages:
        return read.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    tail = read.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.n")
    scores, _ = _word_scores(tail, model)
    each = tail.join(scores, "token").select("row", "n", F.explode("seen").alias("s"))
    sums = each.groupBy("row", "s.k").agg(F.sum(F.col("n") * F.col("s.above")).alias("sum"))
    extra = sums.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("k", "sum"))).alias("extra"))

    some = lambda k: F.coalesce(F.try_element_at("extra", k), F.lit(0).cast("long"))
    bases = [F.array(*[F.lit(int(x)) for x in row]) for row in model.base]

    def total(own: Column, i: Column) -> Column:
        for size, base in enumerate(bases):
            own = own + some(F.lit(-1 - size)) * base[i]
        return own + some(i)

    whole = read.drop("tail").join(extra, "row", "left").select("doc_id", "held_out", "letters", F.transform("sums", total).alias("sums"))
    top = F.array_max("sums")
    mass = F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp((x - F.array_max("sums")) / F.lit(float(UNIT))))
    best = F.array(*[F.lit(x) for x in model.languages])[(F.array_position("sums", top) - 1).cast("int")]
    return whole.select("doc_id", "held_out", F.when(F.col("letters"), best).otherwise(UNKNOWN).alias("lang_pred"),
                        F.when(F.col("letters"), 1 / mass).otherwise(0.0).alias("score"))
