"""Exact dedup by deterministic block naming.

The normalised text of a document is cut into blocks of fixed size. Distinct blocks are sorted and
numbered; the number is the block's name. Then adjacent names are paired, distinct pairs sorted and
numbered in turn, and so on until one name is left: documents with equal (levels, name) have equal
texts and others do not. Names are never hashes:

* Level 0 groups blocks by a 64-bit digest but keeps the *set* of contents per digest (one, unless
  digests collide), combined on the map side, so each distinct content crosses the network about
  once. Each content gets its own name. Rows look their name up by digest; only a digest that holds
  several contents is looked up by content as well.
* Higher levels group the pair of names itself.

A hot block or text is combined before every shuffle, and the joins that bring names back are plain
equi-joins that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.shared import release, stash, without_white

BLOCK_BYTES = 8_192
LAST = (1 << 63) - 1  # stands for a null id: it comes after all others


def _blocks(docs: DataFrame, size: int, digest, *keep: str) -> DataFrame:
    whole = docs.withColumn("bytes", F.col("norm").cast("binary")).withColumn(
        "n", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / size).cast("int")))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                      lambda i: F.substring(F.col("bytes"), i * size + 1, F.lit(size)))
    return whole.select(*keep, "n", F.posexplode(cut).alias("pos", "block")).withColumn("digest", digest(F.col("block")))


def _named(distinct: DataFrame, *order: str) -> tuple[DataFrame, str]:
    """Number the sorted rows of each partition; written once, so that the numbers are settled."""
    return stash(distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id()))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=F.xxhash64) -> tuple[DataFrame, list[str]]:
    """One row per row of ``docs``: ``row, doc_id, n_chars, sha, level, name``; and the stashed paths.

    ``docs`` has ``doc_id`` and ``text``. ``row`` tells repeated ids apart.
    """
    spark = docs.sparkSession
    norm = docs.select("doc_id", "text").withColumn("norm", without_white(F.col("text")))
    sets = _blocks(norm, block_bytes, digest).groupBy("digest").agg(F.collect_set("block").alias("contents"))
    each = sets.select("digest", F.size("contents").alias("alike"),
                       F.explode(F.array_sort("contents")).alias("content"))
    names, names_path = _named(
        each.withColumn("content", F.when(F.col("alike") > 1, F.col("content"))), "digest", "content")

    rows = norm.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                       F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
                       F.sha2("norm", 256).alias("sha"), "norm")
    cells = _blocks(rows, block_bytes, digest, "row", "doc_id", "n_chars", "sha")
    # a table of its own, so that its true size (nothing, unless digests collide) decides how it is joined
    shared, shared_path = stash(names.where("alike > 1").select("digest", F.lit(True).alias("shared")).distinct())
    cells = cells.join(shared, "digest", "left").withColumn("block", F.when(F.col("shared"), F.col("block")))
    same = (cells["digest"] == names["digest"]) & cells["block"].eqNullSafe(names["content"])
    level0, level0_path = stash(cells.join(names, same).select(
        "row", "doc_id", "n_chars", "sha", "n", "pos", "name"))
    release(spark, names_path, shared_path)

    done = level0.where("n = 1").select("row", "doc_id", "n_chars", "sha", F.lit(0).alias("level"), "name")
    most = level0.agg(F.max("n")).first()[0] or 1
    heads = level0.where("n > 1 AND pos = 0").select("row", "doc_id", "n_chars", "sha")
    current, paths, level, ends = level0.where("n > 1").select("row", "n", "pos", "name"), [level0_path], 0, []
    while most > 1:
        level, most = level + 1, -(-most // 2)
        left, right = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = current.groupBy("row", F.ceil(F.col("n") / 2).cast("int").alias("n"),
                                F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(left).alias("l"), F.coalesce(F.max(right), F.lit(-1)).alias("r"))
        names, names_path = _named(pairs.select("l", "r").distinct(), "l", "r")
        named, path = stash(pairs.join(names, ["l", "r"]).select("row", "n", "pos", "name"))
        release(spark, names_path)
        paths.append(path)
        ends.append(named.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
        current = named.where("n > 1")
    for end in ends:
        done = done.unionByName(heads.join(end, "row"))
    return done, paths


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest: Column = F.xxhash64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when they are equal without white space. The longest original stays (code points),
    then the smallest id; a null id comes last, and of fully equal rows (repeated ids) one stays. A null
    text counts as empty and all empty texts are one group. Further columns of ``docs`` are ignored; an
    empty table gives no rows.
    """
    done, _ = identities(docs, block_bytes, digest)
    rank = F.struct((-F.col("n_chars")).alias("longest"), F.coalesce("doc_id", F.lit(LAST)).alias("id"),
                    F.col("row"), F.col("doc_id"))
    best, _ = stash(done.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best")))
    return done.join(best, ["level", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))
