"""Helpers shared by the corpus operators: tables in the shared folder, text column expressions,
connected components."""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.session import checkpoint_dir

# Fixed values of the contracts: the white space that separates words, and the letters that are folded.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def with_package(docs: DataFrame) -> DataFrame:
    """``docs``, once the Python workers can import this package.

    They can where it is installed, on ``PYTHONPATH`` or in the working folder. Elsewhere (a session started from
    another folder) it is sent along as a Python file, once per Spark context.
    """
    root, context = Path(__file__).resolve().parents[2], docs.sparkSession.sparkContext
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages()]
    if str(root) not in [os.path.realpath(p) for p in known] and context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        made = os.path.join(tempfile.mkdtemp(prefix="tapeworks-"), "tapeworks.zip")
        with zipfile.ZipFile(made, "w") as out:
            for path in sorted(root.glob("tapeworks/**/*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(made)
    return docs


_SENT: set[str] = set()


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet below the cluster's shared checkpoint folder; the table and its path.

    Unlike a checkpoint the copy is columnar: later readers prune columns, and its file size is what
    Spark's own broadcast decision sees. A lost executor re-reads it.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete stashed tables that no later plan reads."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, each lengthened until ``df`` has no column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without_white(text: Column) -> Column:
    """The text without any of ``WHITE``; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def hashed_share(key: Column, seed: int, share: float) -> Column:
    """True for about ``share`` of the keys, always the same ones. Thins rows out before a bounded sample is
    ordered, so that what the tasks hand on for it does not grow with their number."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def components(edges: DataFrame, rounds: int = 60) -> tuple[DataFrame, str]:
    """Smallest reachable node per node of an undirected graph: rows ``(node, root)``.

    ``edges`` holds longs ``a``, ``b``; loops and repeated edges are harmless, an edge with a null end
    is left out. A node without an edge gets no row. Two alternating steps, each a map-side combined
    minimum and a join that Spark may split when a node is hot: every node tells its larger neighbours
    about its smallest one (large step), then its smaller neighbours and itself (small step). Ends when
    a pair of steps leaves the edges as they were; then the edges are stars around the smallest nodes.
    """
    spark = edges.sparkSession
    current, path = stash(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
    for _ in range(rounds):
        both = current.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(
            current.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("low"))
        large = (both.where("w > u").join(least, "u")
                 .where("w <> low").select(F.col("w").alias("v"), F.col("low").alias("m")).distinct())
        down = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(down, "v").select(
            F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"),
            F.col("low").alias("m")).where("v <> m").distinct()
        after, to = stash(small)
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        release(spark, path)
        current, path, same, mark = after, to, now == mark, now
        if same:
            break
    else:
        raise RuntimeError(f"components: still changing after {rounds} rounds")
    roots = current.select(F.col("m").alias("node")).distinct()
    return (current.select(F.col("v").alias("node"), F.col("m").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root")))), path
