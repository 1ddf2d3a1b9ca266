"""The best k of every group found from counts, and verdict states kept apart by model."""

import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import monitoring as N
from tapeworks.operators import selection as SE


def groups(seed=2):
    rng = random.Random(seed)
    rows = [("hot", f"t{i:05d}", rng.choice([rng.random(), 0.5, 0.5])) for i in range(6000)]     # two thirds tie
    rows += [("same", f"t{i:03d}", 1.0) for i in range(300)]
    rows += [("few", "a", 1.0), ("few", "b", None)] + [("nulls", f"n{i}", None if i % 3 else float(i)) for i in range(30)]
    rows += [("twice", "x", 2.0)] * 5 + [("twice", "y", 2.0)] * 5 + [(None, f"z{i}", float(i)) for i in range(9)] + [("unwanted", "u", 1.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bound", [None, 10])
def test_mark_best(spark, bound):
    rows = groups()
    wanted = {"hot": 2500, "same": 17, "few": 5, "nulls": 14, "twice": 7, None: 4, "absent": 3}
    df = spark.createDataFrame(rows, "k string, id string, v double").repartition(6)
    k = spark.createDataFrame(list(wanted.items()), "k string, k_ int")
    out = SE.mark_best(df, ["k"], "v", "id", k, "best", max_groups=bound)
    assert out.columns == ["k", "id", "v", "best"]
    got = sorted(((r.k, r.id, r.v) for r in out.collect() if r.best), key=str)
    want = []
    for key, n in wanted.items():
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want += own[:n]
    assert got == sorted(want, key=str)
    assert out.count() == len(rows)


@pytest.mark.parametrize("largest", [True, False])
def test_kth_value(spark, largest):
    rows = [r for r in groups() if r[2] is not None]
    df = spark.createDataFrame(rows, "k string, id string, v double")
    k = spark.createDataFrame([("hot", 1), ("same", 300), ("few", 2), ("twice", 10), (None, 5)], "k string, k_ int")
    got = {r.k: (r.cut_, r.beyond_) for r in SE.kth_value(df, ["k"], "v", k, largest=largest).collect()}
    for key, n in (("hot", 1), ("same", 300), ("twice", 10), (None, 5)):
        own = sorted((r[2] for r in rows if r[0] == key), reverse=largest)
        assert got[key] == (own[n - 1], own.index(own[n - 1]))
    assert "few" not in got


def test_states_of_two_models(spark):
    rows = spark.createDataFrame([(m, q) for m in "ab" for q in (1, 2, 3)], "model_version string, q int")
    events = spark.createDataFrame([("a", 1, 1, "a1"), ("b", 2, 1, "b2"), ("a", 3, 1, "a3"), ("a", 3, 0, "older")],
                                   "model_version string, q int, at int, s string").select(
        "model_version", "q", "at", F.struct("s").alias("state"))
    got = {(r.model_version, r.q): r.s for r in N.as_of(rows, events, "q", "at", "state", ("model_version",)).collect()}
    assert got == {("a", 1): "a1", ("a", 2): "a1", ("a", 3): "a3", ("b", 1): None, ("b", 2): "b2", ("b", 3): "b2"}
