"""Counts from the block index against a plain count."""

import bisect
import random

import pytest

from tapeworks.operators import rank_index as RI


@pytest.mark.parametrize("block,small", [(RI.BLOCK, RI.SMALL_BYTES), (7, RI.SMALL_BYTES), (7, 0)])
def test_counts(spark, monkeypatch, block, small):
    monkeypatch.setattr(RI, "SMALL_BYTES", small)
    rng = random.Random(6)
    ref = [(rng.choice([1.0, 1.0, rng.gauss(0, 3), None]), float(rng.randrange(5)), None) for _ in range(400)]
    rows = [(i, rng.choice([None, 1.0, rng.gauss(0, 3), -99.0, 99.0]), rng.choice([None, -1.0, 0.0, 2.5, 4.0]), 1.0) for i in range(120)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double").repartition(3)
    panel = spark.createDataFrame(ref, "a double, b double, c double")
    out = RI.with_counts(df, panel, ["a", "b", "c"], block)
    assert out.columns == ["id", "a", "b", "c", "a_n_", "b_n_", "c_n_", "a_upto_", "b_upto_", "c_upto_"]
    sides = {c: sorted(r[i] for r in ref if r[i] is not None) for i, c in enumerate("abc")}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        for c, side in sides.items():
            assert r[f"{c}_n_"] == len(side)
            assert r[f"{c}_upto_"] == (None if r[c] is None else bisect.bisect_right(side, r[c])), (c, r)
    sizes = [len(r.values_) for r in RI.ordered_blocks(panel, ["a", "b"], 7).collect()]
    distinct = len(set(sides["a"])) + len(set(sides["b"]))
    assert max(sizes) <= 7 and sum(sizes) == distinct and len(sizes) >= distinct / 7
    assert {(r.a_n_, r.a_upto_ or 0) for r in RI.with_counts(df, panel.limit(0), ["a"], block).collect()} == {(0, 0)}
