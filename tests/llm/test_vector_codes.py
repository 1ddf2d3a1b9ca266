"""Vector codes against a plain version."""

import hashlib
import math
import random

import numpy as np
import pytest

from tapeworks.llm import vector_codes as V

SHAPE = "vec_id long, label string, embedding array<float>, id_ int, ints string, code string"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(order[0][2])
    same = [r for r in order if len(r[2]) == width]
    cuts = [(p * width // parts, (p + 1) * width // parts) for p in range(parts)]
    books = [[r[2][a:b] for r in same[:entries]] for a, b in cuts]

    def near(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            hit = [near(r[2][a:b], books[p])[1] for r in same]
            for k in range(len(books[p])):
                own = [r[2][a:b] for r, h in zip(same, hit) if h == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, l, v in order:
        if len(v) != width:
            out.append((i, l, None, None))
            continue
        hits = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        out.append((i, l, "".join(f"{k:02x}" for _, k in hits), sum(d for d, _ in hits)))
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    totals = {}
    for _, l, _, e in out:
        totals[l] = totals.get(l, 0) + (e or 0)
    return sorted([(*r, totals[r[1]]) for r in out], key=repr), sha


def vectors(width, n=90, seed=1):
    rng = random.Random(seed)
    values = [float(np.float32(rng.uniform(-1, 1))) for _ in range(7)]
    rows = [(i, rng.choice(["a", "b", None]), [rng.choice(values) for _ in range(width)]) for i in range(n)]
    return rows + [
        (500, "a", None), (501, "a", [float("nan")] + [0.5] * (width - 1)), (502, None, [float("-inf")] + [0.5] * (width - 1)),
        (503, "b", [None] + [0.5] * (width - 1)), (None, "b", rows[0][2]), (None, None, rows[1][2]),
        (3, "a", rows[3][2]), (3, "b", rows[9][2]), (504, "b", [0.25] * (width + 1)), (505, "c", []),
    ] + [(600 + i, "hot", rows[5][2]) for i in range(40)]


@pytest.mark.parametrize("width,leaves", [(64, V.LEAVES), (64, 3), (33, 5), (6, 2)])
def test_same_as_plain(spark, monkeypatch, width, leaves):
    monkeypatch.setattr(V, "LEAVES", leaves)
    monkeypatch.setattr(V, "CELLS", 200)
    rows = vectors(width)
    df = spark.createDataFrame([(i, l, v, 7, "x", "y") for i, l, v in rows], SHAPE).repartition(4)
    coded, books = V.compress(df)
    got = V.with_label_error(coded).collect()
    want, sha = plain(rows)
    assert sorted([(r.vec_id, r.label, r.code, r.error, r.label_error) for r in got], key=repr) == want
    assert V.digest(books) == sha


def test_few_none_and_huge(spark):
    few = spark.createDataFrame([(2, "a", [0.5] * 16, 0, "", ""), (1, "a", [3e38] * 16, 0, "", "")], SHAPE)
    coded, books = V.compress(few)
    assert [len(b) for b in books] == [2] * 16
    assert sorted((r.vec_id, r.code, r.error) for r in coded.collect()) == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    none, books = V.compress(few.where("vec_id > 9"))
    assert V.with_label_error(none).collect() == [] and books == []
    odd, _ = V.compress(few.selectExpr("vec_id", "label", "cast(array() as array<float>) embedding"))
    assert {(r.code, r.error) for r in odd.collect()} == {("00" * 16, 0)}


def test_nearest_shares_and_breaks_ties():
    rng = np.random.default_rng(0)
    entries = rng.integers(-3, 4, (20, 5))
    pieces = np.unique(rng.integers(-3, 4, (9000, 5)), axis=0)
    index, distance = V.nearest(pieces, entries)
    full = ((pieces[:, None, :] - entries[None]) ** 2).sum(2)
    assert (index == full.argmin(1)).all() and (distance == full.min(1)).all()
