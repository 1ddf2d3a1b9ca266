"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tapeworks.llm import ranked as R

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def plain(docs, items, top=10):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    number, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * number // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in words(text) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, d[3], -d[0]) for k, d in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Öl", "öl", "straße", "É1", " ", "x y"]
    docs = [(i, rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, k=rng.choice([1, 3, 20, 90])))) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)]
    docs += [(None, docs[5][1]), (None, docs[6][1]), (7, docs[8][1]), (7, docs[8][1]), (900, None), (901, ""), (902, " .,\t"),
             (903, "W1 " * 400_000 + "w2"), (904, "z" * 3_000_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 8])))) for i in range(25)]
    items += [(50, None), (51, "..."), (52, "nowhere"), (None, "w3 w3 W4"), (3, "w9 w10"), (53, "w1 w2 w2"), (53, "w1 w2 w2"), (54, docs[5][1])]
    return docs, items


@pytest.mark.parametrize("cells,seeds", [(R.CELLS, R.SEED_ROWS), (600, 40)])
def test_same_as_plain(spark, monkeypatch, cells, seeds):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "SEED_ROWS", seeds)
    monkeypatch.setattr(R, "PART", 1000)
    docs, items = corpus()
    left = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, n int").repartition(4)
    right = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = R.rank(left, right).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(docs, items)
    assert sorted([(r.item_id, r["rank"]) for r in got if r.item_id != 3], key=str) == sorted(
        {(r.item_id, r["rank"]) for r in got if r.item_id != 3}, key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.rank(docs.where("doc_id > 1"), items).collect() == []
    none = R.rank(docs, items.where("item_id > 1"))
    assert none.collect() == [] and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_prune_and_lose_nothing():
    """Of all (item, document) pairs few reach the leaves, and all that reach the floor are among them."""
    rng = np.random.default_rng(5)
    block = R.Block()
    for i in range(40):
        block.add(i, {b"%d" % t: 1 for t in rng.integers(0, 50, 6) + 50 * (i % 4)})
    weight = rng.integers(1, 9000, len(block.vocabulary))
    tree = R.ItemTree(block, weight)
    assert sorted(np.concatenate([b for b, c in zip(tree.below, tree.children) if not c])) == list(range(40))
    size = rng.integers(0, 9, 3000)
    starts = np.cumsum([0, *size])
    held = np.concatenate([np.sort(rng.choice(len(weight), k, replace=False)) for k in size])
    impact = rng.integers(1, 10**6, len(held))
    full = np.zeros((3000, len(weight)), np.int64)
    full[np.repeat(np.arange(3000), size), held] = impact
    scores = full @ tree.rows.T
    floor = np.sort(scores, axis=0)[-10]
    docs = R.DocTree(tree, starts, held, impact)
    seen = np.zeros_like(scores, bool)
    for own, some in R.pairs(tree, docs, floor):
        assert (docs.scores(tree.rows[own], some) == scores[np.ix_(some, own)].T).all()
        seen[np.ix_(some, own)] = True
    assert seen[scores >= floor].all() and seen.mean() < 0.5


def test_long_corpora_stay_exact():
    tf, n = np.array([3, 9]), np.array([10**6, 5])
    share = [75 * int(x) * 10**12 // 10**15 for x in n]
    assert list(R.impacts(tf, n, 10**12, 10**15)) == [10**9 * int(t) // (1000 * int(t) + 8 * (25 + s)) for t, s in zip(tf, share)]
