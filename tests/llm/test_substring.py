"""Removal of repeated 13-word windows against a plain version."""

import hashlib
import random

import numpy as np
import pytest

from tapeworks.llm import substring


def split(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain(rows, k=13):
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - k + 1):
            s = tuple(w[j:j + k])
            if s not in first or key(i) < key(first[s]):
                first[s] = i
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for j in range(len(w) - k + 1):
            if key(first[tuple(w[j:j + k])]) < key(i):
                gone.update(range(j, j + k))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"wört{i}" for i in range(40)]
    passages = [[rng.choice(words) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(40):
        body = []
        for _ in range(rng.randint(0, 5)):
            body += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(1, 20))]
        rows.append((i, rng.choice([" ", "\n", " \t  "]).join(body)))
    same = " ".join(passages[0] * 3)
    return rows + [(None, rows[3][1]), (None, "x"), (100, None), (101, ""), (102, " \n "), (5, rows[5][1]), (5, rows[5][1]),
                   (103, same), (104, same), (105, "one " * 20_000), (106, "one " * 15), (2, "one " * 13)]


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed, monkeypatch):
    rows = corpus(seed)
    if seed:
        monkeypatch.setattr(substring, "BYTES_PER_SHARD", 5_000)
        monkeypatch.setattr(substring, "BATCH_EDGES", 300)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, doc int, edges string")
    got = substring.remove_repeats(docs.repartition(3), digest_only=True)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == plain(rows)


def test_rows_without_an_id(spark, monkeypatch):
    """They do not repeat each other, lose what named documents hold, and none carries the edges of the others."""
    monkeypatch.setattr(substring, "BATCH_EDGES", 3_000)
    common, own = " ".join(f"c{i}" for i in range(20)), " ".join(f"n{i}" for i in range(20))
    rows = [(None, f"r{i} {common if i % 2 else own} {i}") for i in range(2000)] + [(None, own)] * 5 + [(9, common), (3, "x " + common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring.remove_repeats(docs, digest_only=True)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=str) == plain(rows)
    assert substring.repeated_edges(docs).groupBy("doc").count().agg({"count": "max"}).first()[0] == 8


def test_spans_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (2, "a b " + text + " c"), (3, text + " " + text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert got[1]["spans"] == [] and got[2]["spans"] == [[2, 32]] and got[2]["kept"] == "a b c"
    assert got[3]["n_removed"] == 60 and got[3]["kept"] == ""
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_packing_of_edges():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(0, 1 << 64, 1000, dtype=np.uint64))
    d = rng.integers(-(1 << 63), (1 << 63) - 1, 1000, dtype=np.int64, endpoint=True)
    a, b = substring.unpack(substring.pack(h, d))
    assert (a == h).all() and (b == d).all()
