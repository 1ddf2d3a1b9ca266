"""Exact dedup, sharding and mixing against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tapeworks.llm import exact_dedup, mixing, sharding


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((i, len(t or "")))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(0)
    base = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 5, 16, 17, 31, 32, 33, 200, 999)]
    rows = []
    for i in range(80):
        t = rng.choice(base)
        if rng.random() < 0.5:
            k = rng.randrange(len(t) + 1)
            t = t[:k] + rng.choice([" ", "\n\t", "\x0b\x0c\r"]) + t[k:]
        if rng.random() < 0.2:
            t = t[:-1] + "x"
        rows.append((i, t))
    return rows + [(200, None), (201, ""), (202, " \n"), (7, base[3]), (7, base[3]), (None, base[4]), (None, "only null"),
                   (203, "q" * 40_000), (204, "q" * 40_000), (205, "q" * 40_001), (206, " ")]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])  # the second collides
def test_exact_groups(spark, digest):
    rows = texts()
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, row int, name string")
    out = exact_dedup.exact_groups(docs.repartition(3), 16, digest).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out), key=str) == plain_groups(rows)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in out}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_lookup_table_fills_evenly_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    owner = sharding.fill(names, 2003)
    counts = Counter(owner)
    assert set(counts) == set(range(20)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 19)
    assert moved < 0.15 * 2003
    double = Counter(sharding.fill(names, 2003, {"s0": 2}))
    assert abs(double[0] - 2 * double[1]) <= 4
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill(bad)
    with pytest.raises(ValueError):
        sharding.fill(names, 2004)


def test_place(spark, tmp_path):
    owner = sharding.fill(["a", "b", "c"], 101)
    rows = [(i, "t") for i in range(300)] + [(5, "u"), (None, None)]
    docs = spark.createDataFrame([(i, t, "old", "old") for i, t in rows], "doc_id long, text string, slot string, shard string")
    out = sharding.place(docs, owner).collect()
    assert len(out) == len(rows)
    for r in out:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, owner[slot])
    assert sharding.place(docs.limit(0), owner).count() == 0
    sharding.write_shards(docs, owner, str(tmp_path / "out"), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["shard"] for r in back.collect()) == sorted(r["shard"] for r in out)


def plain_copies(seed, key, rate, draws=1):
    total = 0
    for d in range(draws):
        u = int(hashlib.md5(f"{seed}:{d}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
        mean, k = rate / draws, 0
        p = c = math.exp(-mean)
        while c <= u and k < mixing.TERMS:
            k += 1
            p = p * mean / k
            c += p
        total += k
    return total


def test_replicate(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small") for i in range(600)] + [(5, "again", "big"), (None, None, "small"), (9000, "x", None)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, copy int, order_key string")
    weights = {"big": 1.0, "small": 3.0, None: 0.5}
    table = mixing.rates(docs, weights)
    n = Counter(r[2] for r in rows)
    rate = {s: w / 4.5 * len(rows) / n[s] for s, w in weights.items()}
    assert rate[None] > 2 * mixing.RATE_PER_DRAW  # drawn in parts
    got = mixing.replicate(docs, table, seed=3)
    assert got.columns == ["doc_id", "text", "source", "copy", "order_key"]
    out = got.collect()
    want = Counter()
    for i, t, s in rows:
        draws = max(1, math.ceil(rate[s] / mixing.RATE_PER_DRAW))
        c = plain_copies(3, i, rate[s], draws)
        if c:
            want[(i, t, s)] += c
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in out) == want
    assert abs(len(out) - len(rows)) < 5 * len(rows) ** 0.5
    ids = [r["doc_id"] for r in out if r["doc_id"] is not None]
    assert sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.65 * len(ids)  # not in the order of the input
    none = mixing.rates(docs, {"big": 1.0})
    assert {r["source"] for r in mixing.replicate(docs, none).collect()} == {"big"}
    assert mixing.replicate(docs.limit(0), mixing.rates(docs.limit(0))).count() == 0
