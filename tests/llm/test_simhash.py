"""Fingerprints against a plain vote; links and components against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tapeworks.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


TEXTS = [None, "", " \n\t", "One", "one two", "One TWO three", "one two three", "Éa É é\x0bx\x0cy\rz", "a b c d",
         "a b c d a b c d", "x " * 70_000, "    q", "ẞ ſ K"]


def test_fingerprint():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("seed", range(6))
def test_meet_finds_every_link(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(simhash, "AT_ONCE", 500)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, 7, (1 << 64) - 1]
    fps = list({flipped(rng, rng.choice(base), rng.randint(0, 6)) for _ in range(120)} | {0})
    arr = np.array(fps, np.uint64)
    forest = simhash.Linked(arr)
    simhash.meet(arr, np.zeros(len(arr), np.int64), 0, forest, np.arange(len(arr)))
    assert forest.root.tolist() == plain_components(fps)


def test_links_over_spark(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list({flipped(rng, rng.choice(base), rng.randint(0, 5)) for _ in range(400)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(f,) for f in signed], "fp long")
    for n in (len(fps), 10_000_000):
        roots, _ = simhash.components(simhash.links(rows, n))
        got = {r["node"]: r["root"] for r in roots.collect()}
        want = {}
        for f, r in zip(signed, plain_components(fps)):
            want.setdefault(r, []).append(f)
        assert got == {f: min(g) for g in want.values() if len(g) > 1 for f in g}


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = {}
    for i, r in enumerate(plain_components(fps)):
        groups.setdefault(r, []).append(i)
    out = []
    for g in groups.values():
        low = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        out += [(rows[i][0], f"{fps[i]:016x}", low) for i in g]
    return sorted(out, key=str)


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    long = [rng.choice(words) for _ in range(400)]
    rows = [(i + 10, t) for i, t in enumerate(TEXTS)] + [(3, "one two three"), (3, "one two three"), (None, "One two three")]
    for i in range(40):
        edit = list(long)
        edit[rng.randrange(400)] = "zz"
        rows.append((100 + i, " ".join(edit)))
    rows += [(500 + i, " ".join(rng.choices(words, k=60))) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, fp string, key int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_every_component(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    apart = [" ".join(rng.choices(words, k=60)) for _ in range(40)]
    rows = [(None, t) for t in apart[:30]] + [(None, apart[0]), (None, apart[0])]  # components without any id
    rows += [(7, apart[30]), (7, apart[31]), (7, apart[31])]  # unequal texts under one id
    rows += [(1, apart[32]), (8, apart[32]), (8, apart[33])]  # one of them copies an earlier document
    rows += [(None, apart[34]), (9, apart[34]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id2 string")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(None, t) for t in apart[:30]] + [(7, apart[30]), (7, apart[31]), (1, apart[32]), (8, apart[33]), (9, apart[34])]
    assert sorted((x for x in got if x[1]), key=str) == sorted(want, key=str)
    assert sum(not t for _, t in got) == 1
