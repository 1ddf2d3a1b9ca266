"""Packing: exact round trip of the ids, gapless sequences, and the plan against a plain best fit decreasing."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeworks.llm import packing


def plain_best_fit(lengths, capacity):
    rooms, opened = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            opened += 1
            room = capacity
        else:
            room = rooms.pop(at)
        bisect.insort(rooms, room - n)
    return opened


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 2048])
    lengths = [rng.randint(1, rng.choice([3, capacity // 2 + 1, capacity])) for _ in range(rng.randint(0, 400))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    steps, opened = packing.plan(counts, capacity)
    assert opened == plain_best_fit(lengths, capacity)
    bins = defaultdict(list)
    for i, (n, first, b, each, offset) in enumerate(steps):
        stop = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == n else counts[n]
        for j in range(stop - first):
            bins[b + j // each].append((offset + j % each * n, n))
    assert len(bins) == opened
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity


def ids_of(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids


ODD = ["", " ", "a", " a  b", "x \n y", "a  b", "tab\there", "end ", "\n\n a", "don't 12 34.5 <|endoftext|> x",
       "a\x1cb \x1f c", "é ü\nñ ß", "日本語 テキスト", "word " * 5000, "z" * 30000,
       "ab" * 9 + "\u00a0 b \u2003\u2003x \u0085y \ufeffz ½ ² Ⅷ ٣ 𝟘 👩‍👩‍👧 e\u0301 I'LL i'll \x00\x01\r\nq\r \x0b\x0cw"]


def test_special_text_and_long_runs():
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275] == ids_of("a <|endoftext|> b")
    assert encode("<|endoftext|><|endoftext|>x") == ids_of("<|endoftext|><|endoftext|>x")
    for c in (" ", "\t", "\n", "\u00a0", "z", "é"):
        run = c * 60_000
        for text in (f"a b{run}", f"{run}c", f"x {run} y<|endoftext|>{run} z"):
            assert encode(text) == ids_of(text), (c, text[:5])
    for c in (" ", "\n", "z"):
        assert encode(c * 2_000_000) == ids_of(c * 2_000_000)


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "nobody"), (77, None)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, piece int, offset string")
    out = packing.best_fit(docs, keep_ids=True).collect()
    by = defaultdict(list)
    for r in out:
        assert r["length"] * 4 == len(r["ids"]) and r["length"] <= 2048
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        by[r["doc_id"]].append(r)
    for i, t in rows:
        want = ids_of(t or "") + [0]
        own = sorted({(r["piece"], r["start"], bytes(r["ids"])) for r in by[i]})
        assert np.frombuffer(b"".join(x[2] for x in own), "<u4").tolist() == want
        assert [x[0] for x in own] == list(range(-(-len(want) // 2048)))
        assert all(len(x[2]) == 8192 for x in own[1:])
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) == plain_best_fit([r["length"] for r in out], 2048)
    assert len(by[3]) == 2


def test_lanes_and_empty(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 7)
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('ab ', cast(id % 5 as int)) AS text")
    out = packing.best_fit(docs).collect()
    assert len(out) == 200 and len({(r["sequence_id"], r["offset"]) for r in out}) == 200
    assert packing.best_fit(docs.limit(0)).count() == 0


def test_ranks_give_the_same_ids(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    fast = packing.encoder(public_tokenizers.path(packing.TOKENIZER))
    slow = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(fast(t) == slow(t) for t in [*texts, *ODD])
