"""Base counts against a plain version; held-out accuracy of the verdict."""

import random
import re

from pyspark.sql import functions as F

from tapeworks.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen, covered = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered.update(range(i, i + 8))
    dup = len(lines) - len(set(lines))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def texts():
    rng = random.Random(4)
    out = [None, "", "\n\n", "a", "é b c", "x\x0by\x0cz", "# * $ % & | < >", "line\nline\n line\n\n \n \nline",
           "a b c d e f g h " * 3, "a b c d e f g a b c d e f g", "w " * 7, "w " * 8, "w " * 9, "z" * 100_000, "ab cd\n" * 30_000]
    words = [f"w{i}" for i in range(9)]
    for _ in range(60):
        out.append(rng.choice(["\n", " "]).join(rng.choice([" ", "", "\t"]) + rng.choice(words) for _ in range(rng.randint(0, 120))))
    for n in (19, 20, 21):
        out.append(" ".join(f"u{i}" for i in range(n)))
    return out


def test_counts():
    blank = quality.fit([], [])
    for t in texts():
        got = quality.verdict(t, blank)
        assert got[:6] == plain(t), repr(t)[:80]
        assert got[6] == (not got[5])  # an untrained model rejects nothing


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = quality.assess(docs, quality.train(docs, labels.where(~part))).join(labels.where(part), "doc_id").where("NOT base_failed")
    rows = out.select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 50 and sum(good) >= 0.98 * len(good)
    assert len(bad) > 5 and sum(bad) <= 0.2 * len(bad)


def test_tables(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a b"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t in rows], "doc_id long, text string, quality string, probability double")
    labels = spark.createDataFrame([(20, 1), (21, 0), (20, 1), (None, 1), (22, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    out = quality.assess(docs, model)
    assert sorted((tuple(r)[:7] for r in out.collect()), key=str) == sorted(((i, *plain(t)) for i, t in rows), key=str)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()
    assert quality.assess(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0
