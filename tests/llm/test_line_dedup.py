"""Line dedup against a plain version; deletions bring lines back; filters miss nothing."""

import random
from collections import defaultdict

import numpy as np

from tapeworks.llm import line_dedup
from tapeworks.llm.line_dedup import Cuckoo, LineIndex


def fold(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)


def plain(rows, min_docs=3):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(fold(line)) >= 20:
                holders[fold(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, t in rows:
        me = -(1 << 63) if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(fold(x), ())) < min_docs or max(holders[fold(x)]) == me]
        out.append((i, "\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(3)
    pool = [f"this is the shared line number {i}" for i in range(8)] + ["é" * 19, "é" * 20, "Ä" * 25, "ä" * 25, "short"]
    rows = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 6))] + [f"own line of document number {i}"]
        lines = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \x0b"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    return rows + [(None, pool[0] + "\n"), (7, pool[0] + "\n" + pool[1]), (50, None), (51, ""), (52, "\n" * 5000 + pool[2]),
                   (None, None), (53, "\n".join([pool[3]] * 3000))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines int, doc string")


def test_against_plain(spark, monkeypatch):
    rows = corpus()
    docs = frame(spark, rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "doc", "n_lines", "n_dropped"]
    assert got(out) == plain(rows)
    monkeypatch.setattr(line_dedup, "TOGETHER", 5)  # every shard is dealt out over copies of its filter
    assert got(line_dedup.dedup_lines(docs)) == plain(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_filters_are_asked(spark, monkeypatch):
    """References reach the exact join only through the filters, however many there are."""
    monkeypatch.setattr(line_dedup, "TOGETHER", 50)
    rows = [(i, "a line in every document of them\n" + f"own line of document number {i}") for i in range(300)]
    index = LineIndex.empty(spark).insert(frame(spark, rows))
    assert index.drops().count() == 299
    none = LineIndex(index.refs, index.hot, index.filters.where("false"), index.shards)
    assert none.drops().count() == 0


def test_rows_without_an_id(spark):
    """They count as one document, are each rewritten, and go and come back together."""
    shared = ["first line that many documents hold", "second line that many documents hold", "a line of rows without an id only"]
    rows = [(None, f"row {i}\n{shared[i % 2]}\n{shared[2]}") for i in range(3000)] + [(None, f"row 0\n{shared[0]}\n{shared[2]}")] * 5
    rows += [(1, shared[0]), (2, shared[0] + "\n" + shared[1])]
    docs = frame(spark, rows)
    assert got(line_dedup.dedup_lines(docs)) == plain(rows)
    assert got(line_dedup.dedup_lines(docs, 1)) == plain(rows, 1)
    index = LineIndex.empty(spark).insert(docs)
    per_doc = index.drops().groupBy("doc").count().agg({"count": "max"}).first()[0]
    assert per_doc <= 2
    less = index.delete(frame(spark, [(None, "")]))
    left = rows[-2:]
    assert less.refs.count() == 3 and got(line_dedup.drop_lines(frame(spark, left), less.drops())) == plain(left)


def test_insert_and_delete(spark):
    rows = corpus()
    first, second = rows[:25], rows[25:]
    index = LineIndex.empty(spark).insert(frame(spark, first), fresh=True).insert(frame(spark, second))
    assert got(line_dedup.drop_lines(frame(spark, rows), index.drops())) == plain(rows)
    gone = {0, 3, 9, 39, 53, None}
    less = index.delete(frame(spark, [(i, "") for i in gone]))
    left = [(i, t) for i, t in rows if i not in gone]
    assert got(line_dedup.drop_lines(frame(spark, left), less.drops())) == plain(left)
    hot = {(r["k1"], r["k2"]) for r in less.hot.collect()}
    size = {r["shard"]: int((np.frombuffer(bytes(r["cells"]), "<u2") != 0).sum()) + len(r["extra"]) for r in less.filters.collect()}
    assert sum(size.values()) == len(hot)
    back = less.insert(frame(spark, [(i, t) for i, t in rows if i in gone]))
    assert got(line_dedup.drop_lines(frame(spark, rows), back.drops())) == plain(rows)


def test_cuckoo_keeps_everything():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)
    for buckets in (16, 1024, 2048):  # far too small, nearly full, roomy
        c = Cuckoo(buckets)
        c.insert(keys[:3000])
        c.insert(keys[3000:])
        assert c.contains(keys).all()
        assert int((c.table != 0).sum()) + len(c.extra) == len(keys)
        c = Cuckoo(buckets, c.table.tobytes(), c.extra)
        c.delete(keys[:4000])
        assert c.contains(keys[4000:]).all()
        assert int((c.table != 0).sum()) + len(c.extra) == 1000
        if buckets > 16:
            assert c.contains(keys[:4000]).mean() < 0.05
