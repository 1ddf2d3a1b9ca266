"""Every pipeline stage, on all that its predecessor kept, against the plain versions."""

from collections import Counter

import corpus_pipeline
from tapeworks.llm import mixing, quality
from tapeworks.llm.shared import stash
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_native import plain_copies
from tests.llm.test_packing import ids_of, plain_best_fit
from tests.llm.test_quality import plain as plain_quality
from tests.llm.test_simhash import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stash(stage(spark, tables[-1], SF))[0])
    start, good, lines, single, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables)
    for t in tables[1:-1]:
        assert t.columns == docs.columns

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in good} == {r["doc_id"] for r in start if quality.verdict(r["text"], model)[6]}
    assert not any(plain_quality(r["text"])[5] for r in good)

    want = {i: (t, gone) for i, t, _, gone in plain_lines([(r["doc_id"], r["text"]) for r in good])}
    assert {r["doc_id"]: r["text"] for r in lines} == {i: t for i, (t, _) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines if want[r["doc_id"]][1])

    groups = brute([(r["doc_id"], r["text"]) for r in lines])
    assert sorted(r["doc_id"] for r in single) == sorted({c for _, _, c in groups})

    n, w = Counter(r["source"] for r in single), Counter()
    for s, c in n.items():
        w[s] = c**0.5
    rate = {s: w[s] / sum(w.values()) * len(single) / n[s] for s in n}
    copies = {r["doc_id"]: plain_copies(mixing.SEED, r["doc_id"], rate[r["source"]]) for r in single}
    assert Counter(r["doc_id"] for r in mixed) == +Counter(copies)

    tokens = {r["doc_id"]: len(ids_of(r["text"] or "")) + 1 for r in mixed}
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == Counter({i: tokens[i] * c for i, c in copies.items() if c})
    assert len({r["sequence_id"] for r in packed}) == plain_best_fit([r["length"] for r in packed], 2048)


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
            rows.collect()
