"""Columns whose names an operator would like for itself pass through."""

from pyspark.sql import functions as F

from tapeworks.llm import line_dedup, mixing, simhash
from tapeworks.llm.shared import free_names

PRIVATE = ["_id", "_NO_ID", "_key_a", "_key_b", "_k1", "_k2", "_doc", "_mix_cdf", "_mix_source", "_mix_draws", "_mix_u", "_mix_n"]
LINE = "this line is in every single document"


def table(spark):
    rows = [(i, f"words of document number {i} and {i * 7} more\n{LINE}", ["a", "b", None][i % 3]) for i in range(12)] + [(None, LINE, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in PRIVATE})


def test_names(spark):
    docs = table(spark)
    kept = {
        "keep_first": simhash.keep_first(docs), "drop_lines": line_dedup.dedup_lines(docs).drop("n_lines", "n_dropped"),
        "replicate": mixing.replicate(docs, mixing.rates(docs)).drop("copy", "order_key")}
    for name, out in kept.items():
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in PRIVATE), name
    assert sum(LINE in (r.text or "") for r in kept["drop_lines"].collect()) == 1
    assert free_names(docs, "_k1", "_new", "_K1") == ["_k1_", "_new", "_K1__"]
