"""Drift and its verdict on growing tables: passes over the lines, the test for repeats, arrivals of a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import drift_state as DS
from tapeworks.plans import job_queries as J
from tapeworks.plans import market as M
from tapeworks.plans import signal_queries as Q
from tapeworks.streaming import jobs

START = dt.datetime(1997, 7, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Lines of three names from 1997 to 1999, one without a day, one without a price, one of a year of three digits."""
    at = str(tmp_path_factory.mktemp("lines"))
    lines = [(i % 3, float(i % 50 + 1), 100.0 + i % 97, i % 11 / 100, i % 9 / 100, "A", START + dt.timedelta(days=i // 3))
             for i in range(2700)]
    lines += [(0, 1.0, 10.0, 0.01, 0.02, "N", None), (1, 2.0, None, 0.03, None, "R", START),
              (2, 3.0, 10.0, 0.01, 0.02, "N", dt.datetime(998, 2, 3))]
    spark.createDataFrame(lines, "l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(i, f"Brand#{i}") for i in range(3)], "p_partkey long, p_brand string").write.parquet(f"{at}/part.parquet")
    return at


def test_lines_are_joined_once_for_scores_and_labels(spark, tables, monkeypatch):
    reads, sales = [], M.sales
    monkeypatch.setattr(M, "sales", lambda *a: reads.append(a) or sales(*a))
    assert Q.matured(spark, tables)[0].count() > 0
    assert len(reads) == 1
    reads.clear()
    Q.states(spark, tables)
    assert len(reads) == 1


def test_test_for_repeats_estimates_few_values_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(DS, "TESTED", 1 << 10)
    alike = spark.range(1 << 15).select(F.lit(1).alias("q"), F.lit("f").alias("feature"), (F.col("id") % 4096).cast("double").alias("value"))
    rows, weight = DS.counted(alike, ["q", "feature"])
    assert weight == "c" and rows.agg(F.sum("c"), F.count("value")).first()[:] == (1 << 15, 4096)
    distinct = alike.withColumn("value", F.monotonically_increasing_id().cast("double"))
    assert DS.counted(distinct, ["q", "feature"])[1] is None


def test_arrivals_bring_every_row_in_batches_without_a_shuffle(spark, tmp_path):
    rows = spark.range(0, 6000, 1, 6).select(F.floor(F.col("id") / 1000).cast("int").alias("quarter_no"), "id")
    stream, sizes = jobs.arrivals(rows, str(tmp_path / "lines"), 3), []
    assert stream.columns == rows.columns

    def keep(batch, batch_id):
        sizes.append(batch.count())
        batch.write.parquet(str(tmp_path / "seen" / str(batch_id)))
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    assert len(sizes) == 3 and sum(sizes) == 6000
    assert len(list((tmp_path / "lines").glob("deal_=*/*.parquet"))) == 18      # three of each of the six tasks
    seen = spark.read.parquet(str(tmp_path / "seen" / "*"))
    assert seen.distinct().count() == 6000


def test_quarters_as_numbers_name_the_same_quarters(spark, tables):
    li = M.table(spark, tables, "lineitem")
    text = F.concat_ws("-Q", F.year("l_shipdate").cast("string"), F.quarter("l_shipdate").cast("string"))
    want = sorted(tuple(r) for r in li.groupBy(text, text >= "1998").count().collect())
    lines = M.drift_lines(spark, tables)
    assert sorted(tuple(r) for r in lines.groupBy(M.quarter_text(), M.is_live()).count().collect()) == want


def test_streamed_drift_is_the_drift_of_the_lines(spark, tables):
    rows = lambda df: sorted(df.collect(), key=lambda r: (r["quarter"], r["feature"]))
    streamed = rows(J.q87_drift_stream(spark, tables))
    assert len(streamed) > 12 and streamed == rows(Q.q37_feature_psi(spark, tables))


def test_rounding_of_lines_is_that_of_round_and_makes_no_decimals(spark, tables):
    odd = [0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, -0.2, 0.49999999999999994, -0.49999999999999994, 4503599627370495.5, 4503599627370497.0,
           1e22, -1e300, 5e-324, 100.5, 1.005 * 100, 1.15 * 100, 0.07 * 100, float("nan"), float("inf"), float("-inf"), None]
    rows = spark.createDataFrame([(x,) for x in odd + [n / 1000 * 100 for n in range(-5000, 5000)]], "x double")
    text = lambda c: c.cast("string")
    pairs = rows.select(text(F.round("x")).alias("want"), text(M.rounded(F.col("x"))).alias("got"))
    assert pairs.filter(~F.col("want").eqNullSafe(F.col("got"))).count() == 0
    for df in (M.daily(spark, tables), M.drift_lines(spark, tables)):
        assert "round(" not in df._jdf.queryExecution().optimizedPlan().toString()
