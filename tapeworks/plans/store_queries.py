"""Queries on versioned tables: batches that repeat, retention, merged levels, an index by due date."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.plans import job_queries as JQ
from tapeworks.plans import market as M
from tapeworks.plans import signal_queries as Q
from tapeworks.plans.model_queries import SQL as MODEL_SQL
from tapeworks.plans.panel_queries import six
from tapeworks.session import durable
from tapeworks.sources import versions as V
from tapeworks.streaming import jobs

CUTOFF = "1998-03-15"
BATCHES = 4


def order_batches(spark, sf, path: str, **kept) -> None:
    """Orders appended in batches, one of them twice."""
    orders = M.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    for batch in (0, 1, 1, 2, 3, 2):
        V.append(orders.filter(F.pmod("o_orderkey", F.lit(BATCHES)) == batch), path, batch, **kept)


def q108_batch_log(spark, sf):
    """Every order once, though batches were repeated."""
    path = JQ.folder(spark, "orders")
    order_batches(spark, sf, path)
    return six(V.read(spark, path))


def q109_dropped_days(spark, sf):
    """Orders kept by month, those before the cutoff dropped: what is left, and the months whose files are gone."""
    path = JQ.folder(spark, "orders")
    order_batches(spark, sf, path, day="day")
    before = {p.low[:7] for p in V.manifest(spark, path).pieces}
    V.retain(spark, path, CUTOFF)
    V.vacuum(spark, path)
    now = V.manifest(spark, path)
    there = {n for d in V.Folder(spark, path).names("data") for n in V.Folder(spark, path).names(f"data/{d}") if n.startswith("part_=")}
    gone = len(before) - len({n[6:13] for n in there})
    rows = V.read(spark, path)
    return six(rows.withColumn("months_gone", F.lit(gone)).withColumn("first_day", F.lit(min(p.low for p in now.pieces))))


def q110_merged_signals(spark, sf):
    """q69 from many small batches, whose pieces are merged level by level."""
    arriving, out, state = (JQ.folder(spark, n) for n in ("events", "signals", "state"))
    events = M.table(spark, sf, "events")
    events.repartition(24).write.parquet(arriving)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    jobs.signal_state_stream(M.as_payload(stream), out, state).awaitTermination()
    return six(jobs.read_signal_state(spark, out))


def q111_due_index(spark, sf):
    """q88 from an index by due date: bars arrive year by year, each arrival opens what is due by its last day."""
    series = durable(M.bars(spark, sf))
    rows, _ = Q.matured(spark, sf)
    pending, bars, arriving, done, state = (JQ.folder(spark, n) for n in ("pending", "bars", "arriving", "matured", "state"))
    jobs.add_pending(rows.drop("realized_return", "matured"), pending, 0)
    series.write.parquet(bars)
    years = [r[0] for r in series.select(F.year("dt")).distinct().orderBy(F.year("dt")).collect()]      # one row a year
    for lo, hi in zip(years[::2], [*years[2::2], 9999], strict=True):
        series.filter((F.year("dt") >= lo) & (F.year("dt") < hi)).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema(series.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    jobs.maturation_index_stream(stream, pending, done, lambda s: s.read.parquet(bars), Q.NOW, state).awaitTermination()
    return six(V.read(spark, done).select(
        "pred_id", "model_version", "period_key", "predicted_at", "ticker", "prediction", "horizon_days", "realized_return"))


ORDERS = "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, round(o_totalprice, 6) AS o_totalprice FROM orders"
SQL = {
    "q108_batch_log": ORDERS,
    "q109_dropped_days": f"""
WITH o AS ({ORDERS}), kept AS (SELECT * FROM o WHERE day >= DATE '{CUTOFF}')
SELECT *, (SELECT count(DISTINCT strftime(day, '%Y-%m')) FROM o) - (SELECT count(DISTINCT strftime(day, '%Y-%m')) FROM kept) AS months_gone,
  (SELECT CAST(min(day) AS VARCHAR) FROM kept) AS first_day FROM kept""",
    "q110_merged_signals": MODEL_SQL["q69_stream_signal_state"],
    "q111_due_index": JQ.SQL["q88_maturation_stream"],
}
QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
