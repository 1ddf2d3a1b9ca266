"""Streaming forms of the jobs whose inputs are append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeworks import constants as K
from tapeworks.operators import drift_state as DS
from tapeworks.operators import monitoring as N
from tapeworks.operators import scoring as R
from tapeworks.session import written
from tapeworks.sources import versions as V


def batch_writer(path: str, transform):
    """foreachBatch function writing each batch into its own folder.

    A replayed batch overwrites its own output, so a restart leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def drift_stream(rows: DataFrame, base: DataFrame, by: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Feature drift of every arriving batch of (by, feature, value) rows against a baseline."""
    write = batch_writer(path, lambda batch: N.feature_drift(batch, base, by))
    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def folding_writer(path: str, writer: str, transform, merge):
    """foreachBatch function appending each batch to a versioned table and merging its pieces by levels.

    A replayed batch is known by its number and adds nothing; readers open a bounded number of pieces however many
    batches there were.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        V.append(transform(batch), path, batch_id, writer)
        V.compact(batch.sparkSession, path, merge)
    return write


def arrivals(rows: DataFrame, path: str, batches: int) -> DataFrame:
    """A stream of ``rows`` that brings them in about ``batches`` batches, each with rows from all over the table.

    Every task deals its rows out to its own ``batches`` files: nothing is shuffled, and with the table grow the files
    and the tasks that write and read a batch, not the rows of one of them.
    """
    dealt = rows.withColumn("deal_", F.pmod(F.monotonically_increasing_id(), F.lit(batches)).cast("int"))
    dealt.write.partitionBy("deal_").parquet(path)
    spark = rows.sparkSession
    files = len(spark.read.schema(dealt.schema).parquet(path).inputFiles())
    stream = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)
    return stream.drop("deal_")


def drift_state_stream(rows: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Value counts of every arriving batch of (keys, value) rows, to be added up by ``read_drift_state``.

    A period may arrive in any number of batches: its drift comes from all of them together.
    """
    write = folding_writer(path, "drift", lambda batch: DS.value_counts(batch, keys), lambda rows: DS.merge([rows], keys))
    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_drift_state(spark, path: str, keys: list[str]) -> DataFrame:
    """(keys, value, c) over all batches, written once for the statistics that follow."""
    return written(DS.merge([V.read(spark, path)], keys))


def signal_state(events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Latest signal per (user, ticker). State holds one row per key; replays change nothing."""
    entries = R.parse_payloads(events)
    best = F.max_by(F.struct("signal", "score", F.col(ts).alias("at"), F.col(tie).alias("event_id")), F.struct(ts, tie))
    return entries.groupBy(user, "ticker").agg(best.alias("e")).select(user, "ticker", "e.*")


SIGNAL_KEYS = ["user_id", "ticker"]


def newest_signals(rows: DataFrame) -> DataFrame:
    return N.latest_per_key(rows, SIGNAL_KEYS, ["at", "event_id"])


def signal_state_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the keys that changed in each batch; ``read_signal_state`` folds them, newest first."""
    write = folding_writer(path, "signals", lambda batch: batch, newest_signals)
    return (signal_state(events).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_signal_state(spark, path: str) -> DataFrame:
    return newest_signals(V.read(spark, path))


def daily_counts(events: DataFrame, ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Closed days only: (day, event_type, n). Rows later than the watermark are dropped."""
    timed = events.withColumn("at", F.col(ts).cast("timestamp")).withWatermark("at", lateness)
    n = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.to_date("w.start").alias("day"), "event_type", "n")


def daily_counts_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (daily_counts(events).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def mature_pending(predictions: DataFrame, matured: DataFrame | None, bars: DataFrame, now) -> DataFrame:
    """Newly matured rows: due, not matured before, future bars present."""
    open_rows = predictions if matured is None else predictions.join(matured.select("pred_id"), "pred_id", "left_anti")
    return N.mature_labels(open_rows, bars, now).filter("matured")


def maturation_stream(new_bars: DataFrame, predictions_path: str, matured_path: str, bars_of, now, checkpoint: str) -> StreamingQuery:
    """Each arrival of bars matures the open predictions in the log that are due and have their bars.

    The log drives it: a name that trades no more still matures from the bars already
    stored. ``bars_of(spark)`` reads the full bar table, of which only the names with open
    predictions are used. Ids already written are left out by an anti-join, so replays are
    harmless and no year of state is held.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        preds = spark.read.parquet(predictions_path)
        names = preds.select("ticker").distinct()
        try:
            done = spark.read.parquet(matured_path)
        except Exception as err:                      # first run: no table yet
            if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
                raise
            done = None
        fresh = mature_pending(preds, done, bars_of(spark).join(names, "ticker", "left_semi"), now)
        fresh.write.mode("append").partitionBy("model_version").parquet(matured_path)
    return (new_bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def add_pending(predictions: DataFrame, path: str, batch: int) -> None:
    """Put predictions into the index of open ones: pieces by the month in which they fall due."""
    rows = predictions.withColumn("due_on", N.due_on())
    V.append(rows, path, batch, "predictions", day="due_on", unit="month")


def mature_from_index(bars: DataFrame, pending: str, matured: str, now: str, batch: int) -> None:
    """Mature what is due on the day ``now``, opening only the pieces that hold predictions due by then.

    The matured rows are appended under the batch number, then the opened pieces are replaced by their rows that are
    still open, so no batch reads what earlier ones settled. A job that dies between the two is repeated: its rows
    are not added again, and they leave the index then.
    """
    spark = bars.sparkSession
    m = V.manifest(spark, pending)
    old = [p for p in m.pieces if p.low <= now]
    if not old:
        return
    rows = written(V.read_pieces(spark, pending, m, old))
    names = bars.join(rows.select("ticker").distinct(), "ticker", "left_semi")
    done = written(N.mature_labels(rows.drop("due_on"), names, F.to_date(F.lit(now))).filter("matured"))
    V.append(done, matured, batch, "maturation")
    settled = V.read(spark, matured).select("pred_id")
    left = rows.join(settled, "pred_id", "left_anti")
    V.swap(spark, pending, old, V.pieces_of(left, pending, m))


def maturation_index_stream(new_bars: DataFrame, pending: str, matured: str, bars_of, last, checkpoint: str) -> StreamingQuery:
    """Each arrival of bars matures the predictions due by its newest day, at most ``last``, from the index.

    ``bars_of(spark)`` reads the full bar table, of which only the names with due predictions are used.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.least(F.max("dt"), F.lit(last).cast("date")).cast("string")).first()[0]
        if newest is not None:
            mature_from_index(bars_of(batch.sparkSession), pending, matured, newest, batch_id)
    return (new_bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
