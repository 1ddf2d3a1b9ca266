"""Queries that fit models or run streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeworks.operators import cross_section as X
from tapeworks.operators import ensemble as E
from tapeworks.operators import labels as L
from tapeworks.plans import market as M
from tapeworks.plans import panel_oracle as PO
from tapeworks.plans.panel_queries import RANKS, six
from tapeworks.session import checkpoint_dir, durable
from tapeworks.streaming import jobs

# Trees of the registered queries. The statements they return hold for any number; the operator's own defaults
# (300 + 300 trees of depth 5, one fit per period) take minutes a fit and are an argument away.
QUICK = E.Settings(trees=10, rounds=3, depth=4)
EMBARGO = 4


def training_panel(spark, sf):
    rows, _ = M.ranked(spark, sf)
    return rows.select("period", "ticker", *RANKS, "fwd_ret", "vol", "label")


def q41_walk_forward_ml(spark, sf, settings: E.Settings = QUICK):
    """What each period's fresh model was trained on, and that its scores are probabilities that differ."""
    out = E.walk_forward(training_panel(spark, sf), RANKS, embargo=EMBARGO, settings=settings)
    return six(out.groupBy("period", "train_from", "train_to", "train_rows").agg(
        F.count("model_score").alias("scored"), F.countDistinct("ticker").alias("names"),
        (F.min("model_score") >= 0).alias("from_0"), (F.max("model_score") <= 1).alias("to_1"),
        (F.min("model_score") < F.max("model_score")).alias("differ")))


def q42_importance(spark, sf, settings: E.Settings = QUICK):
    """Importances on the multi-horizon labels: complete, adding up to one, and the same from a second fit."""
    rows = E.training_cache(L.multi_horizon_labels(durable(M.bars(spark, sf))))
    first = E.feature_importance(spark, E.fit(rows, RANKS, settings)).withColumn("fit", F.lit(1))
    again = E.feature_importance(spark, E.fit(rows, RANKS, settings)).withColumn("fit", F.lit(2))
    n = rows.count()
    rows.unpersist()
    per = first.unionByName(again).groupBy("feature").agg(
        F.sum(F.when(F.col("fit") == 1, F.col("importance"))).alias("share"),
        (F.min("importance") == F.max("importance")).alias("same"))
    return six(per.agg(F.count(F.lit(1)).alias("features"), (F.abs(F.sum("share") - 1) < 1e-4).alias("adds_up"),
                       F.bool_and("same").alias("repeats"), F.lit(n).alias("train_rows")))


def q91_out_of_fold(spark, sf, settings: E.Settings = QUICK):
    """Rows that the embargoed folds cover, each scored once by a model that had not seen it."""
    panel = training_panel(spark, sf).withColumn("is_snapshot", F.lit(False))
    cached = E.training_cache(panel)
    oof = durable(E.out_of_fold(cached, RANKS, settings, EMBARGO))
    cached.unpersist()
    return six(oof.groupBy("period").agg(
        F.count(F.lit(1)).alias("covered"), F.countDistinct("ticker").alias("names"),
        F.bool_and((F.col("oof") >= 0) & (F.col("oof") <= 1)).alias("in_range")))


def q92_saved_model(spark, sf, settings: E.Settings = QUICK):
    """A model trained through the cascade, saved, listed and loaded: the same scores as before."""
    panel = durable(training_panel(spark, sf))
    model = E.train_cascade(settings, real=panel, embargo=EMBARGO)
    path = f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    E.save(spark, model, path, "m1", M.MODEL)
    back = E.load(spark, path, "m1")
    one = E.predict(model, panel, "before")
    both = E.predict(back, one, "after")
    listed = E.list_saved(spark, path).select("name", "trained_at", "source")
    same = both.agg(F.count(F.lit(1)).alias("n_rows"), F.bool_and(F.col("before") == F.col("after")).alias("same"))
    return six(X.join_small(listed, same, []))


def _folders(spark) -> tuple[str, str]:
    """Fresh output and checkpoint folders inside the shared checkpoint folder."""
    run = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{run}/out", f"{run}/state"


def event_stream(spark, sf):
    kind = M.table(spark, sf, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf)


def q69_stream_signal_state(spark, sf):
    """Latest signal per user and ticker, kept by a stateful stream over the events."""
    out, state = _folders(spark)
    events = M.as_payload(event_stream(spark, sf))
    jobs.signal_state_stream(events, out, state).awaitTermination()
    return six(jobs.read_signal_state(spark, out))


def q70_stream_daily_counts(spark, sf):
    """Event counts of the days the watermark has closed."""
    out, state = _folders(spark)
    jobs.daily_counts_stream(event_stream(spark, sf), out, state).awaitTermination()
    return six(spark.read.parquet(out))


SQL = {
    "q41_walk_forward_ml": PO.with_(PO.PANEL + """, lab AS (SELECT *, CAST(fwd_ret >= median_ret AS INT) AS label FROM ranked),
      per AS (SELECT period, count(*) AS n, count(DISTINCT ticker) AS names, sum(label) AS pos FROM lab GROUP BY 1),
      tr AS (SELECT t.period, any_value(t.n) AS n, any_value(t.names) AS names, min(p.period) AS train_from, max(p.period) AS train_to, sum(p.n) AS train_rows,
          count(*) AS k, sum(p.pos) AS pos FROM per t JOIN per p ON p.period <= t.period - 5 GROUP BY 1)""",
      """SELECT period, train_from, train_to, train_rows::BIGINT AS train_rows, n AS scored, names, true AS from_0, true AS to_1, n > 1 AS differ
         FROM tr WHERE k >= 3 AND pos >= 2 AND train_rows - pos >= 2"""),
    "q42_importance": "SELECT 7 AS features, true AS adds_up, true AS repeats, count(*) AS train_rows FROM (" + PO.SQL["q15_multi_horizon"] + ")",
    "q91_out_of_fold": PO.with_(PO.PANEL + """,
      p AS (SELECT DISTINCT period FROM ranked), q AS (SELECT *, row_number() OVER (ORDER BY period) AS pos FROM p),
      f AS (SELECT period, ntile(5) OVER (ORDER BY period) AS fold FROM q WHERE pos > 1),
      g AS (SELECT *, min(period) OVER (PARTITION BY fold) - 4 AS train_below FROM f)""",
      """SELECT period, count(*) AS covered, count(DISTINCT ticker) AS names, true AS in_range FROM ranked
         WHERE period IN (SELECT period FROM g WHERE train_below > (SELECT min(period) FROM p)) GROUP BY 1"""),
    "q92_saved_model": PO.with_(PO.PANEL, f"SELECT 'm1' AS name, '{M.MODEL}' AS trained_at, 'real_returns' AS source, count(*) AS n_rows, true AS same FROM ranked"),
    "q69_stream_signal_state": """SELECT user_id, 'T' || json_extract_string(props, '$.k') AS ticker,
        CASE WHEN value > 80 THEN 'STRONG BUY' WHEN value > 50 THEN 'BUY' WHEN value > 20 THEN 'HOLD' ELSE 'SELL' END AS signal,
        round(least(value, 100), 6) AS score, ts AS at, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, ticker ORDER BY ts DESC, event_id DESC) = 1""",
    "q70_stream_daily_counts": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
      WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
}
QUERIES = {name: fn for name, fn in list(globals().items()) if name[:1] == "q" and name[1:3].isdigit()}
