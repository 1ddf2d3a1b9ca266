"""Models, streams, sinks and the entry points."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tapeworks import constants as K
from tapeworks.plans import job_queries, registry, signal_queries
from tapeworks.operators import ensemble as E
from tapeworks.operators import monitoring as N
from tapeworks.operators import scoring as R
from tapeworks.operators import timeseries as TS
from tapeworks.session import checkpoint_dir, durable
from tapeworks.sources import tables as T
from tapeworks.streaming import jobs
from tests.compare import compare, connect

SF = "/root/testdata/sf0.01"
TINY = E.Settings(trees=3, rounds=2, depth=3, cv_folds=2)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(0)
    rows = []
    for p in range(1, 9):
        for t in range(20):
            x = float(rng.random())
            y = 0.3 * x + float(rng.normal(0, 0.05))
            rows.append((p, f"T{t}", x, float(rng.random()) if t % 5 else None, y, 0.2, int(y > 0.15)))
    return spark.createDataFrame(rows, "period int, ticker string, mom_1m_rank double, mom_3m_rank double, fwd_ret double, vol double, label int").cache()


def test_walk_forward_scores_only_the_future(spark, panel):
    cols = ["mom_1m_rank", "mom_3m_rank"]
    out = E.walk_forward(panel, cols, embargo=1, settings=TINY, min_train=3).toPandas()
    assert sorted(out["period"].unique()) == [5, 6, 7, 8]
    assert out["model_score"].between(0, 1).all() and len(out) == 80
    # what happens later must not change a score
    changed = panel.withColumn("label", F.when(F.col("period") >= 5, 1 - F.col("label")).otherwise(F.col("label")))
    again = E.walk_forward(changed, cols, embargo=1, settings=TINY, min_train=3).filter("period <= 6").toPandas()
    a = out[out.period <= 6].sort_values(["period", "ticker"])["model_score"].to_numpy()
    b = again.sort_values(["period", "ticker"])["model_score"].to_numpy()
    assert np.array_equal(a, b)


def test_cv_calibration_save_and_load(spark, panel, tmp_path):
    model = E.fit_with_cv(panel, E.feature_columns(panel.columns), TINY)
    t = model.report["thresholds"]
    assert t["strong_buy"] >= t["buy"] >= t["hold"] and 0 <= model.report["cv_accuracy"] <= 1
    E.save(spark, model, str(tmp_path), "a", "2024-01-01T00:00:00")
    E.save(spark, model, str(tmp_path), "b", "2024-02-01T00:00:00")
    assert [r["name"] for r in E.list_saved(spark, str(tmp_path)).collect()] == ["b", "a"]
    back = E.load(spark, str(tmp_path), "a")
    x = E.predict(model, panel).orderBy("period", "ticker").toPandas()["model_score"]
    y = E.predict(back, panel).orderBy("period", "ticker").toPandas()["model_score"]
    assert np.allclose(x, y)
    imp = E.feature_importance(spark, model).toPandas()
    assert imp["feature"].tolist()[0] == "Mom 1m" and imp["importance"].sum() == pytest.approx(1.0, abs=1e-3)


def test_cascade(spark, panel):
    few = panel.limit(4)
    assert E.train_cascade(TINY, real=few, cache=panel).source == "price_cache"
    snap = panel.filter("period = 1").select("ticker", "mom_12m_rank" if "mom_12m_rank" in panel.columns else F.col("mom_1m_rank").alias("mom_12m_rank"))
    assert E.train_cascade(TINY, real=few, snapshot=snap).source == "last_resort_momentum"
    none = E.train_cascade(TINY)
    assert none.source == "none" and E.predict(none, panel).agg(F.max("model_score")).first()[0] == 0.5


def test_feature_columns():
    assert E.feature_columns(["emb_10", "emb_2", "roe", "roe_rank", "beta", "ticker"]) == ["roe_rank", "beta", "emb_2", "emb_10"]


def write(df, path, mode="append"):
    df.coalesce(1).write.mode(mode).parquet(str(path))


def test_drift_stream_and_replay(spark, tmp_path):
    base_rows = [("f", float(i)) for i in range(100)]
    base = N.baseline(spark.createDataFrame(base_rows, "feature string, value double"), ["feature"], max_groups=1).cache()
    kind = "day string, feature string, value double"
    write(spark.createDataFrame([("d1", f, v) for f, v in base_rows], kind), tmp_path / "in")
    args = (base, ["day"], str(tmp_path / "out"), str(tmp_path / "ck"))
    jobs.drift_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), *args).awaitTermination()
    write(spark.createDataFrame([("d2", f, v + 80) for f, v in base_rows], kind), tmp_path / "in")
    jobs.drift_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), *args).awaitTermination()
    got = {r["day"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"d1": "stable", "d2": "critical"}


def test_signal_state_stream(spark, tmp_path):
    kind = "user_id int, event_id int, ts timestamp, payload string"
    body = lambda s: '{"signals":{"A":{"signal":"%s","score":1.0}}}' % s
    t0 = dt.datetime(2024, 1, 1)
    write(spark.createDataFrame([(1, 1, t0, body("BUY")), (2, 2, t0, body("HOLD"))], kind), tmp_path / "in")
    for step in range(2):
        jobs.signal_state_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        if step == 0:        # a newer and a late event
            write(spark.createDataFrame([(1, 3, t0 + dt.timedelta(1), body("SELL")), (2, 4, t0 - dt.timedelta(1), body("BUY"))], kind), tmp_path / "in")
    got = {r["user_id"]: r["signal"] for r in jobs.read_signal_state(spark, str(tmp_path / "out")).collect()}
    assert got == {1: "SELL", 2: "HOLD"}


def test_maturation_stream_is_idempotent(spark, tmp_path):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    px = spark.createDataFrame([("A", day(i), 100.0 + i, 1.0) for i in range(12)], "ticker string, dt date, close double, volume double")
    preds = spark.createDataFrame([(1, "m", "p", "A", day(2), 0.5, 3), (2, "m", "p", "A", day(10), 0.5, 3)],
                                  "pred_id int, model_version string, period_key string, ticker string, predicted_at date, prediction double, horizon_days int")
    write(preds, tmp_path / "preds")
    write(px, tmp_path / "px")
    bars_of = lambda s: TS.with_bars(s.read.parquet(str(tmp_path / "px")))
    for run in range(2):
        jobs.maturation_stream(
            spark.readStream.schema(px.schema).parquet(str(tmp_path / "px")), str(tmp_path / "preds"), str(tmp_path / "done"),
            bars_of, F.lit(day(40)), str(tmp_path / f"ck{run}")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "done")).collect()
    assert [(r["pred_id"], round(r["realized_return"], 9)) for r in got] == [(1, round(105 / 102 - 1, 9))]


def test_sinks_and_checkpoints(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1), ("m2", 2)], "model_version string, x int")
    T.append_table(df, str(tmp_path / "t"))
    T.append_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("model_version = 'm1'").count() == 2
    T.write_report(df, str(tmp_path / "r"))
    T.write_report(df.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    assert durable(df).count() == 2 and checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    payload = R.signal_payloads(spark.createDataFrame([("r", "A", "BUY", 61.0)], "run string, ticker string, signal string, composite_score double"), ["run"])
    assert payload.first()["payload"] == '{"signals":{"A":{"signal":"BUY","score":61.0}}}'


def test_alerts_and_dashboard(spark):
    ic = spark.createDataFrame([("m", "p", 0.01, "CRITICAL", 0.2)], "model_version string, ic_period string, rolling_ic double, ic_level string, ic_ratio double")
    drift = spark.createDataFrame([("m", ["a"], ["b"], 0.4)], "model_version string, critical_features array<string>, warning_features array<string>, max_psi double")
    pred = spark.createDataFrame([("m", "p", 0.3, "critical", 0., 1., 0., 0., 0., 0., 0., [1, 2])],
                                 "model_version string, period_key string, psi double, status string, mean double, std double, p5 double, p25 double, p50 double, p75 double, p95 double, counts array<int>")
    assert {(r["level"], r["kind"]) for r in N.alert_rows(ic, drift, pred).collect()} == {("CRITICAL", "ic"), ("CRITICAL", "psi"), ("CRITICAL", "pred_drift")}
    states = N.decide(ic.join(drift, "model_version").withColumns({"prediction_status": F.lit("critical"), "prediction_psi": F.lit(0.3)}))
    feat = spark.createDataFrame([("m", "p0", "a", 0.1, "warning"), ("m", "p1", "a", 0.4, "critical")], "model_version string, period_key string, feature string, psi double, status string")
    roll = spark.createDataFrame([("m", 60, 1, 0.1, 0.1, 1.0, 3)], "model_version string, window int, ts int, ic_mean double, spearman double, ic_ir double, n_obs int")
    text = N.dashboard(feat, pred, roll, states).first()["payload"]
    assert '"status":"retrain","confidence":1.0' in text and '"psi":0.4' in text and '"psi":0.1' not in text


FAST = ["q01_price_panel", "q13_emb_zscore", "q31_prior_signals", "q33_flags", "q44_sector_norm", "q46_paging", "q49_holdings_clean",
        "q52_freshness", "q57_ownership_earnings", "q69_stream_signal_state", "q70_stream_daily_counts", "q17_spearman_ic", "q22_hysteresis_book"]


@pytest.mark.parametrize("name", FAST)
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF), SF, entry_points.queries()[name], entry_points.oracle_sql()[name]) is None


def test_entry_points(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and {"period", "ticker", "model_score", "label"} <= set(df.columns)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(registry.oracle_sql()) == set(registry.queries())      # each of the library's own queries has SQL


def test_no_cross_join_or_single_task_scan(spark):
    """The pooled statistic neither crosses tables nor orders all rows in one partition."""
    from tapeworks.operators import books as B
    df = spark.range(1000).select(F.col("id"), F.rand(1).alias("model_score"), F.rand(2).alias("fwd_ret"))
    plan = B.pooled_ic(durable(df), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert K.FEATURES and "Window" in plan and "bucket_" in plan


def test_every_result_has_its_place(spark, monkeypatch):
    rows = [(f"T{i:04d}", float(i % 700), "HOLD") for i in range(1500)] + [("NONE", None, "HOLD")]
    df = spark.createDataFrame(rows, "ticker string, composite_score double, signal string")
    monkeypatch.setattr(job_queries.M, "results", lambda spark, sf: df)
    got = {r["ticker"]: r["place"] for r in job_queries.q81_ranked_results(spark, "").collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}


def test_payloads_are_dealt_out(spark, monkeypatch):
    rows = [(f"T{i:04d}", float(i), "HOLD") for i in range(1500)]
    df = spark.createDataFrame(rows, "ticker string, composite_score double, signal string")
    most, made = [], R.signal_payloads

    def watched(results, keys):
        most.append(max(r["count"] for r in results.groupBy(*keys).count().collect()))
        return made(results, keys)

    monkeypatch.setattr(signal_queries.M, "results", lambda spark, sf: df)
    monkeypatch.setattr(signal_queries.R, "signal_payloads", watched)
    got = signal_queries.q67_signal_payload(spark, "").collect()
    assert sorted((r["run"], r["ticker"], r["score"]) for r in got) == [("run", t, s) for t, s, _ in rows]
    assert most[0] < 30
