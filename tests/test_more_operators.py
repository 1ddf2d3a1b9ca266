"""Channel windows by spec, holdings compared in any spelling, gates, states as of a period, panels per series."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks import constants as K
from tapeworks.operators import labels as L
from tapeworks.operators import monitoring as N
from tapeworks.operators import ordering as O
from tapeworks.operators import portfolio as D
from tapeworks.operators import timeseries as TS
from tapeworks.session import checkpoint_dir

SPEC = [*K.BASE_CHANNELS, *K.MARKET_CHANNELS, *K.EVENT_CHANNELS, "unheard_of"]


def bars(spark, n=300, tickers=("A",)):
    rng = np.random.default_rng(4)
    rows = []
    for t in tickers:
        close = 50 * np.cumprod(1 + rng.normal(0, 0.02, n))
        market = 90 * np.cumprod(1 + rng.normal(0, 0.01, n))
        for i in range(n):
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(i), i, float(close[i]), float(rng.integers(0, 5)), float(market[i]), i / n))
    return spark.createDataFrame(rows, "ticker string, dt date, bar bigint, close double, volume double, market_close double, pulse double"), rows


def test_window_channels(spark):
    df, rows = bars(spark)
    out = TS.window_channels(TS.window_rows(df), SPEC)
    assert out.columns == ["ticker", "end_bar", "bar", *SPEC]
    got = {(r["end_bar"], r["bar"]): r for r in out.collect()}
    assert {e for e, _ in got} == {252, 273, 294}
    for end in (252, 294):
        cut = rows[end - 252: end + 1]
        c, v, m = (np.array([r[k] for r in cut]) for k in (3, 4, 5))
        ret, mret, v = np.diff(np.log(c)), np.diff(np.log(m)), v[1:]
        for j in (0, 1, 5, 19, 20, 251):
            r, last = got[(end, end - 251 + j)], slice(max(0, j - 19), j + 1)
            med = np.median(v[last])
            want = [ret[j], ret[last].std() if j else 0.0, math.log(v[j] / med) if v[j] > 0 and med > 0 else 0.0,
                    math.log(c[j + 1] * v[j]) if v[j] > 0 else 0.0, ret[j] - mret[j], 0.0, cut[j + 1][6], 0.0, 0.0]
            assert [r[x] for x in SPEC] == pytest.approx(want, abs=1e-12)


def test_encoder_must_keep_its_length(spark):
    df, _ = bars(spark, 260)
    rows = TS.base_window_channels(TS.window_rows(df.select("ticker", "dt", "bar", "close")))
    good = TS.encoded_windows(rows, K.BASE_CHANNELS, lambda m: m.mean(axis=0), 2).collect()
    assert len(good[0]["embedding"]) == 2
    with pytest.raises(Exception, match="the encoder gave shape"):
        TS.encoded_windows(rows, K.BASE_CHANNELS, lambda m: m.mean(axis=0), 3).collect()


def test_held_names_in_any_spelling(spark):
    cands = spark.createDataFrame([("AAPL", K.SECTORS[0], 90.0, "BUY"), ("MSFT", K.SECTORS[0], 80.0, "BUY"), ("XOM", K.SECTORS[1], 70.0, None)],
                                  "ticker string, sector string, composite_score double, signal string")
    held = spark.createDataFrame([(1, " aapl", K.SECTORS[2], 5.0), (1, "msft", K.SECTORS[2], 5.0)], "portfolio_id int, ticker string, sector string, weight double")
    assert [r["ticker"] for r in D.exclude_held(cands, held, ["ticker"]).collect()] == ["XOM"]
    picks = D.recommend_additions(D.composition(held), held.select("portfolio_id", "ticker"), cands).collect()
    assert [r["ticker"] for r in picks] == ["XOM"]
    report = D.holdings_report(held, cands).collect()
    assert {(r["section"], r["item"]) for r in report} >= {("holding", "AAPL"), ("holding", "MSFT"), ("sector", K.SECTORS[2]), ("addition", "XOM")}


def test_candidate_gates(spark):
    rows = spark.createDataFrame([(f"T{i}", 59 + (i > 2)) for i in range(12)], "ticker string, bars int")
    assert D.eligible(rows).count() == 0 and D.eligible(rows, min_names=9).count() == 9


def test_state_as_of(spark):
    rows = spark.createDataFrame([("2000-Q1", 1), ("2000-Q3", 2), ("2001-Q1", 3)], "q string, x int")
    events = spark.createDataFrame([("2000-Q2", 1, "old"), ("2000-Q3", 2, "mid"), ("2000-Q3", 3, "new")], "q string, at int, s string").select(
        "q", F.struct("at").alias("at"), F.struct("s").alias("state"))
    got = {r["q"]: r["s"] for r in N.as_of(rows, events, "q", "at", "state").collect()}
    assert got == {"2000-Q1": None, "2000-Q3": "new", "2001-Q1": "new"}


def test_panel_until(spark):
    long, _ = bars(spark, 700, ("A", "B"))
    short = long.filter("ticker = 'B' AND bar < 360").unionByName(long.filter("ticker = 'A'"))
    both = {u: {r["ticker"]: r["n"] for r in L.period_panel(short, until=u).groupBy("ticker").agg(F.count("*").alias("n")).collect()}
            for u in ("shortest", "own")}
    assert both["shortest"] == {"A": 1, "B": 1} and both["own"] == {"A": 7, "B": 1}
    with pytest.raises(ValueError):
        L.period_panel(short, until="later")


def test_measured_broadcast(spark):
    small = spark.range(3)
    assert "Broadcast" in spark.range(10).join(O.checked_broadcast(small), "id")._jdf.queryExecution().executedPlan().toString()
    assert O.checked_broadcast(small, max_bytes=1).count() == 3


def test_shared_folder_is_asked_for_off_local(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
