"""Keys cut into ranges and slices give the rows of the plain windows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import asof as J
from tapeworks.operators import ranges as R
from tapeworks.operators import slices as SL
from tapeworks.operators import timeseries as TS


def table(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def hot(spark):
    """4,000 rows of one key next to 2,000 keys of four rows; some keys are null."""
    one = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 7 % 4001).alias("at"))
    many = spark.range(8000).select(F.concat(F.lit("k"), (F.col("id") % 2000).cast("string")).alias("k"), F.col("id").alias("at"))
    none = spark.range(30).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("at"))
    return one.unionByName(many).unionByName(none).repartition(5)


def test_a_hot_key_is_cut_by_its_weight(hot):
    rows = R.cut(hot, ["k"], "at", 100).groupBy("k", "range_").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")).collect()
    of_hot = sorted((r.range_, r.lo, r.hi, r.n) for r in rows if r.k == "hot")
    assert 20 <= len(of_hot) <= 80 and max(n for *_, n in of_hot) < 1000
    assert all(a[2] < b[1] for a, b in zip(of_hot, of_hot[1:]))
    assert sum(r.n for r in rows) == 12030


@pytest.mark.parametrize("ranged", [1, 50, True, 10**6])
def test_numbered(hot, ranged):
    got = {(r.k, r["at"]): r.bar for r in R.numbered(hot, ["k"], "at", "bar", ranged).collect()}
    want, seen = {}, {}
    for r in sorted(hot.collect(), key=lambda r: (str(r.k), r["at"])):
        want[(r.k, r["at"])] = seen.get(r.k, 0)
        seen[r.k] = seen.get(r.k, 0) + 1
    assert got == want


def test_affine_scan(spark):
    rng = random.Random(1)
    maps = [(k, i, rng.uniform(-1, 1), rng.uniform(-5, 5), rng.uniform(-5, 5)) for k, n in (("a", 37), ("b", 1), (None, 8)) for i in range(n)]
    got = R.carry_affine(spark.createDataFrame(maps, "k string, range_ int, f double, x double, y double"), ["k"], "f", ["x", "y"])
    states = {(r.k, r.range_): (r.x, r.y) for r in got.collect()}
    state = {}
    for k, i, f, x, y in maps:
        assert states[(k, i)] == (pytest.approx(state[k]) if k in state else (None, None))
        before = state.get(k, (0.0, 0.0))
        state[k] = (f * before[0] + x, f * before[1] + y)


def asof_tables(spark):
    rng = random.Random(3)
    day = datetime.datetime(2020, 1, 1)
    at = lambda: day + datetime.timedelta(seconds=rng.randrange(5000))
    keys = ["hot"] * 6 + ["b", "c", None]
    probe = [(i, rng.choice(keys), at()) for i in range(1500)] + [(9000, "only probes", day), (9001, "hot", None)]
    ref = {(rng.choice(keys), at()): float(i) for i in range(300)}
    ref[("only refs", day)] = 1.0
    return (spark.createDataFrame(probe, "id long, k string, at timestamp"),
            spark.createDataFrame([(k, t, v, None if v % 5 else "x") for (k, t), v in ref.items()], "k string, at timestamp, v double, w string"))


@pytest.mark.parametrize("ranged", [1, 40, True])
@pytest.mark.parametrize("by", [["k"], []])
def test_asof_in_ranges(spark, by, ranged):
    probe, ref = asof_tables(spark)
    ref = ref if by else J.keep_last(ref, [], "at", ["v", "w"], F.col("v"))
    probe = probe if by else probe.drop("k")
    cols = ["id", *by, "at", "v", "w"]
    plain = table(J.asof_ffill(probe, ref, by, "at", ["v", "w"]), cols)
    assert table(J.asof_ffill(probe, ref, by, "at", ["v", "w"], ranged), cols) == plain
    assert sum(r[-2] is not None for r in plain) > 1000
    events = ref.withColumnRenamed("at", "since")
    cols = ["id", "since", "v"]
    assert table(J.asof_latest(probe, events, by, "at", "since", ["v"], None, ranged), cols) == table(
        J.asof_latest(probe, events, by, "at", "since", ["v"]), cols)
    none = ref.where("v < 0")
    assert {r.v for r in J.asof_ffill(probe, none, by, "at", ["v"], ranged).collect()} == {None}


@pytest.mark.parametrize("ranged", [1, 15, True])
def test_next_bar_in_ranges(spark, ranged):
    rng = random.Random(5)
    day = datetime.date(2020, 1, 1)
    bars = [(t, day + datetime.timedelta(days=3 * i), i, float(i + 1)) for t, n in (("a", 200), ("b", 5)) for i in range(n)]
    asked = [(i, rng.choice(["a", "a", "b", "none"]), day + datetime.timedelta(days=rng.randrange(-5, 700)), rng.randrange(9)) for i in range(300)]
    bars = spark.createDataFrame(bars, "ticker string, dt date, bar long, close double")
    asked = spark.createDataFrame(asked, "id int, ticker string, at date, ahead int")
    cols = ["id", "start_bar", "p0", "p1"]
    assert table(J.asof_next_bar(asked, bars, "at", "ahead", ranged), cols) == table(J.asof_next_bar(asked, bars, "at", "ahead"), cols)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(9)
    day = datetime.date(1950, 1, 1)
    rows = []
    for t, n in (("long", 9300), ("short", 40), ("one", 1), ("edge", 1008)):
        price = 100.0
        for i in range(n):
            price = max(0.5, price + rng.choice([-1.5, -0.25, 0.0, 0.25, 1.5]))
            rows.append((t, day + datetime.timedelta(days=i), price, float(rng.randrange(1000))))
    return spark.createDataFrame(rows, "ticker string, dt date, close double, volume double").repartition(3)


@pytest.mark.parametrize("rule,size", [("snapshot", 1008), ("panel", 252), ("label", 252), ("backtest", SL.SLICE_BARS)])
def test_sliced_features(series, rule, size):
    whole = TS.price_features(TS.with_bars(series), rule)
    parts = SL.price_features(SL.with_bars(series), rule, size)
    assert sorted(parts.columns) == sorted(whole.columns)
    want = {(r.ticker, r.bar): r for r in whole.collect()}
    got = parts.collect()
    assert len(got) == len(want) == 10349
    for r in got:
        w = want[(r.ticker, r.bar)]
        for c in whole.columns:
            # the digits given are compared: sums that start elsewhere differ far behind them
            assert r[c] == w[c] or (c in ("vol_60d", "rsi_14") and r[c] == pytest.approx(w[c], abs=0.0101 if c == "rsi_14" else 2e-6)), (c, r, w)


def test_a_series_runs_in_many_tasks(series):
    rows = SL.sliced(SL.with_bars(series), 252)
    sizes = [r.n for r in rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 252 + SL.HALO and len(sizes) > 40
    with pytest.raises(ValueError):
        SL.sliced(series, 100)
