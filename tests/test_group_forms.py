"""Cross-sectional operators give the same rows in both plans, whatever the keys, ids and values."""

import math

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import cross_section as X
from tapeworks.operators import ordering as O
from tapeworks.operators import timeseries as TS
from tapeworks.sources import prices as P

ROWS = [("a", "x", 1.0, 5.0), ("a", "x", 1.0, 5.0), ("a", None, 3.0, None), ("a", "y", 2.0, 5.0), (None, "x", 4.0, 1.0),
        (None, None, 5.0, 2.0), (None, "z", 4.0, None), ("b", "x", None, None), ("c", "q", 7.0, 7.0), ("a", "w", 1.0, 9.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k string, id string, v double, w double")


def table(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("spread", [True, 3])
def test_average_ranks(rows, spread):
    cols = ["k", "id", "v", "w", "v_rank", "w_rank"]
    plain = O.average_ranks(rows, ["k"], ["id"], ["v", "w"], spread=False)
    large = O.average_ranks(rows, ["k"], ["id"], ["v", "w"], spread=spread)
    assert table(plain, cols) == table(large, cols)
    assert table(X.pct_ranks(rows, ["k"], ["id"], ["v", "w"], spread=False), cols) == table(
        X.pct_ranks(rows, ["k"], ["id"], ["v", "w"], spread=spread), cols)


@pytest.mark.parametrize("order", [{"v": True, "id": True}, {"v": False, "id": True}])
def test_row_numbers(rows, order):
    plain = O.row_numbers(rows, ["k"], order, spread=False)
    large = O.row_numbers(rows, ["k"], order, spread=True)
    assert large.count() == len(ROWS)
    assert table(plain, ["k", "id", "v", "rn"]) == table(large, ["k", "id", "v", "rn"])


def test_percentiles_fills_and_labels(rows):
    for keys in (["k"], []):
        for fn in (lambda s: X.winsorise(rows, keys, ["v", "w"], spread=s, low=0.1, high=0.9),  # noqa: B023
                   lambda s: X.median_fill(rows, keys, ["v", "w"], spread=s),  # noqa: B023
                   lambda s: X.median_labels(rows, keys, spread=s, inclusive=True, value="v")):  # noqa: B023
            plain, large = fn(False), fn(True)
            assert plain.count() == len(ROWS)
            assert table(plain, sorted(plain.columns)) == table(large, sorted(plain.columns))


def test_one_infinite_bar_leaves_later_bars_alone(spark):
    closes = [100 + 10 * math.sin(i / 7) for i in range(400)]
    bad = {50: float("inf"), 60: float("nan")}
    make = lambda skip: spark.createDataFrame(
        [("T", i, bad.get(i, c) if not skip else c, 1.0) for i, c in enumerate(closes) if not (skip and i in bad)],
        "ticker string, i int, close double, volume double").withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    feats = [table(TS.price_features(TS.with_bars(P.clean_prices(make(s)).drop("i")), "snapshot"), ["dt", "vol_60d", "rsi_14", "price_vs_52w_high"])
             for s in (False, True)]
    assert feats[0] == feats[1]
    assert all(v is None or math.isfinite(v) for r in feats[0] for v in r[1:])
