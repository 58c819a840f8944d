"""Hand-computed cases of features, score, levels, exits, fees and sizing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tapeline.functions import features as ft
from tapeline.params import Params

DAY = dt.date(2026, 1, 5)


def bars(spark, closes, volumes=None, spread=1.0, ticker="X"):
    rows = [(ticker, DAY + dt.timedelta(days=i), c, c + spread / 2, c - spread / 2, float(c), float((volumes or [1e6] * len(closes))[i])) for i, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def last(df):
    return df.orderBy(F.desc("date")).first()


def test_return_lags_differ_by_one_bar(spark):
    row = last(ft.features(bars(spark, [100 + 2 * i for i in range(21)])))
    assert row.r20_19 == pytest.approx((140 - 102) / 102 * 100, abs=1e-6)
    assert row.r20_20 == pytest.approx(40.0)


def test_short_history_counts_nothing(spark):
    row = last(ft.features(bars(spark, [100, 110, 120])))
    assert (row.r5, row.r20_19, row.r20_20, row.atr) == (0.0, 0.0, 0.0, None)
    assert last(ft.features(bars(spark, [100]))).volume_ratio == 1.0


def test_full_score(spark):
    closes, volumes = [100 + 2.5 * i for i in range(45)], [1e6] * 44 + [2.5e6]
    row = last(ft.features(bars(spark, closes, volumes)).withColumns(ft.score()))
    assert (row.r5_pts, row.r20_pts, row.volume_pts, row.ma_pts, row.score) == (20, 20, 30, 30, 100)
    flat = last(ft.features(bars(spark, [100] * 30)).withColumns(ft.score()))
    assert flat.score == 0


@pytest.mark.parametrize(("spread", "share"), [(0.05, 0.05), (50, 0.08)])
def test_stop_distance_is_clamped(spark, spread, share):
    closes = [100 + (0.01 if spread < 1 else 3) * i for i in range(30)]
    row = last(ft.features(bars(spark, closes, spread=spread)).withColumns(ft.levels()))
    assert row.sl == pytest.approx(row.entry * (1 - 2 * share), rel=1e-6)
    assert row.tp1 == pytest.approx(row.entry * (1 + share / 2), rel=1e-6)


@pytest.mark.parametrize(
    ("o", "h", "low", "c", "held", "reason", "price"),
    [
        (106, 107, 104, 106, 1, "TP_GAP", 106),
        (89, 95, 88, 92, 1, "SL_GAP", 89),
        (100, 106, 89, 95, 1, "STOP_LOSS", 90),
        (100, 106, 95, 101, 1, "TAKE_PROFIT_1", 105),
        (100, 104, 95, 101, 10, "TIME_EXIT", 101),
        (100, 104, 95, 101, 9, None, None),
    ],
)
def test_exit_order(spark, o, h, low, c, held, reason, price):
    df = spark.createDataFrame([(float(o), float(h), float(low), float(c), held, 90.0, 105.0)], "open double, high double, low double, close double, bars_held long, sl double, tp1 double")
    why, at = ft.exit_event("")
    assert tuple(df.select(why, at).first()) == (reason, price)


def test_fees_and_rounding(spark):
    one = spark.range(1)
    got = one.select(*[ft.fee(F.lit(x), side, p) for x, side in ((10_000.0, "buy"), (10_600.0, "sell")) for p in ("PROD_FLAT", "AJAIB_EXACT")]).first()
    assert tuple(got) == pytest.approx((20.0, 15.0, 21.2, 27.0))
    assert tuple(one.select(*[ft.round_half_up(F.lit(x)) for x in (2.5, -2.5, 151.303)]).first()) == (3, -2, 151)


def test_position_size(spark):
    cases = [(12e6, 9e6, 200.0), (30e6, 5e6, 200.0), (3e5, 3e5, 5000.0), (1e6, 1e6, 0.0)]
    got = [spark.range(1).select(ft.position_size(*map(F.lit, c))).first()[0] for c in cases]
    assert got == [20000, 24500, 0, 0]


def test_ohlc_violation_skips_unknown_prices(spark):
    rows = [(1.0, 2.0, 0.5, None), (1.0, 0.4, 0.5, 1.0), (1.0, 1.0, 1.0, 1.0), (-1.0, -1.0, -1.0, -1.0)]
    df = spark.createDataFrame(rows, "open double, high double, low double, close double")
    assert [r[0] for r in df.select(ft.ohlc_violation(Params())).collect()] == [False, True, False, True]
