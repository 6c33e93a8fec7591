"""Point-in-time features: look-ahead, determinism, plans and small cases with known answers."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.operators import features as T
from granary.operators import labels as L

SETS = {"core_20": T.core_20, "price_48": T.price_48, "candidate_v2": T.candidate_v2,
        "vol_35": T.vol_35, "vol_38": T.vol_38}
D0 = dt.date(2024, 1, 1)


def series(spark, prices, offsets=None, market="M", variety="V"):
    offsets = offsets if offsets is not None else range(len(prices))
    rows = [("rice", market, variety, D0 + dt.timedelta(days=int(o)), p - 10.0, p + 10.0, float(p), 100.0 + 2 * i)
            for i, (p, o) in enumerate(zip(prices, offsets))]
    return spark.createDataFrame(rows, "commodity string, market string, variety string, reported_date date, "
                                       "min_price double, max_price double, modal_price double, arrivals double")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("market", "variety", "reported_date").collect()]


@pytest.mark.parametrize("name", SETS)
def test_future_prices_do_not_change_features(spark, name):
    prices = [2500 + 15 * (i % 6) for i in range(45)]
    poisoned = prices[:35] + [99999] * 10
    a = SETS[name](series(spark, prices)).filter(F.col("reported_date") < D0 + dt.timedelta(days=35))
    b = SETS[name](series(spark, poisoned)).filter(F.col("reported_date") < D0 + dt.timedelta(days=35))
    assert rows(a, *a.columns) == rows(b, *a.columns)


@pytest.mark.parametrize("name", SETS)
def test_row_order_does_not_matter(spark, name):
    df = series(spark, [2500 + 15 * (i % 6) + i for i in range(40)])
    a, b = SETS[name](df), SETS[name](df.orderBy(F.rand(3)).repartition(5))
    assert rows(a, *a.columns) == rows(b, *a.columns)


@pytest.mark.parametrize("name", SETS)
def test_series_stay_apart(spark, name):
    one = series(spark, [2000 + i for i in range(40)], market="A")
    both = one.unionByName(series(spark, [9000 - 7 * i for i in range(40)], market="B"))
    a = SETS[name](one)
    assert rows(a, *a.columns) == rows(SETS[name](both).filter("market = 'A'"), *a.columns)


@pytest.mark.parametrize("name", SETS)
def test_one_exchange_per_feature_set(spark, name):
    plan = SETS[name](series(spark, range(100, 140)))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange", plan)) == 1


def test_windows_need_all_values(spark):
    out = T.add(series(spark, range(1, 11)), T.rolling_mean((7,)), T.rolling_std((7,)))
    got = rows(out, "rolling_mean_7", "rolling_std_7")
    assert [g[0] for g in got] == [None] * 7 + [4.0, 5.0, 6.0]
    assert got[7][1] == pytest.approx(2.1602468994)


def test_slope_of_a_line(spark):
    out = T.add(T.price_sums(series(spark, [100 + 3 * i for i in range(35)])), T.trend_slope())
    assert rows(out, "trend_slope_30")[-1][0] == pytest.approx(3.0)
    assert rows(out, "trend_slope_30")[28][0] is None


def test_ewma_matches_the_recursion(spark):
    p = [100.0, 110.0, 90.0, 130.0]
    got = [r[0] for r in rows(T.ewma(series(spark, p), [("e", "modal_price", 5, False)]), "e")]
    want, e = [], None
    for x in p:
        e = x if e is None else x / 3 + e * 2 / 3
        want.append(e)
    assert got == pytest.approx(want)


def test_streaks(spark):
    df = series(spark, [10, 10, 10, 11, 12, 12, 11, 11, 11])
    df = df.withColumn("price_change_1", F.col("modal_price") - F.lag("modal_price").over(T.series_window()))
    df = T.add(df, T.move_flags(False), T.row_numbers())
    df = T.add(df, {"z": T.streak(F.col("_flat") == 1), "p": T.streak(F.col("_pos") == 1)})
    # the first row is neither flat nor a move
    assert rows(df, "z") == [(x,) for x in (0, 1, 2, 0, 0, 1, 0, 1, 2)]
    assert rows(df, "p") == [(x,) for x in (0, 0, 0, 1, 2, 0, 0, 0, 0)]


def test_forward_window_cases(spark):
    # reports on days 0, 5, 14, 16, 31, 33, 60
    df = series(spark, [2000, 2010, 2050, 2060, 2100, 2110, 2200], [0, 5, 14, 16, 31, 33, 60])
    got = rows(L.dual_horizon_targets(df), "future_price_14d", "target_change_14d", "actual_days_14d", "future_price_30d")
    assert got[0] == (2050.0, 50.0, 14, 2100.0)
    assert got[1] == (None, None, None, None)
    assert got[-1] == (None, None, None, None)


@pytest.mark.parametrize("tie,day", [("forward", 16), ("backward", 14)])
def test_nearest_target_ties(spark, tie, day):
    df = series(spark, [100, 140, 160], [0, 13, 15])
    got = rows(L.nearest_calendar_target(df, 14, 3, tie), "target_date", "offset_error")[0]
    assert got == (dt.date(2024, 1, day), 1 if tie == "forward" else -1)


def test_nearest_target_outside_the_window(spark):
    df = series(spark, [100, 110, 120, 130], [0, 3, 8, 20])
    near = rows(L.nearest_calendar_target(df, 7, 3), "target_date", "actual_offset", "target_change")[0]
    assert near == (dt.date(2024, 1, 9), 8, 20.0)
    far = rows(L.nearest_calendar_target(df, 30, 3), "target_date")
    assert far == [(None,)] * 4


def test_forward_range_skips_bad_prices(spark):
    df = series(spark, [100, 0, 150, 90], [0, 1, 2, 20])
    got = rows(L.forward_calendar_range(df, 7), "future_obs_count_7d", "future_pct_range_7d")
    assert got[0][0] == 1 and got[0][1] == pytest.approx(50.0, rel=1e-5)
    assert got[1] == (0, None) and got[3] == (0, None)


def test_thresholds_reject_sparse_data(spark):
    df = spark.createDataFrame([(0.0,)] * 50 + [(5.0,)] * 4, "r double")
    with pytest.raises(Exception, match="too few"):
        L.thresholds_quantile_or_zero_aware(df, "r").collect()


def test_ewma_equals_pandas_with_gaps(spark):
    import pandas as pd
    draw = random.Random(3)
    p = [draw.choice([None, None, float("nan"), 5.0, 2000.5, 0.0, 1e-3]) if i % 3 else 100 + 50 * math.sin(i / 9) for i in range(1200)]
    p[:4] = [None, float("nan"), 7.0, None]
    specs = [(f"e{s}{a}", "modal_price", s, a) for s in (5, 14, 30) for a in (True, False)]
    df = series(spark, [0.0] * len(p)).drop("modal_price").join(spark.createDataFrame(
        [(D0 + dt.timedelta(days=i), x) for i, x in enumerate(p)], "reported_date date, modal_price double"), "reported_date")
    want = {n: pd.Series([float("nan") if x is None else x for x in p]).ewm(span=s, adjust=a).mean() for n, _, s, a in specs}

    def check():
        out = T.ewma(df, specs)
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        for n, *_ in specs:
            got = [r[0] for r in rows(out, n)]
            assert all((g is None) == (w != w) and (g is None or g == pytest.approx(w, rel=1e-10, abs=1e-12)) for g, w in zip(got, want[n], strict=True))
    check()


def test_slopes_need_whole_frames(spark):
    p = [100.25 + (i * 7919 % 13) / 4 for i in range(60)]
    p[20] = None
    df = series(spark, [x or 0.0 for x in p])
    df = df.withColumn("modal_price", F.when(F.col("reported_date") != D0 + dt.timedelta(days=20), F.col("modal_price")))
    out = T.add(T.price_sums(df), T.trend_slope())
    for n in (7, 14, 30):
        got = [r[0] for r in rows(out, f"trend_slope_{n}")]
        for t in range(60):
            frame = p[t - n + 1:t + 1] if t >= n - 1 else [None]
            if None in frame:
                assert got[t] is None
            else:
                centre = (n - 1) / 2
                assert got[t] == pytest.approx(sum((i - centre) * x for i, x in enumerate(frame)) / sum((i - centre) ** 2 for i in range(n)), abs=1e-9)
