"""Distributed statistics, sources, cleaning, upserts and ledgers on small inputs."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions.distributed import exact_quantiles, first_by, running_by_value
from granary.functions.scalars import classify3, parse_dates, parse_double
from granary.operators import cleaning as C
from granary.operators import ledger as K
from granary.operators import metrics as M
from granary.operators import monitoring as O
from granary.operators import upserts as U
from granary.sources import tables as S

OBS = "commodity string, market string, variety string, reported_date date, modal_price double, arrivals double"


def obs(spark, items):
    rows = [("rice", m, "V", dt.date.fromisoformat(d), float(p), 1.0) for m, d, p in items]
    return spark.createDataFrame(rows, OBS)


# --- statistics -----------------------------------------------------------------------

def test_exact_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    hot = np.concatenate([np.full(700, 7.25), rng.normal(0, 1e4, 1300), rng.random(200) * 1e-3])
    cold = rng.normal(5, 2, 31)
    df = spark.createDataFrame([("hot", float(x)) for x in hot] + [("cold", float(x)) for x in cold], "k string, x double")
    got = {r["k"]: r for r in exact_quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.975}, ["k"]).collect()}
    for k, values in (("hot", hot), ("cold", cold)):
        assert [got[k][c] for c in "abc"] == pytest.approx(np.quantile(values, [0.1, 0.5, 0.975]))


def test_running_sums_by_value(spark):
    df = spark.createDataFrame([(3.0, 1), (1.0, 2), (3.0, 4), (-2.0, 8)], "v double, n int")
    up = {r["v"]: (r["n"], r["n_before"], r["n_total"]) for r in running_by_value(df, "v", {"n": F.col("n")}).collect()}
    assert up == {-2.0: (8, 0, 15), 1.0: (2, 8, 15), 3.0: (5, 10, 15)}
    down = {r["v"]: r["n_before"] for r in running_by_value(df, "v", {"n": F.col("n")}, descending=True).collect()}
    assert down == {3.0: 0, 1.0: 5, -2.0: 7}


def test_first_by_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    out = first_by(df, ["k"], ["v"], keep_last=True)
    assert {(r["k"], r["v"]) for r in out.collect()} == {(0, 99), (1, 97), (2, 98)}
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_wilcoxon_and_t_statistics(spark):
    a = [1.0, 2.0, 3.0, 5.0, 5.0, 9.0]
    b = [2.0, 2.0, 1.0, 1.0, 4.0, 5.0]
    frame = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    r = M.paired_tests(frame, "a", "b", zeros="wilcox", least_nonzero=1).first()
    d = np.array(a) - np.array(b)
    assert r["t_statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / np.sqrt(6)))
    assert (r["w_plus"], r["w_minus"]) == (13.5, 1.5)
    pratt = M.paired_tests(frame, "a", "b", least_nonzero=1).first()
    assert (pratt["w_plus"], pratt["w_minus"]) == (17.5, 2.5)  # the zero takes rank 1
    few = M.paired_tests(frame, "a", "b").first()
    assert few["wilcoxon_p_value"] is None and few["wilcoxon_statistic"] is None and few["t_p_value"] == r["t_p_value"]
    up, down = (M.paired_tests(frame, "a", "b", alternative=x, least_nonzero=1).first() for x in ("greater", "less"))
    assert up["t_p_value"] == pytest.approx(r["t_p_value"] / 2) and down["t_p_value"] == pytest.approx(1 - r["t_p_value"] / 2)
    assert up["wilcoxon_p_value"] + down["wilcoxon_p_value"] == pytest.approx(1)
    same = M.paired_tests(frame.selectExpr("a", "a AS b"), "a", "b", alternative="greater").first()
    assert (same["t_p_value"], same["wilcoxon_p_value"]) == (1.0, 1.0)


def test_student_tail(spark):
    # two-sided critical values of the published table
    table = [(12.7062047, 1, 0.05), (4.3026527, 2, 0.05), (3.1824463, 3, 0.05), (2.0638986, 24, 0.05), (2.7969395, 24, 0.01),
             (2.0595386, 25, 0.05), (1.9839715, 100, 0.05), (1.9623391, 1000, 0.05), (1.9611508, 2000, 0.05), (1.9611502, 2001, 0.05), (0.0, 7, 1.0)]
    df = spark.createDataFrame(table, "t double, f long, p double")
    for r in df.select("p", (2 * M.student_tail(F.col("t"), F.col("f"))).alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-6)
    assert spark.range(1).select(M.student_tail(F.lit(1.0), F.lit(0))).first()[0] is None


def test_precision_recall_with_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)], "s double, y int")
    r = M.precision_recall_areas(df, F.col("y") == 1, "s").first()
    assert r["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)


def test_class_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (2.1,), (6.0,), (6.1,), (None,)], "x double")
    assert [r[0] for r in df.select(classify3(F.col("x"), 2.0, 6.0)).collect()] == [
        "LOW", "LOW", "MEDIUM", "MEDIUM", "HIGH", None]


# --- parsing and cleaning -----------------------------------------------------------------

def test_mixed_dates(spark):
    good = ["2024-03-05", "05/03/2024", "5 Mar 2024", "2024-03-05 00:00:00", "2024-03-05T23:59:59.123Z", "2024-3-5", "2024/03/05", "05-Mar-2024",
            "5 March 2024", "Mar 5, 2024", "March 5 2024", "05/03/24", "5.3.2024", "20240305", " 5-3-2024 14:30 ", "2024-03-05T10:00:00+05:30", "5mar2024"]
    bad = ["garbage", "", None, "2024-02-30", "31/04/2024", "2024-13-01", "5 Foo 2024", "2024", "12:30", "2024-03-05 25:00", "1/2/3/2024"]
    df = spark.createDataFrame([(t,) for t in good + bad], "d string")
    got = [r[0] for r in df.select(parse_dates(F.col("d"))).collect()]
    assert got == [dt.date(2024, 3, 5)] * len(good) + [None] * len(bad)
    assert spark.createDataFrame([("01/02/69",)], "d string").select(parse_dates(F.col("d"))).first()[0] == dt.date(1969, 2, 1)


def test_number_sentinels(spark):
    texts = ["2200", " -50 ", "1.5e3", "N/A", "nan", "inf", "-", "?", "", None, "12abc", "1d", "1e100", "1.7e-120", "1e999", "0x1p3", ".5", "7."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_double(F.col("t"))).collect()] == [
        2200.0, -50.0, 1500.0, *[None] * 9, 1e100, 1.7e-120, None, None, 0.5, 7.0]


def raw(spark, rows):
    cols = "commodity string, market string, variety string, reported_date string, modal_price string, arrivals string"
    return spark.createDataFrame(rows, cols)


def test_batch_rejects_and_maps(spark):
    df = raw(spark, [("rice", " bardhaman ", "swarna", "2024-03-15", "2200", None),
                     ("rice", "Burdwan", "Other", "15/03/2024", "2300", "-3"),
                     ("rice", "Nowhere", "Jyoti", "2024-03-15", "100", "5"),
                     ("rice", "Kalna", "Fine", "2024-03-15", "0", "5"),
                     ("rice", "Kalna", "Fine", "bad", "10", "5")])
    got = {(r["market"], r["variety"]): (r["modal_price"], r["arrivals"]) for r in C.normalize_batch(df).collect()}
    # both spellings are one key, the later value wins; unknown names stay as they are
    assert got == {("Burdwan", "Other"): (2300.0, 0.0), ("Nowhere", "Jyoti"): (100.0, 5.0)}
    a = C.batch_audit(df).first()
    assert (a["raw_rows"], a["accepted"], a["rejected_dates"], a["rejected_prices"], a["duplicates"], a["unmapped_markets"]) == (
        5, 2, 1, 1, 1, 1)


@pytest.mark.parametrize("text,want", [("BURDWAN", "Bardhaman"), ("north 24-parganas", "North 24 Parganas"), ("?", "Unknown"),
                                       (None, "Unknown"), ("Atlantis", "Atlantis"), (" hugli", "Hooghly")])
def test_districts(spark, text, want):
    df = spark.createDataFrame([(text,)], "district string")
    assert C.normalize_district(df).first()["district"] == want


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "market int")
    with pytest.raises(ValueError, match="variety, modal_price"):
        S.require_columns(df, ["market", "variety", "modal_price"])
    assert S.require_columns(df, ["market"]).first()["arrivals"] == 0.0


def test_leaking_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, future_price double")
    with pytest.raises(ValueError, match="future_price"):
        C.model_ready_rows(df, ["a", "future_price"], "a2", ["future_price"])


def test_missing_days_are_never_filled(spark):
    df = raw(spark, [("rice", "Kalna", "Fine", "2024-03-01", "10", "1"), ("rice", "Kalna", "Fine", "2024-03-09", "12", "1")])
    assert C.normalize_batch(df).count() == 2


# --- sources ---------------------------------------------------------------------------------

def test_csv_files_take_the_commodity_from_the_folder(spark, tmp_path):
    from granary.schemas import RAW_OBSERVATION
    head = ",".join(RAW_OBSERVATION.names)
    for crop in ("rice", "wheat"):
        (tmp_path / crop).mkdir()
        (tmp_path / crop / "a.csv").write_text(f"{head}\nWB,Nadia,Kalna,Fine,Cereals,3,90,110,100,02 Jan 2024\n")
    df = S.typed_observations(S.normalize_columns(S.read_observations(spark, f"{tmp_path}/*/*.csv"), keep=["commodity"]))
    got = sorted((r["commodity"], r["market"], r["modal_price"], r["reported_date"]) for r in df.collect())
    assert got == [("rice", "Kalna", 100.0, dt.date(2024, 1, 2)), ("wheat", "Kalna", 100.0, dt.date(2024, 1, 2))]


def test_weather_json(spark, tmp_path):
    doc = {"properties": {"parameter": {"T2M": {"20200101": 20.5, "20200102": -999}, "PRECTOTCORR": {"20200101": 1.0}}}}
    (tmp_path / "nadia.json").write_text(json.dumps(doc, indent=1))
    got = {r["date"].day: (r["district"], r["t2m"], r["precip"]) for r in S.read_weather_json(spark, f"{tmp_path}/*.json").collect()}
    assert got == {1: ("nadia", 20.5, 1.0), 2: ("nadia", None, None)}


# --- upserts ------------------------------------------------------------------------------------

def test_upserts_are_idempotent(spark):
    target = obs(spark, [("A", "2024-01-01", 10)])
    batch = obs(spark, [("A", "2024-01-01", 11), ("A", "2024-01-02", 12), ("A", "2024-01-02", 9)])
    once = U.upsert_keep_first(target, batch)
    assert sorted((r["reported_date"].day, r["modal_price"], r["_inserted"]) for r in once.collect()) == [
        (1, 10.0, False), (2, 9.0, True)]
    twice = U.upsert_keep_first(once.drop("_inserted"), batch)
    assert twice.filter("_inserted").count() == 0
    c = U.upsert_counts(once, batch).first()
    assert (c["inserted"], c["duplicates"], c["total"]) == (1, 2, 2)


def test_last_value_wins_and_creation_time_stays(spark):
    day = lambda s: F.lit(s).cast("date")
    target = obs(spark, [("A", "2024-01-01", 10)]).withColumn("created_at", day("2024-01-05"))
    batch = obs(spark, [("A", "2024-01-01", 11)]).withColumn("created_at", day("2024-02-05"))
    r = U.upsert_last_wins(target, batch, ["modal_price", "arrivals"]).first()
    assert (r["modal_price"], r["created_at"]) == (11.0, dt.date(2024, 1, 5))


# --- ledgers ------------------------------------------------------------------------------------

def history(spark, n=40, market="A"):
    d0 = dt.date(2024, 1, 1)
    return obs(spark, [(market, (d0 + dt.timedelta(days=i)).isoformat(), 100 + i) for i in range(n)])


def test_price_forecast_life_cycle(spark):
    hist = history(spark)
    ledger = K.generate_price_forecasts(hist, ["2024-02-09"])
    assert {(r["horizon"], r["window_start"], r["window_end"], r["status"]) for r in ledger.collect()} == {
        (14, dt.date(2024, 2, 23), dt.date(2024, 2, 26), "PENDING"), (30, dt.date(2024, 3, 10), dt.date(2024, 3, 13), "PENDING")}
    assert K.generate_price_forecasts(hist, ["2024-02-09"], existing=ledger).count() == 0
    # nothing reported past the window: still pending
    assert {r["status"] for r in K.resolve_price_outcomes(ledger, hist).collect()} == {"PENDING"}
    # the series went on without a report in the 14-day window
    later = hist.unionByName(obs(spark, [("A", "2024-03-01", 150)]))
    step = K.resolve_price_outcomes(ledger, later)
    assert {(r["horizon"], r["status"]) for r in step.collect()} == {(14, "TARGET_UNAVAILABLE"), (30, "PENDING")}
    # a late report is only seen when asked to look again
    late = later.unionByName(obs(spark, [("A", "2024-02-24", 160), ("A", "2024-02-25", 170)]))
    assert K.resolve_price_outcomes(step, late).filter("status = 'EVALUATED'").count() == 0
    done = K.resolve_price_outcomes(step, late, recheck=True).filter("status = 'EVALUATED'").collect()
    assert [(r["horizon"], r["actual_price"], r["actual_offset"], r["abs_error"], r["reason"]) for r in done] == [
        (14, 160.0, 15, 21.0, "late observation")]


def test_short_series_get_no_forecast(spark):
    assert K.generate_price_forecasts(history(spark, 29), ["2024-02-09"]).count() == 0


def test_volatility_windows(spark):
    hist = history(spark)
    ledger = K.generate_volatility_forecasts(hist, hist, "2024-02-09", 2.0, 6.0)
    row = ledger.first()
    assert row["p_low"] + row["p_medium"] + row["p_high"] == pytest.approx(1.0)
    assert K.generate_volatility_forecasts(hist, hist, "2024-02-10").count() == 0
    empty = K.resolve_volatility_outcomes(ledger, hist, "2024-02-23").first()
    assert (empty["status"], empty["matched_trades"]) == ("WINDOW_EMPTY", 0)
    assert K.resolve_volatility_outcomes(ledger, hist, "2024-02-22").first()["status"] == "PENDING"
    traded = hist.unionByName(obs(spark, [("A", "2024-02-12", 150), ("A", "2024-02-13", 120)]))
    r = K.resolve_volatility_outcomes(ledger, traded, "2024-02-23", 2.0, 6.0).first()
    assert (r["status"], r["matched_trades"], r["actual_min"], r["actual_max"], r["actual_class"]) == (
        "EVALUATED", 2, 120.0, 150.0, "HIGH")


def test_stale_batches_issue_nothing(spark):
    stored = history(spark)
    batch = raw(spark, [("rice", "A", "V", "2024-02-10", "140", "1")])
    ledger = K.generate_price_forecasts(stored, ["2024-01-31"])
    run = lambda day: O.daily_prospective_run(batch, stored, ledger, day, O.commodity_baselines(spark))
    stale = run("2024-03-20")
    assert stale["audit"].first()["status"] == "STALE"
    assert stale["ledger"].filter("origin_date = '2024-03-20'").count() == 0
    fresh = run("2024-02-12")
    assert fresh["audit"].first()["status"] == "OK"
    assert fresh["ledger"].filter("origin_date = '2024-02-12'").count() == 2


def test_composition_shift_is_no_drift(spark):
    train = spark.createDataFrame([("rice", f"m{i % 4}", v, p + i % 3) for i in range(40) for v, p in (("lo", 1000.0), ("hi", 3000.0))],
                                  "commodity string, market string, variety string, modal_price double")
    base = lambda *by: O.learned_baselines(train, list(by))
    batch = train.filter("variety = 'hi'").withColumn("market", F.lit("new"))
    r = O.drift_group_aware(batch, base("commodity"), base("variety"), base("market")).first()
    assert (r["verdict"], r["drift_detected"], r["composition_shift_only"]) == ("composition", False, True)
    shifted = train.withColumn("modal_price", F.col("modal_price") * 2)
    r = O.drift_group_aware(shifted, base("commodity"), base("variety"), base("market")).first()
    assert (r["verdict"], r["drift_detected"]) == ("group_drift", True)


# --- models -----------------------------------------------------------------------------------------

def test_ridge_equals_the_closed_form(spark):
    from pyspark.ml.feature import VectorAssembler
    from granary.operators.models import fit_delta_ridge
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) * [1, 10, 0.1]
    y = x @ [2.0, -0.3, 5.0] + rng.normal(size=80) + 4
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, delta double")
    m = fit_delta_ridge(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), alpha=7.0)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(z.T @ z + 7.0 * np.eye(3), z.T @ (y - y.mean()))
    assert list(m.coefficients * x.std(0, ddof=1)) == pytest.approx(list(w), rel=2e-2)


def test_unseen_categories_are_accepted(spark):
    from granary.operators.models import prep_pipeline
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a")], "x double, k string")
    test = spark.createDataFrame([(None, "zzz")], "x double, k string")
    assert prep_pipeline(["x"], ["k"]).fit(train).transform(test).select("features").count() == 1


def test_calibrated_probabilities_sum_to_one(spark):
    from granary.operators.models import calibrate
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(300):
        p = rng.dirichlet([1, 1, 1])
        rows.append((*map(float, p), M.CLASSES[int(rng.choice(3, p=p))]))
    df = spark.createDataFrame(rows, "p_low double, p_medium double, p_high double, y string")
    cal, ece = calibrate(df, df, "y")
    for r in cal.collect():
        assert r["p_low"] + r["p_medium"] + r["p_high"] == pytest.approx(1.0)
    assert set(ece) == {"sigmoid", "isotonic"}


def test_header_aliases():
    from granary.schemas import OBSERVATION_ALIASES, OBSERVATION_CONTAINS
    from granary.sources.tables import resolve_aliases
    for columns, want in (
            (["Mandi", "Crop Variety", "Report_Date", "ModalPrice", "Volume (t)", "created_date", "Min Price"],
             {"market": "Mandi", "variety": "Crop Variety", "reported_date": "Report_Date", "modal_price": "ModalPrice", "arrivals": "Volume (t)", "min_price": "Min Price"}),
            (["market_name", "commodity_variety", "arrival_date", "modal_price_rs_quintal", "arrival_quantity"],
             {"market": "market_name", "variety": "commodity_variety", "reported_date": "arrival_date", "modal_price": "modal_price_rs_quintal", "arrivals": "arrival_quantity"}),
            (["MARKET", "Commodity Variety", "Date", "Price per quintal", "Total Arrivals"],
             {"market": "MARKET", "variety": "Commodity Variety", "reported_date": "Date", "modal_price": "Price per quintal", "arrivals": "Total Arrivals"})):
        assert resolve_aliases(columns, OBSERVATION_ALIASES, OBSERVATION_CONTAINS) == want
