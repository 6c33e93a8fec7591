"""Baselines, routing, MLlib fits and evaluation loops."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions.windows import series_window
from granary.operators import features as T
from granary.operators import labels as L
from granary.operators import metrics as M
from granary.operators import models as J
from granary.operators import panel as N
from granary.operators import splits as S
from granary.operators import tuning as G
from granary.plans.labels import KEY, NEXT, P
from granary.plans.metrics import (CLASSIFIED, PANEL_SCORED, RELIABILITY, SCORED, _PL, _POLICIES, classified, panel_scored, reg_sql,
                                   scored)
from granary.plans.panel import HIER, INSEASON_SQL, PK, weather
from granary.plans.registry import W, lag, query, rows
from granary.session import materialize
from granary.sources import adapters as A


@query("j01_baseline_predictions", f"""
SELECT market, variety, reported_date, {P} AS pred_current, {lag(P)} AS pred_lag1,
  ~avg({P}) OVER {rows(-100000, -1)} AS pred_mean
FROM @obs@""")
def j01(spark, folder):
    return J.baseline_predictions(A.observations(spark, folder)).select(*KEY, "pred_current", "pred_lag1", "pred_mean")


@query("j01_class_baselines", f"""
WITH {CLASSIFIED}, tr AS (SELECT y FROM c WHERE reported_date < DATE '2000-01-01'),
sh AS (SELECT count(*) FILTER (y = 'LOW') / count(*) AS lo, count(*) FILTER (y = 'MEDIUM') / count(*) AS mid FROM tr),
mj AS (SELECT y AS m FROM tr GROUP BY y ORDER BY count(*) DESC, y LIMIT 1),
u AS (SELECT *, ('0x' || substr(md5('42|' || market || '|' || variety || '|' || strftime(reported_date, '%Y-%m-%d')), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u
  FROM c WHERE reported_date >= DATE '2000-01-01')
SELECT y, m AS pred_majority, CASE WHEN u < lo THEN 'LOW' WHEN u < lo + mid THEN 'MEDIUM' ELSE 'HIGH' END AS pred_stratified, count(*) AS n
FROM u CROSS JOIN sh CROSS JOIN mj GROUP BY ALL""")
def j01c(spark, folder):
    df = classified(spark, folder)
    train, test = df.filter("reported_date < '2000-01-01'"), df.filter("reported_date >= '2000-01-01'")
    out = J.stratified_class(J.majority_class(test, train, "y"), train, "y", KEY)
    return out.groupBy("y", "pred_majority", "pred_stratified").agg(F.count("*").alias("n"))


@query("j06_per_series_models", f"""
WITH {SCORED},
f AS (SELECT market, variety, count(*) AS n, regr_slope(y, current) AS b, regr_intercept(y, current) AS a FROM s WHERE reported_date < DATE '1995-06-01' GROUP BY ALL),
t AS (SELECT s.*, CASE WHEN n >= 30 AND a IS NOT NULL THEN 'MODEL' ELSE 'PERSISTENCE' END AS strategy,
    CASE WHEN n >= 30 AND a IS NOT NULL THEN least(greatest(a + b * current, current * 0.5), current * 2) ELSE current END AS p
  FROM s LEFT JOIN f USING (market, variety) WHERE reported_date >= DATE '1995-06-01')
SELECT market, variety, strategy,
{reg_sql('y', 'p')}
FROM t GROUP BY market, variety, strategy""")
def j06(spark, folder):
    df = scored(spark, folder)
    fits = J.fit_per_series_linear(df.filter("reported_date < '1995-06-01'"), "y", "current")
    test = J.score_per_series_linear(df.filter("reported_date >= '1995-06-01'"), fits, "current")
    return M.regression_metrics(test, "y", "predicted", ["market", "variety", "strategy"])


@query("j09_ensemble_average", f"""
WITH {PANEL_SCORED}
SELECT district, season, year,
  ~(ridge - persistence) * 0.5::DOUBLE + (y - persistence) * 0.5::DOUBLE AS delta
FROM ps""")
def j09(spark, folder):
    p = F.col("persistence")
    return panel_scored(spark, folder).select(
        *PK, J.ensemble_average(F.col("ridge") - p, F.col("y") - p).alias("delta"))


def lagged_panel(spark, folder):
    """Yield rows with their lags; some are missing or invalid."""
    w = T.panel_window()
    y = F.col("yield_kg_ha")
    a = F.col("area")
    return A.yield_panel(spark, folder).select(
        *PK, "area", "yield_kg_ha", F.when(a % 4 == 0, -1.0).otherwise(F.lag(y, 1).over(w)).alias("yield_lag1"),
        F.when(a % 3 == 0, None).otherwise(F.lag(y, 2).over(w)).alias("yield_lag2"),
        F.when(a % 7 == 0, y - 1).alias("hist"))


LAGGED_PANEL = f"""lp AS (SELECT district, season, year, area, yield_kg_ha, CASE WHEN area % 4 = 0 THEN -1 ELSE {_PL(1)} END AS l1,
    CASE WHEN area % 3 = 0 THEN NULL ELSE {_PL(2)} END AS l2, CASE WHEN area % 7 = 0 THEN yield_kg_ha - 1 END AS hist FROM @panel@)"""


@query("j12_impute_yield_baseline", f"""
WITH {LAGGED_PANEL},
tr AS (SELECT * FROM @panel@ WHERE year < 1999 AND NOT (district = 'NATION_2' AND season = 'Winter') AND district <> 'NATION_7'),
ds AS (SELECT district, season, avg(yield_kg_ha) AS m FROM tr GROUP BY ALL), d AS (SELECT district, avg(yield_kg_ha) AS m FROM tr GROUP BY ALL),
s AS (SELECT season, avg(yield_kg_ha) AS m FROM tr GROUP BY ALL), st AS (SELECT avg(yield_kg_ha) AS m FROM tr),
j AS (SELECT lp.*, ds.m AS dsm, d.m AS dm, s.m AS sm, st.m AS stm FROM lp LEFT JOIN ds USING (district, season) LEFT JOIN d USING (district) LEFT JOIN s USING (season) CROSS JOIN st)
SELECT district, season, year, NOT coalesce(l1 > 0, false) AS imputed, CASE WHEN l1 > 0 THEN 'lag1' WHEN l2 > 0 THEN 'lag2' WHEN hist > 0 THEN 'supplied_mean'
    WHEN dsm > 0 THEN 'district_season' WHEN dm > 0 THEN 'district' WHEN sm > 0 THEN 'season' ELSE 'state' END AS baseline_source,
  ~CASE WHEN l1 > 0 THEN l1 WHEN l2 > 0 THEN l2 WHEN hist > 0 THEN hist WHEN dsm > 0 THEN dsm WHEN dm > 0 THEN dm WHEN sm > 0 THEN sm ELSE stm END AS baseline
FROM j""")
def j12(spark, folder):
    train = A.yield_panel(spark, folder).filter(
        "year < 1999 AND NOT (district = 'NATION_2' AND season = 'Winter') AND district <> 'NATION_7'")
    return J.impute_yield_baseline(lagged_panel(spark, folder), train, hist="hist").select(
        *PK, "imputed", "baseline_source", "baseline")


def with_weather(spark, folder, df):
    feats = N.inseason_weather_features(weather(spark, folder), df.select(*PK))
    return df.join(feats.select(*PK, *N.INSEASON), list(PK), "left")


_MISS = f"[x FOR x IN [{', '.join(f'CASE WHEN {c} IS NULL THEN {c!r} END' for c in N.INSEASON)}] IF x IS NOT NULL]"
ROUTED = f"""{INSEASON_SQL},
ro AS (SELECT *, {_MISS} AS ms FROM fe)"""


@query("j13_route_prediction", f"""
WITH {ROUTED}
SELECT district, season, year, array_to_string(ms, ',') AS missing_features,
  CASE WHEN len(ms) = 0 THEN 'complete' WHEN len(ms) = 10 THEN 'missing' ELSE 'incomplete' END AS weather_status,
  CASE WHEN season = 'Summer' THEN 'persistence_summer' WHEN len(ms) = 0 THEN 'delta_ridge' ELSE 'persistence' END AS method,
  season <> 'Summer' AND len(ms) = 0 AS weather_used, season = 'Summer' AS routing_applied, season <> 'Summer' AND len(ms) = 0 AS use_delta
FROM ro""")
def j13(spark, folder):
    df = with_weather(spark, folder, A.yield_panel(spark, folder).select(*PK))
    return J.route_prediction(df).select(
        *PK, F.array_join("missing_features", ",").alias("missing_features"), "weather_status", "method", "weather_used",
        "routing_applied", "use_delta")


@query("j14_finalize_yield", f"""
WITH {PANEL_SCORED}, r AS (SELECT *, persistence / 64 + CASE WHEN weather_complete THEN (ridge - persistence) / 16 ELSE 0 END AS raw FROM ps)
SELECT district, season, year, raw < 500 OR raw > 6000 AS clamped,
  ~least(greatest(raw, 500), 6000) AS yield_kg,
  ~least(greatest(raw, 500), 6000) / 1000 AS yield_t
FROM r""")
def j14(spark, folder):
    # scaled so that both bounds are reached
    out = J.finalize_yield(F.col("persistence") / 64, (F.col("ridge") - F.col("persistence")) / 16,
                           F.col("weather_complete"), J.YIELD_BOUNDS["rice"])
    return panel_scored(spark, folder).select(*PK, *[c.alias(n) for n, c in out.items()])


@query("j15_reconstruct_price", f"""
WITH {SCORED}, r AS (SELECT *, floor((current + CASE WHEN abs((model - current) * 3) < 500 THEN 0 ELSE (model - current) * 3 END) * 100 + 0.5) / 100 AS p FROM s)
SELECT market, variety, reported_date, CASE WHEN current > 0 AND p > 0 THEN p END AS predicted FROM r""")
def j15(spark, folder):
    change = (F.col("model") - F.col("current")) * 3
    return scored(spark, folder).select(*KEY, J.reconstruct_price(F.col("current"), change, 500.0).alias("predicted"))


_QS = ", ".join(f"quantile_cont(y - model, {v}) AS q{k}" for k, v in M.QUANTILES.items() if k in J.DEFAULT_QUANTILES)
_BAND = ", ".join(f"floor((model + coalesce(q{k}, {v})) * 100 + 0.5) / 100" for k, v in J.DEFAULT_QUANTILES.items())


@query("j16_prediction_intervals", f"""
WITH {SCORED},
q AS (SELECT variety, {_QS} FROM s WHERE reported_date < DATE '2000-01-01' AND variety <> 'R' GROUP BY variety),
b AS (SELECT market, s.variety, reported_date, list_sort([{_BAND}]) AS b FROM s LEFT JOIN q USING (variety) WHERE reported_date >= DATE '2000-01-01')
SELECT market, variety, reported_date, {', '.join(f'b[{i + 1}] AS {k}' for i, k in enumerate(J.DEFAULT_QUANTILES))} FROM b""")
def j16(spark, folder):
    df = scored(spark, folder)
    train = df.filter("reported_date < '2000-01-01' AND variety <> 'R'").withColumn("residual", F.col("y") - F.col("model"))
    q = M.residual_quantiles(train, "residual", by=["variety"])
    out = J.prediction_intervals(df.filter("reported_date >= '2000-01-01'"), "model", q, ["variety"])
    return out.select(*KEY, *J.DEFAULT_QUANTILES)


# --- fitted models: what does not depend on the fit is compared, the fit has to pass its gates ------------------------------------

def yield_table(spark, folder):
    """Yield rows with lags, in-season weather and the completeness flag."""
    w = T.panel_window()
    y = F.col("yield_kg_ha")
    df = A.yield_panel(spark, folder).select(
        *PK, "yield_kg_ha", F.lag(y, 1).over(w).alias("yield_lag1"), F.lag(y, 2).over(w).alias("yield_lag2"),
        F.lag("area", 1).over(w).alias("area_lag1"), T.expanding_past_mean().alias("yield_hist_mean"))
    full = with_weather(spark, folder, df)
    complete = F.lit(True)
    for c in N.INSEASON:
        complete = complete & F.col(c).isNotNull()
    return full.withColumn("weather_complete", complete)


# Validation rows with their lag: yields are positive, so the imputed baseline of a row with a lag is that lag.
PANEL_FOLDS = """sp AS (SELECT *, lag(yield_kg_ha) OVER (PARTITION BY district, season ORDER BY year) AS l1 FROM @panel@),
va AS (SELECT * FROM sp WHERE l1 IS NOT NULL AND year >= 2000)"""
#: A fitted model passes if its error is at most so many times that of persistence.
MARGIN = 1.5


def _split_panel(spark, folder):
    df = J.impute_yield_baseline(yield_table(spark, folder).filter("yield_lag1 IS NOT NULL"),
                                 A.yield_panel(spark, folder).filter("year < 2000"))
    df = materialize(df.withColumn("delta", F.col("yield_kg_ha") - F.col("baseline")), "yield-table")
    return df.filter("year < 2000"), df.filter("year >= 2000")


@query("j02_prep_pipeline", f"""
WITH {PANEL_FOLDS}
SELECT district, season, year, true AS finite, true AS one_district, CAST({len(J.YIELD_NUMERIC)} + (SELECT count(DISTINCT district) + 2 FROM sp WHERE l1 IS NOT NULL AND year < 2000)
  + (SELECT count(DISTINCT season) + 2 FROM sp WHERE l1 IS NOT NULL AND year < 2000) AS INTEGER) AS width
FROM va""")
def j02(spark, folder):
    train, val = _split_panel(spark, folder)
    prep = J.prep_pipeline(J.YIELD_NUMERIC, ["district", "season"]).fit(train)
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    hot = F.aggregate(vector_to_array("district_hot"), F.lit(0.0), lambda a, x: a + x)
    return prep.transform(val).select(*PK, F.forall(v, lambda x: F.abs(x) < 1e9).alias("finite"), (hot == 1).alias("one_district"), F.size(v).alias("width"))


def _scored_delta(spark, folder, fit):
    train, val = _split_panel(spark, folder)
    prep = J.prep_pipeline(J.YIELD_NUMERIC, ["district", "season"]).fit(train)
    model = fit(prep.transform(train).select("features", "delta"))
    out = model.transform(prep.transform(val)).withColumn("pred", F.col("baseline") + F.col("pred_delta"))
    m, b = M.regression_aggs("yield_kg_ha", "pred"), M.regression_aggs("yield_kg_ha", "baseline", suffix="_persistence")
    return out.groupBy("season").agg(*[e.alias(k) for k, e in b.items()], (m["mae"] <= b["mae_persistence"] * MARGIN).alias("within_margin"),
                                     (m["n"] == b["n_persistence"]).alias("all_scored"))


DELTA_SQL = f"""
WITH {PANEL_FOLDS}
SELECT season, true AS within_margin, true AS all_scored,
{reg_sql('yield_kg_ha', 'l1', suffix='_persistence')}
FROM va GROUP BY season"""


@query("j03_fit_delta_ridge", DELTA_SQL)
def j03(spark, folder):
    return _scored_delta(spark, folder, lambda tr: J.fit_delta_ridge(tr, "delta", 300.0))


@query("j04_fit_delta_huber", DELTA_SQL)
def j04(spark, folder):
    return _scored_delta(spark, folder, J.fit_delta_huber)


def price_table(spark, folder):
    """core-20 with the next price, one written table for all fits."""
    obs = T.core_20(A.observations(spark, folder))
    rows_ = L.next_obs_target(obs).filter("lag_30 IS NOT NULL").withColumn("future_change", F.col("future_price") - F.col(P))
    cut = S.day_quantile(rows_, "reported_date", 0.8)
    return materialize(rows_.withColumn("role", F.when(F.unix_date("reported_date") >= cut, "test").otherwise("train")), "price-table")


@query("j05_fit_price_change_trees")
def j05(spark, folder):
    df = J.assemble(price_table(spark, folder), T.CORE_20 + (P,))
    train, test = df.filter("role = 'train'"), df.filter("role = 'test'")
    parts = []
    for kind in ("gbt", "forest"):
        model = J.fit_price_change_trees(train, "future_change", kind, trees=10)
        scored_ = model.transform(test).withColumn("pred", F.col(P) + F.col("pred_change"))
        m, b = M.regression_aggs("future_price", "pred"), M.regression_aggs("future_price", P, suffix="_persistence")
        parts.append(scored_.groupBy("variety").agg(*[e.alias(k) for k, e in (m | b).items()]).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def volatility_table(spark, folder):
    """vol-38 with the class of the next 14 days and of the past 14 days."""
    from granary.functions.scalars import classify3
    obs = T.vol_38(A.observations(spark, folder))
    df = L.past_calendar_persistence(L.forward_calendar_range(obs, 14), 14)
    out = df.select("*", classify3(F.col("future_pct_range_14d"), 60.0, 150.0).alias("label"),
                    classify3(F.col("past_pct_range_14d"), 60.0, 150.0).alias("persistence"))
    return materialize(out.filter("label IS NOT NULL AND persistence IS NOT NULL"), "volatility-table")


@query("j07_fit_volatility_classifier")
def j07(spark, folder):
    df = volatility_table(spark, folder)
    train = S.purge_masks(df, "2000-01-01", "future_target_date_14d").filter("clean_train").drop("clean_train", "is_eval", "leaks")
    test = df.filter("reported_date >= '2000-01-01'")
    model = J.fit_volatility_classifier(J.assemble(train, T.VOL_38), "label", trees=15)
    out = J.score_classes(model, J.assemble(test, T.VOL_38))
    return M.classification_metrics(out, "label", "predicted_class", ["variety"])


@query("j08_calibrate", f"""
WITH {CLASSIFIED.replace(chr(10) + "c AS (", chr(10) + "ca AS (")}, c AS (SELECT * FROM ca WHERE reported_date >= DATE '2000-01-01'),
{RELIABILITY},
ec AS (SELECT label, sum(gap * n / total) AS ece FROM rt GROUP BY label)
SELECT label, true AS not_worse, true AS probabilities,
  ~ece AS raw
FROM (SELECT * FROM ec UNION ALL SELECT 'ALL', avg(ece) FROM ec)""")
def j08(spark, folder):
    df = classified(spark, folder)
    val, test = df.filter("reported_date < '2000-01-01'"), df.filter("reported_date >= '2000-01-01'")
    val, test = materialize(val, "cal-val"), materialize(test, "cal-test")
    cal, _ = J.calibrate(val, test, "y")
    cal = materialize(cal, "calibrated")
    sums = cal.agg(F.max(F.abs(sum(F.col(p) for p in M.PROBS) - 1)) < 1e-9).scalar()
    both = M.ece_classwise(test, "y").withColumnRenamed("ece", "raw").join(
        M.ece_classwise(cal, "y").withColumnRenamed("ece", "calibrated"), "label")
    return both.select("label", "raw", (F.col("calibrated") <= F.col("raw") + 0.05).alias("not_worse"), sums.alias("probabilities"))


#: Ridge penalties of the tuning grid. Fixed values.
ALPHAS = (0.01, 0.1, 1.0, 5.0, 10.0, 20.0, 50.0, 80.0, 100.0, 150.0, 200.0, 300.0, 500.0)


#: The validation period, then yearly expanding folds that confirm it: name, first and last validation year.
RIDGE_FOLDS = (("validation", 2000, 2100), *((str(y), y, y) for y in (1997, 1998, 1999, 2000, 2001)))
ABLATIONS = (None, "yield_lag2", "yield_hist_mean", "district")


def _grid(spark, folder):
    """Every fit of the grid, confirmed per year and with features left out, and each fold's error of persistence."""
    df = materialize(_panel_deltas(spark, folder), "tuning-rows")
    out = G.ridge_grid(df, J.YIELD_NUMERIC, ["district", "season"], "delta", "baseline", "yield_kg_ha", RIDGE_FOLDS, ALPHAS, ABLATIONS)
    folds = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in RIDGE_FOLDS])
    limit = df.select("*", F.explode(folds).alias("f")).filter(F.col("year").between(F.col("f.a"), F.col("f.b"))).groupBy(
        F.col("f.fold").alias("fold")).agg(F.avg(F.abs(F.col("yield_kg_ha") - F.col("baseline"))).alias("persistence_mae"))
    return out.join(limit, "fold")


def _panel_deltas(spark, folder):
    train, val = _split_panel(spark, folder)
    return train.unionByName(val)


@query("j10_tune_grid", f"""
WITH {PANEL_FOLDS},
f AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {a}, {b})" for n, a, b in RIDGE_FOLDS)}) f(fold, a, b)),
m AS (SELECT fold, count(*) AS n, avg(abs(yield_kg_ha - l1)) AS persistence_mae FROM sp JOIN f ON year BETWEEN a AND b WHERE l1 IS NOT NULL GROUP BY fold)
SELECT fold, dropped, alpha::DOUBLE AS alpha, n, 1::BIGINT AS best_of_fold, true AS within_margin,
  ~persistence_mae AS persistence_mae
FROM m, (SELECT unnest({list(ALPHAS)}) AS alpha), (SELECT unnest({[a or 'none' for a in ABLATIONS]}) AS dropped)""")
def j10(spark, folder):
    out = _grid(spark, folder)
    best = F.count_if("best").over(Window.partitionBy("fold"))
    return out.select("fold", "dropped", "alpha", "n", best.alias("best_of_fold"), "persistence_mae",
                      (F.min("mae").over(Window.partitionBy("fold")) <= F.col("persistence_mae") * MARGIN).alias("within_margin"))


_SUMMED = ("yield_lag1", "yield_lag2", "delta")


@query("j10_year_sums", f"""
WITH sp AS (SELECT *, {_PL(1)} AS yield_lag1, {_PL(2)} AS l2 FROM @panel@),
x AS (SELECT year, yield_lag1, coalesce(l2, 0) AS yield_lag2, yield_kg_ha - yield_lag1 AS delta FROM sp WHERE yield_lag1 IS NOT NULL)
{' UNION ALL '.join(f"SELECT year, '{a}' AS a, '{b}' AS b,{chr(10)}  ~sum({a} * {b}) / 1e9::DOUBLE AS value{chr(10)}FROM x GROUP BY year" for i, a in enumerate(_SUMMED) for b in _SUMMED[i:])}""")
def j10s(spark, folder):
    df = _panel_deltas(spark, folder)
    design = G.design_of(df, J.YIELD_NUMERIC, [], "delta")
    at = {**{c: i for i, c in enumerate(J.YIELD_NUMERIC)}, "delta": 2 * len(J.YIELD_NUMERIC) + 1}
    pairs = F.create_map(*[F.lit(x) for i, a in enumerate(_SUMMED) for b in _SUMMED[i:] for x in (f"{at[a]},{at[b]}", f"{a},{b}")])
    named = G.year_sums(df, design).select(F.col("year").cast("int").alias("year"), F.split(F.try_element_at(pairs, F.concat_ws(",", "i", "j")), ",").alias("p"), "value")
    return named.filter("p IS NOT NULL").select("year", F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"), (F.col("value") / 1e9).alias("value"))


@query("j10_tree_grid", """
SELECT unnest([2, 3, 2, 3, 2, 3])::INTEGER AS depth, unnest([50, 50, 75, 75, 100, 100])::INTEGER AS trees, 1::BIGINT AS best_of_grid, true AS finite""")
def j10t(spark, folder):
    train, val = _split_panel(spark, folder)
    out = G.tree_grid(train, val, J.YIELD_NUMERIC, "delta", (2, 3), (0.05,), (50, 75, 100))
    return out.select("depth", "trees", F.count_if("best").over(Window.partitionBy()).alias("best_of_grid"), F.col("mae").between(0, 1e9).alias("finite"))


@query("j11_feature_importance", f"""
SELECT unnest({[*T.CORE_20, P]}) AS feature, feature IN ('year', 'month', 'day', 'day_of_week', 'week_of_year', 'quarter') AS is_calendar,
  true AS is_share, true AS ranked,
  ~1.0::DOUBLE AS total""")
def j11(spark, folder):
    names = T.CORE_20 + (P,)
    df = J.assemble(price_table(spark, folder).filter("role = 'train'"), names)
    out = J.feature_importance(J.fit_price_change_trees(df, "future_change", "forest", trees=100), names, spark)
    w = Window.orderBy("rank")
    ranked = F.coalesce(F.col("importance") <= F.lag("importance").over(w), F.lit(True)) & (F.row_number().over(w) == F.col("rank"))
    return out.select("feature", "is_calendar", F.col("share").between(0, 1).alias("is_share"), ranked.alias("ranked"),
                      F.sum("share").over(Window.partitionBy()).alias("total"))


#: Validation years of the rolling origins that the panel has a past for.
ORIGINS = (1998, 1999, 2000, 2001)


@query("j17_rolling_origin_evaluation", f"""
WITH {PANEL_FOLDS}, ps AS (SELECT season, yield_kg_ha AS y, l1 AS persistence, year FROM sp WHERE l1 IS NOT NULL AND year IN {ORIGINS})
SELECT CAST(policy AS INTEGER) AS policy, true AS within_margin, count(*) AS n,
  ~(SELECT avg(abs(y - persistence)) FROM ps) AS persistence_mae,
  ~count(*) FILTER (list_contains(seasons, season)) / count(*) * 100 AS routed_pct
FROM ps CROSS JOIN (VALUES {_POLICIES}) p(policy, seasons) GROUP BY policy""")
def j17(spark, folder):
    pred = materialize(J.rolling_origin_evaluation(yield_table(spark, folder).filter("yield_lag1 IS NOT NULL"), ORIGINS), "origins")
    every = pred.withColumn("complete", F.lit(True))
    out = M.routing_policy_compare(every, "y", "ridge_s1", "persistence", "complete")
    base = out.agg(F.max(F.when(F.col("policy") == 1, F.col("mae")))).scalar()
    return out.select("policy", "n", base.alias("persistence_mae"), F.col("coverage_pct").alias("routed_pct"),
                      (F.col("mae") <= base * MARGIN).alias("within_margin"))


@query("j18_walk_forward_volatility")
def j18(spark, folder):
    df = volatility_table(spark, folder)
    folds = [("A", "1998-01-01", "1999-01-01", "1999-12-31"), ("holdout", "1999-07-01", "2000-01-01", "2001-12-31")]
    pred = materialize(J.walk_forward_volatility(df, T.VOL_38, folds, "label", "persistence", "future_target_date_14d", 10), "walk-forward")
    by = ["fold", "model"]
    cls = M.classification_metrics(pred, "label", "predicted_class", by)
    brier = M.brier_multiclass(pred, "label", by=by).drop("n")
    ece = M.ece_classwise(pred, "label", by=by).filter("label = 'ALL'").drop("label")
    return cls.join(brier, by).join(ece, by)


@query("j19_unseen_market_generalization")
def j19(spark, folder):
    df = volatility_table(spark, folder)
    unseen = df.select("market").distinct().filter("market IN ('NATION_2', 'NATION_9', 'NATION_17')")
    pred = materialize(J.unseen_market_generalization(df, T.VOL_38, unseen, "label", "persistence", "2000-01-01",
                                                      "future_target_date_14d", 10), "unseen")
    model = M.classification_metrics(pred, "label", "predicted_class", ["group"]).withColumn("model", F.lit("forest"))
    return model.unionByName(M.classification_metrics(pred, "label", "persistence", ["group"]).withColumn("model", F.lit("persistence")))
