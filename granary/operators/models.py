"""Baselines, MLlib models, routing and evaluation loops."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (GBTRegressor, IsotonicRegression, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.distributed import row_scalar
from granary.functions.scalars import CLASSES, class_code, normalized, round_half_up
from granary.functions.windows import series_window
from granary.operators import metrics as M
from granary.operators.labels import class_weights
from granary.operators.panel import INSEASON, hierarchical_means
from granary.schemas import SERIES
from granary.session import materialize

SEED = 42


# --- baselines -------------------------------------------------------------------------

def baseline_predictions(df: DataFrame, price: str = "modal_price") -> DataFrame:
    """Current price, previous price and mean of all earlier prices."""
    w = series_window()
    return df.select("*", F.col(price).alias("pred_current"), F.lag(price).over(w).alias("pred_lag1"),
                     F.avg(price).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("pred_mean"))


def majority_class(df: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """The most frequent training class for every row; ties by name."""
    best = train.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label)))).scalar()
    return df.withColumn("pred_majority", best)


def stratified_class(df: DataFrame, train: DataFrame, label: str, keys: Sequence[str], seed: str = "42") -> DataFrame:
    """A class drawn with the training shares; the md5 of the key is the random number."""
    share = row_scalar(train.agg(*[F.try_divide(F.count_if(F.col(label) == k), F.count(label)).alias(k) for k in CLASSES]))
    digest = F.substring(F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys])), 1, 8)
    u = F.conv(digest, 16, 10).cast("double") / float(2 ** 32)
    low, mid = share["LOW"], share["LOW"] + share["MEDIUM"]
    return df.withColumn("pred_stratified", F.when(u < low, "LOW").when(u < mid, "MEDIUM").otherwise("HIGH"))


def fit_per_series_linear(train: DataFrame, y: str, x: str, min_rows: int = 30) -> DataFrame:
    """Slope and intercept per series from grouped sufficient statistics."""
    return train.groupBy(*SERIES).agg(
        F.count("*").alias("n_train"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept")).withColumn("trained", F.col("n_train") >= min_rows)


def score_per_series_linear(df: DataFrame, fits: DataFrame, x: str) -> DataFrame:
    """Prediction within half and twice the current price; persistence for untrained series."""
    p = F.col(x)
    raw = F.col("intercept") + F.col("slope") * p
    use = F.coalesce(F.col("trained"), F.lit(False)) & raw.isNotNull()
    pred = F.when(use, F.least(F.greatest(raw, p * 0.5), p * 2.0)).otherwise(p)
    return df.join(fits, list(SERIES), "left").select(
        *df.columns, pred.alias("predicted"), F.when(use, "MODEL").otherwise("PERSISTENCE").alias("strategy"))


# --- feature vectors --------------------------------------------------------------------

def prep_pipeline(numeric: Sequence[str], categorical: Sequence[str] = (), out: str = "features") -> Pipeline:
    """Median imputation and scaling of numbers, one-hot coding of categories.

    A category unseen in training gets a code of its own. One-hot columns are not
    scaled here; LinearRegression standardises all columns while it fits.
    """
    num = [f"{c}_num" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=num),
              VectorAssembler(inputCols=num, outputCol="_num", handleInvalid="keep"),
              StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True, withStd=True)]
    parts = ["_scaled"]
    for c in categorical:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep"),
                   OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_hot", dropLast=False, handleInvalid="keep")]
        parts.append(f"{c}_hot")
    return Pipeline(stages=stages + [VectorAssembler(inputCols=parts, outputCol=out)])


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Plain vector for trees; NULL becomes 0."""
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    vec = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out).transform(filled)
    return vec.drop(*[f"_f_{c}" for c in features])


# --- regressors ---------------------------------------------------------------------------

def ridge_reg_param(train: DataFrame, label: str, alpha: float) -> float:
    """Penalty that equals a closed-form ridge with this alpha on standardised features.

    The fit averages the loss over n and scales the label by its deviation.
    """
    s = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sd")).first()
    return alpha * (s["sd"] or 0.0) / s["n"]


def fit_delta_ridge(train: DataFrame, label: str = "delta", alpha: float = 300.0, features: str = "features"):
    return LinearRegression(featuresCol=features, labelCol=label, predictionCol="pred_delta", solver="normal",
                            regParam=ridge_reg_param(train, label, alpha), elasticNetParam=0.0).fit(train)


def fit_delta_huber(train: DataFrame, label: str = "delta", epsilon: float = 1.35, features: str = "features"):
    return LinearRegression(featuresCol=features, labelCol=label, predictionCol="pred_delta", loss="huber",
                            epsilon=epsilon, regParam=1e-4, maxIter=50).fit(train)


def fit_price_change_trees(train: DataFrame, label: str, kind: str = "gbt", features: str = "features",
                           trees: int = 20, depth: int = 4):
    """Gradient-boosted (absolute loss) or random-forest regressor of the price change."""
    if kind == "gbt":
        return GBTRegressor(featuresCol=features, labelCol=label, predictionCol="pred_change", lossType="absolute",
                            maxIter=trees, maxDepth=depth, stepSize=0.1, seed=SEED).fit(train)
    return RandomForestRegressor(featuresCol=features, labelCol=label, predictionCol="pred_change",
                                 numTrees=trees, maxDepth=depth, seed=SEED).fit(train)


# --- classifiers and calibration -------------------------------------------------------------

def fit_volatility_classifier(train: DataFrame, label: str, features: str = "features", strategy: str = "balanced",
                              trees: int = 20, depth: int = 5):
    """Three-class random forest with class weights computed on the training rows."""
    weights = class_weights(train, label, strategy).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight")))).scalar()
    rows = (train.filter(F.col(label).isNotNull()).withColumn("weight", F.try_element_at(weights, F.col(label)))
            .withColumn("_y", class_code(F.col(label)).cast("double")))
    return RandomForestClassifier(featuresCol=features, labelCol="_y", weightCol="weight", numTrees=trees,
                                  maxDepth=depth, seed=SEED).fit(rows)


def score_classes(model, df: DataFrame) -> DataFrame:
    """Probabilities and the most likely class; ties go to the first class."""
    # a class absent from training has no slot in the vector
    arr = vector_to_array("probability")
    out = model.transform(df).withColumns(
        {p: F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0)) for i, p in enumerate(M.PROBS)})
    _, label = M.top1()
    return out.select(*df.columns, *M.PROBS, label.alias("predicted_class"))


def _calibration_rows(df: DataFrame, label: str, k: int) -> DataFrame:
    """(p, hit, weight) with equal probabilities merged, so the fit sees each value once."""
    return df.groupBy(F.col(M.PROBS[k]).alias("p")).agg(
        F.avg((F.col(label) == CLASSES[k]).cast("double")).alias("rate"), F.count("*").cast("double").alias("w"))


def fit_calibrators(df: DataFrame, label: str, method: str) -> list:
    """One calibrator per class on a validation tail."""
    models = []
    for k in range(len(CLASSES)):
        rows = VectorAssembler(inputCols=["p"], outputCol="x").transform(_calibration_rows(df, label, k))
        if method == "isotonic":
            models.append(IsotonicRegression(featuresCol="x", labelCol="rate", weightCol="w",
                                             predictionCol="_cal").fit(rows))
        elif method == "sigmoid":
            # both outcomes of a probability as weighted rows
            both = rows.select("x", F.explode(F.array(
                F.struct(F.lit(1.0).alias("y"), (F.col("rate") * F.col("w")).alias("w")),
                F.struct(F.lit(0.0).alias("y"), ((1 - F.col("rate")) * F.col("w")).alias("w")))).alias("s")).select("x", "s.*")
            models.append(LogisticRegression(featuresCol="x", labelCol="y", weightCol="w",
                                             probabilityCol="_prob").fit(both.filter("w > 0")))
        else:
            raise ValueError(f"unknown method {method!r}")
    return models


def apply_calibrators(models: Sequence, df: DataFrame, method: str) -> DataFrame:
    """Calibrated and renormalised probabilities under the same names."""
    out = df
    for k, m in enumerate(models):
        vec = VectorAssembler(inputCols=[M.PROBS[k]], outputCol="x").transform(out)
        scored = m.transform(vec)
        value = F.col("_cal") if method == "isotonic" else F.get(vector_to_array("_prob"), F.lit(1))
        out = scored.withColumn(f"_c{k}", F.greatest(value, F.lit(0.0))).select(
            *df.columns, *[f"_c{j}" for j in range(k + 1)])
    norm = normalized([F.col(f"_c{k}") for k in range(len(models))])
    return out.select(*[c for c in df.columns if c not in M.PROBS],
                      *[F.coalesce(n, F.col(p)).alias(p) for n, p in zip(norm, M.PROBS)])


def calibrate(val: DataFrame, test: DataFrame, label: str) -> tuple[DataFrame, dict[str, float]]:
    """Calibrate test probabilities with the method of lower validation error."""
    fits = {m: fit_calibrators(val, label, m) for m in ("sigmoid", "isotonic")}
    # two single numbers decide the method
    ece = {m: M.ece_top1(apply_calibrators(f, val, m), label).first()["ece"] for m, f in fits.items()}
    best = min(ece, key=ece.get)
    return apply_calibrators(fits[best], test, best).withColumn("calibration", F.lit(best)), ece


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Ranked importances with the running share; one row per feature."""
    values = model.featureImportances.toArray()
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    calendar = {"year", "month", "day", "day_of_week", "week_of_year", "quarter"}
    total = sum(v for _, v in rows) or 1.0
    data = [(i + 1, f, v, v / total, f in calendar) for i, (f, v) in enumerate(rows)]
    return spark.createDataFrame(data, "rank int, feature string, importance double, share double, is_calendar boolean")


# --- yield serving ---------------------------------------------------------------------------

def ensemble_average(a: Column, b: Column, weight: float = 0.5) -> Column:
    return a * weight + b * (1 - weight)


def impute_yield_baseline(df: DataFrame, train: DataFrame, target: str = "yield_kg_ha", hist: str | None = None) -> DataFrame:
    """First positive of lag 1, lag 2, supplied mean, district x season, district, season, state mean."""
    levels = materialize(hierarchical_means(train, target), "levels")
    pick = lambda level, name, *keys: levels.filter(F.col("level") == level).select(*keys, F.col("mean").alias(name))
    j = (df.join(pick("district_season", "_ds", "district", "season"), ["district", "season"], "left")
         .join(pick("district", "_d", "district"), "district", "left")
         .join(pick("season", "_s", "season"), "season", "left"))
    state = levels.filter("level = 'state'").agg(F.max("mean")).scalar()
    steps = [("lag1", F.col("yield_lag1")), ("lag2", F.col("yield_lag2"))]
    if hist:
        steps.append(("supplied_mean", F.col(hist)))
    steps += [("district_season", F.col("_ds")), ("district", F.col("_d")), ("season", F.col("_s")), ("state", state)]
    value = F.coalesce(*[F.when(c > 0, c) for _, c in steps])
    source = F.coalesce(*[F.when(c > 0, F.lit(n)) for n, c in steps])
    return j.select(*df.columns, value.alias("baseline"), (source != "lag1").alias("imputed"), source.alias("baseline_source"))


def route_prediction(df: DataFrame, policy: str = "persistence", routing: bool = True,
                     weather: Sequence[str] = INSEASON, model_name: str = "delta_ridge") -> DataFrame:
    """Which method serves a row: Summer and missing weather go to persistence, or to the imputing model."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), c) for c in weather]), lambda x: x.isNotNull())
    n = F.size("missing_features")
    out = df.withColumn("missing_features", missing)
    status = F.when(n == 0, "complete").when(n == len(weather), "missing").otherwise("incomplete")
    summer = F.lit(routing) & (F.col("season") == "Summer")
    fallback = "persistence" if policy == "persistence" else "model_imputation"
    method = F.when(summer, "persistence_summer").when(n == 0, model_name).otherwise(fallback)
    return out.select("*", status.alias("weather_status"), method.alias("method"),
                      (~summer & (n == 0)).alias("weather_used"), summer.alias("routing_applied"),
                      (~summer & ((n == 0) | F.lit(fallback != "persistence"))).alias("use_delta"))


# Plausible yields in kg per hectare. Fixed values.
YIELD_BOUNDS = {"rice": (500.0, 6000.0), "wheat": (500.0, 5000.0)}


def finalize_yield(baseline: Column, delta: Column, use_delta: Column, bounds: tuple[float, float]) -> dict[str, Column]:
    """Baseline plus delta, clamped; kg and tonnes per hectare."""
    raw = baseline + F.when(use_delta, F.coalesce(delta, F.lit(0.0))).otherwise(0.0)
    kg = F.least(F.greatest(raw, F.lit(bounds[0])), F.lit(bounds[1]))
    return {"yield_kg": F.when(raw.isNotNull(), kg), "yield_t": F.when(raw.isNotNull(), kg) / 1000,
            "clamped": (raw < bounds[0]) | (raw > bounds[1])}


def reconstruct_price(current: Column, change: Column, deadband: float = 0.0) -> Column:
    """Current price plus the predicted change, rounded to 2 digits; NULL unless positive."""
    kept = F.when(F.abs(change) < deadband, 0.0).otherwise(change)
    price = round_half_up(current + kept, 2)
    return F.when((current > 0) & (price > 0), price)


# Residual quantiles used when none were measured. Fixed values.
DEFAULT_QUANTILES = {"p10": -20.0, "p25": -5.0, "p50": 0.0, "p75": 5.0, "p90": 25.0}


def prediction_intervals(df: DataFrame, predicted: str, quantiles: DataFrame | None = None,
                         keys: Sequence[str] = ()) -> DataFrame:
    """Prediction plus residual quantiles, sorted; defaults for keys without measured quantiles."""
    names = list(DEFAULT_QUANTILES)
    if quantiles is None:
        j = df.withColumns({f"_{n}": F.lit(v) for n, v in DEFAULT_QUANTILES.items()})
    else:
        q = quantiles.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
        j = df.join(q, list(keys), "left").withColumns(
            {f"_{n}": F.coalesce(F.col(f"_{n}"), F.lit(v)) for n, v in DEFAULT_QUANTILES.items()})
    band = F.array_sort(F.array(*[round_half_up(F.col(predicted) + F.col(f"_{n}"), 2) for n in names]))
    return j.withColumn("_band", band).select(*df.columns, *[F.col("_band")[i].alias(n) for i, n in enumerate(names)])


# --- evaluation loops -------------------------------------------------------------------------

YIELD_NUMERIC = ("yield_lag1", "yield_lag2", "area_lag1", "yield_hist_mean", "precip_cum", "t2m_mean", "rh2m_mean")


def _fit_yield_fold(train: DataFrame, val: DataFrame, numeric: Sequence[str], alpha: float, trees: int) -> DataFrame:
    train = impute_yield_baseline(train, train).withColumn("delta", F.col("yield_kg_ha") - F.col("baseline"))
    val = impute_yield_baseline(val, train.select("district", "season", "yield_kg_ha"))
    prep = prep_pipeline(numeric, ["district", "season"]).fit(train)
    tr = prep.transform(train).select("features", "delta")
    ridge = fit_delta_ridge(tr, "delta", alpha)
    boosted = fit_price_change_trees(tr, "delta", "gbt", trees=trees, depth=2)
    scored = boosted.transform(ridge.transform(prep.transform(val)))
    return scored.select("district", "season", "year", "yield_kg_ha", "weather_complete", "baseline",
                         F.col("pred_delta").alias("ridge_delta"), F.col("pred_change").alias("trees_delta"))


def rolling_origin_evaluation(panel: DataFrame, val_years: Sequence[int], numeric: Sequence[str] = YIELD_NUMERIC,
                              alpha: float = 300.0, trees: int = 10) -> DataFrame:
    """Out-of-fold yield predictions of persistence, ridge, trees and their average.

    s1 falls back to persistence where weather is incomplete, s2 never does. One
    fit per fold year; all folds become one table of prediction rows.
    """
    panel = materialize(panel, "yield-panel")
    parts = []
    for i, v in enumerate(val_years, start=1):
        rows = _fit_yield_fold(panel.filter(F.col("year") < v), panel.filter(F.col("year") == v), numeric, alpha, trees)
        parts.append(rows.withColumn("fold", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cols = {"persistence": F.col("baseline")}
    deltas = {"ridge": F.col("ridge_delta"), "trees": F.col("trees_delta"),
              "ensemble": ensemble_average(F.col("ridge_delta"), F.col("trees_delta"))}
    for n, d in deltas.items():
        cols[f"{n}_s1"] = F.col("baseline") + F.when(F.col("weather_complete"), d).otherwise(0.0)
        cols[f"{n}_s2"] = F.col("baseline") + d
    return out.select("fold", "district", "season", "year", F.col("yield_kg_ha").alias("y"), "weather_complete",
                      *[c.alias(n) for n, c in cols.items()])


def walk_forward_volatility(rows: DataFrame, features: Sequence[str], folds: Sequence[tuple[str, str, str, str]],
                            label: str, persistence: str, target_date: str, trees: int = 20) -> DataFrame:
    """Prediction rows of a classifier, raw and calibrated, and of the baselines, for every named fold.

    folds: (name, validation start, test start, test end). Training ends before
    the validation start, and rows whose target reaches it are purged.
    """
    cols = [*SERIES, "reported_date", label, persistence]
    parts = []
    for name, v0, t0, t1 in folds:
        day = F.col("reported_date")
        date = lambda s: F.lit(s).cast("date")
        train = rows.filter((day < date(v0)) & ~F.coalesce(F.col(target_date) >= date(v0), F.lit(False)))
        val = rows.filter((day >= date(v0)) & (day < date(t0)) & ~F.coalesce(F.col(target_date) >= date(t0), F.lit(False)))
        test = rows.filter((day >= date(t0)) & (day <= date(t1)))
        model = fit_volatility_classifier(assemble(train, features), label, trees=trees)
        score = lambda d: score_classes(model, assemble(d, features)).select(*cols, *M.PROBS)
        val_s = materialize(score(val), "volatility-val")
        test_s = materialize(score(test), "volatility-test")
        cal, _ = calibrate(val_s, test_s, label)
        _, top = M.top1()
        tag = lambda d, m: d.select(F.lit(name).alias("fold"), F.lit(m).alias("model"), *cols, *M.PROBS, top.alias("predicted_class"))
        parts += [tag(test_s, "forest"), tag(cal, "forest_calibrated")]
        one = {k: F.when(F.col(persistence) == k, 1.0).otherwise(0.0) for k in CLASSES}
        parts.append(tag(test_s.withColumns({p: one[k] for k, p in zip(CLASSES, M.PROBS)}), "persistence"))
        maj = majority_class(test_s, train, label)
        one = {k: F.when(F.col("pred_majority") == k, 1.0).otherwise(0.0) for k in CLASSES}
        parts.append(tag(maj.withColumns({p: one[k] for k, p in zip(CLASSES, M.PROBS)}), "majority"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unseen_market_generalization(rows: DataFrame, features: Sequence[str], unseen: DataFrame, label: str,
                                 persistence: str, split: str, target_date: str, trees: int = 20) -> DataFrame:
    """Holdout predictions of a model that never saw the listed markets, marked seen or unseen."""
    cut = F.lit(split).cast("date")
    flags = unseen.select("market").distinct().withColumn("_unseen", F.lit(True))
    train = rows.filter((F.col("reported_date") < cut) & ~F.coalesce(F.col(target_date) >= cut, F.lit(False))).join(
        flags.select("market"), "market", "left_anti")
    test = rows.filter(F.col("reported_date") >= cut).join(flags, "market", "left")
    model = fit_volatility_classifier(assemble(train, features), label, trees=trees)
    scored = score_classes(model, assemble(test, features))
    return scored.select(*SERIES, "reported_date", label, persistence, *M.PROBS, "predicted_class",
                         F.when(F.col("_unseen"), "unseen").otherwise("seen").alias("group"))
