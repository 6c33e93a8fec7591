"""Forecast ledgers: issue, resolve when the outcome window closed, report.

A ledger is a table; every state change is one set-based join that yields a new
snapshot of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.distributed import first_by, row_scalar
from granary.functions.scalars import (CLASSES, classify3, movement_class, price_forecast_id,
                                       volatility_forecast_id)
from granary.functions.windows import running, series_window, trailing
from granary.operators import metrics as M
from granary.operators.labels import ZERO_MOVE_CUTOFF, past_calendar_persistence
from granary.operators.ledger_joins import outcome_match_join, window_extremes_join
from granary.schemas import OBS_KEY, SERIES

MIN_PRICE_HISTORY = 30      # rows a series needs before a price forecast; fixed value
MIN_VOLATILITY_HISTORY = 14  # rows before a volatility forecast; fixed value
WINDOW_DAYS = 3             # days an outcome window stays open after the horizon; fixed value


def _day(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


# --- issuing -----------------------------------------------------------------------

def origin_states(obs: DataFrame, origins: Sequence[str]) -> DataFrame:
    """Per series and origin date: rows so far, latest price and its date.

    Origin markers are merged into the series and read the running state, so no
    observation is repeated per origin. The row count decides eligibility.
    """
    marks = obs.select(*SERIES).distinct().select(
        *SERIES, F.explode(F.array(*[_day(o) for o in origins])).alias("reported_date"),
        F.lit(None).cast("double").alias("modal_price"), F.lit(True).alias("_mark"))
    rows = obs.select(*OBS_KEY, "modal_price", F.lit(False).alias("_mark")).unionByName(marks)
    # a marker of a day comes after that day's observation
    w = Window.partitionBy(*SERIES).orderBy(F.unix_date("reported_date"), "_mark")
    seen = F.when(~F.col("_mark"), F.lit(1)).otherwise(0)
    counted = rows.select("*", F.sum(seen).over(running(w)).alias("history"),
                          F.last("modal_price", ignorenulls=True).over(running(w)).alias("origin_price"),
                          F.last(F.when(~F.col("_mark"), F.col("reported_date")), ignorenulls=True).over(
                              running(w)).alias("last_observation"))
    return counted.filter("_mark").select(
        *SERIES, F.col("reported_date").alias("origin_date"), "history", "origin_price", "last_observation")


def persistence_model(states: DataFrame) -> DataFrame:
    return states.withColumn("predicted_price", F.col("origin_price"))


def generate_price_forecasts(obs: DataFrame, origins: Sequence[str], horizons: Sequence[int] = (14, 30),
                             existing: DataFrame | None = None, cohort: str = "PROSPECTIVE",
                             model: Callable[[DataFrame], DataFrame] = persistence_model,
                             model_name: str = "persistence") -> DataFrame:
    """PENDING forecasts of all series with enough history, one per origin and horizon.

    The model adds ``predicted_price`` to the origin states. Ids already in
    ``existing`` are left out, which makes repeated runs idempotent.
    """
    states = origin_states(obs, origins).filter(F.col("history") >= MIN_PRICE_HISTORY)
    rows = model(states).select("*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    start = F.date_add("origin_date", F.col("horizon"))
    out = rows.select(
        price_forecast_id(F.col("market"), F.col("variety"), F.col("origin_date"), F.col("horizon"),
                          F.lit(model_name)).alias("forecast_id"),
        *SERIES, "origin_date", "horizon", "origin_price", "predicted_price",
        start.alias("window_start"), F.date_add(start, WINDOW_DAYS).alias("window_end"),
        F.lit(cohort).alias("cohort"), F.lit("PENDING").alias("status"))
    if existing is None:
        return out
    return out.join(existing.select("forecast_id"), "forecast_id", "left_anti")


def generate_volatility_forecasts(batch: DataFrame, stored: DataFrame, origin: str, low: float = ZERO_MOVE_CUTOFF,
                                  high: float = 6.0, horizon: int = 14, cohort: str = "PROSPECTIVE",
                                  existing: DataFrame | None = None) -> DataFrame:
    """PENDING volatility forecasts of the series observed on the origin date.

    Short batches are completed from stored history (batch values win). The
    persistence class is that of the past calendar range; class probabilities are
    the shares of that class over the last 30 rows.
    """
    cols = [*OBS_KEY, "modal_price"]
    ranked = stored.select(*cols, F.lit(0).alias("_src")).unionByName(batch.select(*cols, F.lit(1).alias("_src")))
    usable = ranked.filter((F.col("modal_price") > 0) & (F.col("reported_date") <= _day(origin)))
    history = first_by(usable, OBS_KEY, ["_src", "modal_price"], keep_last=True).drop("_src")
    w = series_window()
    rows = past_calendar_persistence(history, horizon).select(
        *cols, classify3(F.col(f"past_pct_range_{horizon}d"), low, high).alias("persistence_class"))
    known = F.count("persistence_class").over(trailing(w, 30))
    share = lambda k: F.count_if(F.col("persistence_class") == k).over(trailing(w, 30)) / known
    scored = rows.select(
        *cols, "persistence_class", F.row_number().over(w).alias("history"), known.alias("_known"),
        *[F.when(known > 0, share(k)).alias(p) for k, p in zip(CLASSES, M.PROBS)])
    ready = scored.filter((F.col("reported_date") == _day(origin)) & (F.col("history") >= MIN_VOLATILITY_HISTORY)
                          & (F.col("_known") > 0))
    _, label = M.top1()
    c = F.col
    out = ready.select(
        volatility_forecast_id(c("commodity"), c("market"), c("variety"), c("reported_date"), F.lit(horizon),
                               F.lit("class-share")).alias("forecast_id"),
        *SERIES, c("reported_date").alias("origin_date"), F.lit(horizon).alias("horizon"),
        c("modal_price").alias("origin_price"), "persistence_class", label.alias("predicted_class"), *M.PROBS,
        F.date_add("reported_date", 1).alias("window_start"), F.date_add("reported_date", horizon).alias("window_end"),
        F.lit(cohort).alias("cohort"), F.lit("PENDING").alias("status"))
    if existing is None:
        return out
    return out.join(existing.select("forecast_id"), "forecast_id", "left_anti")


def replay_origins(obs: DataFrame, origins: Sequence[str], existing: DataFrame | None = None) -> DataFrame:
    """Retrospective forecasts at many past origins in one plan."""
    return generate_price_forecasts(obs, origins, existing=existing, cohort="RETROSPECTIVE")


# --- resolving ---------------------------------------------------------------------

OUTCOME = {"target_date": "date", "actual_price": "double", "actual_offset": "int", "abs_error": "double",
           "pct_error": "double", "persistence_abs_error": "double", "persistence_pct_error": "double",
           "reason": "string"}


def _with_outcome_columns(ledger: DataFrame) -> DataFrame:
    return ledger.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OUTCOME.items() if c not in ledger.columns])


def _resolved(matched: DataFrame, base_cols: Sequence[str], open_: Column, closed: Column,
              reasons: dict[str, Column | str]) -> DataFrame:
    """Outcome columns and the new status of matched ledger rows."""
    hit = open_ & F.col("_date").isNotNull()
    gone = open_ & F.col("_date").isNull() & closed & (F.col("status") == "PENDING")
    err, perr = F.abs(F.col("_price") - F.col("predicted_price")), F.abs(F.col("_price") - F.col("origin_price"))
    as_pct = lambda e: F.when(F.col("_price") != 0, e / F.abs("_price") * 100)
    new = {"target_date": F.col("_date"), "actual_price": F.col("_price"),
           "actual_offset": F.datediff("_date", "origin_date"), "abs_error": err, "pct_error": as_pct(err),
           "persistence_abs_error": perr, "persistence_pct_error": as_pct(perr)}
    why = F.when(F.col("status") == "TARGET_UNAVAILABLE", reasons["late"]).otherwise(reasons["match"])
    cols = []
    for c in base_cols:
        if c in new:
            cols.append(F.when(hit, new[c]).otherwise(F.col(c)).alias(c))
        elif c == "status":
            cols.append(F.when(hit, "EVALUATED").when(gone, "TARGET_UNAVAILABLE").otherwise(F.col(c)).alias(c))
        elif c == "reason":
            cols.append(F.when(hit, why).when(gone, reasons["closed"]).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return matched.select(*cols)


def _matched(ledger: DataFrame, obs: DataFrame) -> DataFrame:
    hits = outcome_match_join(ledger.select("forecast_id", *SERIES, "window_start", "window_end"), obs).select(
        "forecast_id", F.col("target_date").alias("_date"), F.col("actual_price").alias("_price"))
    return ledger.join(hits, "forecast_id", "left")


def resolve_price_outcomes(ledger: DataFrame, obs: DataFrame, recheck: bool = False) -> DataFrame:
    """Earliest observation in the window evaluates a forecast.

    Without one the forecast becomes unavailable once its series has reported past
    the window, and stays pending otherwise. ``recheck`` gives unavailable
    forecasts another look, for observations that arrived late.
    """
    ledger = _with_outcome_columns(ledger)
    latest = obs.groupBy(*SERIES).agg(F.max("reported_date").alias("_latest"))
    rows = _matched(ledger, obs).join(latest, list(SERIES), "left")
    states = ("PENDING", "TARGET_UNAVAILABLE") if recheck else ("PENDING",)
    closed = F.coalesce(F.col("_latest") > F.col("window_end"), F.lit(False))
    return _resolved(rows, ledger.columns, F.col("status").isin(*states), closed, {
        "late": F.lit("late observation"), "match": F.lit("observation in window"),
        "closed": F.lit("window closed without observation")})


def resolve_commodity_outcomes(ledger: DataFrame, obs: DataFrame, as_of: str) -> DataFrame:
    """As above with a global closing date, plus the signed residual and the movement class."""
    ledger = _with_outcome_columns(ledger)
    closed = _day(as_of) > F.col("window_end")
    out = _resolved(_matched(ledger, obs), ledger.columns, F.col("status") == "PENDING", closed, {
        "late": F.lit("late observation"), "match": F.lit("MATCHED_WINDOW_OBSERVATION"),
        "closed": F.lit("WINDOW_CLOSED_WITHOUT_OBSERVATION")})
    moved = F.abs(F.col("actual_price") - F.col("origin_price")) / (F.col("origin_price") + 1e-4) * 100
    return out.select("*", (F.col("actual_price") - F.col("predicted_price")).alias("residual"),
                      movement_class(moved).alias("actual_class"))


def resolve_volatility_outcomes(ledger: DataFrame, obs: DataFrame, as_of: str, low: float = ZERO_MOVE_CUTOFF,
                                high: float = 6.0, recheck: bool = False) -> DataFrame:
    """Range of the origin price and all positive prices in the window, once it ended by as_of."""
    slim = ledger.select("forecast_id", *SERIES, "window_start", "window_end")
    hits = window_extremes_join(slim, obs).select("forecast_id", "window_obs", "window_min", "window_max")
    rows = ledger.join(hits, "forecast_id", "left")
    states = ("PENDING", "WINDOW_EMPTY") if recheck else ("PENDING",)
    due = F.col("status").isin(*states) & (F.col("window_end") <= _day(as_of))
    seen = due & (F.coalesce("window_obs", F.lit(0)) > 0)
    lo, hi = F.least("window_min", "origin_price"), F.greatest("window_max", "origin_price")
    pct = (hi - lo) / (F.col("origin_price") + 1e-4) * 100
    return rows.select(
        *[c for c in ledger.columns if c != "status"],
        F.when(seen, "EVALUATED").when(due, "WINDOW_EMPTY").otherwise(F.col("status")).alias("status"),
        F.when(seen, F.col("window_obs")).when(due, F.lit(0)).alias("matched_trades"),
        F.when(seen, lo).alias("actual_min"), F.when(seen, hi).alias("actual_max"),
        F.when(seen, pct).alias("actual_pct_range"), F.when(seen, classify3(pct, low, high)).alias("actual_class"))


# --- reporting ---------------------------------------------------------------------

def ledger_status(ledger: DataFrame) -> DataFrame:
    """Counts and latest origin for every combination of status, horizon and cohort, with totals."""
    base = ledger.groupBy("status", "horizon", "cohort").agg(
        F.count("*").alias("n"), F.max("origin_date").alias("d"))
    return base.cube("status", "horizon", "cohort").agg(
        F.sum("n").alias("n"), F.max("d").alias("latest_origin"), F.grouping_id().alias("level"))


def price_shadow_metrics(ledger: DataFrame, tolerance: float = M.TOLERANCE) -> DataFrame:
    """Per horizon and cohort: status counts, both error suites, intervals and the win rate."""
    ev = F.col("status") == "EVALUATED"
    y = F.when(ev, F.col("actual_price"))
    m = M.regression_aggs(y, "predicted_price", tolerance)
    b = M.regression_aggs(y, "origin_price", tolerance, "_persistence")
    diff = F.when(ev, F.col("abs_error") - F.col("persistence_abs_error"))
    half = 1.96 * F.stddev_samp(diff) / F.sqrt(F.count(diff))
    enough = F.count(diff) >= 10
    aggs = {"total": F.count("*"), "evaluated": F.count_if(ev), "pending": F.count_if(F.col("status") == "PENDING"),
            "unavailable": F.count_if(F.col("status") == "TARGET_UNAVAILABLE")}
    aggs |= {k: v for k, v in (m | b).items() if k not in ("n", "n_persistence")}
    aggs |= {"mae_delta": F.avg(diff), "mae_delta_low": F.when(enough, F.avg(diff) - half),
             "mae_delta_high": F.when(enough, F.avg(diff) + half),
             "win_rate_pct": F.try_divide(
                 F.count_if(ev & (F.col("abs_error") <= F.col("persistence_abs_error"))), F.count_if(ev)) * 100}
    out = ledger.groupBy("horizon", "cohort").agg(*[e.alias(k) for k, e in aggs.items()])
    return out.withColumn("gate", F.when(F.col("mae_delta") <= 0, "PASSES_BENCHMARK")
                          .when(F.col("mae_delta") > 0, "EXPERIMENTAL_DEFICIT_CONFIRMED"))


def offset_distribution(ledger: DataFrame) -> DataFrame:
    return (ledger.filter("status = 'EVALUATED'").groupBy("horizon", "actual_offset")
            .agg(F.count("*").alias("n")))


def volatility_shadow_metrics(ledger: DataFrame, reps: int = M.DELTA_REPLICATES, min_obs: int = 20) -> DataFrame:
    """One row: classification of both, Brier, calibration, market comparison and the promotion verdict."""
    ev = ledger.filter("status = 'EVALUATED'")
    counts = M.confusion_counts("actual_class", "predicted_class", "_ml") | M.confusion_counts(
        "actual_class", "persistence_class", "_base")
    wide = ev.agg(*[e.alias(k) for k, e in counts.items()],
                  F.datediff(F.max("window_end"), F.min("origin_date")).alias("days"),
                  F.countDistinct("market").alias("markets"))
    ml, base = M.classification_exprs("_ml"), M.classification_exprs("_base")
    ece = M.ece_classwise(ev, "actual_class").filter("label = 'ALL'").agg(F.max("ece")).scalar()
    brier = M.brier_multiclass(ev, "actual_class").agg(F.max("brier")).scalar()
    markets = M.market_level_comparison(ev, "actual_class", "predicted_class", "persistence_class", min_obs)
    wins = markets.agg(F.try_divide(F.count_if(F.col("outcome") == "win"), F.count("*")) * 100).scalar()
    boot = row_scalar(M.mean_delta_bootstrap(markets, "market", "delta_macro_f1", reps))
    evidence = wide.select(
        ml["n_ml"].alias("forecasts"), "days", "markets", ml["accuracy_ml"].alias("accuracy"),
        ml["macro_f1_ml"].alias("macro_f1"), base["accuracy_base"].alias("persistence_accuracy"),
        base["macro_f1_base"].alias("persistence_macro_f1"), ml["high_recall_ml"].alias("high_recall"),
        brier.alias("brier"), ece.alias("macro_ece"), wins.alias("win_rate_pct"),
        boot["mean_delta"].alias("mean_delta"), boot["ci_low"].alias("ci_low"), boot["ci_high"].alias("ci_high"))
    return M.promotion_gate(evidence)


# --- yield ledger --------------------------------------------------------------------

def yield_ledger_reconcile(ledger: DataFrame, actuals: DataFrame) -> DataFrame:
    """Pending yield forecasts with published actuals become EVALUATED."""
    a = actuals.filter("actual_kg_ha > 0").select("crop", "district", "year", F.col("actual_kg_ha").alias("_a"))
    j = ledger.join(a, ["crop", "district", "year"], "left")
    hit = (F.col("status") == "PENDING") & F.col("_a").isNotNull()
    return j.select(*[c for c in ledger.columns if c != "status"],
                    F.when(hit, F.col("_a")).alias("actual_kg_ha"),
                    F.when(hit, "EVALUATED").otherwise(F.col("status")).alias("status"))


def yield_ledger_metrics(ledger: DataFrame, by: Sequence[str] = ("crop",)) -> DataFrame:
    """MAE, RMSE, bias and 80 % interval coverage of evaluated yield forecasts."""
    ev = ledger.filter("status = 'EVALUATED'")
    r = F.col("predicted_kg_ha") - F.col("actual_kg_ha")
    known = F.col("p10_kg_ha").isNotNull() & F.col("p90_kg_ha").isNotNull()
    inside = known & F.col("actual_kg_ha").between(F.col("p10_kg_ha"), F.col("p90_kg_ha"))
    return ev.groupBy(*by).agg(
        F.count("*").alias("evaluated"), F.avg(F.abs(r)).alias("mae"), F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(r).alias("bias"), F.count_if(known).alias("valid_intervals"),
        F.coalesce(F.try_divide(F.count_if(inside), F.count_if(known)) * 100, F.lit(0.0)).alias("coverage_pct"))
