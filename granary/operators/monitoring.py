"""Freshness, drift, service health and the daily run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.distributed import exact_quantiles, row_scalar, running_by_value
from granary.operators import cleaning as C
from granary.operators import ledger as K
from granary.operators.upserts import upsert_keep_first, upsert_last_wins
from granary.schemas import OBS_KEY
from granary.session import materialize

MAX_LAG_DAYS = 14       # fixed value
GROUP_SHIFT_PCT = 35.0  # fixed value
COMPOSITION_PCT = 25.0  # fixed value
STD_RATIO = 2.0         # fixed value
MIN_GROUP_ROWS = 5      # fixed value

# Published price statistics per commodity: mean, std, p25, median, p75, IQR. Fixed values.
COMMODITY_BASELINES = {
    "rice": (2420.50, 620.30, 1950.00, 2380.00, 2850.00, 900.00),
    "wheat": (1587.78, 435.60, 1300.00, 1580.00, 1850.00, 550.00),
    "potato": (1027.08, 583.93, 590.00, 900.00, 1350.00, 760.00),
    "tea": (13739.68, 5273.01, 10000.00, 13500.00, 16000.00, 6000.00),
}
BASELINE_COLUMNS = ("price_mean", "price_std", "price_p25", "price_median", "price_p75", "price_iqr")


def commodity_baselines(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in COMMODITY_BASELINES.items()]
    return spark.createDataFrame(rows, "commodity string, " + ", ".join(f"{c} double" for c in BASELINE_COLUMNS))


def learned_baselines(train: DataFrame, by: Sequence[str], price: str = "modal_price") -> DataFrame:
    """The same statistics recomputed from a training slice."""
    stats = train.groupBy(*by).agg(F.avg(price).alias("price_mean"), F.stddev_pop(price).alias("price_std"))
    q = exact_quantiles(train, price, {"price_p25": 0.25, "price_median": 0.5, "price_p75": 0.75}, by)
    return stats.join(q, list(by)).withColumn("price_iqr", F.col("price_p75") - F.col("price_p25"))


def _day(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date")


def freshness(batch: DataFrame, as_of, max_lag: int = MAX_LAG_DAYS, floor_at_zero: bool = False,
              by: Sequence[str] = ()) -> DataFrame:
    """Latest date, lag in days and the stale flag; an empty batch is stale."""
    lag = F.datediff(_day(as_of), F.max("reported_date"))
    lag = F.greatest(lag, F.lit(0)) if floor_at_zero else lag
    return batch.groupBy(*by).agg(
        F.max("reported_date").alias("latest_date"), F.when(F.max("reported_date").isNotNull(), lag).alias("lag_days"),
        F.coalesce(lag > max_lag, F.lit(True)).alias("is_stale"))


def drift_mean_2sd(batch: DataFrame, baselines: DataFrame, price: str = "modal_price") -> DataFrame:
    """Batch statistics per commodity; drift when the mean is over two baseline deviations away."""
    by = ["commodity"]
    s = batch.groupBy(*by).agg(F.count("*").alias("n"), F.avg(price).alias("mean"), F.stddev_samp(price).alias("std"))
    q = exact_quantiles(batch, price, {"p25": 0.25, "median": 0.5, "p75": 0.75}, by)
    base = baselines.select("commodity", "price_mean", "price_std")
    j = s.join(q, by).join(base, by, "left")
    return j.select("commodity", "n", "mean", "std", "median", (F.col("p75") - F.col("p25")).alias("iqr"),
                    (F.col("mean") - F.col("price_mean")).alias("mean_delta"),
                    (F.abs(F.col("mean") - F.col("price_mean")) > 2 * F.col("price_std")).alias("drift"))


def group_shifts(batch: DataFrame, baselines: DataFrame, col: str, price: str = "modal_price") -> DataFrame:
    """Median shift per group with enough rows and a baseline median."""
    n = batch.groupBy(col).agg(F.count("*").alias("n"))
    med = exact_quantiles(batch, price, {"batch_median": 0.5}, [col])
    j = (n.filter(F.col("n") >= MIN_GROUP_ROWS).join(med, col)
         .join(baselines.select(col, F.col("price_median").alias("baseline_median")), col))
    shift = (F.col("batch_median") - F.col("baseline_median")) / F.col("baseline_median") * 100
    return j.select(F.lit(col).alias("kind"), F.col(col).alias("value"), "n", "batch_median", "baseline_median",
                    shift.alias("pct_shift"), (F.abs(shift) > GROUP_SHIFT_PCT).alias("drift"))


def drift_group_aware(batch: DataFrame, overall: DataFrame, varieties: DataFrame, markets: DataFrame,
                      price: str = "modal_price") -> DataFrame:
    """One row: global shift, group anomalies and whether only the composition changed.

    ``overall`` is a one-row baseline. A global shift counts as composition only
    when every evaluated variety stays within 25 % and no group is anomalous.
    """
    q = row_scalar(exact_quantiles(batch, price, {"median": 0.5}))
    base = row_scalar(overall.select("price_median", "price_std"))
    v, m = group_shifts(batch, varieties, "variety", price), group_shifts(batch, markets, "market", price)
    vs = row_scalar(v.agg(F.count("*").alias("n"), F.count_if("drift").alias("bad"), F.max(F.abs("pct_shift")).alias("worst")))
    ms = row_scalar(m.agg(F.count("*").alias("n"), F.count_if("drift").alias("bad")))
    s = batch.agg(F.count("*").alias("n"), F.avg(price).alias("mean"), F.stddev_pop(price).alias("std"))
    med = q["median"]
    shift = (med - base["price_median"]) / base["price_median"] * 100
    r = s.select("*", med.alias("median"), shift.alias("median_pct_shift"), (F.col("std") / base["price_std"]).alias("std_ratio"),
                 vs["n"].alias("varieties_checked"), ms["n"].alias("markets_checked"),
                 (vs["bad"] + ms["bad"]).alias("anomalies"), vs["worst"].alias("_worst"))
    raw = (F.abs("median_pct_shift") > GROUP_SHIFT_PCT) | (F.col("std_ratio") > STD_RATIO)
    only = raw & (F.col("anomalies") == 0) & (F.col("varieties_checked") > 0) & (F.col("_worst") <= COMPOSITION_PCT)
    only = F.coalesce(only, F.lit(False))
    drift = ~only & ((F.col("anomalies") > 0) | F.coalesce(raw, F.lit(False)))
    verdict = (F.when(only, "composition").when(F.col("anomalies") > 0, "group_drift")
               .when(drift, "global_drift").otherwise("nominal"))
    return r.select(*[c for c in r.columns if c != "_worst"], only.alias("composition_shift_only"),
                    drift.alias("drift_detected"), verdict.alias("verdict"))


def service_health_rollup(events: DataFrame, by: str = "service", keep: int = 1000) -> DataFrame:
    """Success and error rates, index-based latency percentiles of the last ``keep`` successful calls and of all of them.

    ``row_number() <= keep`` is applied per input task before the shuffle (window
    group limit), so a busy service sends at most ``keep`` rows per task. The percentiles of the whole
    period are exact, from running counts over buckets of latencies.
    """
    w = Window.partitionBy(by).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = (events.filter("ok").select(by, "latency", "ts", "event_id", F.row_number().over(w).alias("rn"))
            .filter(F.col("rn") <= keep))
    sorted_ = last.groupBy(by).agg(F.sort_array(F.collect_list("latency")).alias("a"))
    n = F.size("a")
    lat = sorted_.select(by, F.element_at("a", (F.floor(n * 0.5) + 1).cast("int")).alias("p50"),
                         F.element_at("a", (F.least(F.floor(n * 0.95), n - 1) + 1).cast("int")).alias("p95"),
                         n.alias("latencies"))
    ranked = running_by_value(events.filter("ok").filter(F.col(by).isNotNull()), "latency", {"m": F.lit(1)}, [by])
    total = F.col("m_total")
    hit = lambda rank: F.max(F.when((F.col("m_before") <= rank) & (rank < F.col("m_before") + F.col("m")), F.col("latency")))
    period = ranked.groupBy(by).agg(
        hit(F.floor(total * 0.5)).alias("p50_period"), hit(F.least(F.floor(total * 0.95), total - 1)).alias("p95_period"),
        F.max(total).alias("latencies_period"))
    rates = events.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(~F.col("ok")).alias("errors"),
        F.count_if("is_ingest").alias("ingestions"), F.count_if(F.col("is_ingest") & F.col("ok")).alias("ingestions_ok"))
    err = F.coalesce(F.try_divide(F.col("errors"), F.col("total")) * 100, F.lit(0.0))
    return rates.join(lat, by, "left").join(period, by, "left").select(
        by, "total", "errors", err.alias("error_rate_pct"),
        F.coalesce(F.try_divide(F.col("ingestions_ok"), F.col("ingestions")) * 100, F.lit(100.0)).alias("ingestion_success_pct"),
        F.coalesce("p50", F.lit(0.0)).alias("p50"), F.coalesce("p95", F.lit(0.0)).alias("p95"),
        F.coalesce("latencies", F.lit(0)).alias("latencies"),
        F.coalesce("p50_period", F.lit(0.0)).alias("p50_period"), F.coalesce("p95_period", F.lit(0.0)).alias("p95_period"),
        F.coalesce("latencies_period", F.lit(0)).cast("long").alias("latencies_period"),
        F.when(err > 20, "degraded").otherwise("healthy").alias("health"))


def daily_prospective_run(raw_batch: DataFrame, stored: DataFrame, ledger: DataFrame, as_of: str, overall: DataFrame,
                          allow_stale: bool = False, markets: DataFrame | None = None,
                          varieties: DataFrame | None = None) -> dict[str, DataFrame]:
    """Normalise, upsert, check freshness and drift, issue, resolve, report.

    Gates are values inside the plan: a stale or empty batch leaves the forecast
    table empty, everything else still runs. Nothing is collected. Batch, merged
    table and forecasts are written once, and every later step reads them.
    """
    batch = materialize(C.normalize_batch(raw_batch, markets, varieties), "batch")
    merged = upsert_last_wins(stored.withColumn("created_at", _day(as_of)), batch.withColumn("created_at", _day(as_of)),
                              ["modal_price", "arrivals"]).drop("created_at")
    merged = materialize(merged, "observations")
    fresh = freshness(batch, as_of)
    is_open = F.lit(True) if allow_stale else ~fresh.select("is_stale").scalar()
    has_rows = batch.agg(F.count("*")).scalar() > 0
    ledger = materialize(ledger, "ledger")
    issued = materialize(K.generate_price_forecasts(merged, [as_of], existing=ledger).filter(is_open & has_rows), "issued")
    resolved = materialize(K.resolve_price_outcomes(ledger, merged, recheck=True), "resolved")
    book = resolved.unionByName(K._with_outcome_columns(issued))
    metrics = K.price_shadow_metrics(book)
    drift = drift_mean_2sd(batch, overall)
    states = row_scalar(resolved.agg(F.count_if(F.col("status") == "EVALUATED").alias("evaluated"),
                                     F.count_if(F.col("status") == "PENDING").alias("pending")))
    audit = fresh.select(
        _day(as_of).alias("run_date"), F.when(~has_rows, "EMPTY").when(~is_open, "STALE").otherwise("OK").alias("status"),
        "latest_date", "lag_days", "is_stale", batch.agg(F.count("*")).scalar().alias("accepted"),
        drift.agg(F.max("drift")).scalar().alias("drift"), issued.agg(F.count("*")).scalar().alias("forecasts_issued"),
        states["evaluated"].alias("evaluated"), states["pending"].alias("pending"))
    return {"observations": merged, "ledger": book, "metrics": metrics, "audit": audit}
