"""Joins shared by evaluation and the forecast ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.schemas import OBS_KEY, SERIES
from granary.session import materialize


def holdout_feature_join(holdout: DataFrame, features: DataFrame, keys: Sequence[str] = OBS_KEY) -> DataFrame:
    """Labelled holdout rows with recomputed features of the same series and day."""
    return holdout.join(features, list(keys))


def lookup_join(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join to a small table; it is written first, so its size is known and decides about the broadcast."""
    return df.join(materialize(lookup, "lookup"), list(keys), "left")


def outcome_match_join(forecasts: DataFrame, obs: DataFrame) -> DataFrame:
    """Forecasts with the earliest observation of their series inside their window.

    Windows are a few days long, so each forecast names the days it accepts and
    joins on (series, day): an equi-join with as many rows per forecast as
    window days, whatever the length of the series.
    """
    days = forecasts.select(
        "forecast_id", *SERIES, F.explode(F.sequence("window_start", "window_end")).alias("_day"))
    seen = obs.select(*SERIES, F.col("reported_date").alias("_day"), F.col("modal_price").alias("_price"))
    hit = (days.join(seen, [*SERIES, "_day"])
           .groupBy("forecast_id").agg(F.min(F.struct("_day", "_price")).alias("_hit")))
    return forecasts.join(hit, "forecast_id", "left").select(
        *forecasts.columns, F.col("_hit._day").alias("target_date"), F.col("_hit._price").alias("actual_price"))


def window_extremes_join(forecasts: DataFrame, obs: DataFrame) -> DataFrame:
    """Forecasts with count, lowest, highest and last date of the positive prices in their window."""
    days = forecasts.select(
        "forecast_id", *SERIES, F.explode(F.sequence("window_start", "window_end")).alias("_day"))
    seen = obs.filter("modal_price > 0").select(
        *SERIES, F.col("reported_date").alias("_day"), F.col("modal_price").alias("_price"))
    hit = (days.join(seen, [*SERIES, "_day"]).groupBy("forecast_id")
           .agg(F.count("*").alias("window_obs"), F.min("_price").alias("window_min"),
                F.max("_price").alias("window_max"), F.max("_day").alias("last_window_date")))
    return forecasts.join(hit, "forecast_id", "left")
