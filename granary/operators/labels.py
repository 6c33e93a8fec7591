"""Forward-looking labels over calendar or row frames; no self-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.distributed import exact_quantiles, row_scalar
from granary.functions.scalars import CLASSES, classify3, log_return, pct_change
from granary.functions.windows import days_around, full, series_window, trailing

PRICE = "modal_price"
DATE = "reported_date"

# Share of price (in %) up to which a movement counts as none. Fixed value.
ZERO_MOVE_CUTOFF = 0.014286


# --- price targets ------------------------------------------------------------

def next_obs_target(df: DataFrame, max_days: int = 7) -> DataFrame:
    """Next price of the series when it comes within max_days."""
    w = series_window()
    nxt, gap = F.lead(PRICE).over(w), F.datediff(F.lead(DATE).over(w), F.col(DATE))
    rows = df.select("*", nxt.alias("future_price"), gap.alias("days_to_next"))
    return rows.filter((F.col("days_to_next") > 0) & (F.col("days_to_next") <= max_days)).withColumns({
        "future_change": F.col("future_price") - F.col(PRICE),
        "future_pct_change": pct_change(F.col("future_price"), F.col(PRICE)) / 100,
        "future_log_return": log_return(F.col("future_price"), F.col(PRICE))})


def forward_calendar_target(df: DataFrame, horizon: int, tolerance: int = 3) -> DataFrame:
    """First observation in [t + H, t + H + tolerance], NULL without one."""
    frame = days_around(horizon, horizon + tolerance)
    hit = F.first(F.struct(F.col(DATE).alias("d"), F.col(PRICE).alias("p"))).over(frame)
    s = f"{horizon}d"
    return df.withColumn("_hit", hit).select(
        *df.columns, F.col("_hit.d").alias(f"target_date_{s}"), F.col("_hit.p").alias(f"future_price_{s}"),
        (F.col("_hit.p") - F.col(PRICE)).alias(f"target_change_{s}"),
        F.datediff("_hit.d", DATE).alias(f"actual_days_{s}"))


def dual_horizon_targets(df: DataFrame, horizons: Sequence[int] = (14, 30), tolerance: int = 3) -> DataFrame:
    """Both horizons over one sorted partitioning."""
    for h in horizons:
        df = forward_calendar_target(df, h, tolerance)
    return df


def nearest_calendar_target(df: DataFrame, horizon: int = 7, tolerance: int = 3,
                            tie: str = "forward") -> DataFrame:
    """Observation closest to t + H within the tolerance; equal distances go forward or backward.

    The frame holds at most 2 * tolerance + 1 rows of a series.
    """
    if tie not in ("forward", "backward"):
        raise ValueError(f"unknown tie rule {tie!r}")
    frame = days_around(horizon - tolerance, horizon + tolerance)
    near = F.collect_list(F.struct(F.col(DATE).alias("d"), F.col(PRICE).alias("p"))).over(frame)
    offset = lambda x: F.datediff(x["d"], F.col(DATE)) - horizon
    sign = -1 if tie == "forward" else 1
    ranked = F.transform(F.col("_near"), lambda x: F.struct(
        F.abs(offset(x)).alias("far"), (offset(x) * sign).alias("side"), x["d"].alias("d"), x["p"].alias("p")))
    hit = df.withColumn("_near", near).withColumn("_hit", F.array_min(ranked))
    days = F.datediff("_hit.d", DATE)
    return hit.select(
        *df.columns, F.col("_hit.d").alias("target_date"), F.col("_hit.p").alias("future_price"),
        (F.col("_hit.p") - F.col(PRICE)).alias("target_change"), days.alias("actual_offset"),
        (days - horizon).alias("offset_error"))


def obs_shift_target(df: DataFrame, k: int = 7) -> DataFrame:
    """k-th next row and the calendar days it is away."""
    w = series_window()
    return df.select("*", F.lead(PRICE, k).over(w).alias("future_price"),
                     F.datediff(F.lead(DATE, k).over(w), F.col(DATE)).alias("elapsed_days"))


# --- volatility targets ---------------------------------------------------------

def forward_obs_range(n: int = 5) -> Column:
    """max - min of the next n prices, NULL unless all n exist."""
    f = series_window().rowsBetween(1, n)
    return full(F.max(PRICE), F.col(PRICE), f, n) - F.min(PRICE).over(f)


def forward_pct_range(df: DataFrame, n: int = 5) -> DataFrame:
    spread = forward_obs_range(n)
    return df.select("*", spread.alias("future_nominal_range"),
                     (spread / F.col(PRICE) * 100).alias("future_pct_range"),
                     F.lead(DATE, n).over(series_window()).alias("future_target_date"))


def _calendar_extremes(lo: int, hi: int):
    """Count, min, max and last date of positive prices lo..hi days away."""
    f = days_around(lo, hi)
    good = F.when(F.col(PRICE) > 0, F.col(PRICE))
    return (F.count(good).over(f), F.min(good).over(f), F.max(good).over(f),
            F.max(F.when(F.col(PRICE) > 0, F.col(DATE))).over(f))


def _range_with_own(n: Column, low: Column, high: Column, minimum: int) -> Column:
    p = F.col(PRICE)
    spread = F.greatest(high, p) - F.least(low, p)
    return F.when((p > 0) & (n >= minimum), spread / (p + 1e-4) * 100)


def forward_calendar_range(df: DataFrame, horizon: int, min_obs: int = 1) -> DataFrame:
    """Range of P_t and the positive prices in (t, t + H] as % of P_t, with count and last date."""
    n, low, high, last = _calendar_extremes(1, horizon)
    s = f"{horizon}d"
    priced = F.col(PRICE) > 0
    return df.select(
        "*", _range_with_own(n, low, high, min_obs).alias(f"future_pct_range_{s}"),
        F.when(priced & (n >= min_obs), last).alias(f"future_target_date_{s}"),
        F.when(priced, n).otherwise(0).alias(f"future_obs_count_{s}"))


def forward_window_range_excl(df: DataFrame, horizon: int) -> DataFrame:
    """Range of the prices in (t, t + H] without P_t."""
    f = days_around(1, horizon)
    spread = F.max(PRICE).over(f) - F.min(PRICE).over(f)
    s = f"{horizon}d"
    return df.select("*", spread.alias(f"window_range_{s}"),
                     (spread / F.col(PRICE) * 100).alias(f"window_pct_range_{s}"),
                     F.count(PRICE).over(f).alias(f"window_obs_{s}"))


def past_calendar_persistence(df: DataFrame, horizon: int) -> DataFrame:
    """The same range over [t - H, t), NULL without a past observation."""
    n, low, high, _ = _calendar_extremes(-horizon, -1)
    s = f"{horizon}d"
    return df.select("*", _range_with_own(n, low, high, 1).alias(f"past_pct_range_{s}"),
                     F.when(F.col(PRICE) > 0, n).otherwise(0).alias(f"past_obs_count_{s}"))


def past_obs_persistence(df: DataFrame, nominal: tuple[float, float], pct: tuple[float, float],
                         n: int = 5) -> DataFrame:
    """Class of the range of the last n rows, in price units and in %."""
    f = trailing(series_window(), n)
    spread = full(F.max(PRICE), F.col(PRICE), f, n) - F.min(PRICE).over(f)
    return df.select("*", classify3(spread, *nominal).alias("persistence_nominal"),
                     classify3(spread / (F.col(PRICE) + 1e-4) * 100, *pct).alias("persistence_pct"))


# --- thresholds and classes -------------------------------------------------------

def thresholds_quantile_or_zero_aware(df: DataFrame, col: str, min_nonzero: int = 10) -> DataFrame:
    """One row (low, high, method): p33/p66 when they separate, else zero-aware.

    Zero-aware: half of the smallest non-zero value and the median of the
    non-zero values (their p75 when that does not separate). Fewer than
    ``min_nonzero`` non-zero values are an error.
    """
    nonzero = df.filter(F.col(col) > 0)
    q = row_scalar(exact_quantiles(df, col, {"p33": 0.33, "p66": 0.66}))
    z = row_scalar(exact_quantiles(nonzero, col, {"p50": 0.5, "p75": 0.75}))
    counts = df.agg(F.count(col).alias("n_values"), F.count_if(F.col(col) > 0).alias("n_nonzero"),
                    F.min(F.when(F.col(col) > 0, F.col(col))).alias("smallest"))
    c = counts.select("*", q.alias("q"), z.alias("z"))
    separated = F.coalesce((F.col("q.p33") > 0) & (F.col("q.p33") < F.col("q.p66")), F.lit(False))
    sparse = F.raise_error(F.concat(F.col("n_nonzero").cast("string"), F.lit(" non-zero values are too few")))
    half = F.col("smallest") / 2
    return c.select(
        F.when(separated, F.col("q.p33")).when(F.col("n_nonzero") < min_nonzero, sparse.cast("double"))
        .otherwise(half).alias("low"),
        F.when(separated, F.col("q.p66")).when(half >= F.col("z.p50"), F.col("z.p75"))
        .otherwise(F.col("z.p50")).alias("high"),
        F.when(separated, "quantiles").otherwise("zero-aware").alias("method"), "n_values", "n_nonzero")


def thresholds_nonzero_median(df: DataFrame, col: str, cutoff: float = ZERO_MOVE_CUTOFF) -> DataFrame:
    """Fixed low bound; the high bound is the exact median of the values above it."""
    above = df.filter(F.col(col) > cutoff)
    median = exact_quantiles(above, col, {"m": 0.5}).scalar()
    return df.agg(F.count(col).alias("n_values"),
                  (F.try_divide(F.count_if(F.col(col) <= cutoff), F.count(col)) * 100).alias("zero_pct")).select(
        F.lit(cutoff).alias("low"), median.alias("high"), "n_values", "zero_pct")


def label_with(df: DataFrame, thresholds: DataFrame, col: str, out: str) -> DataFrame:
    """Classes by a one-row threshold table, looked up once as a value."""
    t = row_scalar(thresholds.select("low", "high"))
    return df.withColumn(out, classify3(F.col(col), t["low"], t["high"]))


def volatility_labels(train: DataFrame, test: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled train and test rows and the thresholds, which only train decides."""
    col = "future_range"
    train = train.withColumn(col, forward_obs_range(n)).filter(F.col(col).isNotNull())
    test = test.withColumn(col, forward_obs_range(n)).filter(F.col(col).isNotNull())
    thresholds = thresholds_quantile_or_zero_aware(train, col)
    return (label_with(train, thresholds, col, "volatility_class"),
            label_with(test, thresholds, col, "volatility_class"), thresholds)


def class_counts(df: DataFrame, col: str = "volatility_class", require_all: bool = True) -> DataFrame:
    """One row with a count per class; an empty class is an error when all are required."""
    n = {c: F.count_if(F.col(col) == c) for c in CLASSES}
    out = df.agg(*[e.alias(c.lower()) for c, e in n.items()])
    if require_all:
        empty = (F.least(*[F.col(c.lower()) for c in CLASSES]) == 0)
        out = out.withColumn("low", F.when(empty, F.raise_error(F.lit("a volatility class is empty")).cast("long"))
                             .otherwise(F.col("low")))
    return out


def delta_target(y: Column, baseline: Column) -> Column:
    return y - baseline


def class_weights(df: DataFrame, col: str, strategy: str = "balanced") -> DataFrame:
    """n / (classes * count) per class, its square root, or 1."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    total = row_scalar(counts.agg(F.sum("n").alias("n"), F.count("*").alias("k")))
    balanced = total["n"] / (total["k"] * F.col("n"))
    weight = {"balanced": balanced, "sqrt": F.sqrt(balanced), "none": F.lit(1.0)}[strategy]
    return counts.select(col, "n", weight.alias("weight"))
