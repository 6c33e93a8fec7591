"""Profiles, distributions and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.distributed import exact_quantiles, row_scalar
from granary.functions.windows import series_window
from granary.schemas import SERIES

PRICE = "modal_price"
DATE = "reported_date"


def time_profiles(obs: DataFrame) -> DataFrame:
    """Yearly and calendar-month mean, std and count in one pass over (year, month) sums."""
    base = obs.groupBy(F.year(DATE).alias("y"), F.month(DATE).alias("m")).agg(
        F.count("*").alias("n"), F.sum(PRICE).alias("s"), F.sum(F.col(PRICE) * F.col(PRICE)).alias("q"))
    kinds = F.array(F.struct(F.lit("year").alias("profile"), F.col("y").alias("period")),
                    F.struct(F.lit("month").alias("profile"), F.col("m").alias("period")))
    g = base.select("n", "s", "q", F.explode(kinds).alias("k")).groupBy("k.profile", "k.period").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n = F.col("n")
    var = F.try_divide(F.col("q") - F.col("s") * F.col("s") / n, n - 1)
    return g.select("profile", "period", "n", (F.col("s") / n).alias("mean"),
                    F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"))


def top_markets(obs: DataFrame, n: int = 6) -> DataFrame:
    """Markets with most rows; ties by name. A bounded top-n, not a full sort."""
    return (obs.groupBy("market").agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), "market").limit(n))


def month_end_means(obs: DataFrame, n: int = 6) -> DataFrame:
    """Monthly mean price of the most active markets."""
    return (obs.join(top_markets(obs, n).select("market"), "market", "left_semi")
            .groupBy("market", F.last_day(DATE).alias("month_end"))
            .agg(F.avg(PRICE).alias("mean_price"), F.count("*").alias("n")))


def gaps(obs: DataFrame) -> DataFrame:
    return obs.select(*SERIES, F.datediff(DATE, F.lag(DATE).over(series_window())).alias("gap"))


def gap_distribution(obs: DataFrame) -> DataFrame:
    """Days between reports. Gaps are small integers: counts per gap carry everything."""
    g = F.col("gap")
    by_gap = gaps(obs).filter("gap IS NOT NULL").groupBy("gap").agg(F.count("*").alias("n"))
    total = F.sum("n")
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / total * 100
    return by_gap.agg(
        total.alias("n"), (F.sum(g * F.col("n")) / total).alias("mean"),
        F.percentile("gap", F.lit(0.5), F.col("n")).alias("median"), share(g == 1).alias("pct_1"),
        share(g.between(2, 3)).alias("pct_2_3"), share(g.between(4, 7)).alias("pct_4_7"),
        share(g > 7).alias("pct_over_7"), F.max("gap").alias("max"))


def flat_price_share(split: DataFrame, target_change: str = "future_change") -> DataFrame:
    """% of zero steps between rows and of zero target changes, per split role."""
    d = F.col(PRICE) - F.lag(PRICE).over(series_window())
    share = lambda c: F.try_divide(F.count_if(c == 0), F.count(c)) * 100
    return split.select("role", d.alias("_d"), F.col(target_change).alias("_t")).groupBy("role").agg(
        F.count("*").alias("n"), share(F.col("_d")).alias("flat_step_pct"), share(F.col("_t")).alias("flat_target_pct"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the smallest and largest value; the last bin includes its end."""
    b = row_scalar(df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")))
    lo, hi = b["lo"], b["hi"]
    width = (hi - lo) / bins
    idx = F.when(hi > lo, F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.filter(F.col(col).isNotNull()).groupBy(idx.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counts.select("bin", (lo + F.col("bin") * width).alias("left_edge"), "n")


def class_distribution(df: DataFrame, label: str, by: str = "role") -> DataFrame:
    counts = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return counts.select(by, label, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(by)) * 100).alias("pct"))


def offset_stats(df: DataFrame, col: str) -> DataFrame:
    """Moments and quartiles of integer day offsets, from counts per offset."""
    n = F.col("n")
    x = F.col(col).cast("double")
    by = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    s = by.agg(F.sum("n").alias("n"), F.sum(x * n).alias("s"), F.sum(x * x * n).alias("q"), F.min(col).alias("min"),
               F.max(col).alias("max"), F.percentile(x, [0.25, 0.5, 0.75], n).alias("p"))
    mean = F.col("s") / F.col("n")
    return s.select("n", mean.alias("mean"), F.sqrt(F.try_divide(F.col("q") - F.col("s") * mean, F.col("n") - 1)).alias("std"),
                    "min", F.col("p")[0].alias("p25"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p75"), "max")


def obs_window_span(obs: DataFrame, n: int = 5) -> DataFrame:
    """Calendar span of the next-n window, its zero-range share and the median non-zero ranges."""
    from granary.operators.labels import forward_pct_range
    rows = forward_pct_range(obs, n).filter("future_nominal_range IS NOT NULL").select(
        F.datediff("future_target_date", DATE).alias("span"), "future_nominal_range", "future_pct_range")
    moving = rows.filter("future_nominal_range > 0")
    med = lambda c: exact_quantiles(moving, c, {"m": 0.5}).scalar()
    return rows.agg(
        F.count("*").alias("n"), F.avg("span").alias("mean_span"),
        F.percentile("span", 0.5).alias("median_span"), F.percentile("span", 0.9).alias("p90_span"),
        F.max("span").alias("max_span"),
        (F.try_divide(F.count_if(F.col("future_nominal_range") == 0), F.count("*")) * 100).alias("zero_range_pct")).select(
        "*", med("future_nominal_range").alias("median_nonzero_range"),
        med("future_pct_range").alias("median_nonzero_pct_range"))


def feature_target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation per feature, all from one aggregate."""
    stats = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target)).alias(f) for f in features])
    return stats.unpivot([], list(features), "feature", "correlation").orderBy(F.desc_nulls_last(F.abs("correlation")))


def bias_corrected_moments(col: str) -> dict[str, Column]:
    """mean, population std and the sample-corrected skewness and excess kurtosis."""
    n = F.count(col)
    g1, g2 = F.skewness(col), F.kurtosis(col)
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return {"n": n, "mean": F.avg(col), "std": F.stddev_pop(col), "skew": skew, "kurt": kurt,
            "min": F.min(col), "max": F.max(col)}


def residual_moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[e.alias(k) for k, e in bias_corrected_moments(col).items()])


def volatility_diagnostics(df: DataFrame, col: str) -> DataFrame:
    """Counts, zeros, moments and quartiles of all and of the non-zero values."""
    nz = df.filter(F.col(col) > 0)
    q = row_scalar(exact_quantiles(df, col, {"p25": 0.25, "p50": 0.5, "p75": 0.75}))
    m = exact_quantiles(nz, col, {"m": 0.5}).scalar()
    x = F.col(col)
    pos = F.when(x > 0, x)
    return df.agg(
        F.count("*").alias("n_rows"), F.count(col).alias("n_valid"), F.count_if(x == 0).alias("n_zero"),
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"),
        F.count(pos).alias("n_nonzero"), F.avg(pos).alias("nonzero_mean"), F.min(pos).alias("nonzero_min")).select(
        "*", q["p25"].alias("p25"), q["p50"].alias("median"), q["p75"].alias("p75"), m.alias("nonzero_median"))


def series_profile(df: DataFrame, max_gap: int = 7) -> DataFrame:
    """Per series: size, price level, flat share, spread of price and of next changes, gap counts."""
    w = series_window()
    d = F.lead(PRICE).over(w) - F.col(PRICE)
    g = F.datediff(F.lead(DATE).over(w), DATE)
    rows = df.select(*SERIES, PRICE, d.alias("_d"), g.alias("_g"))
    return rows.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.avg(PRICE).alias("price_mean"), F.stddev_samp(PRICE).alias("price_std"),
        (F.try_divide(F.count_if(F.col("_d") == 0), F.count("_d")) * 100).alias("zero_pct"),
        F.stddev_samp("_d").alias("change_std"),
        *[F.count_if(F.col("_g") == k).alias(f"gap_{k}") for k in range(1, max_gap + 1)],
        F.count_if(F.col("_g") > max_gap).alias("gap_longer"))


def last_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """The n newest rows of each series."""
    w = Window.partitionBy(*SERIES).orderBy(F.unix_date(DATE).desc())
    return df.select("*", F.row_number().over(w).alias("back")).filter(F.col("back") <= n)
