"""Point-in-time features of irregular price series.

The builders return ``{name: Column}`` over one shared window specification.
Feature sets stack them in a few projections: window columns first, arithmetic
on them next, windows over that arithmetic last. All windows partition and
order alike, so a whole set costs one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from granary.functions.dates import annual_harmonics, calendar_parts
from granary.functions.distributed import exact_quantiles
from granary.functions.scalars import clip, pct_change, zero_if_missing
from granary.functions.windows import days_around, full, past, running, series_window, trailing
from granary.schemas import SERIES
from granary.session import materialize

PRICE = "modal_price"
ARRIVALS = "arrivals"
Columns = dict[str, Column]


def add(df: DataFrame, *groups: Mapping[str, Column]) -> DataFrame:
    """One projection with all new columns."""
    new = {}
    for g in groups:
        new.update(g)
    return df.withColumns(new)


def or_zero(cols: Mapping[str, Column]) -> Columns:
    return {n: F.coalesce(c, F.lit(0.0)) for n, c in cols.items()}


# --- lags and rolling statistics -------------------------------------------

def lag_features(ks: Sequence[int] = (1, 7, 14, 30), col: str = PRICE, prefix: str = "lag",
                 w: WindowSpec | None = None) -> Columns:
    w = w or series_window()
    return {f"{prefix}_{k}": F.lag(col, k).over(w) for k in ks}


def rolling_mean(ns: Sequence[int], col: str = PRICE, prefix: str = "rolling_mean", frame=past) -> Columns:
    w = series_window()
    return {f"{prefix}_{n}": full(F.avg(col), F.col(col), frame(w, n), n) for n in ns}


def rolling_std(ns: Sequence[int], col: str = PRICE, prefix: str = "rolling_std", frame=past) -> Columns:
    w = series_window()
    return {f"{prefix}_{n}": full(F.stddev_samp(col), F.col(col), frame(w, n), n) for n in ns}


def rolling_median(ns: Sequence[int], col: str = PRICE, frame=past) -> Columns:
    w = series_window()
    return {f"rolling_median_{n}": full(F.percentile(col, 0.5), F.col(col), frame(w, n), n) for n in ns}


def rolling_min_max(n: int = 7, col: str = PRICE) -> Columns:
    f = past(series_window(), n)
    return {f"rolling_min_{n}": full(F.min(col), F.col(col), f, n),
            f"rolling_max_{n}": full(F.max(col), F.col(col), f, n)}


def differences(ks: Sequence[int] = (1, 3, 7, 14)) -> Columns:
    """Needs lag_k columns."""
    return {f"price_change_{k}": F.col(PRICE) - F.col(f"lag_{k}") for k in ks}


def momentum(ks: Sequence[int] = (3, 7, 14)) -> Columns:
    return {f"momentum_{k}": (F.col(PRICE) - F.col(f"lag_{k}")) / (F.col(f"lag_{k}") + 1e-4) * 100 for k in ks}


def accelerations_scaled() -> Columns:
    """Differences against the average step of the longer span."""
    c = {k: F.col(PRICE) - F.col(f"lag_{k}") for k in (1, 3, 7, 14)}
    return {"acceleration_3_7": c[3] - (c[7] - c[3]), "acceleration_7_14": c[7] - (c[14] - c[7]),
            "accel_1_7": c[1] - c[7] / 7, "accel_1_14": c[1] - c[14] / 14}


def accelerations_plain() -> Columns:
    """Differences against the whole longer span."""
    c = {k: F.col(PRICE) - F.col(f"lag_{k}") for k in (1, 7, 14)}
    return {"accel_1_7": c[1] - c[7], "accel_1_14": c[1] - c[14]}


def price_sums(df: DataFrame, col: str = PRICE) -> DataFrame:
    """Running count, sum and position-weighted sum of a series, from which every slope is a difference of two rows.

    Values are taken from the first one of the series, which keeps the sums small; whole-unit prices stay exact.
    """
    w = series_window()
    out = add(df, {"_at": F.row_number().over(w), "_from_first": F.col(col) - F.first(col, ignorenulls=True).over(running(w))})
    p = F.col("_from_first")
    return add(out, {"_sum_0": F.count("_from_first").over(running(w)), "_sum_1": F.coalesce(F.sum(p).over(running(w)), F.lit(0.0)),
                     "_sum_2": F.coalesce(F.sum(p * F.col("_at")).over(running(w)), F.lit(0.0))}).drop("_from_first")


#: Helper columns of price_sums, dropped once the slopes are there.
PRICE_SUMS = ("_at", "_sum_0", "_sum_1", "_sum_2")


def trend_slope(ns: Sequence[int] = (7, 14, 30)) -> Columns:
    """Least-squares slope over the last n rows including t; needs price_sums. NULL where a row or a value is missing.

    The centred positions sum to 0, so the slope is sum(position * price) / sum(position^2), and both sums over a frame are
    differences of running ones.
    """
    w = series_window()
    out = {}
    for n in ns:
        norm = n * (n * n - 1) / 12
        count, total, weighted = (F.col(f"_sum_{i}") - F.coalesce(F.lag(f"_sum_{i}", n).over(w), F.lit(0)) for i in range(3))
        out[f"trend_slope_{n}"] = F.when(count == n, (weighted - (F.col("_at") - (n - 1) / 2) * total) / norm)
    return out


#: Weight below which an earlier row no longer moves a mean.
LEAST_WEIGHT = 1e-19


def ewma(df: DataFrame, specs: Sequence[tuple[str, str, int, bool]], keys: Sequence[str] = SERIES,
         date: str = "reported_date", missing_as_zero: bool = False) -> DataFrame:
    """Exponentially weighted means; specs are (output, input, span, adjust).

    Each row maps the mean before it to ``a * mean + b``. Maps compose to maps, so they are composed in blocks of 1, 2, 4, ...
    rows, each block from two of half its size, until what lies before a block weighs less than ``LEAST_WEIGHT``: seven
    steps for a span of 5, ten for 30, however long the series. Only lags are used, on the partitioning and order of
    the series. Missing values keep the mean and weigh by the rows that went by, as usual: a block counts the rows
    that have a value. Adjusted means are the quotient of two such sums over all rows.
    """
    w = series_window(keys, date)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    sources = list(dict.fromkeys(s for _, s, _, _ in specs))
    x = {s: F.col(f"_x{i}") for i, s in enumerate(sources)}
    out = add(df, {"_row": F.row_number().over(w)},
              {f"_x{i}": F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")) for i, s in enumerate(sources)})
    out = add(out, {f"_last{i}": F.last(F.when(x[s].isNotNull(), F.col("_row")), ignorenulls=True).over(before) for i, s in enumerate(sources)})
    first: Columns = {}
    for k, (_, source, span, adjust) in enumerate(specs):
        q, last, v = 1 - 2 / (span + 1), F.col(f"_last{sources.index(source)}"), x[source]
        if adjust:
            first[f"_b{k}"], first[f"_d{k}"] = F.coalesce(v, F.lit(0.0)), F.when(v.isNull(), 0.0).otherwise(1.0)
            continue
        old = F.pow(F.lit(q), F.col("_row") - last)
        first[f"_a{k}"] = F.when(v.isNotNull(), F.coalesce(old / (old + (1 - q)), F.lit(0.0)))
        first[f"_b{k}"] = F.coalesce((1 - q) * v / (old + (1 - q)), v)
    out = add(out, first)
    order = f"OVER (PARTITION BY {', '.join(f'`{c}`' for c in keys)} ORDER BY `{date}`)"
    # only unadjusted columns are missing where their value is; the plain lag is the faster one
    earlier = lambda c, n, whole: F.coalesce(F.lag(c, n).over(w) if whole else F.expr(f"lag({c}, {n}) IGNORE NULLS {order}"), F.lit(0.0))
    block = 1
    while open_ := [k for k, (_, _, span, _) in enumerate(specs) if (1 - 2 / (span + 1)) ** block > LEAST_WEIGHT]:
        step: Columns = {}
        for k in open_:
            _, _, span, adjust = specs[k]
            factor = F.lit((1 - 2 / (span + 1)) ** block) if adjust else F.col(f"_a{k}")
            for c in (f"_b{k}", *[f"_d{k}"] * adjust):
                step[c] = F.col(c) + factor * earlier(c, block, adjust)
            if not adjust:
                step[f"_a{k}"] = factor * earlier(f"_a{k}", block, adjust)
        out = add(out, step)
        block *= 2
    means: Columns = {}
    for k, (name, source, _, adjust) in enumerate(specs):
        last = F.col(f"_last{sources.index(source)}")
        mean = (F.when(x[source].isNotNull() | last.isNotNull(), F.try_divide(F.col(f"_b{k}"), F.col(f"_d{k}"))) if adjust
                else F.last(f"_b{k}", ignorenulls=True).over(running(w)))
        means[name] = F.coalesce(mean, F.lit(0.0)) if missing_as_zero else mean
    return out.select(*df.columns, *[c.alias(n) for n, c in means.items()])


def level_ratios(ns: Sequence[int] = (7, 14), eps: float = 1e-4, z: str = "price_zscore",
                 with_ratio: bool = True) -> Columns:
    """Price against its past mean; needs rolling_mean_n and rolling_std_n."""
    p = F.col(PRICE)
    out: Columns = {}
    for n in ns:
        mean, std = F.col(f"rolling_mean_{n}"), F.col(f"rolling_std_{n}")
        if with_ratio:
            out[f"price_to_rolling_mean_{n}"] = p / (mean + 1e-4)
        out[f"gap_mean_{n}"] = p - mean
        out[f"{z}_{n}"] = (p - mean) / (std + eps)
    return out


# --- arrivals and percentage changes ----------------------------------------

def arrival_features(lags: Sequence[int] = (1, 7), means: Sequence[int] = (7, 14),
                     stds: Sequence[int] = (), change: bool = False) -> Columns:
    w = series_window()
    out = {f"arrival_lag_{k}": F.lag(ARRIVALS, k).over(w) for k in lags}
    out |= rolling_mean(means, ARRIVALS, "arrival_rolling_mean")
    out |= rolling_std(stds, ARRIVALS, "arrival_rolling_std")
    if change:
        out["arrival_change"] = F.lag(ARRIVALS, 1).over(w) - F.lag(ARRIVALS, 2).over(w)
    return out


def pct_changes() -> Columns:
    """% against the previous row; a change from 0 counts as 0."""
    w = series_window()

    def change(c):
        before = F.lag(c).over(w)
        return F.when((before == 0) & (F.col(c) != 0), 0.0).otherwise(pct_change(F.col(c), before))
    return {"price_pct_change": change(PRICE), "arrival_pct_change": change(ARRIVALS)}


def arrival_interaction() -> Columns:
    return {"arrival_price_interaction":
            F.log1p(F.greatest(F.col(ARRIVALS), F.lit(0.0))) * F.col("price_pct_change")}


# --- movements ---------------------------------------------------------------

def move_flags(first_row_moves: bool, eps: float = 0.0) -> Columns:
    """0/1 flags from price_change_1; what the first row counts as is the caller's choice."""
    d = F.col("price_change_1")
    flag = lambda cond, missing=0: F.coalesce(cond.cast("int"), F.lit(missing))
    return {"_move": flag(F.abs(d) > eps, 1 if first_row_moves else 0),
            "_pos": flag(d > eps), "_neg": flag(d < -eps), "_flat": flag(F.abs(d) <= eps)}


def movement_counts(moves: Sequence[int] = (7, 14, 30), signed: Sequence[int] = (7,)) -> Columns:
    """Sums of the flags over the last n rows including t, NULL before n rows exist."""
    w = series_window()

    def count(flag, n):
        return full(F.sum(flag), F.col(flag), trailing(w, n), n).cast("double")
    out = {f"move_count_{n}": count("_move", n) for n in moves}
    out |= {f"pos_count_{n}": count("_pos", n) for n in signed}
    out |= {f"neg_count_{n}": count("_neg", n) for n in signed}
    return out


def streak(flag: Column, w: WindowSpec | None = None) -> Column:
    """Length of the run of true rows ending at t: row number minus that of the last false row.

    Gaps and islands without a second partitioning.
    """
    w = w or series_window()
    n = F.col("_rn")
    last_break = F.last(F.when(~flag, F.col("_rn")), ignorenulls=True).over(running(w))
    return n - F.coalesce(last_break, F.lit(0))


def row_numbers() -> Columns:
    return {"_rn": F.row_number().over(series_window())}


def last_nonzero_move() -> Columns:
    d = F.col("price_change_1")
    carried = F.coalesce(F.last(F.when(d != 0, d), ignorenulls=True).over(running(series_window())), F.lit(0.0))
    return {"last_non_zero_move": carried, "last_move_abs": F.abs(carried)}


# --- volatility --------------------------------------------------------------

def past_obs_range(ns: Sequence[int] = (5, 10, 20)) -> Columns:
    w = series_window()
    p = F.col(PRICE)
    out: Columns = {}
    for n in ns:
        f = trailing(w, n)
        spread = full(F.max(PRICE), p, f, n) - F.min(PRICE).over(f)
        out[f"past_{n}_range"] = spread
        out[f"past_{n}_pct_range"] = spread / (p + 1e-4) * 100
    return out


def past_calendar_range(hs: Sequence[int] = (7, 14), nominal: Sequence[int] = (7,)) -> Columns:
    """max - min of positive prices in [t - H, t]; 0 without an earlier priced row."""
    p = F.col(PRICE)
    good = F.when(p > 0, p)
    out: Columns = {}
    for h in hs:
        f = days_around(-h, 0)
        usable = (p > 0) & (F.count(good).over(f) > 1)
        spread = F.when(usable, F.max(good).over(f) - F.min(good).over(f)).otherwise(0.0)
        if h in nominal:
            out[f"past_{h}d_range"] = spread
        out[f"past_{h}d_pct_range"] = F.when(usable, spread / (p + 1e-4) * 100).otherwise(0.0)
    return out


def lagged_pct() -> Columns:
    w = series_window()
    p = F.col(PRICE)
    lag = lambda k: F.lag(PRICE, k).over(w)
    rel = lambda a, b: (a - b) / (b + 1e-4) * 100
    one, five = rel(p, lag(1)), rel(p, lag(5))
    return {"pct_change_1": one, "pct_change_2": rel(lag(1), lag(2)), "pct_change_5": five,
            "abs_pct_change_1": F.abs(one), "abs_pct_change_5": F.abs(five)}


def rolling_std_incl() -> Columns:
    """Standard deviations of price and pct_change_1 including t, 0 before the window is full."""
    return or_zero(rolling_std((5, 7, 14, 30), frame=trailing)
                   | rolling_std((5, 14), "pct_change_1", "rolling_std_pct", frame=trailing))


def volatility_ratios() -> Columns:
    c = F.col
    return {"vol_trend_5_10": c("past_5_range") / (c("past_10_range") + 1e-4),
            "vol_pct_trend_5_10": c("past_5_pct_range") / (c("past_10_pct_range") + 1e-4),
            "vol_std_ratio_5_14": c("rolling_std_5") / (c("rolling_std_14") + 1e-4)}


def level_and_jump() -> Columns:
    w = series_window()
    p, jump = F.col(PRICE), F.col("abs_pct_change_1")
    mean = full(F.avg(PRICE), p, trailing(w, 7), 7)
    return {"max_daily_pct_jump_5": full(F.max(jump), jump, trailing(w, 5), 5),
            "price_level": p.cast("double"), "price_to_mean_7": p / (mean + 1e-4)}


def price_structure_abs() -> Columns:
    lo, hi, p = F.col("min_price"), F.col("max_price"), F.col(PRICE)
    spread = hi - lo
    return {"price_spread": spread,
            "price_position_in_range": clip((p - lo) / F.greatest(spread, F.lit(1e-4)), 0.0, 1.0),
            "min_to_modal_ratio": lo / (p + 1e-4), "modal_to_max_ratio": p / (hi + 1e-4)}


# --- imputation and encoding -------------------------------------------------

def impute_lags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Carry forward inside a series, then the exact median of the carried column.

    The carried columns are stacked as (name, value), so all medians come from one pass.
    """
    w = running(series_window())
    filled = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    stacked = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                                for c in cols])).alias("s")).select("s.*")
    medians = exact_quantiles(stacked, "value", {"m": 0.5}, ["name"]).agg(
        F.map_from_entries(F.collect_list(F.struct("name", "m")))).scalar()
    return filled.withColumns({c: F.coalesce(F.col(c), F.try_element_at(medians, F.lit(c))) for c in cols})


def ordinal_codes(train: DataFrame, col: str) -> DataFrame:
    """(value, code) of the sorted distinct training values: a dictionary, not the data."""
    return (train.select(F.col(col).cast("string").alias(col)).filter(F.col(col).isNotNull()).distinct()
            .select(col, (F.row_number().over(Window.orderBy(col)) - 1).alias(f"{col}_code")))


def ordinal_encode(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes fitted on train; values it lacks get -1.

    A dictionary is written before the join, which then knows its size and broadcasts a small one.
    """
    for c in cols:
        df = df.join(materialize(ordinal_codes(train, c), "codes"), c, "left").withColumn(
            f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def target_encode(df: DataFrame, train: DataFrame, key: str, target: str, out: str) -> DataFrame:
    """Training mean of the target per key, the global training mean for new keys."""
    means = materialize(train.groupBy(key).agg(F.avg(target).alias(out)), "means")
    overall = train.agg(F.avg(target)).scalar()
    return df.join(means, key, "left").withColumn(out, F.coalesce(F.col(out), overall))


# --- yield panel lags ----------------------------------------------------------

def panel_window(keys: Sequence[str] = ("district", "season")) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("year")


def yield_row_lags(panel: DataFrame, first_year: int = 2000) -> DataFrame:
    """Row lags per district and season; columns of the current season are left out."""
    w = panel_window()
    lags = {"yield_lag1": ("yield_kg_ha", 1), "yield_lag2": ("yield_kg_ha", 2), "area_lag1": ("area", 1),
            "area_lag2": ("area", 2), "precip_lag1": ("precip", 1), "t2m_lag1": ("t2m", 1),
            "rh2m_lag1": ("rh2m", 1), "ndvi_lag1": ("ndvi", 1)}
    cols = [F.lag(c, k).over(w).alias(n) for n, (c, k) in lags.items() if c in panel.columns]
    mean = F.avg("yield_kg_ha").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (panel.select("district", "season", "year", "yield_kg_ha", *cols, mean.alias("yield_hist_mean"))
            .filter(F.col("year") >= first_year))


def expanding_past_mean(col: str = "yield_kg_ha", keys: Sequence[str] = ("district", "season")) -> Column:
    return F.avg(col).over(panel_window(keys).rowsBetween(Window.unboundedPreceding, -1))


def rolling_yield_features(panel: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """Three-year past mean from one year on, with the fallbacks lag2 -> lag1 and mean -> lag1."""
    w = panel_window(keys)
    rows = panel.select(
        "*", F.lag("yield_kg_ha", 1).over(w).alias("yield_lag1"), F.lag("yield_kg_ha", 2).over(w).alias("_lag2"),
        F.avg("yield_kg_ha").over(w.rowsBetween(-3, -1)).alias("_mean3"), F.lag("area", 1).over(w).alias("_area1"))
    area = F.coalesce("_area1", "area")
    return rows.filter("yield_lag1 IS NOT NULL").select(
        *panel.columns, "yield_lag1", F.coalesce("_lag2", "yield_lag1").alias("yield_lag2"),
        F.coalesce("_mean3", "yield_lag1").alias("yield_roll_mean3"), area.alias("area_lag1"),
        F.log1p(area).alias("log_area_lag1"))


# --- scoring rows --------------------------------------------------------------

def latest_feature_row(df: DataFrame) -> DataFrame:
    """The newest row per series with features that also work on short histories.

    A lag that reaches too far back takes the oldest value, means and population
    deviations use what there is.
    """
    w = series_window()
    first = lambda c: F.first(c).over(running(w))
    out: Columns = {}
    for k in (1, 7, 14, 30):
        out[f"lag_{k}"] = F.coalesce(F.lag(PRICE, k).over(w), first(PRICE))
    for n in (7, 14, 30):
        out[f"rolling_mean_{n}"] = F.coalesce(F.avg(PRICE).over(past(w, n)), F.col(PRICE))
    for n in (7, 14):
        out[f"rolling_std_{n}"] = F.coalesce(F.stddev_pop(PRICE).over(past(w, n)), F.lit(0.0))
    for k in (1, 7):
        out[f"arrival_lag_{k}"] = F.coalesce(F.lag(ARRIVALS, k).over(w), first(ARRIVALS))
    for n in (7, 14):
        out[f"arrival_rolling_mean_{n}"] = F.coalesce(F.avg(ARRIVALS).over(past(w, n)), F.col(ARRIVALS))
    for c, name in ((PRICE, "price_pct_change"), (ARRIVALS, "arrival_pct_change")):
        before = F.lag(c).over(w)
        out[name] = F.coalesce(F.when(before > 0, (F.col(c) - before) / before * 100), F.lit(0.0))
    out["_last"] = F.row_number().over(w) == F.count("*").over(Window.partitionBy(*SERIES))
    parts = calendar_parts(F.col("reported_date"))
    cal = {k: parts[k] for k in ("year", "month", "day", "day_of_week", "week_of_year")}
    rows = df.withColumns(out).filter("_last").drop("_last")
    return rows.withColumns(cal | {"price_spread": F.lit(0.0), "price_position_in_range": F.lit(0.5)})


# --- feature sets ---------------------------------------------------------------

CALENDAR = ("year", "day", "month", "day_of_week", "week_of_year")

CORE_20 = (
    "lag_1", "lag_7", "lag_14", "lag_30", "rolling_mean_7", "rolling_mean_14", "rolling_mean_30",
    "rolling_std_7", "rolling_std_14", *CALENDAR, "arrival_lag_1", "arrival_lag_7",
    "arrival_rolling_mean_7", "arrival_rolling_mean_14", "price_pct_change", "arrival_pct_change")

PRICE_48 = CORE_20 + (
    "price_change_1", "price_change_7", "price_change_14", "accel_1_7", "accel_1_14",
    "trend_slope_7", "trend_slope_14", "trend_slope_30", "ewma_7", "ewma_14", "ewma_30",
    "rolling_median_7", "rolling_median_14", "rolling_median_30", "gap_mean_7", "gap_mean_14",
    "zscore_7", "zscore_14", "move_count_7", "move_count_14", "move_count_30", "pos_count_7",
    "neg_count_7", "streak_zero", "streak_pos", "streak_neg", "last_non_zero_move", "last_move_abs")

VOL_35 = (
    "pct_change_1", "pct_change_2", "pct_change_5", "abs_pct_change_1", "abs_pct_change_5",
    "past_5_range", "past_5_pct_range", "past_10_range", "past_10_pct_range", "past_20_range",
    "past_20_pct_range", "rolling_std_5", "rolling_std_7", "rolling_std_14", "rolling_std_30",
    "rolling_std_pct_5", "rolling_std_pct_14", "ewma_abs_diff_5", "ewma_abs_diff_14", "ewma_pct_vol_5",
    "ewma_pct_vol_14", "vol_trend_5_10", "vol_pct_trend_5_10", "vol_std_ratio_5_14", "nonzero_moves_5",
    "nonzero_moves_10", "streak_zero", "max_daily_pct_jump_5", "price_level", "price_to_mean_7",
    "month", "day_of_week", "week_of_year", "arrival_lag_1", "arrival_rolling_mean_7")

VOL_38 = VOL_35 + ("past_7d_range", "past_7d_pct_range", "past_14d_pct_range")


def _calendar(names: Sequence[str]) -> Columns:
    parts = calendar_parts(F.col("reported_date"))
    return {n: parts[n] for n in names}


def core_20(df: DataFrame) -> DataFrame:
    return add(df, lag_features(), rolling_mean((7, 14, 30)), rolling_std((7, 14)), _calendar(CALENDAR),
               arrival_features(), pct_changes())


def _streaks(df: DataFrame) -> DataFrame:
    return add(df, {"streak_zero": streak(F.col("_move") == 0), "streak_pos": streak(F.col("_pos") == 1),
                    "streak_neg": streak(F.col("_neg") == 1)})


def price_48(df: DataFrame, ewma_columns: bool = True) -> DataFrame:
    """core-20 plus momentum, slopes, EWMA, medians, gaps, z-scores, counts, streaks and last move."""
    base = df.columns
    # the means come first, while rows are narrow
    spans = (7, 14, 30) if ewma_columns else ()
    out = ewma(df, [(f"ewma_{s}", PRICE, s, False) for s in spans]) if spans else df
    out = add(price_sums(out), lag_features(), rolling_mean((7, 14, 30)), or_zero(rolling_std((7, 14))),
              _calendar(CALENDAR), arrival_features(), pct_changes(), trend_slope(),
              rolling_median((7, 14, 30), frame=trailing), row_numbers())
    out = add(out, differences((1, 7)), {"price_change_14": F.col(PRICE) - F.col("lag_14")},
              accelerations_plain(), level_ratios(eps=1e-5, z="zscore", with_ratio=False))
    out = add(out, move_flags(first_row_moves=True))
    out = _streaks(add(out, movement_counts(), last_nonzero_move()))
    return out.select(*base, *[c for c in PRICE_48 if not c.startswith("ewma_")], *[f"ewma_{s}" for s in spans])


def candidate_v2(df: DataFrame, ewma_columns: bool = True) -> DataFrame:
    """All v2 forms plus six volatility ratios; missing stays NULL, infinite becomes 0."""
    base = df.columns
    w = series_window()
    lags = (1, 2, 3, 5, 7, 10, 14, 21, 30)
    spans = (5, 7, 14, 30) if ewma_columns else ()
    out = ewma(df, [(f"ewma_{s}", PRICE, s, False) for s in spans]) if spans else df
    out = out.withColumn(ARRIVALS, F.greatest(F.coalesce(F.col(ARRIVALS), F.lit(0.0)), F.lit(0.0)))
    out = add(price_sums(out), lag_features(lags), rolling_mean((3, 5, 7, 14, 30)),
              or_zero(rolling_std((5, 7, 14, 30))), rolling_median((7, 14)), rolling_min_max(7), trend_slope(),
              arrival_features((1, 3, 7), (7, 14)), or_zero(rolling_std((7,), ARRIVALS, "arrival_rolling_std")),
              pct_changes(), _calendar(("year", "month", "day_of_week", "week_of_year", "quarter")),
              annual_harmonics(F.col("reported_date")), price_structure_abs(), row_numbers())
    out = add(out, differences(), momentum(), accelerations_scaled(), level_ratios(), arrival_interaction())
    out = add(out, move_flags(first_row_moves=False, eps=1e-4))
    p = F.col(PRICE)
    spread = F.col("rolling_max_7") - F.col("rolling_min_7")
    out = add(out, movement_counts(), last_nonzero_move(), {
        "streak_zero": streak(F.col("_move") == 0),
        "rolling_range_7": spread, "rolling_pct_range_7": spread / (p + 1e-4) * 100,
        **{f"rolling_pct_std_{n}": F.col(f"rolling_std_{n}") / (p + 1e-4) * 100 for n in (7, 14, 30)},
        "price_to_rolling_mean_30": p / (F.col("rolling_mean_30") + 1e-4)})
    out = out.drop("_rn", "_move", "_pos", "_neg", "_flat", *PRICE_SUMS)
    return out.select(*[c for c in out.columns if not c.startswith("ewma_")], *[f"ewma_{s}" for s in spans])


def _volatility_set(df: DataFrame, names: Sequence[str], first_row_moves: bool, calendar: bool,
                    ewma_columns: bool) -> DataFrame:
    base = df.columns
    w = series_window()
    # day ranges need their own ordering; done first, all later windows share one sort
    out = add(df, past_calendar_range()) if calendar else df
    out = add(out, lagged_pct(), past_obs_range(), {"price_change_1": F.col(PRICE) - F.lag(PRICE).over(w)},
              _calendar(("month", "day_of_week", "week_of_year")), or_zero(arrival_features((1,), (7,))),
              row_numbers())
    out = add(out, rolling_std_incl(), level_and_jump(), move_flags(first_row_moves))
    out = add(out, volatility_ratios(), {"_abs_diff": F.abs("price_change_1")}, {
        f"nonzero_moves_{n}": full(F.sum("_move"), F.col("_move"), trailing(w, n), n).cast("double")
        for n in (5, 10)}, {"streak_zero": streak(F.col("_flat") == 1).cast("double")})
    ints = ("month", "day_of_week", "week_of_year")
    keep = [n for n in names if not n.startswith("ewma_")]
    filled = [F.col(n) if n in ints else zero_if_missing(F.col(n)).alias(n) for n in keep]
    if not ewma_columns:
        return out.select(*base, *filled)
    # inputs of the weighted means keep their leading NULL
    out = out.select(*base, *filled, "_abs_diff", F.col("abs_pct_change_1").alias("_abs_pct"))
    out = ewma(out, [("ewma_abs_diff_5", "_abs_diff", 5, True), ("ewma_abs_diff_14", "_abs_diff", 14, True),
                     ("ewma_pct_vol_5", "_abs_pct", 5, True), ("ewma_pct_vol_14", "_abs_pct", 14, True)],
               missing_as_zero=True)
    return out.select(*base, *names)


def vol_35(df: DataFrame, ewma_columns: bool = True) -> DataFrame:
    """Experimental volatility set: the first row of a series counts as a move."""
    return _volatility_set(df, VOL_35, True, False, ewma_columns)


def vol_38(df: DataFrame, ewma_columns: bool = True) -> DataFrame:
    """vol-35 with calendar ranges; the first row of a series is neither move nor flat."""
    return _volatility_set(df, VOL_38, False, True, ewma_columns)
