"""Panel joins and seasonal weather and market aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.dates import SEASON_WINDOWS, market_season_year, season_window, weather_season

PANEL_KEY = ("district", "season", "year")

# Month ranges of the overlapping rice growing seasons. Fixed values.
RICE_SEASON_MONTHS = {"Autumn": (5, 9), "Winter": (6, 11), "Summer": (3, 6)}


# --- joins ------------------------------------------------------------------------

def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The rows unchanged; a duplicate key fails the job while it runs."""
    stats = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    worst = stats.agg(F.max("_n")).scalar()
    ok = F.coalesce(worst, F.lit(1)) <= 1
    check = F.when(ok, F.lit(0)).otherwise(F.raise_error(F.lit(f"{name} has duplicate keys")).cast("int"))
    return df.withColumn("_unique", check).filter("_unique = 0").drop("_unique")


def merge_panel_one_to_one(yields: DataFrame, weather: DataFrame, ndvi: DataFrame,
                           keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    """Yield rows with weather and NDVI; unique keys on all sides keep the row count."""
    keys = list(keys)
    return (assert_unique(yields, keys, "yields")
            .join(assert_unique(weather, keys, "weather"), keys, "left")
            .join(assert_unique(ndvi, keys, "ndvi"), keys, "left"))


def match_indicator(left: DataFrame, right: DataFrame, keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    """Left rows with _merge = both or left_only."""
    marks = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return left.join(marks, list(keys), "left").select(
        *left.columns, F.when(F.col("_hit"), "both").otherwise("left_only").alias("_merge"))


def unmatched_per_district(left: DataFrame, right: DataFrame, keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    flags = match_indicator(left, right, keys)
    return flags.groupBy("district").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("_merge") == "left_only").alias("unmatched"),
        F.min(F.when(F.col("_merge") == "left_only", F.col("year"))).alias("first_unmatched_year"))


def key_set_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values only in a and only in b, from one aggregate over the tagged union."""
    tagged = (a.select(F.col(col).alias("value"), F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(F.col(col).alias("value"), F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    sides = tagged.groupBy("value").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return sides.filter("_a <> _b").select(
        "value", F.when(F.col("_a") == 1, "only_left").otherwise("only_right").alias("side"))


def explode_district_map(df: DataFrame, mapping: DataFrame, col: str = "market") -> DataFrame:
    """One row per mapped district; unmapped markets drop out."""
    return df.join(mapping, col, "inner")


def map_inflation_audit(df: DataFrame, mapping: DataFrame, col: str = "market") -> DataFrame:
    """Rows before, rows dropped and rows after the 1-to-n mapping, from per-market counts."""
    n = df.groupBy(col).agg(F.count("*").alias("n"))
    fan = mapping.groupBy(col).agg(F.count("*").alias("fan"))
    j = n.join(fan, col, "left").withColumn("fan", F.coalesce("fan", F.lit(0)))
    return j.agg(F.sum("n").alias("rows_before"), F.sum(F.col("n") * F.col("fan")).alias("rows_after"),
                 F.sum(F.when(F.col("fan") == 0, F.col("n")).otherwise(0)).alias("rows_unmapped"),
                 F.count_if(F.col("fan") == 0).alias("unmapped_markets"),
                 F.count_if(F.col("fan") > 1).alias("split_markets"))


def year_offset_join(panel: DataFrame, features: DataFrame, cols: Sequence[str], offsets: Sequence[int] = (1, 2),
                     keys: Sequence[str] = PANEL_KEY) -> DataFrame:
    """Features of year - k, by calendar year rather than by row; names get _lagk."""
    out = panel
    for k in offsets:
        shifted = features.select(*[(F.col(c) + k).alias(c) if c == "year" else F.col(c) for c in keys],
                                  *[F.col(c).alias(f"{c}_lag{k}") for c in cols])
        out = out.join(shifted, list(keys), "left")
    return out


# --- season windows -----------------------------------------------------------------

def season_candidates(date: Column, crop: str = "rice") -> Column:
    """Array of (season, year) whose window may hold the date, so the season join is an equi-join."""
    m, y = F.month(date), F.year(date)
    structs = []
    for (name, season), (shift, sm, _, em, _, _) in SEASON_WINDOWS.items():
        if name != crop:
            continue
        label = F.lit(season) if season else F.lit("Rabi")
        tag = lambda year: F.struct(label.alias("season"), year.alias("year"))
        if shift == 0:
            structs.append(F.when(m.between(sm, em), tag(y)))
        else:
            structs.append(F.when(m >= sm, tag(y - shift)).when(m <= em, tag(y)))
    return F.array_compact(F.array(*structs))


def season_window_join(daily: DataFrame, keys: DataFrame, crop: str = "rice",
                       barrier: str | None = None) -> DataFrame:
    """Daily rows inside [start, cutoff] of each (district, season, year).

    A day belongs to at most two seasons, so it is tagged with them and joins on
    the full key; the date bounds only trim the tagged rows. ``barrier`` names a
    date column of keys that may end the window earlier.
    """
    tagged = daily.select("*", F.explode(season_candidates(F.col("date"), crop)).alias("_s")).select(
        *daily.columns, F.col("_s.season").alias("season"), F.col("_s.year").alias("year"))
    win = season_window(F.col("year"), F.col("season"), crop)
    end = F.col("_w.cutoff")
    if barrier:
        end = F.least(end, F.col(barrier))
    bounds = keys.withColumn("_w", win).select(
        *keys.columns, F.col("_w.start").alias("window_start"), end.alias("window_end"),
        F.col("_w.expected_days").alias("expected_days"))
    return tagged.join(bounds, list(PANEL_KEY)).filter(F.col("date").between(F.col("window_start"), F.col("window_end")))


WEATHER_VALUES = ("precip", "t2m", "t2m_min", "t2m_max", "rh2m", "solar", "wind")


def daily_means(weather: DataFrame) -> DataFrame:
    """One row per district and day: several readings of a day are averaged."""
    return weather.groupBy("district", "date").agg(*[F.avg(c).alias(c) for c in WEATHER_VALUES])


INSEASON = ("precip_cum", "precip_mean", "precip_max", "t2m_mean", "t2m_min", "t2m_max", "t2m_range",
            "rh2m_mean", "solar_mean", "wind_mean")


def inseason_weather_features(weather: DataFrame, keys: DataFrame, barrier: str | None = None) -> DataFrame:
    """Ten features up to the in-season cutoff with coverage counts, one row per key.

    Keys without any weather row stay, with NULL features and complete = false.
    """
    days = daily_means(weather)
    inside = season_window_join(days, keys, "rice", barrier)
    aggs = {
        "precip_cum": F.sum("precip"), "precip_mean": F.avg("precip"), "precip_max": F.max("precip"),
        "t2m_mean": F.avg("t2m"), "t2m_min": F.min("t2m_min"), "t2m_max": F.max("t2m_max"),
        "t2m_range": F.max("t2m_max") - F.min("t2m_min"), "rh2m_mean": F.avg("rh2m"),
        "solar_mean": F.avg("solar"), "wind_mean": F.avg("wind")}
    feats = inside.groupBy(*PANEL_KEY).agg(
        *[e.alias(n) for n, e in aggs.items()], F.count("*").alias("observed_days"),
        F.max("date").alias("last_observation"))
    expected = season_window(F.col("year"), F.col("season"))["expected_days"]
    out = keys.select(*PANEL_KEY, expected.alias("expected_days")).join(feats, list(PANEL_KEY), "left")
    observed = F.coalesce("observed_days", F.lit(0))
    complete = observed > 0
    for c in INSEASON:
        complete = complete & F.col(c).isNotNull()
    return out.select(
        *PANEL_KEY, *INSEASON, observed.alias("observed_days"), "expected_days",
        F.greatest(F.col("expected_days") - observed, F.lit(0)).alias("missing_days"),
        (observed / F.col("expected_days")).alias("completeness"), "last_observation",
        complete.alias("is_complete"))


def cutoff_audit(weather: DataFrame, keys: DataFrame) -> DataFrame:
    """Days of the district before the window start and after its cutoff.

    Window bounds are merged into the district's days as markers and a running
    count is read at them, instead of comparing every day with every key.
    """
    days = weather.select("district", "date").distinct()
    w = season_window(F.col("year"), F.col("season"))
    bounds = keys.withColumn("_w", w)
    marks = (bounds.select(*PANEL_KEY, F.col("_w.start").alias("date"), F.lit("start").alias("kind"), F.lit(0).alias("ord"))
             .unionByName(bounds.select(*PANEL_KEY, F.col("_w.cutoff").alias("date"), F.lit("end").alias("kind"),
                                        F.lit(2).alias("ord"))))
    rows = marks.unionByName(days.select(
        "district", F.lit(None).cast("string").alias("season"), F.lit(None).cast("int").alias("year"), "date",
        F.lit("day").alias("kind"), F.lit(1).alias("ord")))
    by = Window.partitionBy("district")
    is_day = F.when(F.col("kind") == "day", 1).otherwise(0)
    upto = F.sum(is_day).over(by.orderBy("date", "ord").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(is_day).over(by)
    counted = rows.select("*", upto.alias("upto"), total.alias("total")).filter("kind <> 'day'")
    return counted.groupBy(*PANEL_KEY).agg(
        F.max(F.when(F.col("kind") == "start", F.col("upto"))).alias("pre_season_days"),
        F.max(F.when(F.col("kind") == "end", F.col("total") - F.col("upto"))).alias("post_cutoff_days"))


def _rabi_features(weather: DataFrame, keys: DataFrame, crop: str, extra: Mapping[str, Column]) -> DataFrame:
    from granary.functions.distributed import first_by
    # the last of several readings of a day counts
    days = first_by(weather, ["district", "date"], list(WEATHER_VALUES), keep_last=True)
    wanted = keys.select("district", F.lit("Rabi").alias("season"), "year").distinct()
    inside = season_window_join(days, wanted, crop)
    aggs = {
        "precip_cum": F.sum("precip"), "precip_mean": F.avg("precip"),
        "t2m_mean": F.avg("t2m"), "t2m_min": F.avg("t2m_min"), "t2m_max": F.avg("t2m_max"),
        "t2m_range": F.avg(F.col("t2m_max") - F.col("t2m_min")), "solar_mean": F.avg("solar"),
        "rh2m_mean": F.avg("rh2m"), "ws2m_mean": F.avg("wind"),
        "gdd_base5": F.sum(F.greatest(F.col("t2m") - 5, F.when(F.col("t2m").isNotNull(), 0.0)))}
    counts = {"precip_days": F.count_if(F.col("precip") >= 1), **extra}
    out = inside.groupBy("district", "year", "expected_days").agg(
        *[e.alias(n) for n, e in (aggs | counts).items()], F.count("*").alias("observed_days"))
    complete = F.col("observed_days") >= F.col("expected_days") * 0.7
    for c in aggs:
        complete = complete & F.col(c).isNotNull()
    return out.withColumn("is_complete", complete)


def wheat_weather_features(weather: DataFrame, keys: DataFrame) -> DataFrame:
    """15 Nov to 31 Jan: heat days and growing degree days above 5."""
    return _rabi_features(weather, keys, "wheat", {
        "heat_stress_days_28": F.count_if(F.col("t2m_max") >= 28),
        "heat_stress_days_30": F.count_if(F.col("t2m_max") >= 30)})


def potato_weather_features(weather: DataFrame, keys: DataFrame) -> DataFrame:
    """1 Nov to 31 Jan: cool nights and late-blight days."""
    blight = (F.col("rh2m") >= 80) & F.col("t2m").between(10, 22)
    return _rabi_features(weather, keys, "potato", {
        "cool_night_days_16": F.count_if(F.col("t2m_min") <= 16),
        "cool_night_days_14": F.count_if(F.col("t2m_min") <= 14),
        "late_blight_risk_days": F.count_if(blight)})


# --- seasonal aggregates ---------------------------------------------------------------

def _season_means(df: DataFrame, keys, t_min, t_max) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("precip").alias("precip"), F.avg("t2m").alias("t2m"), t_min("t2m_min").alias("t2m_min"),
        t_max("t2m_max").alias("t2m_max"), F.avg("rh2m").alias("rh2m"), F.avg("solar").alias("solar"),
        F.avg("wind").alias("wind"), F.count("*").alias("weather_days"))


def seasonal_weather_agg(weather: DataFrame) -> DataFrame:
    """Overlapping rice seasons: a day counts in every season whose months hold it."""
    m = F.month("date")
    seasons = F.array_compact(F.array(*[F.when(m.between(a, b), s) for s, (a, b) in RICE_SEASON_MONTHS.items()]))
    tagged = weather.select("*", F.year("date").alias("year"), F.explode(seasons).alias("season"))
    return _season_means(tagged, PANEL_KEY, F.avg, F.avg)


def calendar_season_agg(weather: DataFrame) -> DataFrame:
    """Disjoint Kharif, Rabi and Summer with extreme temperatures."""
    tagged = weather.select("*", F.year("date").alias("year"), weather_season(F.month("date")).alias("season"))
    return _season_means(tagged, PANEL_KEY, F.min, F.max)


def market_season_agg(obs: DataFrame) -> DataFrame:
    """Arrivals and prices per district, market season and season year."""
    s = obs.withColumn("_s", market_season_year(F.col("reported_date")))
    p = "modal_price"
    return s.groupBy("district", F.col("_s.season").alias("season"), F.col("_s.year").alias("year")).agg(
        F.sum("arrivals").alias("arrivals_total"), F.avg("arrivals").alias("arrivals_mean"),
        F.avg(p).alias("price_mean"), F.min(p).alias("price_min"), F.max(p).alias("price_max"),
        F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("price_vol"), F.count("*").alias("obs_count"),
        (F.max(p) - F.min(p)).alias("price_range"))


def hierarchical_means(panel: DataFrame, value: str = "yield_kg_ha") -> DataFrame:
    """District x season, district, season and state means.

    Sums per (district, season) come first; the cube then runs over those few rows.
    """
    base = panel.filter(F.col(value).isNotNull()).groupBy("district", "season").agg(
        F.sum(value).alias("s"), F.count("*").alias("n"))
    cube = base.cube("district", "season").agg(
        (F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.grouping_id().alias("g"))
    level = (F.when(F.col("g") == 0, "district_season").when(F.col("g") == 1, "district")
             .when(F.col("g") == 2, "season").otherwise("state"))
    return cube.select(level.alias("level"), "district", "season", "mean", "n")
