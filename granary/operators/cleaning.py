"""Filters, cleaning rules, name mapping and batch audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import names as N
from granary.functions.distributed import first_by
from granary.functions.scalars import finite, pct_change, positive, squash_space, zero_if_missing
from granary.functions.windows import series_window
from granary.schemas import OBS_KEY, SERIES
from granary.session import materialize
from granary.sources.tables import typed_observations


# --- single rules -----------------------------------------------------------

def drop_invalid_dates(df: DataFrame, date: str = "reported_date") -> DataFrame:
    return df.filter(F.col(date).isNotNull())


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def validate_arrivals(df: DataFrame, mode: str = "drop", col: str = "arrivals") -> DataFrame:
    """drop: rows without arrivals >= 0 go; clamp: missing and negative become 0."""
    if mode == "drop":
        return df.filter(F.col(col) >= 0)
    if mode == "clamp":
        return df.withColumn(col, F.greatest(F.coalesce(F.col(col), F.lit(0.0)), F.lit(0.0)))
    raise ValueError(f"unknown mode {mode!r}")


def validate_price(df: DataFrame, col: str = "modal_price") -> DataFrame:
    return df.filter(F.col(col) > 0)


def nullify_nonpositive_bounds(df: DataFrame) -> DataFrame:
    """A zero or negative min or max price means it was not reported."""
    return df.withColumns({c: positive(F.col(c)) for c in ("min_price", "max_price")})


def inconsistent_prices() -> Column:
    """True only when both bounds are present and contradict each other or the modal price."""
    lo, hi, modal = F.col("min_price"), F.col("max_price"), F.col("modal_price")
    return F.coalesce((lo > hi) | (modal < lo) | (modal > hi), F.lit(False)) & lo.isNotNull() & hi.isNotNull()


def drop_inconsistent_prices(df: DataFrame) -> DataFrame:
    return df.filter(~inconsistent_prices())


def dedup_keyed(df: DataFrame, keys: Sequence[str] = OBS_KEY, keep: str = "first",
                order: Sequence[str] | None = None) -> DataFrame:
    """One row per series and day; ties are broken by ``order`` (default: all columns)."""
    return first_by(df, keys, list(order or df.columns), keep_last=keep == "last")


def clean_observations(df: DataFrame) -> DataFrame:
    """All rules in order on typed rows.

    Exact duplicates need no shuffle of their own: they share the key, so the
    keyed step keeps one of them. ``clean_audit`` counts them separately.
    """
    df = validate_price(validate_arrivals(drop_invalid_dates(df), "drop"))
    return dedup_keyed(drop_inconsistent_prices(nullify_nonpositive_bounds(df)))


def clean_audit(df: DataFrame) -> DataFrame:
    """Rows dropped per step in one pass: exact duplicates collapse to a count first."""
    valid_date = F.col("reported_date").isNotNull()
    arrivals = F.coalesce(F.col("arrivals") >= 0, F.lit(False))
    price = F.coalesce(F.col("modal_price") > 0, F.lit(False))
    distinct = nullify_nonpositive_bounds(df.groupBy(*df.columns).agg(F.count("*").alias("_c")))
    step = (F.when(~valid_date, "date").when(~arrivals, "arrivals").when(~price, "price")
            .when(inconsistent_prices(), "inconsistent").otherwise("kept"))
    keyed = distinct.withColumn("_step", step).groupBy(*OBS_KEY).agg(
        F.sum(F.when(F.col("_step") == "date", F.col("_c")).otherwise(0)).alias("invalid_dates"),
        F.sum(F.when(F.col("_step") != "date", F.col("_c") - 1).otherwise(0)).alias("exact_duplicates"),
        *[F.count_if(F.col("_step") == s).alias(a) for s, a in (
            ("arrivals", "bad_arrivals"), ("price", "bad_prices"), ("inconsistent", "inconsistent"),
            ("kept", "kept"))],
        F.sum("_c").alias("raw_rows"))
    alive = F.col("kept") > 0
    return keyed.agg(
        F.sum("raw_rows").alias("raw_rows"), F.sum("invalid_dates").alias("invalid_dates"),
        F.sum("exact_duplicates").alias("exact_duplicates"), F.sum("bad_arrivals").alias("bad_arrivals"),
        F.sum("bad_prices").alias("bad_prices"), F.sum("inconsistent").alias("inconsistent"),
        F.sum(F.when(alive, F.col("kept") - 1).otherwise(0)).alias("keyed_duplicates"),
        F.count_if(alive).alias("final_rows"),
        F.min(F.when(alive, F.col("reported_date"))).alias("first_date"),
        F.max(F.when(alive, F.col("reported_date"))).alias("last_date"),
        F.countDistinct(F.when(alive, F.col("market"))).alias("markets"),
        F.countDistinct(F.when(alive, F.col("variety"))).alias("varieties"))


# --- jumps and anomalies ----------------------------------------------------

def with_jump(df: DataFrame, price: str = "modal_price") -> DataFrame:
    w = series_window()
    previous = F.lag(price).over(w)
    return df.select("*", previous.alias("previous_price"),
                     pct_change(F.col(price), previous).alias("pct_jump"))


def flag_extreme_jumps(df: DataFrame, pct: float = 300.0) -> DataFrame:
    """Flag, never drop."""
    return with_jump(df).withColumn(
        "extreme_jump", F.coalesce(F.abs("pct_jump") > pct, F.lit(False)))


def price_jump_report(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Moves of at least threshold times the previous price, largest first."""
    jumps = with_jump(df).filter(F.abs("pct_jump") >= threshold * 100)
    return (jumps.withColumn("direction", F.when(F.col("pct_jump") > 0, "up").otherwise("down"))
            .orderBy(F.abs("pct_jump").desc(), *OBS_KEY))


def price_jump_counts(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    jump = F.col("pct_jump")
    return with_jump(df).agg(F.count("*").alias("n_rows"), F.count_if(jump >= threshold * 100).alias("up"),
                             F.count_if(jump <= -threshold * 100).alias("down"))


def price_anomaly_rows(df: DataFrame, cap: float = 100000.0) -> DataFrame:
    """Rows with a price above the cap or a modal price outside its bounds."""
    above = F.greatest("min_price", "max_price", "modal_price") > cap
    return df.select("*", F.coalesce(above, F.lit(False)).alias("above_cap"),
                     inconsistent_prices().alias("outside_bounds")).filter("above_cap OR outside_bounds")


def price_anomaly_stats(df: DataFrame, cap: float = 100000.0) -> DataFrame:
    """One row per price column: min, max, exact median and rows above the cap."""
    from granary.functions.distributed import exact_quantiles
    long = df.unpivot([], ["min_price", "max_price", "modal_price"], "price_column", "value")
    med = exact_quantiles(long, "value", {"median": 0.5}, ["price_column"])
    stats = long.groupBy("price_column").agg(
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("value") > cap).alias("above_cap"))
    return stats.join(med, "price_column")


# --- names ------------------------------------------------------------------

def spelling_table(spark: SparkSession, canonical: Mapping[str, Sequence[str]],
                   aliases: Mapping[str, str]) -> DataFrame:
    """(commodity or NULL, spelling, name, rank): rank 0 alias, 1 own commodity, 2 any commodity."""
    rows = [(None, k, v, 0, 0) for k, v in aliases.items()]
    for i, (commodity, names) in enumerate(canonical.items()):
        rows += [(commodity, n.lower(), n, 1, i) for n in names]
        rows += [(None, n.lower(), n, 2, i) for n in names]
    return spark.createDataFrame(rows, "commodity string, spelling string, name string, rank int, pos int")


def map_names(df: DataFrame, spellings: DataFrame, col: str, out: str, known: str) -> DataFrame:
    """Mapped name and whether it was found; unmapped names stay as trimmed text.

    The spelling table is keyed to one row per (commodity or any, spelling), so
    the two joins never multiply rows. It is written first, so its size is known
    when the joins are planned: broadcast below the session's threshold, and the
    rows of the data are not shuffled by spelling.
    """
    best = materialize(spellings.groupBy("commodity", "spelling").agg(
        F.min(F.struct("rank", "pos", "name")).alias("b")), "spellings")
    own = best.filter("commodity IS NOT NULL").select(
        F.col("commodity").alias("_c"), F.col("spelling").alias("_s1"), F.col("b").alias("_own"))
    other = best.filter("commodity IS NULL").select(F.col("spelling").alias("_s2"), F.col("b").alias("_any"))
    key = F.lower(F.trim(F.col(col)))
    joined = (df.join(own, (F.lower("commodity") == F.col("_c")) & (key == F.col("_s1")), "left")
              .join(other, key == F.col("_s2"), "left"))
    hit = F.least("_own", "_any")  # least skips NULLs and compares the rank first
    mapped = {out: F.coalesce(hit["name"], F.trim(F.col(col))), known: hit.isNotNull()}
    keep = [c for c in df.columns if c not in mapped]
    return joined.select(*keep, *[c.alias(n) for n, c in mapped.items()])


def map_market(df: DataFrame, spellings: DataFrame | None = None, col: str = "market") -> DataFrame:
    if spellings is None:
        spellings = spelling_table(df.sparkSession, N.CANONICAL_MARKETS, N.MARKET_ALIASES)
    return map_names(df, spellings, col, "market", "market_known")


def map_variety(df: DataFrame, spellings: DataFrame | None = None, col: str = "variety") -> DataFrame:
    if spellings is None:
        spellings = spelling_table(df.sparkSession, N.CANONICAL_VARIETIES, N.VARIETY_ALIASES)
    return map_names(df, spellings, col, "variety", "variety_known")


def normalize_district(df: DataFrame, col: str = "district", aliases: Mapping[str, str] = N.DISTRICT_ALIASES,
                       districts: Sequence[str] = N.DISTRICTS) -> DataFrame:
    """Blanks to Unknown, spellings to their canonical name, other names unchanged but trimmed."""
    table = {d.lower(): d for d in districts} | dict(aliases)
    names = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    text = F.trim(F.col(col).cast("string"))
    name = F.try_element_at(names, F.regexp_replace(F.lower(text), "-", " "))
    out = (F.when(text.isNull() | F.lower(text).isin(*N.UNKNOWN_TEXT), "Unknown")
           .otherwise(F.coalesce(name, text)))
    return df.select(*[out.alias(c) if c == col else F.col(c) for c in df.columns])


def normalize_season(season: Column) -> Column:
    """Canonical season name; unknown text in title case, NULL as Unknown."""
    text = F.lower(F.trim(season))
    known = F.create_map(*[F.lit(x) for kv in N.SEASON_ALIASES.items() for x in kv])
    return F.when(season.isNull(), "Unknown").otherwise(
        F.coalesce(F.try_element_at(known, text), F.initcap(text)))


def normalize_text(col: Column) -> Column:
    return squash_space(col)


# --- batches ----------------------------------------------------------------

def normalize_batch(raw: DataFrame, markets: DataFrame | None = None, varieties: DataFrame | None = None,
                    source: str | None = None) -> DataFrame:
    """Canonical raw text rows to clean keyed observations: the last spelling of a day wins."""
    rows = _mapped_batch(raw, markets, varieties).filter("_date_ok AND _price_ok")
    cols = [*OBS_KEY, "modal_price", "arrivals"]
    clean = dedup_keyed(rows.select(*cols), OBS_KEY, "last", ["modal_price", "arrivals"])
    return clean.withColumn("source_id", F.lit(source)) if source else clean


def _mapped_batch(raw, markets, varieties):
    typed = validate_arrivals(typed_observations(raw), "clamp")
    flagged = typed.select("*", F.col("reported_date").isNotNull().alias("_date_ok"),
                           F.coalesce(F.col("modal_price") > 0, F.lit(False)).alias("_price_ok"))
    return map_variety(map_market(flagged, markets), varieties)


def batch_audit(raw: DataFrame, markets: DataFrame | None = None,
                varieties: DataFrame | None = None) -> DataFrame:
    """One row: raw, accepted, rejected, duplicates, unmapped names, date range, distinct counts."""
    ok = F.col("_date_ok") & F.col("_price_ok")
    keyed = _mapped_batch(raw, markets, varieties).groupBy(
        *OBS_KEY, "market_known", "variety_known").agg(
        F.count("*").alias("n"), F.count_if(~F.col("_date_ok")).alias("bad_dates"),
        F.count_if(F.col("_date_ok") & ~F.col("_price_ok")).alias("bad_prices"),
        F.count_if(ok).alias("good"))
    alive = F.col("good") > 0
    unmapped = lambda c: F.countDistinct(F.when(alive & ~F.col(f"{c}_known"), F.col(c)))
    return keyed.agg(
        F.sum("n").alias("raw_rows"), F.count_if(alive).alias("accepted"),
        F.sum("bad_dates").alias("rejected_dates"), F.sum("bad_prices").alias("rejected_prices"),
        F.sum(F.when(alive, F.col("good") - 1).otherwise(0)).alias("duplicates"),
        unmapped("market").alias("unmapped_markets"), unmapped("variety").alias("unmapped_varieties"),
        F.min(F.when(alive, F.col("reported_date"))).alias("first_date"),
        F.max(F.when(alive, F.col("reported_date"))).alias("last_date"),
        F.countDistinct(F.when(alive, F.col("market"))).alias("markets"),
        F.countDistinct(F.when(alive, F.col("variety"))).alias("varieties"))


def unmapped_labels(raw: DataFrame, markets: DataFrame | None = None,
                    varieties: DataFrame | None = None) -> DataFrame:
    """(kind, label, n) of accepted rows whose market or variety has no canonical name."""
    rows = _mapped_batch(raw, markets, varieties).filter("_date_ok AND _price_ok")
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("label"),
                               F.col(f"{c}_known").alias("known")) for c in ("market", "variety")])
    return (rows.select(F.explode(kinds).alias("k")).filter("NOT k.known")
            .groupBy("k.kind", "k.label").agg(F.count("*").alias("n")))


# --- yields and weather -----------------------------------------------------

def derive_yield(df: DataFrame, supplied: str = "supplied_yield") -> DataFrame:
    """Valid rows (area > 0, production >= 0) with kg per hectare and the gap to the supplied yield."""
    value = F.col("production") / F.col("area") * 1000
    return (df.filter((F.col("area") > 0) & (F.col("production") >= 0))
            .select("*", value.alias("derived_yield"), F.abs(value - F.col(supplied)).alias("yield_gap")))


def derive_yield_report(df: DataFrame) -> DataFrame:
    ok = F.coalesce((F.col("area") > 0) & (F.col("production") >= 0), F.lit(False))
    gap = F.abs(F.when(ok, F.col("production") / F.col("area") * 1000) - F.col("supplied_yield"))
    return df.agg(F.count("*").alias("n_rows"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"),
                  F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"))


def _unit_groups(df, keys, factor):
    """Per key: row count, distinct areas, smallest and largest production."""
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct("area").alias("areas"), F.countDistinct("production").alias("productions"),
        F.min("production").alias("p_lo"), F.max("production").alias("p_hi"))
    ok = (F.col("n") == 1) | ((F.col("areas") == 1) & (F.col("productions") == 2)
                              & (F.col("p_hi") == F.col("p_lo") * factor))
    return stats.select("*", ok.alias("ok"))


def resolve_unit_duplicates(df: DataFrame, keys: Sequence[str], factor: float = 100.0) -> DataFrame:
    """Pairs that differ by exactly the factor in production keep the smaller row; bad keys are left out."""
    good = _unit_groups(df, keys, factor).filter("ok").select(*keys)
    kept = first_by(df, keys, ["production", *[c for c in df.columns if c != "production"]])
    return kept.join(good, list(keys), "left_semi")


def unit_duplicate_report(df: DataFrame, keys: Sequence[str], factor: float = 100.0) -> DataFrame:
    """Keys whose duplicates cannot be explained by the unit factor."""
    return _unit_groups(df, keys, factor).filter("NOT ok").drop("ok")


def fix_unit_scale(df: DataFrame, limit: float = 10000.0, factor: float = 100.0) -> DataFrame:
    """Yields above the limit come from production in the wrong unit."""
    wrong = F.col("production") / F.col("area") * 1000 > limit
    production = F.when(wrong, F.col("production") / factor).otherwise(F.col("production"))
    return (df.withColumns({"production": production, "unit_fixed": F.coalesce(wrong, F.lit(False))})
            .withColumn("yield_kg_ha", F.col("production") / F.col("area") * 1000))


# Reported yields below these bounds are in t/ha. Fixed values.
CROP_UNIT_THRESHOLDS = {"wheat": 10.0, "potato": 100.0}


def harmonize_crop_units(df: DataFrame, crop: str, keys: Sequence[str], value: str = "yield_raw") -> DataFrame:
    """Yields below the crop's threshold are t/ha, others quintals/ha with production in hundredths.

    Both become kg/ha and tonnes; one row per key is kept.
    """
    small = F.col(value) < CROP_UNIT_THRESHOLDS[crop]
    rows = dedup_keyed(df, keys, "first")
    return rows.select("*", (F.col(value) * F.when(small, 1000.0).otherwise(10.0)).alias("yield_kg_ha"),
                       (F.col("production") / F.when(small, 1.0).otherwise(100.0)).alias("production_tonnes"))


def sanitize_weather(df: DataFrame) -> DataFrame:
    """Sentinels, infinities and implausible values to NULL; flag Tmin > Tmax."""
    def keep(c, low=None, high=None):
        v = finite(F.col(c))
        ok = v != -999.0
        if low is not None:
            ok = ok & (v >= low)
        if high is not None:
            ok = ok & (v <= high)
        return F.when(ok, v)
    bounds = {"precip": (0, None), "rh2m": (0, 100), "solar": (0, None), "wind": (0, None),
              "t2m": (-50, 65), "t2m_min": (-50, 65), "t2m_max": (-50, 65)}
    out = df.withColumns({c: keep(c, *b) for c, b in bounds.items() if c in df.columns})
    return out.withColumn("temp_order_bad", F.coalesce(F.col("t2m_min") > F.col("t2m_max"), F.lit(False)))


def feature_warnings(area: Column, precip: Column, ndvi: Column, t2m: Column, rh: Column) -> Column:
    """Array of texts for implausible inputs, empty when all is well."""
    checks = [(area < 0, "area is negative"), (precip < 0, "precipitation is negative"),
              ((ndvi < -1) | (ndvi > 1), "ndvi outside [-1, 1]"),
              ((t2m < -20) | (t2m > 60), "temperature outside [-20, 60]"),
              ((rh < 0) | (rh > 100), "humidity outside [0, 100]")]
    return F.filter(F.array(*[F.when(c, t) for c, t in checks]), lambda x: x.isNotNull())


# --- profiles and gates -----------------------------------------------------

def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: nulls, distinct values, and min, max, mean, std of numbers.

    Two aggregates over the whole table; the second goes through distinct
    (column, value) pairs, so no task holds all values of a column.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("text"),
                 (F.col(f"`{c}`").cast("double") if c in numeric else F.lit(None).cast("double")).alias("num"))
        for c in df.columns])).alias("p")).select("p.*")
    per_value = pairs.groupBy("column_name", "text", "num").agg(F.count("*").alias("n"))
    n, x = F.col("n"), F.col("num")
    weight = F.sum(F.when(x.isNotNull(), n))
    mean = F.sum(x * n) / weight
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(F.col("text").isNull(), n).otherwise(0)).alias("nulls"),
        F.count("text").alias("distinct_values"), F.min("num").alias("min"), F.max("num").alias("max"),
        mean.alias("mean"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return (df.groupBy(*df.columns).agg(F.count("*").alias("c"))
            .agg(F.sum("c").alias("n_rows"), F.sum(F.col("c") - 1).alias("duplicates")))


def audit_grain(panel: DataFrame, keys: Sequence[str], target: str, lags: Sequence[str],
                weather: Sequence[str]) -> DataFrame:
    """Coverage of a panel: duplicate keys, nulls, and complete/incomplete/missing weather rows."""
    present = sum([F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in weather], F.lit(0))
    # per key first, so the duplicate check is one grouped aggregate
    keyed = panel.select("*", present.alias("_have")).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(target).isNull()).alias("target_nulls"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in lags],
        F.count_if(F.col("_have") == len(weather)).alias("weather_complete"),
        F.count_if((F.col("_have") > 0) & (F.col("_have") < len(weather))).alias("weather_incomplete"),
        F.count_if(F.col("_have") == 0).alias("weather_missing"))
    counts = ["target_nulls", *[f"{c}_nulls" for c in lags],
              "weather_complete", "weather_incomplete", "weather_missing"]
    return keyed.agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        *[F.countDistinct(k).alias(f"distinct_{k}") for k in keys],
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        *[F.sum(c).alias(c) for c in counts])


def history_as_of(df: DataFrame, date, minimum: int = 30,
                  values: Sequence[str] = ("modal_price", "arrivals")) -> DataFrame:
    """Rows up to a date, one per day, gaps filled forward then backward, short series left out."""
    as_of = date if isinstance(date, Column) else F.lit(date).cast("date")
    rows = dedup_keyed(df.filter(F.col("reported_date") <= as_of), OBS_KEY, "last",
                       [c for c in df.columns if c not in OBS_KEY])
    w = series_window()
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back),
                            F.first(c, ignorenulls=True).over(ahead)) for c in values}
    size = F.count("*").over(Window.partitionBy(*SERIES))
    return (rows.select("*", *[e.alias(f"_{c}") for c, e in filled.items()], size.alias("history"))
            .filter(F.col("history") >= minimum)
            .select(*[F.col(f"_{c}").alias(c) if c in filled else F.col(c) for c in df.columns], "history"))


def history_eligibility(df: DataFrame, min_prior: int = 30) -> DataFrame:
    """Rows with at least min_prior earlier observations in their series."""
    return (df.select("*", F.row_number().over(series_window()).alias("_rn"))
            .filter(F.col("_rn") > min_prior).drop("_rn"))


def eligibility_report(df: DataFrame, min_prior: int = 30) -> DataFrame:
    """Per-series counts are enough: the first min_prior rows of each series are excluded."""
    sizes = df.groupBy(*SERIES).agg(F.count("*").alias("n"))
    kept = F.greatest(F.col("n") - min_prior, F.lit(0))
    return sizes.agg(F.count("*").alias("series"), F.count_if(kept == 0).alias("series_excluded"),
                     F.sum("n").alias("n_rows"), F.sum(kept).alias("rows_kept"),
                     F.sum(F.col("n") - kept).alias("rows_excluded"))


def model_ready_rows(df: DataFrame, features: Sequence[str], target: str,
                     forbidden: Sequence[str] = ()) -> DataFrame:
    """Infinite values to NULL, incomplete rows out, leaking feature names refused."""
    leaks = sorted(set(features) & (set(forbidden) | {target}))
    if leaks:
        raise ValueError(f"features would leak the target: {', '.join(leaks)}")
    cols = [*features, target]
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: finite(F.col(c)) for c in cols if c in doubles}).dropna(subset=cols)
