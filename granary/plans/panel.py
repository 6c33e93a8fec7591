"""Panel joins and seasonal aggregates."""

from pyspark.sql import functions as F

from granary.operators import cleaning as C
from granary.operators import labels as L
from granary.operators import ledger_joins as J
from granary.operators import panel as N
from granary.plans.labels import KEY, P, _forward_sql
from granary.plans.registry import query
from granary.sources import adapters as A
from granary.sources import tables as S

PK = ("district", "season", "year")
CLEAN_W = """cw AS (SELECT district, date, nullif(precip, -999) AS precip, nullif(t2m, -999) AS t2m, nullif(t2m_min, -999) AS t2m_min,
  nullif(t2m_max, -999) AS t2m_max, nullif(rh2m, -999) AS rh2m, nullif(solar, -999) AS solar, nullif(wind, -999) AS wind FROM @weather@)"""


def panel(spark, folder):
    return A.yield_panel(spark, folder)


def weather(spark, folder):
    return C.sanitize_weather(A.daily_weather(spark, folder)).drop("temp_order_bad")


SEASONAL = """sw AS (SELECT district, s.season, CAST(year(date) AS INTEGER) AS year, sum(precip) AS precip, avg(t2m) AS t2m,
    avg(t2m_min) AS t2m_min, avg(t2m_max) AS t2m_max, avg(rh2m) AS rh2m, avg(solar) AS solar, avg(wind) AS wind, count(*) AS weather_days
  FROM cw JOIN (VALUES ('Autumn', 5, 9), ('Winter', 6, 11), ('Summer', 3, 6)) s(season, a, b) ON month(date) BETWEEN a AND b GROUP BY ALL)"""


def _ndvi(spark, folder):
    return panel(spark, folder).filter("year % 2 = 0").select(*PK, (F.col("production") / 1000).alias("ndvi"))


@query("g01_merge_panel", f"""
WITH {CLEAN_W},
{SEASONAL}
SELECT p.district, p.season, p.year, weather_days,
  ~p.yield_kg_ha AS yield_kg_ha,
  ~sw.precip AS precip,
  ~sw.t2m AS t2m,
  ~CASE WHEN p.year % 2 = 0 THEN p.production / 1000 END AS ndvi
FROM @panel@ p LEFT JOIN sw USING (district, season, year)""")
def g01(spark, folder):
    seasonal = N.seasonal_weather_agg(weather(spark, folder))
    merged = N.merge_panel_one_to_one(panel(spark, folder), seasonal, _ndvi(spark, folder))
    return merged.select(*PK, "weather_days", "yield_kg_ha", "precip", "t2m", "ndvi")


@query("g02_match_indicator", """
SELECT district, season, year, CASE WHEN year % 2 = 0 THEN 'both' ELSE 'left_only' END AS _merge FROM @panel@""")
def g02(spark, folder):
    return N.match_indicator(panel(spark, folder), _ndvi(spark, folder)).select(*PK, "_merge")


@query("g02_unmatched_per_district", """
SELECT district, count(*) AS n_rows, count(*) FILTER (year % 2 = 1) AS unmatched, min(year) FILTER (year % 2 = 1) AS first_unmatched_year
FROM @panel@ GROUP BY district""")
def g02u(spark, folder):
    return N.unmatched_per_district(panel(spark, folder), _ndvi(spark, folder))


@query("g03_key_set_diff", """
WITH a AS (SELECT DISTINCT trim(market) AS value FROM @obs_raw@), b AS (SELECT DISTINCT district AS value FROM @panel@)
SELECT value, 'only_left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT value, 'only_right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def g03(spark, folder):
    raw = A.raw_observations(spark, folder).select(F.trim("market").alias("district"))
    return N.key_set_diff(raw, panel(spark, folder), "district")


def _mapping(spark, folder):
    """Every third nation is unmapped, every second maps to two districts."""
    n = S.table(spark, folder, "nation")
    k = F.col("n_nationkey")
    two = F.array(F.concat(F.lit("D"), k.cast("string")), F.concat(F.lit("D"), (k + 1).cast("string")))
    one = F.array(F.concat(F.lit("D"), k.cast("string")))
    return n.filter(k % 3 != 0).select(F.col("n_name").alias("market"),
                                       F.explode(F.when(k % 2 == 0, two).otherwise(one)).alias("district"))


MAP = """mp AS (SELECT n_name AS market, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['D' || n_nationkey, 'D' || (n_nationkey + 1)]
  ELSE ['D' || n_nationkey] END) AS district FROM nation WHERE n_nationkey % 3 <> 0)"""


@query("g04_explode_district_map", f"""
WITH {MAP}
SELECT market, district, reported_date, variety, modal_price FROM @obs@ JOIN mp USING (market)""")
def g04(spark, folder):
    return N.explode_district_map(A.observations(spark, folder), _mapping(spark, folder)).select(
        "market", "district", "reported_date", "variety", "modal_price")


@query("g04_map_inflation_audit", f"""
WITH {MAP}, n AS (SELECT market, count(*) AS n FROM @obs@ GROUP BY market),
j AS (SELECT n.market, n, coalesce(fan, 0) AS fan FROM n LEFT JOIN (SELECT market, count(*) AS fan FROM mp GROUP BY market) USING (market))
SELECT CAST(sum(n) AS BIGINT) AS rows_before, CAST(sum(n * fan) AS BIGINT) AS rows_after,
  CAST(sum(CASE WHEN fan = 0 THEN n ELSE 0 END) AS BIGINT) AS rows_unmapped, count(*) FILTER (fan = 0) AS unmapped_markets,
  count(*) FILTER (fan > 1) AS split_markets FROM j""")
def g04a(spark, folder):
    return N.map_inflation_audit(A.observations(spark, folder), _mapping(spark, folder))


MARKET_SEASON = """ms AS (SELECT market AS district, CASE WHEN m BETWEEN 3 AND 7 THEN 'Summer' WHEN m BETWEEN 8 AND 10 THEN 'Autumn' ELSE 'Winter' END AS season,
    CAST(CASE WHEN m <= 2 THEN y - 1 ELSE y END AS INTEGER) AS year, sum(arrivals) AS arrivals_total, avg(arrivals) AS arrivals_mean,
    avg(modal_price) AS price_mean, min(modal_price) AS price_min, max(modal_price) AS price_max,
    coalesce(stddev_samp(modal_price), 0) AS price_vol, count(*) AS obs_count, max(modal_price) - min(modal_price) AS price_range
  FROM (SELECT *, month(reported_date) AS m, year(reported_date) AS y FROM @obs@) GROUP BY ALL)"""


@query("g05_year_offset_join", f"""
WITH {MARKET_SEASON}
SELECT p.district, p.season, p.year, a.obs_count AS obs_count_lag1, b.obs_count AS obs_count_lag2,
  ~a.price_mean AS price_mean_lag1,
  ~b.price_mean AS price_mean_lag2
FROM @panel@ p LEFT JOIN ms a ON p.district = a.district AND p.season = a.season AND p.year = a.year + 1
  LEFT JOIN ms b ON p.district = b.district AND p.season = b.season AND p.year = b.year + 2""")
def g05(spark, folder):
    seasons = N.market_season_agg(A.observations(spark, folder).withColumn("district", F.col("market")))
    return N.year_offset_join(panel(spark, folder).select(*PK), seasons, ["price_mean", "obs_count"])


SEASON_BOUNDS = """k AS (SELECT district, season, year, CASE season WHEN 'Autumn' THEN make_date(year, 5, 1) WHEN 'Winter' THEN make_date(year, 6, 1)
    ELSE make_date(year - 1, 11, 1) END AS a, CASE season WHEN 'Autumn' THEN make_date(year, 7, 31) WHEN 'Winter' THEN make_date(year, 9, 30)
    ELSE make_date(year, 2, 28) END AS b, CAST(CASE season WHEN 'Autumn' THEN 92 WHEN 'Winter' THEN 122 ELSE 120 END AS INTEGER) AS expected_days
  FROM @panel@)"""


@query("g06_season_window_join", f"""
WITH {CLEAN_W},
{SEASON_BOUNDS}
SELECT k.district, k.season, k.year, date, precip FROM cw JOIN k ON cw.district = k.district AND date BETWEEN a AND b""")
def g06(spark, folder):
    return N.season_window_join(weather(spark, folder), panel(spark, folder).select(*PK)).select(*PK, "date", "precip")


@query("g07_holdout_feature_join", f"""
WITH f AS (SELECT *, avg({P}) OVER (PARTITION BY commodity, market, variety ORDER BY reported_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7,
  lead({P}) OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) AS future_price,
  lead(reported_date) OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) - reported_date AS gap,
  count({P}) OVER (PARTITION BY commodity, market, variety ORDER BY reported_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS c FROM @obs@)
SELECT market, variety, reported_date, future_price,
  ~CASE WHEN c = 7 THEN m7 END AS rolling_mean_7
FROM f WHERE reported_date >= DATE '2001-01-01' AND gap BETWEEN 1 AND 7""")
def g07(spark, folder):
    from granary.operators import features as T
    obs = A.observations(spark, folder)
    holdout = L.next_obs_target(obs).filter("reported_date >= '2001-01-01'").select(
        *T.SERIES, "reported_date", "future_price")
    feats = T.add(obs, T.rolling_mean((7,))).select(*T.SERIES, "reported_date", "rolling_mean_7")
    return J.holdout_feature_join(holdout, feats).drop("commodity")


OUTCOME = """oc AS (SELECT l.*, o.reported_date AS target_date, o.modal_price AS actual_price, row_number() OVER (
    PARTITION BY l.forecast_id ORDER BY o.reported_date) AS rn
  FROM @ledger@ l LEFT JOIN @obs@ o ON l.market = o.market AND l.variety = o.variety AND o.reported_date BETWEEN window_start AND window_end)"""


@query("g08_outcome_match_join", f"""
WITH {OUTCOME}
SELECT forecast_id, market, variety, origin_date, horizon, predicted_price, target_date, actual_price FROM oc WHERE rn = 1""")
def g08(spark, folder):
    return J.outcome_match_join(A.forecast_ledger(spark, folder), A.observations(spark, folder)).select(
        "forecast_id", "market", "variety", "origin_date", "horizon", "predicted_price", "target_date", "actual_price")


@query("g09_lookup_join", """
WITH b AS (SELECT variety, avg(modal_price) AS base FROM @obs@ WHERE reported_date < DATE '1998-01-01' GROUP BY variety)
SELECT market, variety, reported_date,
  ~modal_price / base AS relative_price
FROM @obs@ LEFT JOIN b USING (variety)""")
def g09(spark, folder):
    obs = A.observations(spark, folder)
    base = obs.filter("reported_date < '1998-01-01'").groupBy("variety").agg(F.avg("modal_price").alias("base"))
    return J.lookup_join(obs, base, ["variety"]).select(
        *KEY, (F.col("modal_price") / F.col("base")).alias("relative_price"))


def _agg_out(t_min="avg", t_max="avg"):
    return ",\n".join(f"  ~{c} AS {c}" for c in ("precip", "t2m", "t2m_min", "t2m_max", "rh2m", "solar", "wind"))


@query("h01_seasonal_weather_agg", f"""
WITH {CLEAN_W},
{SEASONAL}
SELECT district, season, year, weather_days,
{_agg_out()}
FROM sw""")
def h01(spark, folder):
    return N.seasonal_weather_agg(weather(spark, folder))


@query("h01_calendar_season_agg", f"""
WITH {CLEAN_W},
ca AS (SELECT district, CASE WHEN month(date) BETWEEN 6 AND 11 THEN 'Kharif' WHEN month(date) IN (12, 1, 2) THEN 'Rabi' ELSE 'Summer' END AS season,
    CAST(year(date) AS INTEGER) AS year, sum(precip) AS precip, avg(t2m) AS t2m, min(t2m_min) AS t2m_min, max(t2m_max) AS t2m_max,
    avg(rh2m) AS rh2m, avg(solar) AS solar, avg(wind) AS wind, count(*) AS weather_days FROM cw GROUP BY ALL)
SELECT district, season, year, weather_days,
{_agg_out()}
FROM ca""")
def h01c(spark, folder):
    return N.calendar_season_agg(weather(spark, folder))


INSEASON_SQL = f"""{CLEAN_W},
{SEASON_BOUNDS},
fe AS (SELECT k.district, k.season, k.year, k.expected_days, count(cw.date) AS observed_days, max(cw.date) AS last_observation,
    sum(precip) AS precip_cum, avg(precip) AS precip_mean, max(precip) AS precip_max, avg(t2m) AS t2m_mean, min(t2m_min) AS t2m_min,
    max(t2m_max) AS t2m_max, max(t2m_max) - min(t2m_min) AS t2m_range, avg(rh2m) AS rh2m_mean, avg(solar) AS solar_mean, avg(wind) AS wind_mean
  FROM k LEFT JOIN cw ON cw.district = k.district AND date BETWEEN a AND b GROUP BY ALL)"""


@query("h02_inseason_weather_features", f"""
WITH {INSEASON_SQL}
SELECT district, season, year, observed_days, expected_days, greatest(expected_days - observed_days, 0) AS missing_days, last_observation,
  observed_days > 0 AND {' AND '.join(c + ' IS NOT NULL' for c in N.INSEASON)} AS is_complete,
  ~observed_days / expected_days AS completeness,
{chr(10).join(f'  ~{c} AS {c},' for c in N.INSEASON)[:-1]}
FROM fe""")
def h02(spark, folder):
    return N.inseason_weather_features(weather(spark, folder), panel(spark, folder).select(*PK))


@query("h02_inseason_with_barrier", f"""
WITH {CLEAN_W},
{SEASON_BOUNDS}
SELECT k.district, k.season, k.year, count(cw.date) AS observed_days,
  ~sum(precip) AS precip_cum
FROM k LEFT JOIN cw ON cw.district = k.district AND date BETWEEN a AND least(b, make_date(k.year, 6, 15)) GROUP BY ALL""")
def h02b(spark, folder):
    keys = panel(spark, folder).select(*PK, F.make_date("year", F.lit(6), F.lit(15)).alias("barrier"))
    return N.inseason_weather_features(weather(spark, folder), keys, "barrier").select(*PK, "observed_days", "precip_cum")


@query("h02_cutoff_audit", f"""
WITH {SEASON_BOUNDS}
SELECT k.district, k.season, k.year, count(*) FILTER (w.date < a) AS pre_season_days, count(*) FILTER (w.date > b) AS post_cutoff_days
FROM k LEFT JOIN @weather@ w ON w.district = k.district GROUP BY ALL""")
def h02c(spark, folder):
    return N.cutoff_audit(A.daily_weather(spark, folder), panel(spark, folder).select(*PK))


def _rabi_sql(start_day, expected, extra):
    names = ("precip_cum", "precip_mean", "t2m_mean", "t2m_min", "t2m_max", "t2m_range", "solar_mean", "rh2m_mean", "ws2m_mean", "gdd_base5")
    outs = "\n".join(f"  ~{n} AS {n}," for n in names)[:-1]
    return f"""
WITH {CLEAN_W},
k AS (SELECT DISTINCT district, year FROM @panel@),
g AS (SELECT k.district, k.year, CAST({expected} AS INTEGER) AS expected_days, count(*) AS observed_days, sum(precip) AS precip_cum,
    avg(precip) AS precip_mean, avg(t2m) AS t2m_mean, avg(t2m_min) AS t2m_min, avg(t2m_max) AS t2m_max, avg(t2m_max - t2m_min) AS t2m_range,
    avg(solar) AS solar_mean, avg(rh2m) AS rh2m_mean, avg(wind) AS ws2m_mean, sum(CASE WHEN t2m > 5 THEN t2m - 5 WHEN t2m <= 5 THEN 0 END) AS gdd_base5,
    count(*) FILTER (precip >= 1) AS precip_days, {', '.join(f'count(*) FILTER ({e}) AS {n}' for n, e in extra)}
  FROM k JOIN cw ON cw.district = k.district AND date BETWEEN make_date(k.year - 1, 11, {start_day}) AND make_date(k.year, 1, 31) GROUP BY ALL)
SELECT district, year, expected_days, observed_days, precip_days, {', '.join(n for n, _ in extra)},
  observed_days >= expected_days * 0.7 AND {' AND '.join(n + ' IS NOT NULL' for n in names)} AS is_complete,
{outs}
FROM g"""


# temperatures of the test weather sit around 20 to 45
@query("h03_wheat_weather_features", _rabi_sql(15, 78, [("heat_stress_days_28", "t2m_max >= 28"), ("heat_stress_days_30", "t2m_max >= 30")]))
def h03(spark, folder):
    return N.wheat_weather_features(weather(spark, folder), panel(spark, folder))


@query("h04_potato_weather_features", _rabi_sql(1, 92, [
    ("cool_night_days_16", "t2m_min <= 16"), ("cool_night_days_14", "t2m_min <= 14"),
    ("late_blight_risk_days", "rh2m >= 80 AND t2m BETWEEN 10 AND 22")]))
def h04(spark, folder):
    return N.potato_weather_features(weather(spark, folder), panel(spark, folder))


@query("h05_market_season_agg", f"""
WITH {MARKET_SEASON}
SELECT district, season, year, price_min, price_max, obs_count, price_range,
  ~arrivals_total AS arrivals_total,
  ~arrivals_mean AS arrivals_mean,
  ~price_mean AS price_mean,
  ~price_vol AS price_vol
FROM ms""")
def h05(spark, folder):
    return N.market_season_agg(A.observations(spark, folder).withColumn("district", F.col("market")))


HIER = """hm AS (SELECT CASE grouping_id(district, season) WHEN 0 THEN 'district_season' WHEN 1 THEN 'district' WHEN 2 THEN 'season' ELSE 'state' END AS level,
    district, season, avg(yield_kg_ha) AS mean, count(*) AS n FROM @panel@ GROUP BY CUBE (district, season))"""


@query("h13_hierarchical_means", f"""
WITH {HIER}
SELECT level, district, season, n,
  ~mean AS mean
FROM hm""")
def h13(spark, folder):
    return N.hierarchical_means(panel(spark, folder))
