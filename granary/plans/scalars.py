"""Scalar projections."""

from pyspark.sql import functions as F

from granary.functions import dates as D
from granary.functions import scalars as X
from granary.functions.windows import series_window
from granary.plans.registry import lag, query
from granary.sources import adapters as A


@query("c01_calendar_parts", """
SELECT DISTINCT reported_date, CAST(year(reported_date) AS INTEGER) AS year, CAST(month(reported_date) AS INTEGER) AS month,
  CAST(day(reported_date) AS INTEGER) AS day, CAST(isodow(reported_date) - 1 AS INTEGER) AS day_of_week,
  CAST(weekofyear(reported_date) AS INTEGER) AS week_of_year, CAST(quarter(reported_date) AS INTEGER) AS quarter,
  CAST(dayofyear(reported_date) AS INTEGER) AS day_of_year
FROM @obs@""")
def c01(spark, folder):
    dates = A.observations(spark, folder).select("reported_date").distinct()
    return dates.withColumns(D.calendar_parts(F.col("reported_date")))


@query("c02_annual_harmonics", """
SELECT DISTINCT reported_date,
  ~sin(2 * pi() * dayofyear(reported_date) / 365.25) AS annual_sin,
  ~cos(2 * pi() * dayofyear(reported_date) / 365.25) AS annual_cos
FROM @obs@""")
def c02(spark, folder):
    dates = A.observations(spark, folder).select("reported_date").distinct()
    return dates.withColumns(D.annual_harmonics(F.col("reported_date")))


@query("c03_weather_season", """
SELECT CASE WHEN month(date) BETWEEN 6 AND 11 THEN 'Kharif' WHEN month(date) IN (12, 1, 2) THEN 'Rabi' ELSE 'Summer' END AS season,
  CAST(month(date) AS INTEGER) AS month, count(*) AS n FROM @weather@ GROUP BY ALL""")
def c03(spark, folder):
    w = A.daily_weather(spark, folder)
    return w.groupBy(D.weather_season(F.month("date")).alias("season"), F.month("date").alias("month")).agg(
        F.count("*").alias("n"))


@query("c04_market_season_year", """
SELECT CASE WHEN m BETWEEN 3 AND 7 THEN 'Summer' WHEN m BETWEEN 8 AND 10 THEN 'Autumn' ELSE 'Winter' END AS season,
  CAST(CASE WHEN m <= 2 THEN y - 1 ELSE y END AS INTEGER) AS year, count(*) AS n
FROM (SELECT month(reported_date) AS m, year(reported_date) AS y FROM @obs@) GROUP BY ALL""")
def c04(spark, folder):
    s = A.observations(spark, folder).select(D.market_season_year(F.col("reported_date")).alias("s"))
    return s.groupBy("s.season", "s.year").agg(F.count("*").alias("n"))


@query("c05_season_window", """
SELECT district, season, year, crop,
  CASE WHEN crop = 'wheat' THEN make_date(year - 1, 11, 15) WHEN crop = 'potato' THEN make_date(year - 1, 11, 1)
    WHEN season = 'Autumn' THEN make_date(year, 5, 1) WHEN season = 'Winter' THEN make_date(year, 6, 1)
    ELSE make_date(year - 1, 11, 1) END AS start,
  CASE WHEN crop <> 'rice' THEN make_date(year, 1, 31) WHEN season = 'Autumn' THEN make_date(year, 7, 31)
    WHEN season = 'Winter' THEN make_date(year, 9, 30) ELSE make_date(year, 2, 28) END AS cutoff,
  CAST(CASE WHEN crop = 'wheat' THEN 78 WHEN crop = 'potato' THEN 92 WHEN season = 'Autumn' THEN 92
    WHEN season = 'Winter' THEN 122 ELSE 120 END AS INTEGER) AS expected_days
FROM (SELECT *, unnest(['rice', 'wheat', 'potato']) AS crop FROM @panel@)""")
def c05(spark, folder):
    windows = {c: D.season_window(F.col("year"), F.col("season"), c) for c in ("rice", "wheat", "potato")}
    crops = F.array(*[F.struct(F.lit(c).alias("crop"), w.alias("w")) for c, w in windows.items()])
    return (A.yield_panel(spark, folder).select("district", "season", "year", F.explode(crops).alias("c"))
            .select("district", "season", "year", "c.crop", "c.w.*"))


@query("c06_forecast_id", """
SELECT forecast_id AS price_id,
  sha256(commodity || '|' || lower(market) || '|' || lower(variety) || '|' || strftime(origin_date, '%Y-%m-%d') || '|'
         || horizon || '|persistence') AS volatility_id,
  'rice_' || lower(market) || '_' || year(origin_date) || '_' || substr(sha256('rice|' || lower(market) || '|'
         || year(origin_date) || '|' || strftime(origin_date, '%Y-%m-%d')), 1, 12) AS yield_id
FROM @ledger@""")
def c06(spark, folder):
    led = A.forecast_ledger(spark, folder)
    c = F.col
    model = F.lit("persistence")
    return led.select(
        X.price_forecast_id(F.upper(c("market")), c("variety"), c("origin_date"), c("horizon"), model).alias("price_id"),
        X.volatility_forecast_id(F.lit("Rice"), c("market"), c("variety"), c("origin_date"), c("horizon"),
                                 model).alias("volatility_id"),
        X.yield_forecast_id(c("commodity"), c("market"), F.year("origin_date"),
                            F.date_format("origin_date", "yyyy-MM-dd")).alias("yield_id"))


@query("c07_change_targets", f"""
SELECT market, variety, reported_date, nxt - modal_price AS change,
  ~(nxt - modal_price) / nullif(modal_price, 0) AS pct,
  ~ln(nxt / nullif(modal_price, 0)) AS log_return
FROM (SELECT *, lead(modal_price) OVER (PARTITION BY commodity, market, variety ORDER BY reported_date) AS nxt FROM @obs@)""")
def c07(spark, folder):
    nxt, p = F.lead("modal_price").over(series_window()), F.col("modal_price")
    return A.observations(spark, folder).select(
        "market", "variety", "reported_date", (nxt - p).alias("change"),
        (X.pct_change(nxt, p) / 100).alias("pct"), X.log_return(nxt, p).alias("log_return"))


@query("c08_price_dispersion_pct", """
SELECT market, variety, reported_date,
  ~(max_price - min_price) / nullif(modal_price, 0) * 100 AS spread_pct,
  ~CASE WHEN max_price > min_price THEN (modal_price - min_price) / (max_price - min_price) ELSE 0.5 END AS position
FROM @obs@""")
def c08(spark, folder):
    lo, hi, p = F.col("min_price"), F.col("max_price"), F.col("modal_price")
    return A.observations(spark, folder).select(
        "market", "variety", "reported_date", X.spread_pct(lo, hi, p).alias("spread_pct"),
        X.position_in_range(lo, hi, p).alias("position"))


@query("c09_price_structure_abs", """
SELECT market, variety, reported_date, max_price - min_price AS price_spread,
  ~least(greatest((modal_price - min_price) / greatest(max_price - min_price, 0.0001::DOUBLE), 0), 1) AS price_position_in_range,
  ~min_price / (modal_price + 0.0001::DOUBLE) AS min_to_modal_ratio,
  ~modal_price / (max_price + 0.0001::DOUBLE) AS modal_to_max_ratio
FROM @obs@""")
def c09(spark, folder):
    from granary.operators.features import price_structure_abs
    return A.observations(spark, folder).withColumns(price_structure_abs()).select(
        "market", "variety", "reported_date", *price_structure_abs())


@query("c10_production_estimate", """
SELECT district, season, year,
  ~CASE WHEN area - 20 > 0 THEN yield_kg_ha / 1000 * (area - 20) END AS tonnes
FROM @panel@""")
def c10(spark, folder):
    return A.yield_panel(spark, folder).select(
        "district", "season", "year",
        X.production_tonnes(F.col("yield_kg_ha") / 1000, F.col("area") - 20).alias("tonnes"))


# class probabilities of a row: shares of the gaps between min, modal and max price
_P = """
p AS (SELECT *, CASE WHEN s > 0 THEN p1 / s END AS n1, CASE WHEN s > 0 THEN p2 / s END AS n2, CASE WHEN s > 0 THEN p3 / s END AS n3
  FROM (SELECT *, p1 + p2 + p3 AS s FROM (SELECT *, (modal_price - min_price) / 1000 AS p1,
    (max_price - modal_price) / 1000 AS p2, arrivals / 100 AS p3 FROM @obs@)))"""


@query("c11_probabilities", f"""
WITH {_P.strip()}
SELECT market, variety, reported_date,
  p1 BETWEEN 0 AND 1 AND p2 BETWEEN 0 AND 1 AND p3 BETWEEN 0 AND 1 AND abs(s - 1) <= 0.0001 AS valid_raw,
  ~n1 AS p_low,
  ~n2 AS p_medium,
  ~n3 AS p_high,
  ~greatest(n1, n2, n3) AS confidence
FROM p""")
def c11(spark, folder):
    lo, hi, p = F.col("min_price"), F.col("max_price"), F.col("modal_price")
    ps = [(p - lo) / 1000, (hi - p) / 1000, F.col("arrivals") / 100]
    n = X.normalized(ps)
    return A.observations(spark, folder).select(
        "market", "variety", "reported_date", X.probabilities_valid(ps).alias("valid_raw"),
        *[c.alias(a) for c, a in zip(n, ("p_low", "p_medium", "p_high"))], F.greatest(*n).alias("confidence"))


@query("c12_to_json_report", """
SELECT market, variety, '{"rows":' || count(*) || ',"first":"' || strftime(min(reported_date), '%Y-%m-%d')
  || '","labels":{"LOW":' || count(*) FILTER (modal_price <= 1000) || ',"HIGH":' || count(*) FILTER (modal_price > 1000)
  || '}}' AS details FROM @obs@ GROUP BY ALL""")
def c12(spark, folder):
    low = F.count_if(F.col("modal_price") <= 1000)
    labels = F.create_map(F.lit("LOW"), low, F.lit("HIGH"), F.count("*") - low)
    return A.observations(spark, folder).groupBy("market", "variety").agg(F.to_json(F.struct(
        F.count("*").alias("rows"), F.min("reported_date").cast("string").alias("first"),
        labels.alias("labels"))).alias("details"))
