"""Profiles, distributions, sorts and set operations."""

from pyspark.sql import functions as F

from granary.functions.windows import series_window
from granary.operators import aggregates as G
from granary.operators import labels as L
from granary.operators import splits as S
from granary.plans.labels import FWD5, KEY, NEXT, P, c3, _forward_sql
from granary.plans.registry import W, lag, query
from granary.sources import adapters as A


def obs(spark, folder):
    return A.observations(spark, folder)


@query("h06_time_profiles", f"""
SELECT 'year' AS profile, CAST(year(reported_date) AS INTEGER) AS period, count(*) AS n,
  ~avg({P}) AS mean,
  ~stddev_samp({P}) AS std
FROM @obs@ GROUP BY 2
UNION ALL SELECT 'month', CAST(month(reported_date) AS INTEGER), count(*),
  ~avg({P}) AS mean,
  ~stddev_samp({P}) AS std
FROM @obs@ GROUP BY 2""")
def h06(spark, folder):
    return G.time_profiles(obs(spark, folder))


TOP = "top AS (SELECT market, count(*) AS n FROM @obs@ GROUP BY market ORDER BY n DESC, market LIMIT 6)"


@query("h06_month_end_means", f"""
WITH {TOP}
SELECT market, CAST(last_day(reported_date) AS DATE) AS month_end, count(*) AS n,
  ~avg({P}) AS mean_price
FROM @obs@ WHERE market IN (SELECT market FROM top) GROUP BY ALL""")
def h06m(spark, folder):
    return G.month_end_means(obs(spark, folder))


_GAPS = f"g AS (SELECT market, variety, CAST(reported_date - {lag('reported_date')} AS INTEGER) AS gap FROM @obs@)"


@query("h07_gap_distribution", f"""
WITH {_GAPS}
SELECT count(gap) AS n, max(gap) AS max,
  ~avg(gap) AS mean,
  ~quantile_cont(gap::DOUBLE, 0.5) AS median,
  ~count(*) FILTER (gap = 1) / count(gap) * 100 AS pct_1,
  ~count(*) FILTER (gap BETWEEN 2 AND 3) / count(gap) * 100 AS pct_2_3,
  ~count(*) FILTER (gap BETWEEN 4 AND 7) / count(gap) * 100 AS pct_4_7,
  ~count(*) FILTER (gap > 7) / count(gap) * 100 AS pct_over_7
FROM g""")
def h07(spark, folder):
    return G.gap_distribution(obs(spark, folder))


@query("h08_flat_price_share", f"""
WITH {NEXT},
f AS (SELECT CASE WHEN reported_date >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS role,
  floor({P} / 500) - lag(floor({P} / 500)) OVER {W} AS d, floor(future_price / 500) - floor({P} / 500) AS t
  FROM nx WHERE days_to_next BETWEEN 1 AND 7)
SELECT role, count(*) AS n,
  ~count(*) FILTER (d = 0) / count(d) * 100 AS flat_step_pct,
  ~count(*) FILTER (t = 0) / count(t) * 100 AS flat_target_pct
FROM f GROUP BY role""")
def h08(spark, folder):
    # coarse prices, so that flat steps occur
    coarse = lambda c: F.floor(F.col(c) / 500).cast("double")
    rows = L.next_obs_target(obs(spark, folder)).withColumns({
        "role": F.when(F.col("reported_date") >= "2000-01-01", "test").otherwise("train"),
        "future_change": coarse("future_price") - coarse(P), P: coarse(P)})
    return G.flat_price_share(rows)


@query("h09_histogram", f"""
WITH b AS (SELECT min({P}) AS lo, max({P}) AS hi FROM @obs@)
SELECT CAST(least(floor(({P} - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin,
  ~any_value(lo + CAST(least(floor(({P} - lo) / ((hi - lo) / 40)), 39) AS INTEGER) * ((hi - lo) / 40)) AS left_edge,
  count(*) AS n
FROM @obs@ CROSS JOIN b GROUP BY 1""")
def h09(spark, folder):
    return G.histogram(obs(spark, folder), P, 40)


_LAB = f"lb AS (SELECT CASE WHEN reported_date >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS role, {c3('r', 2000, 5000)} AS label FROM (SELECT *, {FWD5} AS r FROM @obs@) WHERE r IS NOT NULL)"


@query("h10_class_distribution", f"""
WITH {_LAB}, c AS (SELECT role, label, count(*) AS n FROM lb GROUP BY ALL)
SELECT role, label, n,
  ~n / sum(n) OVER (PARTITION BY role) * 100 AS pct
FROM c""")
def h10(spark, folder):
    from granary.functions.scalars import classify3
    rows = obs(spark, folder).select(
        F.when(F.col("reported_date") >= "2000-01-01", "test").otherwise("train").alias("role"),
        classify3(L.forward_obs_range(5), 2000.0, 5000.0).alias("label")).filter("label IS NOT NULL")
    return G.class_distribution(rows, "label")


@query("h11_offset_stats", f"""
WITH {_forward_sql(30)}
SELECT count(*) AS n, min(actual_days_30d) AS min, max(actual_days_30d) AS max,
  ~avg(actual_days_30d) AS mean,
  ~stddev_samp(actual_days_30d) AS std,
  ~quantile_cont(actual_days_30d::DOUBLE, 0.25) AS p25,
  ~quantile_cont(actual_days_30d::DOUBLE, 0.5) AS median,
  ~quantile_cont(actual_days_30d::DOUBLE, 0.75) AS p75
FROM f30""")
def h11(spark, folder):
    return G.offset_stats(L.forward_calendar_target(obs(spark, folder), 30), "actual_days_30d")


@query("h12_obs_window_span", f"""
WITH f AS (SELECT *, {FWD5} AS r, lead(reported_date, 5) OVER {W} - reported_date AS span FROM @obs@)
SELECT count(r) AS n, CAST(max(span) FILTER (r IS NOT NULL) AS INTEGER) AS max_span,
  ~avg(span) FILTER (r IS NOT NULL) AS mean_span,
  ~quantile_cont(span::DOUBLE, 0.5) FILTER (r IS NOT NULL) AS median_span,
  ~quantile_cont(span::DOUBLE, 0.9) FILTER (r IS NOT NULL) AS p90_span,
  ~count(*) FILTER (r = 0) / count(r) * 100 AS zero_range_pct,
  ~quantile_cont(r, 0.5) FILTER (r > 0) AS median_nonzero_range,
  ~quantile_cont(r / {P} * 100, 0.5) FILTER (r > 0) AS median_nonzero_pct_range
FROM f""")
def h12(spark, folder):
    return G.obs_window_span(obs(spark, folder))


_FEATS = ("arrivals", "min_price", "max_price", "lag_1", "persistence_error")


@query("h14_feature_target_correlation", f"""
WITH {NEXT}, f AS (SELECT *, lag({P}) OVER {W} AS lag_1, future_price - {P} AS persistence_error FROM nx)
{chr(10).join(f"{'UNION ALL ' if i else ''}SELECT '{c}' AS feature, floor(corr({c}, future_price) * 1e4 + 0.5) / 1e4 AS correlation FROM f" for i, c in enumerate(_FEATS))}""")
def h14(spark, folder):
    w = series_window()
    rows = obs(spark, folder).withColumns({"lag_1": F.lag(P).over(w), "future_price": F.lead(P).over(w)})
    rows = rows.withColumn("persistence_error", F.col("future_price") - F.col(P))
    return G.feature_target_correlation(rows, _FEATS, "future_price")


@query("h15_residual_moments", f"""
WITH {NEXT}, r AS (SELECT variety, future_price - {P} AS e FROM nx WHERE days_to_next BETWEEN 1 AND 7)
SELECT variety, count(e) AS n, min(e) AS min, max(e) AS max,
  ~avg(e) AS mean,
  ~stddev_pop(e) AS std,
  ~skewness(e) AS skew,
  ~kurtosis(e) AS kurt
FROM r GROUP BY variety""")
def h15(spark, folder):
    rows = L.next_obs_target(obs(spark, folder))
    return G.residual_moments(rows, "future_change", ["variety"])


@query("h16_volatility_diagnostics", f"""
WITH f AS (SELECT CASE WHEN r < 1000 THEN 0 ELSE r END AS r FROM (SELECT {FWD5} AS r FROM @obs@))
SELECT count(*) AS n_rows, count(r) AS n_valid, count(*) FILTER (r = 0) AS n_zero, min(r) AS min, max(r) AS max,
  count(*) FILTER (r > 0) AS n_nonzero, min(r) FILTER (r > 0) AS nonzero_min,
  ~avg(r) AS mean,
  ~stddev_samp(r) AS std,
  ~quantile_cont(r, 0.25) AS p25,
  ~quantile_cont(r, 0.5) AS median,
  ~quantile_cont(r, 0.75) AS p75,
  ~avg(r) FILTER (r > 0) AS nonzero_mean,
  ~quantile_cont(r, 0.5) FILTER (r > 0) AS nonzero_median
FROM f""")
def h16(spark, folder):
    r = L.forward_obs_range(5)
    rows = obs(spark, folder).select(F.when(r < 1000, 0.0).otherwise(r).alias("r"))
    return G.volatility_diagnostics(rows, "r")


@query("h17_series_profile", f"""
WITH s AS (SELECT *, lead({P}) OVER {W} - {P} AS d, lead(reported_date) OVER {W} - reported_date AS g FROM @obs@)
SELECT commodity, market, variety, count(*) AS n, {', '.join(f'count(*) FILTER (g = {k}) AS gap_{k}' for k in range(1, 8))},
  count(*) FILTER (g > 7) AS gap_longer,
  ~avg({P}) AS price_mean,
  ~stddev_samp({P}) AS price_std,
  ~count(*) FILTER (d = 0) / count(d) * 100 AS zero_pct,
  ~stddev_samp(d) AS change_std
FROM s GROUP BY ALL""")
def h17(spark, folder):
    return G.series_profile(obs(spark, folder))


@query("h17_last_rows", f"""
SELECT market, variety, reported_date, {P}, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (
  PARTITION BY commodity, market, variety ORDER BY reported_date DESC) AS back FROM @obs@) WHERE back <= 20""")
def h17l(spark, folder):
    return G.last_rows(obs(spark, folder)).select(*KEY, P, "back")


# --- sorts, top-k, set operations ---------------------------------------------------

@query("l01_series_order", f"""
SELECT market, variety, reported_date, CAST(row_number() OVER {W} AS INTEGER) AS position, reported_date > {lag('reported_date')} AS ascending
FROM @obs@""")
def l01(spark, folder):
    w = series_window()
    return obs(spark, folder).select(*KEY, F.row_number().over(w).alias("position"),
                                     (F.col("reported_date") > F.lag("reported_date").over(w)).alias("ascending"))


@query("l02_top_errors", f"""
WITH {NEXT}, e AS (SELECT market, variety, reported_date, abs(future_price - {P}) AS abs_error FROM nx WHERE days_to_next BETWEEN 1 AND 7)
SELECT * FROM e ORDER BY abs_error DESC, market, variety, reported_date LIMIT 10""")
def l02(spark, folder):
    rows = L.next_obs_target(obs(spark, folder)).select(*KEY, F.abs("future_change").alias("abs_error"))
    return rows.orderBy(F.desc("abs_error"), *KEY).limit(10)


@query("l03_top_markets", f"WITH {TOP}\nSELECT market, n FROM top")
def l03(spark, folder):
    return G.top_markets(obs(spark, folder))


@query("l04_union_batches", """
SELECT variety, count(*) AS n, count(DISTINCT source) AS sources FROM (
  SELECT variety, 'early' AS source FROM @obs@ WHERE reported_date < DATE '1998-01-01'
  UNION ALL SELECT variety, 'late' FROM @obs@ WHERE reported_date >= DATE '1998-01-01') GROUP BY variety""")
def l04(spark, folder):
    df = obs(spark, folder)
    early = df.filter("reported_date < '1998-01-01'").withColumn("source", F.lit("early"))
    late = df.filter("reported_date >= '1998-01-01'").withColumn("source", F.lit("late"))
    return early.unionByName(late).groupBy("variety").agg(
        F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("l05_intersect_except", """
WITH a AS (SELECT DISTINCT market, variety FROM @obs@ WHERE reported_date < DATE '1995-01-05'),
b AS (SELECT DISTINCT market, variety FROM @obs@ WHERE reported_date > DATE '2001-10-30')
SELECT 'both' AS side, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_a', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'only_b', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def l05(spark, folder):
    df = obs(spark, folder)
    a = df.filter("reported_date < '1995-01-05'").select("market", "variety").distinct()
    b = df.filter("reported_date > '2001-10-30'").select("market", "variety").distinct()
    tag = lambda d, s: d.select(F.lit(s).alias("side"), "market", "variety")
    return (tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "only_a"))
            .unionByName(tag(b.exceptAll(a), "only_b")))


@query("l06_best_row_per_key", f"""
SELECT market, max_by(variety, ({P}, -(reported_date - DATE '1970-01-01'), variety)) AS variety, max({P}) AS price FROM @obs@ GROUP BY market""")
def l06(spark, folder):
    order = F.struct(F.col(P), -F.unix_date("reported_date"), F.col("variety"))
    return obs(spark, folder).groupBy("market").agg(F.max_by("variety", order).alias("variety"), F.max(P).alias("price"))
