"""Splits and leakage audits."""

from pyspark.sql import functions as F

from granary.functions.windows import series_window
from granary.operators import labels as L
from granary.operators import splits as S
from granary.operators.features import panel_window
from granary.plans.labels import KEY, P, FWD5, _forward_sql
from granary.plans.registry import W, lag, query
from granary.sources import adapters as A


def targeted(spark, folder):
    """Observations with the date their next observation arrives."""
    return A.observations(spark, folder).withColumn("target_date", F.lead("reported_date").over(series_window()))


_T = f"t AS (SELECT *, lead(reported_date) OVER {W} AS target_date, reported_date - DATE '1970-01-01' AS day FROM @obs@)"
_CUT = f"""{_T},
cut AS (SELECT DATE '1970-01-01' + CAST(floor(quantile_cont(day::DOUBLE, 0.8)) AS INTEGER) AS c FROM t),
sp AS (SELECT t.*, c AS cutoff, CASE WHEN reported_date >= c THEN 'test' WHEN target_date >= c THEN 'purged' ELSE 'train' END AS role
  FROM t CROSS JOIN cut)"""


def split(spark, folder):
    return S.global_time_split(targeted(spark, folder), "target_date")


@query("f01_global_time_split", f"""
WITH {_CUT}
SELECT market, variety, reported_date, role, CAST(cutoff AS DATE) AS cutoff FROM sp""")
def f01(spark, folder):
    return split(spark, folder).select(*KEY, "role", "cutoff")


@query("f01_drop_unseen_groups", f"""
WITH {_T},
sp AS (SELECT *, CASE WHEN reported_date >= DATE '1995-01-20' THEN 'test' WHEN target_date >= DATE '1995-01-20' THEN 'purged'
  ELSE 'train' END AS role FROM t)
SELECT market, variety, role, count(*) AS n FROM sp
WHERE role <> 'test' OR (market, variety) IN (SELECT (market, variety) FROM sp WHERE role = 'train') GROUP BY ALL""")
def f01d(spark, folder):
    out = S.global_time_split(targeted(spark, folder), "target_date", cutoff="1995-01-20", drop_unseen=True)
    return out.groupBy("market", "variety", "role").agg(F.count("*").alias("n"))


@query("f01_rows_per_year", "SELECT CAST(year(reported_date) AS INTEGER) AS year, count(*) AS n FROM @obs@ GROUP BY 1")
def f01y(spark, folder):
    return S.rows_per_year(A.observations(spark, folder))


@query("f02_walk_forward_splits", f"""
WITH {_T}, s AS (SELECT quantile_cont(day::DOUBLE, 0.5) AS lo, max(day)::DOUBLE AS hi FROM t),
f AS (SELECT i AS fold, lo + (hi - lo) * (i / 4.0::DOUBLE) AS a, lo + (hi - lo) * ((i + 1) / 4.0::DOUBLE) AS b, hi FROM s, range(4) r(i))
SELECT market, variety, reported_date, CAST(fold AS INTEGER) AS fold, CASE WHEN day < a - 7 THEN 'train' ELSE 'val' END AS role
FROM t JOIN f ON day < a - 7 OR (day >= a AND (CASE WHEN fold < 3 THEN day < b ELSE day <= hi END))""")
def f02(spark, folder):
    return S.walk_forward_splits(A.observations(spark, folder)).select(*KEY, "fold", "role")


def _chrono_sql(frac):
    return f"""
SELECT market, variety, reported_date, CASE WHEN row_number() OVER {W} <=
  floor(count(*) OVER (PARTITION BY commodity, market, variety) * {frac}::DOUBLE) THEN 'train' ELSE 'val' END AS role FROM @obs@"""


@query("f03_per_series_chrono_split", _chrono_sql(0.8))
def f03(spark, folder):
    return S.per_series_chrono_split(A.observations(spark, folder), 0.2).select(*KEY, "role")


@query("f04_tail_val_split", f"""
WITH {_T}, c AS (SELECT quantile_cont(day::DOUBLE, 0.85) AS c FROM t)
SELECT market, variety, reported_date, CASE WHEN day >= c THEN 'val' WHEN day < c - 7 THEN 'fit' ELSE 'gap' END AS role
FROM t CROSS JOIN c""")
def f04(spark, folder):
    return S.tail_val_split(A.observations(spark, folder)).select(*KEY, "role")


@query("f04_tail_rows_split", f"""
WITH r AS (SELECT *, row_number() OVER {W} - 1 AS pos,
  floor(count(*) OVER (PARTITION BY commodity, market, variety) * 0.85::DOUBLE) AS start FROM @obs@)
SELECT market, variety, reported_date, CASE WHEN pos >= start THEN 'val' WHEN pos < start - 5 THEN 'fit' ELSE 'gap' END AS role FROM r""")
def f04r(spark, folder):
    return S.tail_rows_split(A.observations(spark, folder)).select(*KEY, "role")


@query("f05_quantile_cv", f"""
WITH {_T}, q AS (SELECT quantile_cont(day::DOUBLE, [0.4, 0.6, 0.8]) AS q FROM t)
SELECT market, variety, reported_date, fold, role FROM (
  SELECT t.*, CAST(i AS INTEGER) AS fold, CASE WHEN day < q[i + 1] THEN 'train' WHEN i = 2 OR day < q[i + 2] THEN 'val' END AS role
  FROM t CROSS JOIN q, range(3) r(i)) WHERE role IS NOT NULL""")
def f05(spark, folder):
    return S.quantile_cv(A.observations(spark, folder)).select(*KEY, "fold", "role")


@query("f06_purge_by_target_date", f"""
WITH {_forward_sql(14)},
j AS (SELECT o.*, target_date_14d FROM @obs@ o LEFT JOIN f14 USING (market, variety, reported_date))
SELECT market, count(*) AS n, count(*) FILTER (target_date_14d >= DATE '2000-01-01') AS purged,
  count(*) FILTER (reported_date > DATE '2000-01-01' - 17) AS purged_fallback FROM j GROUP BY market""")
def f06(spark, folder):
    df = L.forward_calendar_target(A.observations(spark, folder), 14)
    exact = S.purge_by_target_date(df, "2000-01-01", "target_date_14d", 14)
    both = S.purge_by_target_date(exact.withColumnRenamed("purged", "p1"), "2000-01-01", None, 14)
    return both.groupBy("market").agg(F.count("*").alias("n"), F.count_if("p1").alias("purged"),
                                      F.count_if("purged").alias("purged_fallback"))


@query("f07_purge_masks", f"""
WITH {_T}, m AS (SELECT *, reported_date < DATE '2000-01-01' AS b, coalesce(target_date >= DATE '2000-01-01', false) AS late FROM t)
SELECT market, variety, reported_date, b AND NOT late AS clean_train, NOT b AS is_eval, b AND late AS leaks FROM m""")
def f07(spark, folder):
    return S.purge_masks(targeted(spark, folder), "2000-01-01", "target_date").select(
        *KEY, "clean_train", "is_eval", "leaks")


PERIODS = [("A", "train", "1995-01-01", "1998-12-31"), ("A", "val", "1999-01-01", "1999-12-31"),
           ("B", "train", "1995-01-01", "1999-12-31"), ("B", "val", "2000-01-01", "2000-12-31"),
           ("holdout", "test", "2001-01-01", "2001-12-31")]
_PERIODS = ", ".join(f"('{a}', '{b}', DATE '{c}', DATE '{d}')" for a, b, c, d in PERIODS)


@query("f08_named_period_split", f"""
SELECT market, variety, fold, role, count(*) AS n FROM @obs@ JOIN (VALUES {_PERIODS}) p(fold, role, a, b)
  ON reported_date BETWEEN a AND b GROUP BY ALL""")
def f08(spark, folder):
    return S.named_period_split(A.observations(spark, folder), PERIODS).groupBy(
        "market", "variety", "fold", "role").agg(F.count("*").alias("n"))


@query("f09_year_split", """
SELECT district, season, year, CASE WHEN year <= 1998 THEN 'train' WHEN year <= 1999 THEN 'val' ELSE 'test' END AS role FROM @panel@""")
def f09(spark, folder):
    return S.year_split(A.yield_panel(spark, folder), 1998, 1999).select("district", "season", "year", "role")


@query("f09_rolling_origin_folds", """
SELECT district, season, year, CAST(v - 1996 AS INTEGER) AS fold, CASE WHEN year < v THEN 'train' ELSE 'val' END AS role
FROM @panel@ JOIN (SELECT unnest([1997, 1998, 1999, 2000, 2001]) AS v) ON year <= v""")
def f09r(spark, folder):
    return S.rolling_origin_folds(A.yield_panel(spark, folder), (1997, 1998, 1999, 2000, 2001), 1995).select(
        "district", "season", "year", "fold", "role")


@query("f09_fold_audit", """
WITH f AS (SELECT *, CAST(v - 1996 AS INTEGER) AS fold FROM @panel@ JOIN (SELECT unnest([1997, 1998, 1999, 2000, 2001]) AS v) ON year <= v)
SELECT fold, max(year) FILTER (year < v) AS train_last, min(year) FILTER (year = v) AS val_first,
  max(year) FILTER (year = v) AS val_last, count(*) FILTER (year < v) AS n_train, count(*) FILTER (year = v) AS n_val,
  true AS passed FROM f GROUP BY fold""")
def f09a(spark, folder):
    return S.fold_audit(S.rolling_origin_folds(A.yield_panel(spark, folder), (1997, 1998, 1999, 2000, 2001), 1995))


@query("f10_leakage_audit", f"""
WITH {_CUT},
a AS (SELECT max(reported_date) FILTER (role = 'train') AS a, min(reported_date) FILTER (role = 'test') AS b,
  max(target_date) FILTER (role = 'train') AS c FROM sp)
SELECT 'train_before_test' AS "check", a < b AS passed FROM a
UNION ALL SELECT 'no_train_target_in_test', c < b FROM a
UNION ALL SELECT 'both_sides_filled', a IS NOT NULL AND b IS NOT NULL FROM a
UNION ALL SELECT 'target_not_a_feature', false FROM a""")
def f10(spark, folder):
    return S.leakage_audit(split(spark, folder), "target_date", ["lag_1", "future_price"], "future_price")


@query("f11_lag_audit", f"""
WITH s AS (SELECT * FROM @panel@ WHERE NOT (district = 'NATION_4' AND year = 1998)),
l AS (SELECT *, {lag('yield_kg_ha', part='district, season', order='year')} AS yield_lag1 FROM s)
SELECT count(*) AS n_rows, count(*) FILTER (l.yield_lag1 IS NOT NULL AND b.district IS NOT NULL) AS compared,
  count(*) FILTER (abs(l.yield_lag1 - b.yield_kg_ha) > 0.000001) AS mismatches,
  count(*) FILTER (l.yield_lag1 IS NOT NULL AND b.district IS NULL) AS year_gaps
FROM l LEFT JOIN s b ON l.district = b.district AND l.season = b.season AND l.year = b.year + 1""")
def f11(spark, folder):
    panel = A.yield_panel(spark, folder).filter("NOT (district = 'NATION_4' AND year = 1998)")
    return S.lag_audit(panel.withColumn("yield_lag1", F.lag("yield_kg_ha").over(panel_window())))


@query("f12_group_overlap", f"""
WITH {_T}, g AS (SELECT market, variety, count(*) FILTER (reported_date < DATE '1995-01-20') AS tr,
  count(*) FILTER (reported_date >= DATE '1995-01-20') AS te FROM t GROUP BY ALL)
SELECT count(*) FILTER (tr > 0 AND te = 0) AS train_only, count(*) FILTER (te > 0 AND tr = 0) AS test_only,
  count(*) FILTER (te > 0 AND tr > 0) AS common, CAST(coalesce(sum(te) FILTER (tr = 0), 0) AS BIGINT) AS rows_in_test_only FROM g""")
def f12(spark, folder):
    role = F.when(F.col("reported_date") < "1995-01-20", "train").otherwise("test")
    return S.group_overlap(A.observations(spark, folder).withColumn("role", role))


@query("f13_backtest_origins", f"""
WITH r AS (SELECT *, row_number() OVER {W} AS rn, lead(reported_date) OVER {W} AS actual_date, lead({P}) OVER {W} AS actual_price,
    {FWD5} AS actual_range FROM @obs@),
o AS (SELECT * FROM r WHERE rn >= 30 AND actual_date - reported_date BETWEEN 1 AND 7 AND reported_date >= DATE '2000-06-01'
    AND actual_date <= DATE '2001-06-30'
  ORDER BY md5('42|rice|' || market || '|' || variety || '|' || strftime(reported_date, '%Y-%m-%d')) LIMIT 50)
SELECT o.commodity, o.market, o.variety, o.reported_date AS origin_date, o.actual_date, o.actual_price, o.actual_range,
  CAST(h.rn AS INTEGER) AS rn, h.reported_date AS history_date, h.{P} AS history_price
FROM o JOIN r h ON o.market = h.market AND o.variety = h.variety AND h.rn BETWEEN o.rn - 59 AND o.rn""")
def f13(spark, folder):
    return S.backtest_origins(A.observations(spark, folder), 50, "42", "2000-06-01", "2001-06-30")


@query("f14_seen_and_volume_flags", f"""
WITH {_T}, sp AS (SELECT *, CASE WHEN reported_date < DATE '1995-01-20' THEN 'train' ELSE 'test' END AS role FROM t),
big AS (SELECT market FROM (SELECT market, row_number() OVER (ORDER BY count(*) DESC, market) AS rank FROM sp WHERE role = 'test' GROUP BY market)
  WHERE rank <= greatest(1, floor((SELECT count(DISTINCT market) FROM sp WHERE role = 'test') * 0.2)))
SELECT market, variety, (market, variety) IN (SELECT (market, variety) FROM sp WHERE role = 'train') AS seen,
  market IN (SELECT market FROM big) AS high_volume, count(*) AS n FROM sp WHERE role = 'test' GROUP BY ALL""")
def f14(spark, folder):
    role = F.when(F.col("reported_date") < "1995-01-20", "train").otherwise("test")
    flags = S.seen_and_volume_flags(A.observations(spark, folder).withColumn("role", role))
    return flags.groupBy("market", "variety", "seen", "high_volume").agg(F.count("*").alias("n"))
