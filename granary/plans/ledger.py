"""Forecast ledger, delayed outcomes and monitoring."""

from pyspark.sql import functions as F

from granary.functions.scalars import yield_forecast_id
from granary.operators import features as T
from granary.operators import ledger as K
from granary.operators import metrics as M
from granary.operators import monitoring as O
from granary.plans.cleaning import _BATCH as BATCH_SQL
from granary.plans.cleaning import _spellings
from granary.plans.labels import P, c3
from granary.plans.metrics import MARKETS as _MARKETS
from granary.plans.metrics import boot_sql, reg_sql
from granary.plans.registry import W, days, lag, query, rows
from granary.schemas import OBS_KEY, SERIES
from granary.session import materialize
from granary.sources import adapters as A

E4 = "0.0001::DOUBLE"


def obs(spark, folder):
    return A.observations(spark, folder)


def stored_obs(spark, folder):
    """The observation table written once, for reports that read it several times."""
    return materialize(A.observations(spark, folder), "observations")


def _fid(model, origin="origin_date"):
    return (f"substr(sha256(lower(market) || '|' || lower(variety) || '|' || strftime({origin}, '%Y-%m-%d') || '|' || horizon || '|{model}'), 1, 16)")


def issue_sql(origins, source="@obs@", cohort="PROSPECTIVE"):
    dates = ", ".join(f"DATE '{o}'" for o in origins)
    return f"""
og AS (SELECT o.commodity, o.market, o.variety, g AS origin_date, count(*) AS history, max_by({P}, reported_date) AS origin_price
  FROM {source} o JOIN (SELECT unnest([{dates}]) AS g) ON reported_date <= g GROUP BY ALL HAVING count(*) >= 30),
issued AS (SELECT {_fid('persistence')} AS forecast_id, commodity, market, variety, origin_date, horizon, origin_price,
    origin_price AS predicted_price, CAST(origin_date + horizon AS DATE) AS window_start, CAST(origin_date + horizon + 3 AS DATE) AS window_end,
    '{cohort}' AS cohort, 'PENDING' AS status FROM (SELECT *, unnest([14, 30]) AS horizon FROM og))"""


@query("k01_generate_price_forecasts", f"""
WITH {issue_sql(['1999-06-30']).strip()}
SELECT * FROM issued WHERE forecast_id NOT IN (SELECT forecast_id FROM @ledger@)""")
def k01(spark, folder):
    return K.generate_price_forecasts(obs(spark, folder), ["1999-06-30"], existing=A.forecast_ledger(spark, folder))


_VOL_RANGE = f"""vh AS (SELECT o.*, count(*) FILTER ({P} > 0) OVER {days(-14, -1)} AS n, min({P}) OVER {days(-14, -1)} AS lo, max({P}) OVER {days(-14, -1)} AS hi
  FROM hist o),
vc AS (SELECT *, {c3(f"(CASE WHEN n >= 1 THEN (greatest(hi, {P}) - least(lo, {P})) / ({P} + {E4}) * 100 END)", 60, 150)} AS persistence_class FROM vh),
vs AS (SELECT *, row_number() OVER {W} AS history, count(persistence_class) OVER {rows(-29, 0)} AS known,
    {', '.join(f"count(*) FILTER (persistence_class = '{k}') OVER {rows(-29, 0)} AS n_{p}" for k, p in zip(M.CLASSES, M.PROBS))} FROM vc),
vp AS (SELECT *, n_p_low / known AS p_low, n_p_medium / known AS p_medium, n_p_high / known AS p_high FROM vs WHERE history >= 14 AND known > 0)"""


def vol_issue_sql(where):
    return f"""vf AS (SELECT sha256(commodity || '|' || lower(market) || '|' || lower(variety) || '|' || strftime(reported_date, '%Y-%m-%d') || '|14|class-share') AS forecast_id,
    commodity, market, variety, reported_date AS origin_date, 14 AS horizon, {P} AS origin_price, persistence_class,
    CASE WHEN p_low = greatest(p_low, p_medium, p_high) THEN 'LOW' WHEN p_medium = greatest(p_low, p_medium, p_high) THEN 'MEDIUM' ELSE 'HIGH' END AS predicted_class,
    p_low, p_medium, p_high, reported_date + 1 AS window_start, reported_date + 14 AS window_end, 'PROSPECTIVE' AS cohort, 'PENDING' AS status
  FROM vp WHERE {where})"""


@query("k02_generate_volatility_forecasts", f"""
WITH hist AS (SELECT commodity, market, variety, reported_date, CASE WHEN reported_date >= DATE '1999-06-25' THEN {P} + 100 ELSE {P} END AS {P}
  FROM @obs@ WHERE reported_date <= DATE '1999-06-30'),
{_VOL_RANGE},
{vol_issue_sql("reported_date = DATE '1999-06-30'")}
SELECT forecast_id, commodity, market, variety, origin_date, CAST(horizon AS INTEGER) AS horizon, origin_price, persistence_class, predicted_class,
  ~p_low AS p_low,
  ~p_medium AS p_medium,
  ~p_high AS p_high,
  CAST(window_start AS DATE) AS window_start, CAST(window_end AS DATE) AS window_end, cohort, status FROM vf""")
def k02(spark, folder):
    stored = obs(spark, folder)
    # the last days arrive again as a corrected batch
    batch = stored.filter("reported_date >= '1999-06-25'").withColumn(P, F.col(P) + 100)
    return K.generate_volatility_forecasts(batch, stored, "1999-06-30", 60.0, 150.0)


# outcomes are known up to this day; every fifth day arrives late
CUT = "2000-06-30"


def known(spark, folder):
    return obs(spark, folder).filter((F.col("reported_date") <= CUT) & (F.unix_date("reported_date") % 5 != 0))


def resolve_sql(ledger, source, closed, name, prior=None):
    """CTE with outcomes of a ledger relation against an observation relation."""
    return f"""{name}_m AS (SELECT l.forecast_id, min_by(o.{P}, o.reported_date) AS ap, min(o.reported_date) AS td
  FROM {ledger} l JOIN {source} o ON l.market = o.market AND l.variety = o.variety AND o.reported_date BETWEEN l.window_start AND l.window_end GROUP BY 1),
{name}_x AS (SELECT market, variety, max(reported_date) AS latest FROM {source} GROUP BY ALL),
{name} AS (SELECT l.* EXCLUDE (status), td AS target_date, ap AS actual_price, CAST(td - origin_date AS INTEGER) AS actual_offset,
    abs(ap - predicted_price) AS abs_error, abs(ap - predicted_price) / abs(ap) * 100 AS pct_error, abs(ap - origin_price) AS persistence_abs_error,
    abs(ap - origin_price) / abs(ap) * 100 AS persistence_pct_error,
    CASE WHEN td IS NOT NULL THEN 'EVALUATED' WHEN {closed} THEN 'TARGET_UNAVAILABLE' ELSE 'PENDING' END AS status
  FROM {ledger} l LEFT JOIN {name}_m m USING (forecast_id) LEFT JOIN {name}_x x ON l.market = x.market AND l.variety = x.variety)"""


KNOWN = f"known AS (SELECT * FROM @obs@ WHERE reported_date <= DATE '{CUT}' AND (reported_date - DATE '1970-01-01') % 5 <> 0)"
RES1 = resolve_sql("@ledger@", "known", "coalesce(latest > window_end, false)", "r1")
_RES_OUT = """  ~pct_error AS pct_error,
  ~persistence_pct_error AS persistence_pct_error"""
_RES_COLS = "forecast_id, origin_date, horizon, status, target_date, actual_price, actual_offset, abs_error, persistence_abs_error"


def resolved(spark, folder):
    return K.resolve_price_outcomes(A.forecast_ledger(spark, folder), known(spark, folder))


def _res(df):
    return df.select("forecast_id", "origin_date", "horizon", "status", "target_date", "actual_price", "actual_offset", "abs_error",
                     "persistence_abs_error", "pct_error", "persistence_pct_error", "reason")


@query("k03_resolve_price_outcomes", f"""
WITH {KNOWN},
{RES1}
SELECT {_RES_COLS}, CASE status WHEN 'EVALUATED' THEN 'observation in window' WHEN 'TARGET_UNAVAILABLE' THEN 'window closed without observation' END AS reason,
{_RES_OUT}
FROM r1""")
def k03(spark, folder):
    return _res(resolved(spark, folder))


@query("k03_recheck_unavailable", f"""
WITH {KNOWN},
{RES1},
full_obs AS (SELECT * FROM @obs@),
{resolve_sql('@ledger@', 'full_obs', 'coalesce(latest > window_end, false)', 'r2')}
SELECT r2.forecast_id, r2.origin_date, r2.horizon, CASE WHEN r1.status = 'EVALUATED' THEN r1.status ELSE r2.status END AS status,
  CASE WHEN r1.status = 'EVALUATED' THEN r1.target_date ELSE r2.target_date END AS target_date,
  CASE WHEN r1.status = 'EVALUATED' THEN r1.actual_price ELSE r2.actual_price END AS actual_price,
  CASE WHEN r1.status = 'EVALUATED' THEN 'observation in window' WHEN r2.status = 'EVALUATED' AND r1.status = 'TARGET_UNAVAILABLE' THEN 'late observation'
    WHEN r2.status = 'EVALUATED' THEN 'observation in window' WHEN r2.status = 'TARGET_UNAVAILABLE' THEN 'window closed without observation' END AS reason
FROM r1 JOIN r2 USING (forecast_id)""")
def k03r(spark, folder):
    again = K.resolve_price_outcomes(resolved(spark, folder), obs(spark, folder), recheck=True)
    return again.select("forecast_id", "origin_date", "horizon", "status", "target_date", "actual_price", "reason")


@query("k04_resolve_commodity_outcomes", f"""
WITH {KNOWN},
{resolve_sql('@ledger@', 'known', f"DATE '{CUT}' > window_end", 'r1')}
SELECT {_RES_COLS}, CASE status WHEN 'EVALUATED' THEN 'MATCHED_WINDOW_OBSERVATION' WHEN 'TARGET_UNAVAILABLE' THEN 'WINDOW_CLOSED_WITHOUT_OBSERVATION' END AS reason,
  actual_price - predicted_price AS residual, {c3(f'abs(actual_price - origin_price) / (origin_price + {E4}) * 100', 2, 6)} AS actual_class,
{_RES_OUT}
FROM r1""")
def k04(spark, folder):
    df = K.resolve_commodity_outcomes(A.forecast_ledger(spark, folder), known(spark, folder), CUT)
    return df.select(*_res(df).columns, "residual", "actual_class")


def vol_ledger(spark, folder):
    """Volatility forecasts at every row with 32 rows of history, from class shares as in a live run."""
    o = obs(spark, folder)
    w = T.series_window()
    from granary.functions.scalars import classify3
    from granary.functions.windows import trailing
    from granary.operators.labels import past_calendar_persistence
    # without a report in the past 14 days nothing moved
    r = past_calendar_persistence(o, 14).select(
        *OBS_KEY, P, F.coalesce(classify3(F.col("past_pct_range_14d"), 60.0, 150.0), F.lit("LOW")).alias("persistence_class"))
    share = lambda k: F.count_if(F.col("persistence_class") == k).over(trailing(w, 32)) / 32.0
    s = r.select("*", F.row_number().over(w).alias("rn"), *[share(k).alias(p) for k, p in zip(M.CLASSES, M.PROBS)])
    _, label = M.top1()
    return s.filter("rn >= 32").select(
        F.sha2(F.concat_ws("|", *OBS_KEY), 256).alias("forecast_id"), *SERIES, F.col("reported_date").alias("origin_date"),
        F.lit(14).alias("horizon"), F.col(P).alias("origin_price"), "persistence_class", label.alias("predicted_class"), *M.PROBS,
        F.date_add("reported_date", 1).alias("window_start"), F.date_add("reported_date", 14).alias("window_end"),
        F.lit("RETROSPECTIVE").alias("cohort"), F.lit("PENDING").alias("status"))


_SH = ", ".join(f"count(*) FILTER (persistence_class = '{k}') OVER {rows(-31, 0)} / 32 AS {p}" for k, p in zip(M.CLASSES, M.PROBS))
VOL_LEDGER = f"""hist AS (SELECT * FROM @obs@),
vh AS (SELECT o.*, count(*) OVER {days(-14, -1)} AS n, min({P}) OVER {days(-14, -1)} AS lo, max({P}) OVER {days(-14, -1)} AS hi FROM hist o),
vc AS (SELECT *, coalesce({c3(f"(CASE WHEN n >= 1 THEN (greatest(hi, {P}) - least(lo, {P})) / ({P} + {E4}) * 100 END)", 60, 150)}, 'LOW') AS persistence_class FROM vh),
vs AS (SELECT *, row_number() OVER {W} AS rn, {_SH} FROM vc),
vl AS (SELECT sha256(commodity || '|' || market || '|' || variety || '|' || strftime(reported_date, '%Y-%m-%d')) AS forecast_id, commodity, market, variety,
    reported_date AS origin_date, {P} AS origin_price, persistence_class, CASE WHEN p_low = greatest(p_low, p_medium, p_high) THEN 'LOW'
      WHEN p_medium = greatest(p_low, p_medium, p_high) THEN 'MEDIUM' ELSE 'HIGH' END AS predicted_class, p_low, p_medium, p_high,
    reported_date + 14 AS window_end FROM vs WHERE rn >= 32),
vm AS (SELECT l.forecast_id, count(*) AS n, min(o.{P}) AS lo, max(o.{P}) AS hi FROM vl l JOIN @obs@ o ON l.market = o.market AND l.variety = o.variety
    AND o.reported_date > l.origin_date AND o.reported_date <= l.window_end GROUP BY 1),
vr AS (SELECT l.*, CASE WHEN window_end > DATE '{CUT}' THEN 'PENDING' WHEN n > 0 THEN 'EVALUATED' ELSE 'WINDOW_EMPTY' END AS status,
    CASE WHEN window_end <= DATE '{CUT}' THEN coalesce(n, 0) END AS matched_trades,
    CASE WHEN window_end <= DATE '{CUT}' AND n > 0 THEN least(lo, origin_price) END AS actual_min,
    CASE WHEN window_end <= DATE '{CUT}' AND n > 0 THEN greatest(hi, origin_price) END AS actual_max FROM vl l LEFT JOIN vm USING (forecast_id)),
ve AS (SELECT *, (actual_max - actual_min) / (origin_price + {E4}) * 100 AS actual_pct_range FROM vr),
vz AS (SELECT *, {c3('actual_pct_range', 60, 150)} AS actual_class FROM ve)"""


def vol_resolved(spark, folder):
    return K.resolve_volatility_outcomes(vol_ledger(spark, folder), obs(spark, folder), CUT, 60.0, 150.0)


@query("k05_resolve_volatility_outcomes", f"""
WITH {VOL_LEDGER}
SELECT forecast_id, market, variety, origin_date, status, matched_trades, actual_min, actual_max, actual_class,
  ~actual_pct_range AS actual_pct_range
FROM vz""")
def k05(spark, folder):
    return vol_resolved(spark, folder).select("forecast_id", "market", "variety", "origin_date", "status", "matched_trades",
                                              "actual_min", "actual_max", "actual_class", "actual_pct_range")


@query("k06_ledger_status", f"""
WITH {KNOWN},
{RES1}
SELECT status, horizon, cohort, count(*) AS n, max(origin_date) AS latest_origin, CAST(grouping_id(status, horizon, cohort) AS BIGINT) AS level
FROM r1 GROUP BY CUBE (status, horizon, cohort)""")
def k06(spark, folder):
    return K.ledger_status(resolved(spark, folder))


_Y = "(CASE WHEN status = 'EVALUATED' THEN actual_price END)"
_D = "(CASE WHEN status = 'EVALUATED' THEN abs_error - persistence_abs_error END)"
_HALF = f"1.96 * stddev_samp({_D}) / sqrt(count({_D}))"


def shifted(df):
    """A model that is not persistence: 90 % of the origin price plus 200."""
    return df.withColumn("predicted_price", F.floor(F.col("origin_price") * 0.875 + 200))


def shifted_resolved(spark, folder):
    return K.resolve_price_outcomes(shifted(A.forecast_ledger(spark, folder)), known(spark, folder))


SHIFTED = f"sl AS (SELECT * REPLACE (floor(origin_price * 0.875 + 200) AS predicted_price) FROM @ledger@),\n" + resolve_sql(
    "sl", "known", "coalesce(latest > window_end, false)", "r1")


@query("k07_price_shadow_metrics", f"""
WITH {KNOWN},
{SHIFTED}
SELECT horizon, cohort, count(*) AS total, count(*) FILTER (status = 'EVALUATED') AS evaluated, count(*) FILTER (status = 'PENDING') AS pending,
  count(*) FILTER (status = 'TARGET_UNAVAILABLE') AS unavailable, CASE WHEN avg({_D}) <= 0 THEN 'PASSES_BENCHMARK' WHEN avg({_D}) > 0 THEN 'EXPERIMENTAL_DEFICIT_CONFIRMED' END AS gate,
{reg_sql(_Y, 'predicted_price', with_n=False)},
{reg_sql(_Y, 'origin_price', '_persistence', with_n=False)},
  ~avg({_D}) AS mae_delta,
  ~CASE WHEN count({_D}) >= 10 THEN avg({_D}) - {_HALF} END AS mae_delta_low,
  ~CASE WHEN count({_D}) >= 10 THEN avg({_D}) + {_HALF} END AS mae_delta_high,
  ~count(*) FILTER (status = 'EVALUATED' AND abs_error <= persistence_abs_error) / count(*) FILTER (status = 'EVALUATED') * 100 AS win_rate_pct
FROM r1 GROUP BY horizon, cohort""")
def k07(spark, folder):
    return K.price_shadow_metrics(shifted_resolved(spark, folder))


@query("k07_offset_distribution", f"""
WITH {KNOWN},
{RES1}
SELECT horizon, actual_offset, count(*) AS n FROM r1 WHERE status = 'EVALUATED' GROUP BY ALL""")
def k07o(spark, folder):
    return K.offset_distribution(resolved(spark, folder))


_C = "c AS (SELECT market, actual_class AS y, predicted_class AS pred, persistence_class AS base, p_low, p_medium, p_high, origin_date, window_end FROM vz WHERE status = 'EVALUATED')"


def _pooled(p, name):
    return f"""{name} AS (SELECT sum(t) / sum(a) AS accuracy, avg(coalesce(2 * t / nullif(a + q, 0), 0)) AS macro_f1, max(coalesce(t / nullif(a, 0), 0)) FILTER (l = 'HIGH') AS high_recall
  FROM (SELECT l, count(*) FILTER (y = l) AS a, count(*) FILTER ({p} = l) AS q, count(*) FILTER (y = l AND {p} = l) AS t FROM c CROSS JOIN (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(l) GROUP BY l))"""


_HITS = [(k, p, f"(CASE WHEN y = '{k}' THEN 1.0::DOUBLE ELSE 0 END)") for k, p in zip(M.CLASSES, M.PROBS)]
_LG = " UNION ALL ".join(f"SELECT '{k}' AS label, {p} AS p, {h} AS hit FROM c" for k, p, h in _HITS)


@query("k08_volatility_shadow_metrics", f"""
WITH {VOL_LEDGER},
{_C},
{_pooled('pred', 'pm')},
{_pooled('base', 'pb')},
lg AS ({_LG}),
ec AS (SELECT label, sum(abs(ob - mp) * n) / sum(n) AS e FROM (SELECT label, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(hit) AS ob FROM lg GROUP BY ALL) GROUP BY label),
{_MARKETS.replace('ml.n >= 20', 'ml.n >= 10')},
cl AS (SELECT market AS k, delta_macro_f1 AS s, 1.0::DOUBLE AS n FROM mt),
{boot_sql('cl', ('s', 'n'), M.DELTA_REPLICATES)},
bt AS (SELECT (SELECT avg(s) FROM cl) AS mean_delta, quantile_cont(s / n, 0.025) AS ci_low, quantile_cont(s / n, 0.975) AS ci_high FROM rp),
z AS (SELECT (SELECT count(*) FROM c) AS forecasts, (SELECT CAST(max(window_end) - min(origin_date) AS INTEGER) FROM c) AS days, (SELECT count(DISTINCT market) FROM c) AS markets,
    pm.accuracy, pm.macro_f1, pb.accuracy AS persistence_accuracy, pb.macro_f1 AS persistence_macro_f1, pm.high_recall,
    (SELECT avg({' + '.join(f'power({p} - {h}, 2)' for _, p, h in _HITS)}) FROM c) AS brier, (SELECT avg(e) FROM ec) AS macro_ece,
    (SELECT count(*) FILTER (outcome = 'win') / count(*) * 100 FROM mt) AS win_rate_pct, mean_delta, ci_low, ci_high FROM pm CROSS JOIN pb CROSS JOIN bt),
g AS (SELECT *, days >= 90 AS days_ok, forecasts >= 2000 AS forecasts_ok, markets >= 35 AS markets_ok, macro_ece <= 0.05 AS ece_ok, win_rate_pct >= 50 AS win_rate_ok,
    ci_low > -0.02 AND mean_delta >= 0 AS non_inferior FROM z)
SELECT forecasts, days, markets, days_ok, forecasts_ok, markets_ok, ece_ok, win_rate_ok, non_inferior,
  CASE WHEN days_ok AND forecasts_ok AND markets_ok AND ece_ok AND win_rate_ok AND non_inferior THEN 'READY_FOR_GOVERNANCE_REVIEW' ELSE 'CONTINUE_SHADOW_MONITORING' END AS verdict,
  ~accuracy AS accuracy,
  ~macro_f1 AS macro_f1,
  ~persistence_accuracy AS persistence_accuracy,
  ~persistence_macro_f1 AS persistence_macro_f1,
  ~high_recall AS high_recall,
  ~brier AS brier,
  ~macro_ece AS macro_ece,
  ~win_rate_pct AS win_rate_pct,
  ~mean_delta AS mean_delta,
  ~ci_low AS ci_low,
  ~ci_high AS ci_high
FROM g""")
def k08(spark, folder):
    # several reports read the evaluated ledger
    return K.volatility_shadow_metrics(materialize(vol_resolved(spark, folder), "volatility-ledger"), min_obs=10)


@query("k09_freshness", """
WITH b AS (SELECT market, max(reported_date) AS latest_date, CAST(DATE '2001-11-10' - max(reported_date) AS INTEGER) AS lag_days FROM @obs@
  WHERE reported_date <= CASE WHEN market < 'NATION_2' THEN DATE '2001-10-20' ELSE DATE '2001-11-30' END GROUP BY market)
SELECT market, latest_date, lag_days, lag_days > 14 AS is_stale FROM b""")
def k09(spark, folder):
    late = obs(spark, folder).filter(
        "reported_date <= CASE WHEN market < 'NATION_2' THEN DATE'2001-10-20' ELSE DATE'2001-11-30' END")
    return O.freshness(late, "2001-11-10", by=["market"])


@query("k10_drift_mean_2sd", f"""
WITH b AS (SELECT CASE variety WHEN 'A' THEN 'rice' WHEN 'N' THEN 'wheat' ELSE 'tea' END AS commodity, {P} FROM @obs@ WHERE reported_date >= DATE '2001-06-01'),
s AS (SELECT commodity, count(*) AS n, avg({P}) AS mean, stddev_samp({P}) AS std, quantile_cont({P}, 0.5) AS median, quantile_cont({P}, 0.75) - quantile_cont({P}, 0.25) AS iqr FROM b GROUP BY 1),
l AS (SELECT * FROM (VALUES ('rice', 2420.50, 620.30), ('wheat', 1587.78, 435.60), ('tea', 13739.68, 5273.01)) v(commodity, m, sd))
SELECT commodity, n, abs(mean - m::DOUBLE) > 2 * sd::DOUBLE AS drift,
  ~mean AS mean,
  ~std AS std,
  ~median AS median,
  ~iqr AS iqr,
  ~mean - m::DOUBLE AS mean_delta
FROM s JOIN l USING (commodity)""")
def k10(spark, folder):
    batch = obs(spark, folder).filter("reported_date >= '2001-06-01'").withColumn(
        "commodity", F.expr("CASE variety WHEN 'A' THEN 'rice' WHEN 'N' THEN 'wheat' ELSE 'tea' END"))
    return O.drift_mean_2sd(batch, O.commodity_baselines(spark))


def _drift_inputs(spark, folder):
    o = stored_obs(spark, folder)
    train, batch = o.filter("reported_date < '2000-01-01'"), o.filter("reported_date >= '2001-06-01'")
    # the batch of one market is shifted
    batch = batch.withColumn(P, F.when(F.col("market") == "NATION_5", F.col(P) * 2).otherwise(F.col(P)))
    return train, batch


_DRIFT = f"""tr AS (SELECT * FROM @obs@ WHERE reported_date < DATE '2000-01-01'),
bt AS (SELECT * REPLACE (CASE WHEN market = 'NATION_5' THEN {P} * 2 ELSE {P} END AS {P}) FROM @obs@ WHERE reported_date >= DATE '2001-06-01'),
gs AS ({' UNION ALL '.join(f"SELECT '{c}' AS kind, b.{c} AS value, n, bm, tm, (bm - tm) / tm * 100 AS pct_shift FROM (SELECT {c}, count(*) AS n, quantile_cont({P}, 0.5) AS bm FROM bt GROUP BY 1 HAVING count(*) >= 5) b JOIN (SELECT {c}, quantile_cont({P}, 0.5) AS tm FROM tr GROUP BY 1) t ON b.{c} = t.{c}" for c in ('variety', 'market'))})"""


@query("k11_group_shifts", f"""
WITH {_DRIFT}
SELECT kind, value, n, abs(pct_shift) > 35 AS drift,
  ~bm AS batch_median,
  ~tm AS baseline_median,
  ~pct_shift AS pct_shift
FROM gs""")
def k11(spark, folder):
    train, batch = _drift_inputs(spark, folder)
    both = [O.group_shifts(batch, O.learned_baselines(train, [c]), c) for c in ("variety", "market")]
    return both[0].unionByName(both[1])


@query("k11_drift_group_aware", f"""
WITH {_DRIFT},
s AS (SELECT count(*) AS n, avg({P}) AS mean, stddev_pop({P}) AS std, quantile_cont({P}, 0.5) AS median FROM bt),
b AS (SELECT quantile_cont({P}, 0.5) AS bm, stddev_pop({P}) AS bs FROM tr),
r AS (SELECT s.*, (median - bm) / bm * 100 AS median_pct_shift, std / bs AS std_ratio, (SELECT count(*) FROM gs WHERE kind = 'variety') AS varieties_checked,
    (SELECT count(*) FROM gs WHERE kind = 'market') AS markets_checked, (SELECT count(*) FROM gs WHERE abs(pct_shift) > 35) AS anomalies,
    (SELECT max(abs(pct_shift)) FROM gs WHERE kind = 'variety') AS worst FROM s CROSS JOIN b),
f AS (SELECT *, abs(median_pct_shift) > 35 OR std_ratio > 2 AS raw FROM r)
SELECT n, varieties_checked, markets_checked, anomalies, raw AND anomalies = 0 AND worst <= 25 AS composition_shift_only,
  NOT (raw AND anomalies = 0 AND worst <= 25) AND (anomalies > 0 OR raw) AS drift_detected,
  CASE WHEN raw AND anomalies = 0 AND worst <= 25 THEN 'composition' WHEN anomalies > 0 THEN 'group_drift' WHEN raw THEN 'global_drift' ELSE 'nominal' END AS verdict,
  ~mean AS mean,
  ~std AS std,
  ~median AS median,
  ~median_pct_shift AS median_pct_shift,
  ~std_ratio AS std_ratio
FROM f""")
def k11g(spark, folder):
    train, batch = _drift_inputs(spark, folder)
    overall = O.learned_baselines(train, ["commodity"])
    return O.drift_group_aware(batch, overall, O.learned_baselines(train, ["variety"]), O.learned_baselines(train, ["market"]))


AS_OF = "2000-06-30"


def daily_run(spark, folder):
    stored = stored_obs(spark, folder).filter("reported_date < '2000-06-01'").select(*OBS_KEY, P, "arrivals")
    raw = A.raw_observations(spark, folder)
    from granary.functions.scalars import parse_dates
    d = parse_dates(F.col("reported_date"))
    raw = raw.filter((d >= "2000-06-01") & (d <= "2000-06-28"))
    ledger = A.forecast_ledger(spark, folder).filter("origin_date < '2000-06-01'")
    markets, varieties = _spellings(spark, folder)
    return O.daily_prospective_run(raw, stored, ledger, AS_OF, O.commodity_baselines(spark), markets=markets, varieties=varieties)


_DAILY = f"""
{BATCH_SQL.strip()},
bat AS (SELECT * FROM final WHERE reported_date BETWEEN DATE '2000-06-01' AND DATE '2000-06-28'),
mg AS (SELECT commodity, market, variety, reported_date, {P} FROM @obs@ WHERE reported_date < DATE '2000-06-01'
  UNION ALL SELECT commodity, market, variety, reported_date, {P} FROM bat),
{issue_sql(['2000-06-30'], 'mg').strip()},
ld AS (SELECT * FROM @ledger@ WHERE origin_date < DATE '2000-06-01'),
{resolve_sql('ld', 'mg', 'coalesce(latest > window_end, false)', 'r1')}"""


@query("k12_daily_run_audit", f"""
WITH {_DAILY.strip()}
SELECT DATE '2000-06-30' AS run_date, 'OK' AS status, (SELECT max(reported_date) FROM bat) AS latest_date, 2 AS lag_days, false AS is_stale,
  (SELECT count(*) FROM bat) AS accepted, (SELECT abs(avg({P}) - 2420.5) > 1240.6 FROM bat) AS drift, (SELECT count(*) FROM issued) AS forecasts_issued,
  (SELECT count(*) FROM r1 WHERE status = 'EVALUATED') AS evaluated, (SELECT count(*) FROM r1 WHERE status = 'PENDING') AS pending""")
def k12(spark, folder):
    return daily_run(spark, folder)["audit"]


@query("k12_daily_run_ledger", f"""
WITH {_DAILY.strip()}
SELECT forecast_id, market, variety, origin_date, horizon, status, actual_price FROM r1
UNION ALL SELECT forecast_id, market, variety, origin_date, horizon, status, NULL FROM issued""")
def k12l(spark, folder):
    return daily_run(spark, folder)["ledger"].select(
        "forecast_id", "market", "variety", "origin_date", "horizon", "status", "actual_price")


def yield_ledger(spark, folder):
    """Forecasts of the district's yearly yield: last year's value with a 20 % band."""
    yearly = A.yield_panel(spark, folder).groupBy("district", "year").agg(
        F.floor(F.floor(F.sum("production") * 1000 + 0.5) / F.sum("area")).cast("double").alias("actual_kg_ha"))
    last = yearly.select("district", (F.col("year") + 1).alias("year"), F.col("actual_kg_ha").alias("predicted_kg_ha"))
    ledger = last.select(
        yield_forecast_id(F.lit("rice"), F.col("district"), F.col("year"), F.lit("v1")).alias("forecast_id"),
        F.lit("rice").alias("crop"), "district", "year", "predicted_kg_ha",
        F.when(F.col("year") % 2 == 0, F.col("predicted_kg_ha") - 8192).alias("p10_kg_ha"),
        (F.col("predicted_kg_ha") + 8192).alias("p90_kg_ha"), F.lit("PENDING").alias("status"))
    return ledger, yearly.withColumn("crop", F.lit("rice"))


_YL = """yr AS (SELECT district, year, floor(floor(sum(production) * 1000 + 0.5) / sum(area)) AS actual FROM @panel@ GROUP BY ALL),
yl AS (SELECT 'rice_' || lower(p.district) || '_' || (p.year + 1) || '_' || substr(sha256('rice|' || lower(p.district) || '|' || (p.year + 1) || '|v1'), 1, 12) AS forecast_id,
    'rice' AS crop, p.district, CAST(p.year + 1 AS INTEGER) AS year, p.actual AS predicted, CASE WHEN (p.year + 1) % 2 = 0 THEN p.actual - 8192 END AS p10, p.actual + 8192 AS p90,
    a.actual AS act FROM yr p LEFT JOIN yr a ON a.district = p.district AND a.year = p.year + 1)"""


@query("k13_yield_ledger_reconcile", f"""
WITH {_YL}
SELECT forecast_id, crop, district, year, predicted AS predicted_kg_ha, p10 AS p10_kg_ha, p90 AS p90_kg_ha, act AS actual_kg_ha,
  CASE WHEN act > 0 THEN 'EVALUATED' ELSE 'PENDING' END AS status FROM yl""")
def k13(spark, folder):
    return K.yield_ledger_reconcile(*yield_ledger(spark, folder))


@query("k13_yield_ledger_metrics", f"""
WITH {_YL}
SELECT year, count(*) AS evaluated, count(p10) AS valid_intervals,
  ~avg(abs(predicted - act)) AS mae,
  ~sqrt(avg((predicted - act) * (predicted - act))) AS rmse,
  ~avg(predicted - act) AS bias,
  ~coalesce(count(*) FILTER (act BETWEEN p10 AND p90) / nullif(count(p10), 0) * 100, 0) AS coverage_pct
FROM yl WHERE act > 0 GROUP BY year""")
def k13m(spark, folder):
    return K.yield_ledger_metrics(K.yield_ledger_reconcile(*yield_ledger(spark, folder)), ["year"])


@query("k14_service_health_rollup", """
WITH e AS (SELECT event_id, ts, value AS latency, event_type <> 'error' AS ok, event_type IN ('purchase', 'signup', 'error') AS is_ingest,
  'svc' || (user_id % 4) AS service FROM events),
l AS (SELECT service, list_sort(list(latency)) AS a FROM (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) AS rn FROM e WHERE ok) WHERE rn <= 1000 GROUP BY 1),
w AS (SELECT service, list_sort(list(latency)) AS b FROM e WHERE ok GROUP BY 1),
r AS (SELECT service, count(*) AS total, count(*) FILTER (NOT ok) AS errors, count(*) FILTER (is_ingest) AS ing, count(*) FILTER (is_ingest AND ok) AS ing_ok FROM e GROUP BY 1)
SELECT service, total, errors, CAST(len(a) AS INTEGER) AS latencies, CASE WHEN errors / total * 100 > 20 THEN 'degraded' ELSE 'healthy' END AS health,
  ~errors / total * 100 AS error_rate_pct,
  ~ing_ok / ing * 100 AS ingestion_success_pct,
  ~a[CAST(floor(len(a) * 0.5) AS BIGINT) + 1] AS p50,
  ~a[CAST(least(floor(len(a) * 0.95), len(a) - 1) AS BIGINT) + 1] AS p95,
  CAST(len(b) AS BIGINT) AS latencies_period,
  ~b[CAST(floor(len(b) * 0.5) AS BIGINT) + 1] AS p50_period,
  ~b[CAST(least(floor(len(b) * 0.95), len(b) - 1) AS BIGINT) + 1] AS p95_period
FROM r JOIN l USING (service) JOIN w USING (service)""")
def k14(spark, folder):
    e = A.service_events(spark, folder).select(
        "event_id", "ts", F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok"),
        F.col("event_type").isin("purchase", "signup", "error").alias("is_ingest"),
        F.concat(F.lit("svc"), (F.col("user_id") % 4).cast("string")).alias("service"))
    return O.service_health_rollup(e)


ORIGINS = [f"{y}-{m:02d}-15" for y in (1997, 1998, 1999) for m in (2, 5, 8, 11)]


@query("k15_replay_origins", f"""
WITH {issue_sql(ORIGINS, cohort='RETROSPECTIVE').strip()},
all_obs AS (SELECT * FROM @obs@),
{resolve_sql('issued', 'all_obs', 'coalesce(latest > window_end, false)', 'r1')}
SELECT origin_date, horizon, status, count(*) AS n, 0::BIGINT AS new_on_rerun,
  ~avg(abs_error) AS mae
FROM r1 GROUP BY ALL""")
def k15(spark, folder):
    o = stored_obs(spark, folder)
    first = K.replay_origins(o, ORIGINS)
    again = K.replay_origins(o, ORIGINS, existing=first)
    done = K.resolve_price_outcomes(first, o)
    return done.groupBy("origin_date", "horizon", "status").agg(
        F.count("*").alias("n"), F.avg("abs_error").alias("mae")).withColumn(
        "new_on_rerun", again.agg(F.count("*")).scalar())
