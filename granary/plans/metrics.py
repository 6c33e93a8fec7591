"""Metric and statistics operators."""

from pyspark.sql import functions as F

from granary.functions.scalars import classify3
from granary.functions.windows import full, series_window, trailing
from granary.operators import features as T
from granary.operators import labels as L
from granary.operators import metrics as M
from granary.operators import panel as N
from granary.operators import splits as S
from granary.plans.labels import FWD5, KEY, NEXT, P, _PAST5, c3
from granary.plans.panel import PK
from granary.plans.registry import W, lag, query, rows
from granary.sources import adapters as A

# --- scored forecasts: y next price, model the mean of the last two prices, current the persistence


def scored(spark, folder):
    w = series_window()
    obs = A.observations(spark, folder).withColumn("before", F.lag(P).over(w))
    return L.next_obs_target(obs).filter("before IS NOT NULL").select(
        *T.SERIES, "reported_date", "days_to_next", F.col("future_price").alias("y"), F.col(P).alias("current"),
        ((F.col(P) + F.col("before")) / 2).alias("model"))


SCORED = f"""{NEXT},
s AS (SELECT commodity, market, variety, reported_date, days_to_next, future_price AS y, {P} AS current, ({P} + before) / 2 AS model
  FROM (SELECT *, lag({P}) OVER {W} AS before FROM nx) WHERE days_to_next BETWEEN 1 AND 7 AND before IS NOT NULL)"""


def reg_sql(y, p, suffix="", tol=25, with_n=True):
    e = f"abs({y} - ({p}))"
    out = f"  count({e}) AS n{suffix},\n" if with_n else ""
    return out + f"""  ~avg({e}) AS mae{suffix},
  ~sqrt(avg({e} * {e})) AS rmse{suffix},
  ~CASE WHEN count({e}) >= 2 AND var_pop({y}) > 0 THEN 1 - sum({e} * {e}) / (var_pop({y}) * count({e})) END AS r2{suffix},
  ~avg(CASE WHEN {y} <> 0 THEN {e} / abs({y}) END) * 100 AS mape{suffix},
  ~100 - avg(CASE WHEN {y} <> 0 THEN {e} / abs({y}) END) * 100 AS mape_accuracy{suffix},
  ~count(*) FILTER ({e} <= {tol}) / count({e}) * 100 AS within_tolerance_pct{suffix}"""


@query("i01_regression_metrics", f"""
WITH {SCORED}
SELECT variety,
{reg_sql('y', 'model', tol=500)}
FROM s GROUP BY variety""")
def i01(spark, folder):
    return M.regression_metrics(scored(spark, folder), "y", "model", ["variety"], 500.0)


@query("i02_bias_medae_maxae", f"""
WITH {SCORED}
SELECT market, count(*) AS n, max(abs(model - y)) AS max_ae,
  ~avg(model - y) AS bias,
  ~quantile_cont(abs(model - y), 0.5) AS median_ae
FROM s GROUP BY market""")
def i02(spark, folder):
    return M.bias_medae_maxae(scored(spark, folder), "y", "model", ["market"])


@query("i03_metrics_by_horizon", f"""
WITH {SCORED}
SELECT days_to_next,
{reg_sql('y', 'model')},
{reg_sql('y', 'current', '_baseline', with_n=False)}
FROM s GROUP BY ROLLUP (days_to_next)""")
def i03(spark, folder):
    return M.metrics_by_horizon(scored(spark, folder), "days_to_next", "y", "model", "current")


_GROUPS = ("market", "variety", "year")
_GROUP_SQL = "\nUNION ALL ".join(f"""SELECT '{g}' AS group_kind, CAST({g} AS VARCHAR) AS group_value, count(*) AS n,
  ~avg(abs(y - model)) AS mae,
  ~sqrt(avg((y - model) * (y - model))) AS rmse,
  ~avg(abs(y - current)) AS mae_baseline,
  ~sqrt(avg((y - current) * (y - current))) AS rmse_baseline,
  ~avg(abs(y - model)) - avg(abs(y - current)) AS mae_delta
FROM sy GROUP BY 2 HAVING count(*) >= 1000""" for g in _GROUPS)


@query("i04_metrics_by_group", f"""
WITH {SCORED}, sy AS (SELECT *, year(reported_date) AS year FROM s)
{_GROUP_SQL}""")
def i04(spark, folder):
    df = scored(spark, folder).withColumn("year", F.year("reported_date"))
    return M.metrics_by_group(df, "y", "model", "current", _GROUPS, 1000)


@query("i05_movement_flat_subsets", f"""
WITH {SCORED}, f AS (SELECT *, CASE WHEN abs(floor(y / 500) - floor(current / 500)) <= 0.00001 THEN 'flat' ELSE 'moving' END AS subset,
  abs(floor(y / 500) - floor(model / 500)) AS e, abs(floor(y / 500) - floor(current / 500)) AS b FROM s)
SELECT variety, subset, count(*) AS n,
  ~avg(e) AS model_mae,
  ~avg(b) AS persistence_mae,
  ~sqrt(avg(e * e)) AS model_rmse,
  ~sqrt(avg(b * b)) AS persistence_rmse,
  ~count(*) / sum(count(*)) OVER (PARTITION BY variety) * 100 AS share_pct
FROM f GROUP BY variety, subset""")
def i05(spark, folder):
    coarse = {c: F.floor(F.col(c) / 500).cast("double") for c in ("y", "current", "model")}
    return M.movement_flat_subsets(scored(spark, folder).withColumns(coarse), "y", "model", "current", ["variety"])


@query("i06_directional_accuracy", f"""
WITH {SCORED}
SELECT variety, count(*) AS n,
  ~count(*) FILTER (sign(y - current) = sign(model - current)) / count(*) * 100 AS directional_accuracy_pct,
  ~1 - sum((y - model) * (y - model)) / (var_pop(y - current) * count(*)) AS r2_change,
  ~avg(abs(y - current)) AS naive_mae
FROM s GROUP BY variety""")
def i06(spark, folder):
    return M.directional_accuracy(scored(spark, folder), "y", "model", "current", ["variety"])


def _ci(name, e):
    half = f"1.96 * stddev_samp({e}) / sqrt(count(*))"
    return f"""  ~avg({e}) AS mae_{name},
  ~CASE WHEN count(*) >= 10 THEN avg({e}) - {half} END AS {name}_low,
  ~CASE WHEN count(*) >= 10 THEN avg({e}) + {half} END AS {name}_high"""


@query("i07_mae_confidence_interval", f"""
WITH {SCORED}
SELECT market, days_to_next, count(*) AS n,
{_ci('model', 'abs(y - model)')},
{_ci('baseline', 'abs(y - current)')},
{_ci('delta', 'abs(y - model) - abs(y - current)')},
  ~quantile_cont(abs(y - model), 0.5) AS p50_error,
  ~quantile_cont(abs(y - model), 0.9) AS p90_error
FROM s GROUP BY ALL""")
def i07(spark, folder):
    return M.mae_confidence_interval(scored(spark, folder), "y", "model", "current", ["market", "days_to_next"])


# --- classified rows: y class of the next five, pred of the last five, base of the five before,
# --- probabilities the class shares of pred over the last eight rows (multiples of 1/8)

BOUNDS = (2000.0, 5000.0)


def classified(spark, folder):
    w = series_window()
    f5 = trailing(w, 5)
    spread = full(F.max(P), F.col(P), f5, 5) - F.min(P).over(f5)
    df = A.observations(spark, folder).select(
        *T.SERIES, "reported_date", classify3(L.forward_obs_range(5), *BOUNDS).alias("y"),
        classify3(spread, *BOUNDS).alias("pred"))
    f8 = trailing(w, 8)
    share = lambda k: F.when(F.count("pred").over(f8) == 8, F.count_if(F.col("pred") == k).over(f8) / 8.0)
    out = df.select("*", F.lag("pred", 5).over(w).alias("base"),
                    *[share(k).alias(p) for k, p in zip(M.CLASSES, M.PROBS)])
    return out.filter("y IS NOT NULL AND base IS NOT NULL AND p_low IS NOT NULL")


CLASSIFIED = f"""c0 AS (SELECT *, {c3('r', 2000, 5000)} AS y, {c3('q', 2000, 5000)} AS pred
  FROM (SELECT *, {FWD5} AS r, {_PAST5} AS q FROM @obs@)),
c AS (SELECT * FROM (SELECT commodity, market, variety, reported_date, y, pred, lag(pred, 5) OVER {W} AS base,
    count(pred) OVER {rows(-7, 0)} AS c8, {', '.join(f"count(*) FILTER (pred = '{k}') OVER {rows(-7, 0)} / 8 AS {p}" for k, p in zip(M.CLASSES, M.PROBS))}
  FROM c0) WHERE y IS NOT NULL AND base IS NOT NULL AND c8 = 8)"""

_PAIRS = ", ".join(f"('{a}', '{b}')" for a in M.CLASSES for b in M.CLASSES)


@query("i08_confusion_matrix", f"""
WITH {CLASSIFIED}, n AS (SELECT variety, y, pred, count(*) AS n FROM c GROUP BY ALL)
SELECT v.variety, a AS actual, p AS predicted, coalesce(n, 0) AS n
FROM (SELECT DISTINCT variety FROM c) v CROSS JOIN (VALUES {_PAIRS}) l(a, p) LEFT JOIN n ON n.variety = v.variety AND n.y = a AND n.pred = p""")
def i08(spark, folder):
    return M.confusion_matrix(classified(spark, folder), "y", "pred", ["variety"])


def cls_sql(source, y, p, by):
    """CTEs with per-key precision, recall and F1 from label counts."""
    lab = ", ".join(f"('{k}')" for k in M.CLASSES)
    return f"""lc AS (SELECT {by}, l, count(*) FILTER ({y} = l) AS a, count(*) FILTER ({p} = l) AS q,
    count(*) FILTER ({y} = l AND {p} = l) AS t FROM {source} CROSS JOIN (VALUES {lab}) v(l) GROUP BY ALL),
pl AS (SELECT *, coalesce(t / nullif(q, 0), 0) AS pr, coalesce(t / nullif(a, 0), 0) AS re, coalesce(2 * t / nullif(a + q, 0), 0) AS f1 FROM lc)"""


def _cls_out():
    out = []
    for k in M.CLASSES:
        for m, c in (("precision", "pr"), ("recall", "re"), ("f1", "f1")):
            out.append(f"  ~max({c}) FILTER (l = '{k}') AS {k.lower()}_{m},")
    return "\n".join(out)


@query("i09_classification_metrics", f"""
WITH {CLASSIFIED},
{cls_sql('c', 'y', 'pred', 'variety')},
hl AS (SELECT variety, count(*) FILTER (y = 'HIGH' AND pred = 'LOW') AS high_to_low, count(*) FILTER (y = 'LOW' AND pred = 'HIGH') AS low_to_high FROM c GROUP BY variety)
SELECT variety, CAST(sum(a) AS BIGINT) AS n, any_value(high_to_low) AS high_to_low, any_value(low_to_high) AS low_to_high,
  max(a) FILTER (l = 'LOW') AS low_support, max(a) FILTER (l = 'MEDIUM') AS medium_support, max(a) FILTER (l = 'HIGH') AS high_support,
{_cls_out()}
  ~sum(t) / sum(a) AS accuracy,
  ~sum(re) / count(*) FILTER (a > 0) AS balanced_accuracy,
  ~avg(f1) AS macro_f1,
  ~sum(f1 * a) / sum(a) AS weighted_f1,
  ~coalesce((sum(t)::DOUBLE * sum(a) - sum(q::DOUBLE * a)) / nullif(sqrt((sum(a)::DOUBLE * sum(a) - sum(q::DOUBLE * q)) * (sum(a)::DOUBLE * sum(a) - sum(a::DOUBLE * a))), 0), 0) AS mcc,
  ~max(q - t) FILTER (l = 'HIGH') / greatest(max(q) FILTER (l = 'HIGH'), 1) AS high_false_alarm_rate
FROM pl JOIN hl USING (variety) GROUP BY variety""")
def i09(spark, folder):
    return M.classification_metrics(classified(spark, folder), "y", "pred", ["variety"])


def _hit(k):
    return f"(CASE WHEN y = '{k}' THEN 1.0::DOUBLE ELSE 0 END)"


@query("i10_brier_multiclass", f"""
WITH {CLASSIFIED}
SELECT variety, count(*) AS n,
  ~avg({' + '.join(f'power({p} - {_hit(k)}, 2)' for k, p in zip(M.CLASSES, M.PROBS))}) AS brier
FROM c GROUP BY variety""")
def i10(spark, folder):
    return M.brier_multiclass(classified(spark, folder), "y", by=["variety"])


RELIABILITY = f"""lg AS ({' UNION ALL '.join(f"SELECT '{k}' AS label, {p} AS p, {_hit(k)} AS hit FROM c" for k, p in zip(M.CLASSES, M.PROBS))}),
rb AS (SELECT label, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS mp, avg(hit) AS ob FROM lg GROUP BY ALL),
rt AS (SELECT l.label, CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(mp, 0) AS mp, coalesce(ob, 0) AS ob, coalesce(abs(ob - mp), 0) AS gap,
    (SELECT count(*) FROM c) AS total
  FROM (SELECT DISTINCT label FROM lg) l CROSS JOIN range(10) r(b) LEFT JOIN rb ON rb.label = l.label AND rb.bin = b)"""


@query("i11_reliability_table", f"""
WITH {CLASSIFIED},
{RELIABILITY}
SELECT label, bin, n, total,
  ~mp AS mean_predicted,
  ~ob AS observed_frequency,
  ~gap AS abs_gap
FROM rt""")
def i11(spark, folder):
    return M.reliability_table(classified(spark, folder), "y")


@query("i11_ece_classwise", f"""
WITH {CLASSIFIED},
{RELIABILITY},
ec AS (SELECT label, sum(gap * n / total) AS ece FROM rt GROUP BY label)
SELECT label,
  ~ece AS ece
FROM (SELECT * FROM ec UNION ALL SELECT 'ALL', avg(ece) FROM ec)""")
def i11e(spark, folder):
    return M.ece_classwise(classified(spark, folder), "y")


@query("i12_ece_top1", f"""
WITH {CLASSIFIED},
t AS (SELECT greatest(p_low, p_medium, p_high) AS conf, CASE WHEN p_low = greatest(p_low, p_medium, p_high) THEN 'LOW'
    WHEN p_medium = greatest(p_low, p_medium, p_high) THEN 'MEDIUM' ELSE 'HIGH' END = y AS hit FROM c),
b AS (SELECT ceil(conf * 10) AS bin, count(*) AS n, avg(conf) AS cf, avg(hit::DOUBLE) AS ac FROM t GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n,
  ~sum(abs(ac - cf) * n) / sum(n) AS ece
FROM b""")
def i12(spark, folder):
    return M.ece_top1(classified(spark, folder), "y")


@query("i13_precision_recall_areas", f"""
WITH {CLASSIFIED},
g AS (SELECT p_high AS s, count(*) AS n, count(*) FILTER (y = 'HIGH') AS pos FROM c GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS seen, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(pos) OVER () AS p FROM g),
q AS (SELECT *, tp / seen AS prec, coalesce(lag(tp / seen) OVER (ORDER BY s DESC), 1) AS prev FROM r)
SELECT count(*) AS thresholds, CAST(max(p) AS BIGINT) AS positives,
  ~sum(pos / p * prec) AS average_precision,
  ~sum(pos / p * (prec + prev) / 2) AS pr_auc
FROM q""")
def i13(spark, folder):
    return M.precision_recall_areas(classified(spark, folder), F.col("y") == "HIGH", "p_high")


_Q = "\n".join(f"  ~quantile_cont(y - model, {v}) AS {k}," for k, v in M.QUANTILES.items())


@query("i14_residual_quantiles", f"""
WITH {SCORED}
SELECT variety, count(*) AS n, min(reported_date) AS first_date, max(reported_date) AS last_date,
{_Q}
  ~avg(y - model) AS mean,
  ~stddev_pop(y - model) AS std,
  ~quantile_cont(y - model, 0.75) - quantile_cont(y - model, 0.25) AS iqr
FROM s GROUP BY variety""")
def i14(spark, folder):
    df = scored(spark, folder).withColumn("residual", F.col("y") - F.col("model"))
    return M.residual_quantiles(df, "residual", by=["variety"])


@query("i15_interval_coverage", f"""
WITH {SCORED}
SELECT days_to_next, count(*) AS n, count(*) FILTER (y BETWEEN model - 800 AND model + 1200) AS covered,
  ~count(*) FILTER (y BETWEEN model - 800 AND model + 1200) / count(*) * 100 AS coverage_pct
FROM s GROUP BY days_to_next""")
def i15(spark, folder):
    df = scored(spark, folder).withColumns({"lo": F.col("model") - 800, "hi": F.col("model") + 1200})
    return M.interval_coverage(df, "y", "lo", "hi", ["days_to_next"])


def _mk(source, p, prefix):
    lab = ", ".join(f"('{k}')" for k in M.CLASSES)
    return f"""{prefix} AS (SELECT market, sum(a) AS n, sum(t) / sum(a) AS accuracy, sum(re) / count(*) FILTER (a > 0) AS balanced_accuracy,
    avg(f1) AS macro_f1, max(re) FILTER (l = 'HIGH') AS high_recall, max(pr) FILTER (l = 'HIGH') AS high_precision
  FROM (SELECT *, coalesce(t / nullif(q, 0), 0) AS pr, coalesce(t / nullif(a, 0), 0) AS re, coalesce(2 * t / nullif(a + q, 0), 0) AS f1
    FROM (SELECT market, l, count(*) FILTER (y = l) AS a, count(*) FILTER ({p} = l) AS q, count(*) FILTER (y = l AND {p} = l) AS t
          FROM {source} CROSS JOIN (VALUES {lab}) v(l) GROUP BY ALL)) GROUP BY market)"""


MARKETS = f"""{_mk('c', 'pred', 'ml')},
{_mk('c', 'base', 'ba')},
mj AS (SELECT ml.market, CAST(ml.n AS BIGINT) AS n, ml.accuracy AS ml_accuracy, ml.balanced_accuracy AS ml_balanced_accuracy, ml.macro_f1 AS ml_macro_f1,
    ml.high_recall AS ml_high_recall, ml.high_precision AS ml_high_precision, ba.accuracy AS base_accuracy, ba.balanced_accuracy AS base_balanced_accuracy,
    ba.macro_f1 AS base_macro_f1, ba.high_recall AS base_high_recall, ba.high_precision AS base_high_precision,
    ml.macro_f1 - ba.macro_f1 AS delta_macro_f1, ml.high_recall - ba.high_recall AS delta_high_recall
  FROM ml JOIN ba USING (market) WHERE ml.n >= 20),
mt AS (SELECT *, CASE WHEN delta_macro_f1 > 0 THEN 'win' WHEN delta_macro_f1 < 0 THEN 'loss' ELSE 'tie' END AS outcome,
    CASE WHEN n <= (SELECT quantile_cont(n::DOUBLE, 0.25) FROM mj) THEN 'small' WHEN n <= (SELECT quantile_cont(n::DOUBLE, 0.75) FROM mj) THEN 'medium' ELSE 'large' END AS tier FROM mj)"""


@query("i16_market_level_comparison", f"""
WITH {CLASSIFIED},
{MARKETS}
SELECT market, n, outcome, tier,
  ~ml_accuracy AS ml_accuracy,
  ~ml_balanced_accuracy AS ml_balanced_accuracy,
  ~ml_macro_f1 AS ml_macro_f1,
  ~ml_high_recall AS ml_high_recall,
  ~ml_high_precision AS ml_high_precision,
  ~base_accuracy AS base_accuracy,
  ~base_balanced_accuracy AS base_balanced_accuracy,
  ~base_macro_f1 AS base_macro_f1,
  ~base_high_recall AS base_high_recall,
  ~base_high_precision AS base_high_precision,
  ~delta_macro_f1 AS delta_macro_f1,
  ~delta_high_recall AS delta_high_recall
FROM mt""")
def i16(spark, folder):
    return M.market_level_comparison(classified(spark, folder), "y", "pred", "base")


@query("i16_tier_summary", f"""
WITH {CLASSIFIED},
{MARKETS}
SELECT tier, count(*) AS markets, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses,
  ~avg(n) AS mean_n,
  ~avg(ml_macro_f1) AS mean_ml_macro_f1,
  ~avg(base_macro_f1) AS mean_base_macro_f1,
  ~avg(delta_macro_f1) AS mean_delta,
  ~count(*) FILTER (outcome = 'win') / count(*) * 100 AS win_rate_pct
FROM mt GROUP BY tier""")
def i16t(spark, folder):
    return M.tier_summary(M.market_level_comparison(classified(spark, folder), "y", "pred", "base"))


def boot_sql(source, sums, reps):
    return f"""nb AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS idx FROM {source}),
dr AS (SELECT r AS rep, ('0x' || substr(md5('42|' || r || '|' || idx), 1, 8))::BIGINT % (SELECT count(*) FROM nb) AS pick
  FROM nb CROSS JOIN range(1, {reps} + 1) t(r)),
rp AS (SELECT rep, {', '.join(f'sum({s}) AS {s}' for s in sums)} FROM dr JOIN nb ON dr.pick = nb.idx GROUP BY rep)"""


@query("i17_clustered_bootstrap", f"""
WITH {SCORED},
cl AS (SELECT market AS k, sum(abs(y - current)) AS b, sum(abs(y - model)) AS m, count(*)::DOUBLE AS n FROM s GROUP BY market),
{boot_sql('cl', ('b', 'm', 'n'), M.ERROR_REPLICATES)}
SELECT count(*) AS replicates,
  ~(SELECT (sum(b) - sum(m)) / sum(n) FROM cl) AS observed,
  ~quantile_cont((b - m) / n, 0.025) AS ci_low,
  ~quantile_cont((b - m) / n, 0.975) AS ci_high,
  ~count(*) FILTER ((b - m) / n > 0) / count(*) * 100 AS prob_better_pct
FROM rp""")
def i17(spark, folder):
    df = scored(spark, folder).withColumns({"eb": F.abs(F.col("y") - F.col("current")), "em": F.abs(F.col("y") - F.col("model"))})
    return M.clustered_bootstrap(df, "market", "eb", "em")


@query("i17_mean_delta_bootstrap", f"""
WITH {CLASSIFIED},
{MARKETS},
cl AS (SELECT market AS k, floor(delta_macro_f1 * 65536) / 65536 AS s, 1.0::DOUBLE AS n FROM mt),
{boot_sql('cl', ('s', 'n'), M.DELTA_REPLICATES)},
a AS (SELECT avg(s) AS mean FROM cl)
SELECT
  ~any_value(mean) AS mean_delta,
  ~quantile_cont(s / n, 0.025) AS ci_low,
  ~quantile_cont(s / n, 0.975) AS ci_high,
  ~least(CASE WHEN any_value(mean) > 0 THEN count(*) FILTER (s / n <= 0) ELSE count(*) FILTER (s / n >= 0) END / count(*) * 2, 1) AS p_value
FROM rp CROSS JOIN a""")
def i17m(spark, folder):
    markets = M.market_level_comparison(classified(spark, folder), "y", "pred", "base")
    steps = markets.withColumn("delta", F.floor(F.col("delta_macro_f1") * 65536) / 65536)
    return M.mean_delta_bootstrap(steps, "market", "delta")


def tail_sql(z):
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = "0::DOUBLE"
    for a in reversed(M.NORMAL_TAIL):
        poly = f"(({poly} + ({a!r})::DOUBLE) * {t})"
    return f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly})"


@query("i18_paired_tests", f"""
WITH {SCORED},
d AS (SELECT abs(y - current) - abs(y - model) AS d FROM s),
t AS (SELECT count(*) AS n, avg(d) AS mean, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS ts, count(*) - 1.0::DOUBLE AS f,
    count(*) FILTER (d <> 0) AS other FROM d),
o AS (SELECT *, atan2(abs(ts), sqrt(f)) AS a, power(cos(atan2(abs(ts), sqrt(f))), 2) AS c FROM t),
p AS (SELECT *, CASE WHEN f > 2000 THEN 2 * {tail_sql('(ts * (1 - 1 / (4 * f)) / sqrt(1 + ts * ts / (2 * f)))')}
    WHEN f % 2 = 1 THEN 1 - 2 / pi() * (a + sin(a) * cos(a) * (
      SELECT coalesce(sum(exp(lgamma(j + 1) - lgamma(j + 1.5::DOUBLE)) * sqrt(pi()) / 2 * power(c, j)), 0) FROM range(1000) r(j) WHERE j <= (f - 3) / 2))
    ELSE 1 - sin(a) * (SELECT sum(exp(lgamma(j + 0.5::DOUBLE) - lgamma(j + 1)) / sqrt(pi()) * power(c, j)) FROM range(1001) r(j) WHERE j <= (f - 2) / 2)
    END AS tp FROM o),
k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY abs(d)) AS c FROM d),
w AS (SELECT sum(r) FILTER (d > 0) AS w_plus, sum(r) FILTER (d < 0) AS w_minus, sum(c::DOUBLE * c - 1) FILTER (d <> 0) AS ties,
    count(*)::DOUBLE AS m, count(*) FILTER (d = 0)::DOUBLE AS m0 FROM k),
z AS (SELECT *, (w_plus - (m * (m + 1) - m0 * (m0 + 1)) / 4)
    / sqrt((m * (m + 1) * (2 * m + 1) - m0 * (m0 + 1) * (2 * m0 + 1)) / 24 - ties / 48) AS z FROM w)
SELECT n, w_plus, w_minus, CASE WHEN other >= 10 THEN least(w_plus, w_minus) END AS wilcoxon_statistic,
  ~mean AS mean_difference,
  ~ts AS t_statistic,
  ~tp AS t_p_value,
  ~CASE WHEN other >= 10 THEN z END AS wilcoxon_z,
  ~CASE WHEN other >= 10 THEN 2 * {tail_sql('z')} END AS wilcoxon_p_value
FROM p CROSS JOIN z""")
def i18(spark, folder):
    df = scored(spark, folder).select(F.abs(F.col("y") - F.col("current")).alias("a"),
                                      F.abs(F.col("y") - F.col("model")).alias("b"))
    return M.paired_tests(df, "a", "b")


@query("i18_mcnemar", f"""
WITH {CLASSIFIED},
b AS (SELECT count(*) FILTER (pred = y AND base <> y) AS only_a, count(*) FILTER (pred <> y AND base = y) AS only_b FROM c),
s AS (SELECT *, power(abs(only_a - only_b) - 1.0::DOUBLE, 2) / (only_a + only_b) AS st FROM b)
SELECT only_a, only_b,
  ~st AS statistic,
  ~2 * {tail_sql('sqrt(st)')} AS p_value
FROM s""")
def i18m(spark, folder):
    return M.mcnemar(classified(spark, folder), "y", "pred", "base")


@query("i19_blend_search", f"""
WITH {SCORED}, a AS (SELECT s.*, i / 20.0::DOUBLE AS alpha FROM s CROSS JOIN range(21) r(i)),
m AS (SELECT alpha, avg(abs(y - (current + alpha * (model - current)))) AS mae_ FROM a GROUP BY alpha),
b AS (SELECT min_by(alpha, (mae_, alpha)) AS best FROM m)
SELECT alpha, alpha = any_value(best) AS best,
{reg_sql('y', 'current + alpha * (model - current)')}
FROM a CROSS JOIN b GROUP BY alpha""")
def i19(spark, folder):
    df = scored(spark, folder).withColumn("change", F.col("model") - F.col("current"))
    return M.blend_search(df, "y", "current", "change")


@query("i20_deadband_sweep", f"""
WITH {SCORED}, a AS (SELECT s.*, unnest([100, 500, 1000, 2500])::DOUBLE AS eps FROM s)
SELECT eps,
{reg_sql('y', 'current + CASE WHEN abs(model - current) < eps THEN 0 ELSE model - current END')}
FROM a GROUP BY eps""")
def i20(spark, folder):
    df = scored(spark, folder).withColumn("change", F.col("model") - F.col("current"))
    return M.deadband_sweep(df, "y", "current", "change", (100, 500, 1000, 2500))


_VALUES = M.multiplier_values()
GRID = f"""gr AS (SELECT wm, wh, y, CASE WHEN p_low >= p_medium * wm AND p_low >= p_high * wh THEN 'LOW' WHEN p_medium * wm >= p_high * wh THEN 'MEDIUM' ELSE 'HIGH' END AS g
  FROM c CROSS JOIN (SELECT unnest([{', '.join(repr(v) for v in _VALUES)}]::DOUBLE[]) AS wm) CROSS JOIN (SELECT unnest([{', '.join(repr(v) for v in _VALUES)}]::DOUBLE[]) AS wh)),
gl AS (SELECT wm, wh, l, count(*) FILTER (y = l) AS a, count(*) FILTER (g = l) AS q, count(*) FILTER (y = l AND g = l) AS t
  FROM gr CROSS JOIN (VALUES ('LOW'), ('MEDIUM'), ('HIGH')) v(l) GROUP BY ALL),
gm AS (SELECT wm AS w_med, wh AS w_high, avg(coalesce(2 * t / nullif(a + q, 0), 0)) AS macro_f1, max(coalesce(t / nullif(a, 0), 0)) FILTER (l = 'HIGH') AS high_recall
  FROM gl GROUP BY ALL)"""


@query("i21_threshold_multiplier_grid", f"""
WITH {CLASSIFIED},
{GRID}
SELECT
  ~w_med AS w_med,
  ~w_high AS w_high,
  ~macro_f1 AS macro_f1,
  ~high_recall AS high_recall
FROM gm""")
def i21(spark, folder):
    return M.threshold_multiplier_grid(classified(spark, folder), "y")


@query("i21_pick_multipliers", f"""
WITH {CLASSIFIED},
{GRID}
SELECT high_recall >= 0.5 AS floor_met,
  ~w_med AS w_med,
  ~w_high AS w_high,
  ~macro_f1 AS macro_f1,
  ~high_recall AS high_recall
FROM gm ORDER BY gm.high_recall >= 0.5 DESC, CASE WHEN gm.high_recall >= 0.5 THEN floor(gm.macro_f1 * 1e9) ELSE gm.high_recall END DESC, gm.w_med, gm.w_high LIMIT 1""")
def i21p(spark, folder):
    return M.pick_multipliers(M.threshold_multiplier_grid(classified(spark, folder), "y"), 0.5)


def panel_scored(spark, folder):
    """Yield rows with last year's value as persistence and the mean of two years as model."""
    w = T.panel_window()
    y1, y2 = F.lag("yield_kg_ha", 1).over(w), F.lag("yield_kg_ha", 2).over(w)
    return A.yield_panel(spark, folder).select(
        *PK, F.col("yield_kg_ha").alias("y"), y1.alias("persistence"), ((y1 + y2) / 2).alias("ridge"),
        (F.col("area") % 3 != 0).alias("weather_complete")).filter("ridge IS NOT NULL")


_PL = lambda k: lag("yield_kg_ha", k, part="district, season", order="year")
PANEL_SCORED = f"""ps AS (SELECT * FROM (SELECT district, season, year, yield_kg_ha AS y, {_PL(1)} AS persistence, ({_PL(1)} + {_PL(2)}) / 2 AS ridge,
    area % 3 <> 0 AS weather_complete FROM @panel@) WHERE ridge IS NOT NULL)"""
_POLICIES = ", ".join(f"({k}, [{', '.join(repr(s) for s in v)}]::VARCHAR[])" for k, v in M.ROUTING_POLICIES.items())
_PP = "CASE WHEN use_model THEN ridge ELSE persistence END"


@query("i22_routing_policy_compare", f"""
WITH {PANEL_SCORED},
r AS (SELECT ps.*, CAST(policy AS INTEGER) AS policy, list_contains(seasons, season) AS use_model FROM ps CROSS JOIN (VALUES {_POLICIES}) p(policy, seasons))
SELECT policy,
{reg_sql('y', _PP)},
  ~avg({_PP} - y) AS bias,
  ~count(*) FILTER (use_model AND weather_complete) / count(*) * 100 AS coverage_pct,
  ~avg(abs(y - {_PP})) FILTER (season = 'Autumn') AS autumn_mae,
  ~avg(abs(y - {_PP})) FILTER (season = 'Winter') AS winter_mae,
  ~avg(abs(y - {_PP})) FILTER (season = 'Summer') AS summer_mae,
  ~(SELECT avg(abs(y - persistence)) FROM ps) - avg(abs(y - {_PP})) AS improvement_vs_persistence
FROM r GROUP BY policy""")
def i22(spark, folder):
    return M.routing_policy_compare(panel_scored(spark, folder), "y", "ridge", "persistence", "weather_complete")


@query("i23_cv_average", f"""
WITH {SCORED}, f AS (SELECT year(reported_date) AS fold, count(*) AS n, avg(abs(y - model)) AS mae, sqrt(avg(power(y - model, 2))) AS rmse,
    avg(abs(y - current)) AS mae_baseline, sqrt(avg(power(y - current, 2))) AS rmse_baseline FROM s GROUP BY 1)
SELECT count(*) AS folds, CAST(sum(n) AS BIGINT) AS n,
  ~avg(mae) AS mae,
  ~avg(rmse) AS rmse,
  ~avg(mae_baseline) AS mae_baseline,
  ~avg(rmse_baseline) AS rmse_baseline
FROM f""")
def i23(spark, folder):
    return M.cv_average(scored(spark, folder).withColumn("fold", F.year("reported_date")), "fold", "y", "model", "current")


@query("i24_weather_coverage_by_fold", """
WITH p AS (SELECT *, CASE WHEN area % 3 <> 0 THEN area END AS w1, CASE WHEN area % 5 <> 0 AND area % 3 <> 0 THEN area END AS w2 FROM @panel@)
SELECT CAST(v - 1996 AS INTEGER) AS fold, CASE WHEN year < v THEN 'train' ELSE 'val' END AS role, count(*) AS n,
  count(*) FILTER (w1 IS NOT NULL AND w2 IS NOT NULL) AS complete, count(*) FILTER (w1 IS NOT NULL AND w2 IS NULL) AS incomplete,
  count(*) FILTER (w1 IS NULL AND w2 IS NULL) AS missing
FROM p JOIN (SELECT unnest([1997, 1998, 1999, 2000, 2001]) AS v) ON year <= v GROUP BY ALL""")
def i24(spark, folder):
    a = F.col("area")
    panel = A.yield_panel(spark, folder).withColumns({
        "w1": F.when(a % 3 != 0, a), "w2": F.when((a % 5 != 0) & (a % 3 != 0), a)})
    return M.weather_coverage_by_fold(S.rolling_origin_folds(panel, (1997, 1998, 1999, 2000, 2001), 1995), ["w1", "w2"])


@query("i25_promotion_gate", f"""
WITH {SCORED}, d AS (SELECT market, CAST(max(reported_date) - min(reported_date) AS INTEGER) AS days, count(*) AS forecasts, count(DISTINCT variety) * 20 AS markets,
    count(*) FILTER (abs(y - model) <= 25) / count(*) AS macro_ece, count(*) FILTER (abs(y - model) <= abs(y - current)) / count(*) * 100 AS win_rate_pct,
    avg(abs(y - current) - abs(y - model)) AS mean_delta FROM s GROUP BY market),
g AS (SELECT *, mean_delta - 0.01 AS ci_low, days >= 90 AS days_ok, forecasts >= 2000 AS forecasts_ok, markets >= 35 AS markets_ok, macro_ece <= 0.05 AS ece_ok,
    win_rate_pct >= 50 AS win_rate_ok, mean_delta - 0.01 > -0.02 AND mean_delta >= 0 AS non_inferior FROM d)
SELECT market, days, forecasts, markets, days_ok, forecasts_ok, markets_ok, ece_ok, win_rate_ok, non_inferior,
  CASE WHEN days_ok AND forecasts_ok AND markets_ok AND ece_ok AND win_rate_ok AND non_inferior THEN 'READY_FOR_GOVERNANCE_REVIEW' ELSE 'CONTINUE_SHADOW_MONITORING' END AS verdict,
  ~macro_ece AS macro_ece,
  ~win_rate_pct AS win_rate_pct,
  ~mean_delta AS mean_delta,
  ~ci_low AS ci_low
FROM g""")
def i25(spark, folder):
    em, eb = F.abs(F.col("y") - F.col("model")), F.abs(F.col("y") - F.col("current"))
    evidence = scored(spark, folder).groupBy("market").agg(
        F.datediff(F.max("reported_date"), F.min("reported_date")).alias("days"), F.count("*").alias("forecasts"),
        (F.countDistinct("variety") * 20).alias("markets"), (F.count_if(em <= 25) / F.count("*")).alias("macro_ece"),
        (F.count_if(em <= eb) / F.count("*") * 100).alias("win_rate_pct"), F.avg(eb - em).alias("mean_delta"))
    return M.promotion_gate(evidence.withColumn("ci_low", F.col("mean_delta") - 0.01))


@query("i26_error_table", f"""
WITH {SCORED}
SELECT market, variety, reported_date, y - model AS model_error, y - current AS baseline_error, abs(y - model) AS model_abs_error,
  abs(y - current) AS baseline_abs_error, abs(y - model) < abs(y - current) AS model_better,
  ~(y - current) / nullif(current, 0) * 100 AS movement_pct
FROM s""")
def i26(spark, folder):
    return M.error_table(scored(spark, folder), "y", "model", "current").drop("commodity", "days_to_next", "y", "current", "model")


_DESC = ("model_abs_error", "baseline_abs_error")


@query("i26_error_describe", f"""
WITH {SCORED}, u AS (SELECT 'model_abs_error' AS column_name, abs(y - model) AS value FROM s UNION ALL SELECT 'baseline_abs_error', abs(y - current) FROM s)
SELECT column_name, count(*) AS n, min(value) AS min, max(value) AS max,
  ~avg(value) AS mean,
  ~stddev_samp(value) AS std,
  ~quantile_cont(value, 0.25) AS p25,
  ~quantile_cont(value, 0.5) AS p50,
  ~quantile_cont(value, 0.75) AS p75
FROM u GROUP BY column_name""")
def i26d(spark, folder):
    return M.describe(M.error_table(scored(spark, folder), "y", "model", "current"), _DESC)


@query("z01_persistence_error_by_gap", f"""
WITH {NEXT}, n AS (SELECT * FROM nx WHERE days_to_next BETWEEN 1 AND 7)
SELECT market, days_to_next,
{reg_sql('future_price', P)}
FROM n GROUP BY ALL""")
def z01(spark, folder):
    """How wrong is 'tomorrow equals today', per gap length and market?"""
    rows_ = L.next_obs_target(A.observations(spark, folder))
    return M.regression_metrics(rows_, "future_price", P, ["market", "days_to_next"])
