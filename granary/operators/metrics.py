"""Regression, classification, calibration and comparison metrics as grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.distributed import exact_quantiles, row_scalar, running_by_value
from granary.functions.scalars import CLASSES

TOLERANCE = 25.0  # price units within which a forecast counts as accurate; fixed value


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- regression -------------------------------------------------------------------

def regression_aggs(y, pred, tolerance: float = TOLERANCE, suffix: str = "") -> dict[str, Column]:
    """n, MAE, RMSE, R2, MAPE without zero actuals, 100 - MAPE, share within the tolerance.

    R2 is NULL when the actual values do not vary.
    """
    y, pred = _c(y), _c(pred)
    both = y.isNotNull() & pred.isNotNull()
    y = F.when(both, y)
    err = F.abs(y - pred)
    n = F.count(err)
    sse = F.sum(err * err)
    sst = F.var_pop(y) * n
    mape = F.avg(F.when(y != 0, err / F.abs(y))) * 100
    out = {"n": n, "mae": F.avg(err), "rmse": F.sqrt(F.avg(err * err)),
           "r2": F.when((n >= 2) & (sst > 0), 1 - sse / sst), "mape": mape, "mape_accuracy": 100 - mape,
           "within_tolerance_pct": F.try_divide(F.count_if(err <= tolerance), n) * 100}
    return {f"{k}{suffix}": v for k, v in out.items()}


def regression_metrics(df: DataFrame, y, pred, by: Sequence[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    return df.groupBy(*by).agg(*[e.alias(k) for k, e in regression_aggs(y, pred, tolerance).items()])


def bias_medae_maxae(df: DataFrame, y: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Mean residual (prediction - actual), median and largest absolute error per key."""
    rows = df.select(*by, (F.col(pred) - F.col(y)).alias("_r")).withColumn("_a", F.abs("_r"))
    stats = rows.groupBy(*by).agg(F.count("_r").alias("n"), F.avg("_r").alias("bias"), F.max("_a").alias("max_ae"))
    return stats.join(exact_quantiles(rows, "_a", {"median_ae": 0.5}, by), list(by))


def metrics_by_horizon(df: DataFrame, horizon: str, y: str, model: str, baseline: str) -> DataFrame:
    """Model and baseline per horizon plus one overall row (horizon NULL)."""
    m, b = regression_aggs(y, model), regression_aggs(y, baseline, suffix="_baseline")
    return df.rollup(horizon).agg(*[e.alias(k) for k, e in (m | b).items() if k != "n_baseline"])


def metrics_by_group(df: DataFrame, y: str, model: str, baseline: str, groups: Sequence[str],
                     min_n: int = 5) -> DataFrame:
    """(group_kind, group_value) rows with MAE and RMSE of both and their difference."""
    kinds = F.array(*[F.struct(F.lit(g).alias("kind"), F.col(g).cast("string").alias("value")) for g in groups])
    rows = df.select(F.explode(kinds).alias("g"), (F.abs(F.col(y) - F.col(model))).alias("em"),
                     (F.abs(F.col(y) - F.col(baseline))).alias("eb"))
    out = rows.groupBy(F.col("g.kind").alias("group_kind"), F.col("g.value").alias("group_value")).agg(
        F.count("em").alias("n"), F.avg("em").alias("mae"), F.sqrt(F.avg(F.col("em") * F.col("em"))).alias("rmse"),
        F.avg("eb").alias("mae_baseline"), F.sqrt(F.avg(F.col("eb") * F.col("eb"))).alias("rmse_baseline"))
    return out.filter(F.col("n") >= min_n).withColumn("mae_delta", F.col("mae") - F.col("mae_baseline"))


def movement_flat_subsets(df: DataFrame, y: str, model: str, current: str, by: Sequence[str] = (),
                          eps: float = 1e-5) -> DataFrame:
    """Errors on unchanged and on moving outcomes, with their shares."""
    change = F.col(y) - F.col(current)
    subset = F.when(F.abs(change) <= eps, "flat").otherwise("moving")
    err, base = F.abs(F.col(y) - F.col(model)), F.abs(change)
    g = df.filter(change.isNotNull()).groupBy(*by, subset.alias("subset")).agg(
        F.count("*").alias("n"), F.avg(err).alias("model_mae"), F.avg(base).alias("persistence_mae"),
        F.sqrt(F.avg(err * err)).alias("model_rmse"), F.sqrt(F.avg(base * base)).alias("persistence_rmse"))
    # at most two rows per key
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return g.select("*", (F.col("n") / total * 100).alias("share_pct"))


def directional_accuracy(df: DataFrame, y: str, model: str, current: str, by: Sequence[str] = ()) -> DataFrame:
    """% of rows whose predicted change has the sign of the actual one, and R2 of the change."""
    t, p = F.col(y) - F.col(current), F.col(model) - F.col(current)
    n = F.count("*")
    sst = F.var_pop(t) * n
    return df.groupBy(*by).agg(
        n.alias("n"), (F.try_divide(F.count_if(F.signum(t) == F.signum(p)), n) * 100).alias("directional_accuracy_pct"),
        F.when(sst > 0, 1 - F.sum((t - p) * (t - p)) / sst).alias("r2_change"), F.avg(F.abs(t)).alias("naive_mae"))


def mae_confidence_interval(df: DataFrame, y: str, model: str, baseline: str, by: Sequence[str],
                            min_n: int = 10) -> DataFrame:
    """MAE +- 1.96 standard errors for model, baseline and their paired difference; p50 and p90."""
    rows = df.select(*by, F.abs(F.col(y) - F.col(model)).alias("em"), F.abs(F.col(y) - F.col(baseline)).alias("eb"))
    rows = rows.withColumn("ed", F.col("em") - F.col("eb"))
    out = {"n": F.count("*")}
    for name, c in (("model", "em"), ("baseline", "eb"), ("delta", "ed")):
        half = 1.96 * F.stddev_samp(c) / F.sqrt(F.count(c))
        enough = F.count(c) >= min_n
        out |= {f"mae_{name}": F.avg(c), f"{name}_low": F.when(enough, F.avg(c) - half),
                f"{name}_high": F.when(enough, F.avg(c) + half)}
    stats = rows.groupBy(*by).agg(*[e.alias(k) for k, e in out.items()])
    q = exact_quantiles(rows, "em", {"p50_error": 0.5, "p90_error": 0.9}, by)
    return stats.join(q, list(by))


# --- classification ---------------------------------------------------------------

def confusion_counts(y, pred, suffix: str = "") -> dict[str, Column]:
    """Nine conditional counts, so every label pair exists without a scaffold join."""
    y, pred = _c(y), _c(pred)
    return {f"c{i}{j}{suffix}": F.count_if((y == a) & (pred == b))
            for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)}


def confusion_matrix(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Long form (actual, predicted, n) with all nine pairs per key."""
    wide = df.groupBy(*by).agg(*[e.alias(k) for k, e in confusion_counts(y, pred).items()])
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{i}{j}").alias("n"))
                      for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)])
    return wide.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")


def classification_exprs(suffix: str = "") -> dict[str, Column]:
    """Metrics as algebra over the nine counts; undefined ratios count as 0.

    Macro averages run over all three labels; balanced accuracy only over labels that occur.
    """
    c = [[F.col(f"c{i}{j}{suffix}") for j in range(3)] for i in range(3)]
    actual = [c[i][0] + c[i][1] + c[i][2] for i in range(3)]
    predicted = [c[0][j] + c[1][j] + c[2][j] for j in range(3)]
    n = actual[0] + actual[1] + actual[2]
    hits = c[0][0] + c[1][1] + c[2][2]
    ratio0 = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    prec = [ratio0(c[k][k], predicted[k]) for k in range(3)]
    rec = [ratio0(c[k][k], actual[k]) for k in range(3)]
    f1 = [ratio0(2 * c[k][k], actual[k] + predicted[k]) for k in range(3)]
    present = [F.when(actual[k] > 0, 1).otherwise(0) for k in range(3)]
    # in doubles: products of counts outgrow long integers at scale
    d = lambda x: x.cast("double")
    cov_yp = d(hits) * d(n) - sum([d(predicted[k]) * d(actual[k]) for k in range(3)], F.lit(0.0))
    cov_pp = d(n) * d(n) - sum([d(predicted[k]) * d(predicted[k]) for k in range(3)], F.lit(0.0))
    cov_yy = d(n) * d(n) - sum([d(actual[k]) * d(actual[k]) for k in range(3)], F.lit(0.0))
    out = {"n": n, "accuracy": ratio0(hits, n),
           "balanced_accuracy": F.try_divide(rec[0] + rec[1] + rec[2], present[0] + present[1] + present[2]),
           "macro_f1": (f1[0] + f1[1] + f1[2]) / 3,
           "weighted_f1": ratio0(sum([f1[k] * actual[k] for k in range(3)], F.lit(0.0)), n),
           "mcc": ratio0(cov_yp, F.sqrt(cov_pp * cov_yy)),
           "high_false_alarm_rate": (predicted[2] - c[2][2]) / F.greatest(predicted[2], F.lit(1)),
           "high_to_low": c[2][0], "low_to_high": c[0][2]}
    for k, name in enumerate(("low", "medium", "high")):
        out |= {f"{name}_precision": prec[k], f"{name}_recall": rec[k], f"{name}_f1": f1[k],
                f"{name}_support": actual[k]}
    return {f"{k}{suffix}": v for k, v in out.items()}


def classification_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    wide = df.groupBy(*by).agg(*[e.alias(k) for k, e in confusion_counts(y, pred).items()])
    return wide.select(*by, *[e.alias(k) for k, e in classification_exprs().items()])


PROBS = ("p_low", "p_medium", "p_high")


def onehot(y: str) -> list[Column]:
    return [F.when(F.col(y) == k, 1.0).otherwise(0.0) for k in CLASSES]


def brier_multiclass(df: DataFrame, y: str, probs: Sequence[str] = PROBS, by: Sequence[str] = ()) -> DataFrame:
    gaps = [F.col(p) - h for p, h in zip(probs, onehot(y))]
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(sum([g * g for g in gaps], F.lit(0.0))).alias("brier"))


def reliability_table(df: DataFrame, y: str, probs: Sequence[str] = PROBS, bins: int = 10,
                      by: Sequence[str] = ()) -> DataFrame:
    """Left-closed bins per class, empty bins included."""
    cells = F.array(*[F.struct(F.lit(k).alias("label"), F.col(p).alias("p"), h.alias("hit"))
                      for k, p, h in zip(CLASSES, probs, onehot(y))])
    long = df.select(*by, F.explode(cells).alias("x")).select(*by, "x.*")
    bin_ = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    filled = long.groupBy(*by, "label", bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("observed"))
    # at most ``bins`` entries per (key, label): look every bin up in a small map
    packed = filled.groupBy(*by, "label").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "mean_p", "observed")))).alias("m"),
        F.sum("n").alias("total"))
    every = packed.select(*by, "label", "m", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    cell = F.try_element_at("m", F.col("bin"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return every.select(
        *by, "label", "bin", F.coalesce(cell["n"], F.lit(0)).alias("n"), zero(cell["mean_p"]).alias("mean_predicted"),
        zero(cell["observed"]).alias("observed_frequency"),
        zero(F.abs(cell["observed"] - cell["mean_p"])).alias("abs_gap"), "total")


def ece_classwise(df: DataFrame, y: str, probs: Sequence[str] = PROBS, bins: int = 10,
                  by: Sequence[str] = ()) -> DataFrame:
    """Calibration error per class and their mean (label ALL)."""
    table = reliability_table(df, y, probs, bins, by)
    per = table.groupBy(*by, "label").agg(F.sum(F.col("abs_gap") * F.col("n") / F.col("total")).alias("ece"))
    return per.unionByName(per.groupBy(*by).agg(F.avg("ece").alias("ece")).withColumn("label", F.lit("ALL")))


def top1(probs: Sequence[str] = PROBS) -> tuple[Column, Column]:
    """Confidence and class of the largest probability; ties go to the first class."""
    conf = F.greatest(*probs)
    label = F.when(F.col(probs[0]) == conf, CLASSES[0]).when(F.col(probs[1]) == conf, CLASSES[1]).otherwise(CLASSES[2])
    return conf, label


def ece_top1(df: DataFrame, y: str, probs: Sequence[str] = PROBS, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Right-closed bins on the confidence of the predicted class."""
    conf, label = top1(probs)
    rows = df.select(*by, conf.alias("conf"), (label == F.col(y)).cast("double").alias("hit"))
    per = rows.groupBy(*by, F.ceil(F.col("conf") * bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("conf").alias("c"), F.avg("hit").alias("a"))
    return per.groupBy(*by).agg((F.sum(F.abs(F.col("a") - F.col("c")) * F.col("n")) / F.sum("n")).alias("ece"),
                                F.sum("n").alias("n"))


def precision_recall_areas(df: DataFrame, hit: Column, score: str) -> DataFrame:
    """Average precision and the trapezoid area under the precision-recall curve.

    Equal scores form one threshold. Running counts over descending scores are
    bucketed, so no task sees all thresholds.
    """
    rows = df.select(F.col(score).alias("score"), hit.cast("long").alias("hit"))
    run = running_by_value(rows, "score", {"n": F.lit(1), "pos": F.col("hit")}, descending=True)
    c = F.col
    tp, seen = c("pos_before") + c("pos"), c("n_before") + c("n")
    precision = tp / seen
    before = F.when(c("n_before") > 0, c("pos_before") / c("n_before")).otherwise(1.0)
    step = F.try_divide(c("pos"), c("pos_total"))
    return run.agg(F.sum(step * precision).alias("average_precision"),
                   F.sum(step * (precision + before) / 2).alias("pr_auc"),
                   F.count("*").alias("thresholds"), F.max("pos_total").alias("positives"))


# --- residuals ---------------------------------------------------------------------

QUANTILES = {"p05": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def residual_quantiles(df: DataFrame, residual: str, date: str = "reported_date", by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles, mean, population std, IQR, count and period of residuals."""
    stats = df.groupBy(*by).agg(
        F.count(residual).alias("n"), F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"),
        F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    q = exact_quantiles(df, residual, QUANTILES, by)
    if by:
        out = stats.join(q, list(by))
    else:
        s = row_scalar(q)
        out = stats.select("*", *[s[k].alias(k) for k in QUANTILES])
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def interval_coverage(df: DataFrame, y: str, low: str, high: str, by: Sequence[str] = ()) -> DataFrame:
    known = F.col(y).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
    inside = known & F.col(y).between(F.col(low), F.col(high))
    return df.groupBy(*by).agg(F.count_if(known).alias("n"), F.count_if(inside).alias("covered"),
                               (F.try_divide(F.count_if(inside), F.count_if(known)) * 100).alias("coverage_pct"))


def error_table(df: DataFrame, y: str, model: str, current: str) -> DataFrame:
    """Per-row errors of model and persistence and the movement in %."""
    em, eb = F.col(y) - F.col(model), F.col(y) - F.col(current)
    return df.select("*", em.alias("model_error"), eb.alias("baseline_error"), F.abs(em).alias("model_abs_error"),
                     F.abs(eb).alias("baseline_abs_error"),
                     (F.try_divide(eb, F.col(current)) * 100).alias("movement_pct"),
                     (F.abs(em) < F.abs(eb)).alias("model_better"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column in long form."""
    long = df.unpivot([], list(cols), "column_name", "value")
    s = long.groupBy("column_name").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return s.join(exact_quantiles(long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column_name"]), "column_name")


# --- comparisons ---------------------------------------------------------------------

def market_level_comparison(df: DataFrame, y: str, model: str, baseline: str, min_obs: int = 20,
                            by: str = "market") -> DataFrame:
    """Per-market metrics of both, who wins on macro-F1, and the market's volume tier."""
    rows = df.filter(F.col(y).isNotNull() & F.col(model).isNotNull() & F.col(baseline).isNotNull())
    counts = confusion_counts(y, model, "_ml") | confusion_counts(y, baseline, "_base")
    wide = rows.groupBy(by).agg(*[e.alias(k) for k, e in counts.items()])
    ml, base = classification_exprs("_ml"), classification_exprs("_base")
    names = ("accuracy", "balanced_accuracy", "macro_f1", "high_recall", "high_precision")
    m = wide.select(by, ml["n_ml"].alias("n"), *[ml[f"{k}_ml"].alias(f"ml_{k}") for k in names],
                    *[base[f"{k}_base"].alias(f"base_{k}") for k in names]).filter(F.col("n") >= min_obs)
    q = row_scalar(m.agg(F.percentile("n", 0.25).alias("q25"), F.percentile("n", 0.75).alias("q75")))
    d = F.col("ml_macro_f1") - F.col("base_macro_f1")
    return m.select(
        "*", d.alias("delta_macro_f1"), (F.col("ml_high_recall") - F.col("base_high_recall")).alias("delta_high_recall"),
        F.when(d > 0, "win").when(d < 0, "loss").otherwise("tie").alias("outcome"),
        F.when(F.col("n") <= q["q25"], "small").when(F.col("n") <= q["q75"], "medium").otherwise("large").alias("tier"))


def tier_summary(markets: DataFrame) -> DataFrame:
    return markets.groupBy("tier").agg(
        F.count("*").alias("markets"), F.avg("n").alias("mean_n"), F.avg("ml_macro_f1").alias("mean_ml_macro_f1"),
        F.avg("base_macro_f1").alias("mean_base_macro_f1"), F.avg("delta_macro_f1").alias("mean_delta"),
        F.count_if(F.col("outcome") == "win").alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"),
        (F.try_divide(F.count_if(F.col("outcome") == "win"), F.count("*")) * 100).alias("win_rate_pct"))


#: Replicates of the bootstrap of errors and of that of differences per cluster.
ERROR_REPLICATES, DELTA_REPLICATES = 10_000, 2_000


#: Clusters whose sums one row holds, and parts into which the replicates are cut.
CLUSTER_BLOCK, REPLICATE_PARTS = 4096, 32


def bootstrap_replicates(clusters: DataFrame, order: str, sums: Sequence[str], reps: int, seed: str = "42") -> DataFrame:
    """Per replicate the sums over as many clusters as there are, drawn with replacement.

    ``clusters`` holds one pre-aggregated row per cluster. Draw j of replicate r
    takes cluster md5(seed|r|j) mod k, so every engine draws alike. The sums travel as arrays over blocks of
    clusters, once per part of the replicates; a task adds up the draws that fall into its block, so no row is
    made or shuffled per draw. Missing sums count as 0.
    """
    # numbering needs one row per cluster only
    by = Window.orderBy(order)
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = clusters.select(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums],
                               (F.row_number().over(by) - 1).alias("idx"), F.count("*").over(whole).alias("k"))
    blocks = numbered.groupBy((F.col("idx") / CLUSTER_BLOCK).cast("int").alias("block"), "k").agg(
        F.sort_array(F.collect_list(F.struct("idx", *sums))).alias("held"))
    parts = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPLICATE_PARTS - 1))).alias("part")).repartition(
        REPLICATE_PARTS, "part")
    mine = F.filter(F.sequence(F.lit(1), F.lit(reps)), lambda r: r % REPLICATE_PARTS == F.col("part"))
    rows = parts.select("block", "k", "held", F.explode(mine).alias("rep"))

    def step(state: Column, j: Column) -> Column:
        digest = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("rep"), j)), 1, 8)
        # an index outside of this block has no place in its array
        at = F.conv(digest, 16, 10).cast("long") % F.col("k") - F.col("block") * CLUSTER_BLOCK
        got = F.when(at >= 0, F.get("held", at.cast("int")))
        return F.struct(*[(state[s] + F.coalesce(got[s], F.lit(0.0))).alias(s) for s in sums])
    start = F.struct(*[F.lit(0.0).alias(s) for s in sums])
    drawn = rows.select("rep", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), start, step).alias("of"))
    return drawn.groupBy("rep").agg(*[F.sum(f"of.{s}").alias(s) for s in sums])


def clustered_bootstrap(df: DataFrame, cluster: str, base_error: str, model_error: str, reps: int = ERROR_REPLICATES,
                        seed: str = "42") -> DataFrame:
    """Improvement in mean error with its 95 % interval from resampled clusters."""
    sums = df.groupBy(cluster).agg(F.sum(base_error).alias("b"), F.sum(model_error).alias("m"),
                                   F.count("*").cast("double").alias("n"))
    rep = bootstrap_replicates(sums, cluster, ["b", "m", "n"], reps, seed).select(
        ((F.col("b") - F.col("m")) / F.col("n")).alias("d"))
    observed = sums.agg(F.try_divide(F.sum("b") - F.sum("m"), F.sum("n"))).scalar()
    # reps rows, a parameter
    return rep.agg(F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high"),
                   (F.try_divide(F.count_if(F.col("d") > 0), F.count("*")) * 100).alias("prob_better_pct"),
                   F.count("*").alias("replicates")).select(observed.alias("observed"), "*")


def mean_delta_bootstrap(df: DataFrame, cluster: str, delta: str, reps: int = DELTA_REPLICATES, seed: str = "42") -> DataFrame:
    """Mean of per-cluster differences with its 95 % interval and two-sided p-value."""
    rows = df.select(cluster, F.col(delta).alias("s"), F.lit(1.0).alias("n"))
    rep = bootstrap_replicates(rows, cluster, ["s", "n"], reps, seed).select((F.col("s") / F.col("n")).alias("d"))
    mean = rows.agg(F.avg("s")).scalar()
    out = rep.agg(F.percentile("d", 0.025).alias("ci_low"), F.percentile("d", 0.975).alias("ci_high"),
                  F.try_divide(F.count_if(F.col("d") <= 0), F.count("*")).alias("lo"),
                  F.try_divide(F.count_if(F.col("d") >= 0), F.count("*")).alias("hi"))
    return out.select(mean.alias("mean_delta"), "ci_low", "ci_high",
                      F.least(F.when(mean > 0, F.col("lo")).otherwise(F.col("hi")) * 2, F.lit(1.0)).alias("p_value"))


# Coefficients of a published rational approximation of the normal tail. Fixed values.
NORMAL_TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) to about 7 digits."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = F.lit(0.0)
    for a in reversed(NORMAL_TAIL):
        poly = (poly + a) * t
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


#: Degrees of freedom up to which Student's distribution is summed term by term; beyond, the normal distribution of
#: a transformed statistic is right to more than 7 digits.
T_TERMS = 2000


def student_tail(t: Column, df: Column) -> Column:
    """P(T > |t|) of Student's distribution with whole degrees of freedom; NULL below 1.

    The distribution is a finite series in the cosine of atan(t / sqrt(df)), of other first terms for odd and
    even df. One term follows from the one before.
    """
    x = F.abs(t)
    df = F.when(df >= 1, df)
    angle = F.atan2(x, F.sqrt(df.cast("double")))
    cos2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    last = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] * ratio(j) * cos2
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.least(last, F.lit(T_TERMS)))).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, start, step, lambda s: s["total"])
    between = (F.when(df == 1, angle * 2 / math.pi)
               .when(odd, (angle + F.sin(angle) * F.cos(angle) * series) * 2 / math.pi)
               .otherwise(F.sin(angle) * series))
    z = x * (1 - 1 / (4.0 * df)) / F.sqrt(1 + x * x / (2.0 * df))
    return F.when(df > T_TERMS, normal_tail(z)).when(df >= 1, F.greatest((1 - between) / 2, F.lit(0.0)))


#: Differences other than zero that the signed-rank test asks for.
LEAST_NONZERO = 10


def one_sided(p_upper: Column, statistic: Column, alternative: str) -> Column:
    """p-value from the tail beyond |statistic|."""
    if alternative == "two-sided":
        return F.when(p_upper.isNotNull(), F.least(2 * p_upper, F.lit(1.0)))
    if alternative not in ("greater", "less"):
        raise ValueError(f"alternative must be two-sided, greater or less, not {alternative}")
    toward = statistic >= 0 if alternative == "greater" else statistic <= 0
    return F.when(toward, p_upper).otherwise(1 - p_upper)


def paired_tests(df: DataFrame, a: str, b: str, alternative: str = "two-sided", zeros: str = "pratt",
                 least_nonzero: int = LEAST_NONZERO) -> DataFrame:
    """Paired t test (Student, n - 1 degrees) and Wilcoxon signed-rank test of a - b.

    ``zeros``: "pratt" ranks zero differences too and leaves their ranks out of the sums, "wilcox" drops them first.
    Tied differences share their mean rank; the signed-rank p-value is that of the normal approximation, and NULL
    like its statistic below ``least_nonzero`` differences other than zero. ``alternative`` is about a - b; if all
    differences are zero both p-values are 1 in a one-sided test.
    """
    if zeros not in ("pratt", "wilcox"):
        raise ValueError(f"zeros must be pratt or wilcox, not {zeros}")
    rows = df.select((F.col(a) - F.col(b)).alias("d")).filter("d IS NOT NULL")
    t = row_scalar(rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"),
                            F.count_if(F.col("d") == 0).alias("zeros")))
    ranked = rows if zeros == "pratt" else rows.filter("d <> 0")
    sizes = ranked.select(F.abs("d").alias("v"), F.when(F.col("d") > 0, 1).otherwise(0).alias("pos"))
    run = running_by_value(sizes, "v", {"n": F.lit(1), "pos": F.col("pos")})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    other = F.col("v") != 0
    w = run.agg(F.sum(F.when(other, F.col("pos") * rank)).alias("w_plus"),
                F.sum(F.when(other, (F.col("n") - F.col("pos")) * rank)).alias("w_minus"),
                F.sum(F.when(other, n * n * n - n)).alias("ties"), F.sum(n).alias("m"),
                F.coalesce(F.sum(F.when(~other, n)), F.lit(0.0)).alias("m0"))
    # higher-order functions take no subqueries, so the row of the t test becomes a column first
    w = w.select("*", F.explode(F.array(t)).alias("t"))
    t = F.col("t")
    m, m0 = F.col("m"), F.col("m0")
    mean = (m * (m + 1) - m0 * (m0 + 1)) / 4
    var = (m * (m + 1) * (2 * m + 1) - m0 * (m0 + 1) * (2 * m0 + 1)) / 24 - F.col("ties") / 48
    enough = t["n"] - t["zeros"] >= least_nonzero
    z = F.when(enough, F.try_divide(F.col("w_plus") - mean, F.sqrt(var)))
    t_stat = F.try_divide(t["mean"], F.try_divide(t["sd"], F.sqrt(t["n"])))
    same = F.lit(alternative != "two-sided") & (t["n"] == t["zeros"])
    t_p = F.when(same, 1.0).otherwise(one_sided(student_tail(t_stat, t["n"] - 1), t_stat, alternative))
    w_p = F.when(same, 1.0).otherwise(one_sided(normal_tail(z), z, alternative))
    return w.select(t["n"].alias("n"), t["mean"].alias("mean_difference"), t_stat.alias("t_statistic"),
                    t_p.alias("t_p_value"), "w_plus", "w_minus",
                    F.when(enough, F.least("w_plus", "w_minus")).alias("wilcoxon_statistic"), z.alias("wilcoxon_z"),
                    w_p.alias("wilcoxon_p_value"))


def mcnemar(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Continuity-corrected McNemar statistic of two classifiers on the same rows."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    g = df.agg(F.count_if(ra & ~rb).alias("only_a"), F.count_if(~ra & rb).alias("only_b"))
    diff, total = F.abs(F.col("only_a") - F.col("only_b")) - 1.0, F.col("only_a") + F.col("only_b")
    stat = F.coalesce(F.try_divide(diff * diff, total), F.lit(0.0))
    return g.select("only_a", "only_b", stat.alias("statistic"),
                    F.when(total > 0, 2 * normal_tail(F.sqrt(stat))).otherwise(1.0).alias("p_value"))


# --- searches ----------------------------------------------------------------------------

def _explode_values(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    """Each row once per parameter value; the grid is a fixed short list."""
    return df.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))


def blend_search(df: DataFrame, y: str, current: str, change: str, steps: int = 20, tolerance: float = TOLERANCE) -> DataFrame:
    """Metrics of current + alpha * change for alpha = 0..1, with the smallest MAE marked.

    The absolute error of a row is linear in alpha on both sides of the point where it turns. Rows are summed once, by
    the number of grid points before their turn; an alpha's sum is that of the rows which have not turned minus
    that of the others. Squares need three sums. The shuffle holds one row per turning place, whatever the grid.
    """
    r, d = F.col(y) - F.col(current), F.col(change)
    turn = F.try_divide(r, d)
    rows = df.filter(F.col(y).isNotNull() & F.col(current).isNotNull() & d.isNotNull()).select(
        F.col(y).alias("y"), F.col(current).alias("c"), d.alias("d"), r.alias("r"),
        F.when(d == 0, F.signum(r)).when(turn <= 0, -F.signum(d)).otherwise(F.signum(r)).alias("side"),
        F.when((d != 0) & (turn > 0), F.least(F.floor(turn * steps) + 1, F.lit(steps + 1))).otherwise(steps + 1).alias("turns"))
    sums = {"n": F.count("*"), "mean": F.avg("y"), "var": F.var_pop("y"), "r": F.sum(F.col("side") * F.col("r")), "d": F.sum(F.col("side") * F.col("d")),
            "rr": F.sum(F.col("r") * F.col("r")), "rd": F.sum(F.col("r") * F.col("d")), "dd": F.sum(F.col("d") * F.col("d")),
            "pn": F.count_if(F.col("y") != 0), "pr": F.sum(F.when(F.col("y") != 0, F.col("side") * F.col("r") / F.abs("y"))),
            "pd": F.sum(F.when(F.col("y") != 0, F.col("side") * F.col("d") / F.abs("y")))}
    close = {f"w{i}": F.count_if(F.abs(F.col("y") - (F.col("c") + F.lit(i / steps) * F.col("d"))) <= tolerance) for i in range(steps + 1)}
    held = rows.groupBy("turns").agg(*[e.alias(k) for k, e in (sums | close).items()])
    # from here on there are steps + 2 rows at most
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i / steps).alias("alpha"), F.col(f"w{i}").alias("close")) for i in range(steps + 1)]))
    cells = held.select(*sums, "turns", grid.alias("g")).select("*", F.when(F.col("g.i") < F.col("turns"), 1.0).otherwise(-1.0).alias("sign"))
    a, zero = F.col("g.alpha"), F.lit(0.0)
    part = cells.groupBy(a.alias("alpha")).agg(
        F.sum("n").alias("n"), F.sum(F.col("sign") * (F.col("r") - a * F.col("d"))).alias("abs"),
        F.sum(F.coalesce(F.col("sign") * (F.col("pr") - a * F.col("pd")), zero)).alias("pct"), F.sum("pn").alias("pn"), F.sum("g.close").alias("close"),
        F.sum(F.col("rr") - 2 * a * F.col("rd") + a * a * F.col("dd")).alias("sse"), F.sum(F.col("n") * F.col("mean")).alias("sy"),
        F.sum(F.col("n") * F.col("var")).alias("inner"), F.collect_list(F.struct("n", "mean")).alias("groups"))
    n, mean = F.col("n"), F.col("sy") / F.col("n")
    sst = F.col("inner") + F.aggregate("groups", zero, lambda t, g: t + g["n"] * (g["mean"] - mean) * (g["mean"] - mean))
    sse = F.greatest(F.col("sse"), zero)
    mape = F.try_divide(F.col("pct"), F.col("pn")) * 100
    m = part.select("alpha", "n", (F.col("abs") / n).alias("mae"), F.sqrt(sse / n).alias("rmse"), F.when((n >= 2) & (sst > 0), 1 - sse / sst).alias("r2"),
                    mape.alias("mape"), (100 - mape).alias("mape_accuracy"), (F.col("close") / n * 100).alias("within_tolerance_pct"))
    best = m.agg(F.min_by("alpha", F.struct("mae", "alpha"))).scalar()
    return m.withColumn("best", F.col("alpha") == best)


def deadband_sweep(df: DataFrame, y: str, current: str, change: str, eps: Sequence[float] = (1, 2, 3, 5)) -> DataFrame:
    """Metrics after setting predicted changes below eps to 0."""
    rows = _explode_values(df, "eps", eps)
    kept = F.when(F.abs(change) < F.col("eps"), 0.0).otherwise(F.col(change))
    return regression_metrics(rows, y, F.col(current) + kept, ["eps"])


def multiplier_values(low: float = 0.8, high: float = 3.5, n: int = 12) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def threshold_multiplier_grid(df: DataFrame, y: str, probs: Sequence[str] = PROBS,
                              values: Sequence[float] | None = None) -> DataFrame:
    """Macro-F1 and HIGH recall when MEDIUM and HIGH probabilities are multiplied.

    A row's labels over the whole grid follow from three places: how many MEDIUM factors leave LOW ahead, how many HIGH
    factors do, and how many cells, in the order of their factors' ratio, put MEDIUM before HIGH. Rows are counted
    once by these places and the label, so what is shuffled does not depend on the grid or the number of rows; the
    counts are laid over the cells afterwards.
    """
    values = sorted(values or multiplier_values())
    low, med, high = (F.col(p) for p in probs)
    order = {cell: place for place, cell in enumerate(sorted(
        ((i, j) for i in range(len(values)) for j in range(len(values))), key=lambda c: values[c[1]] / values[c[0]]))}

    def places(rows: DataFrame, name: str, x: Column, y: Column, edges: Sequence[float]) -> DataFrame:
        """How many of the rising edges e have x >= y * e, by halving; one small projection per step."""
        table = F.array(*[F.lit(float(e)) for e in edges])
        rows, step = rows.withColumn(name, F.lit(0)), 1 << (len(edges).bit_length() - 1)
        while step:
            at = F.col(name) + (step - 1)
            rows = rows.withColumn(name, F.col(name) + F.when((at < len(edges)) & (x >= y * F.get(table, at)), step).otherwise(0))
            step //= 2
        return rows
    rows = df.select(F.col(y).alias("y"), low.alias("low"), med.alias("med"), high.alias("high"))
    low, med, high = F.col("low"), F.col("med"), F.col("high")
    for name, a, b, edges in (("beats_med", low, med, values), ("beats_high", low, high, values), ("med_first", med, high, [values[j] / values[i] for i, j in order])):
        rows = places(rows, name, a, b, edges)
    counted = rows.groupBy("y", "beats_med", "beats_high", "med_first").agg(F.count("*").alias("rows"))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(values[i]).alias("w_med"), F.lit(values[j]).alias("w_high"),
                                         F.lit(place).alias("place")) for (i, j), place in order.items()]))
    laid = counted.select("*", cells.alias("g"))
    label = F.when((F.col("g.i") < F.col("beats_med")) & (F.col("g.j") < F.col("beats_high")), CLASSES[0]).when(
        F.col("g.place") < F.col("med_first"), CLASSES[1]).otherwise(CLASSES[2])
    table = {f"c{i}{j}": F.coalesce(F.sum(F.when((F.col("y") == a) & (label == b), F.col("rows"))), F.lit(0))
             for i, a in enumerate(CLASSES) for j, b in enumerate(CLASSES)}
    wide = laid.groupBy(F.col("g.w_med").alias("w_med"), F.col("g.w_high").alias("w_high")).agg(*[e.alias(k) for k, e in table.items()])
    m = classification_exprs()
    return wide.select("w_med", "w_high", m["macro_f1"].alias("macro_f1"), m["high_recall"].alias("high_recall"))


def pick_multipliers(grid: DataFrame, min_high_recall: float = 0.0) -> DataFrame:
    """Largest macro-F1 among cells that reach the recall floor, else the largest recall."""
    ok = F.col("high_recall") >= min_high_recall
    order = F.struct(F.when(ok, 1).otherwise(0), F.when(ok, F.col("macro_f1")).otherwise(F.col("high_recall")),
                     -F.col("w_med"), -F.col("w_high"))
    best = grid.agg(F.max_by(F.struct("w_med", "w_high", "macro_f1", "high_recall"), order).alias("b"))
    return best.select("b.*", (F.col("b.high_recall") >= min_high_recall).alias("floor_met"))


# Seasons in which each policy trusts the model; persistence elsewhere. Fixed values.
ROUTING_POLICIES = {
    1: (),
    2: ("Autumn", "Winter", "Summer"),
    3: ("Autumn",),
    4: ("Autumn", "Winter"),
    5: ("Winter", "Summer"),
    6: ("Autumn", "Summer"),
    7: ("Winter", "Summer"),
    8: ("Autumn", "Winter", "Summer"),
}


def routing_policy_compare(df: DataFrame, y: str, model: str, baseline: str, complete: str) -> DataFrame:
    """All policies on identical rows: overall metrics, MAE per season, share of rows the model serves."""
    table = F.array(*[F.struct(F.lit(k).alias("policy"), F.array(*[F.lit(s) for s in v]).cast("array<string>").alias("seasons"))
                      for k, v in ROUTING_POLICIES.items()])
    rows = df.select("*", F.explode(table).alias("_p")).withColumn(
        "_use", F.array_contains("_p.seasons", F.col("season")))
    pred = F.when(F.col("_use"), F.col(model)).otherwise(F.col(baseline))
    err = F.abs(F.col(y) - pred)
    aggs = regression_aggs(y, pred) | {"bias": F.avg(pred - F.col(y)),
                                       "coverage_pct": F.count_if(F.col("_use") & F.col(complete)) / F.count("*") * 100}
    for s in ("Autumn", "Winter", "Summer"):
        aggs[f"{s.lower()}_mae"] = F.avg(F.when(F.col("season") == s, err))
    out = rows.groupBy(F.col("_p.policy").alias("policy")).agg(*[e.alias(k) for k, e in aggs.items()])
    first = out.filter("policy = 1").agg(F.max("mae")).scalar()
    return out.withColumn("improvement_vs_persistence", first - F.col("mae"))


def cv_average(df: DataFrame, fold: str, y: str, model: str, baseline: str) -> DataFrame:
    """Fold MAE and RMSE of both, averaged over folds."""
    m, b = regression_aggs(y, model), regression_aggs(y, baseline, suffix="_baseline")
    per = df.groupBy(fold).agg(*[(m | b)[k].alias(k) for k in ("n", "mae", "rmse", "mae_baseline", "rmse_baseline")])
    return per.agg(F.count("*").alias("folds"), F.sum("n").alias("n"),
                   *[F.avg(k).alias(k) for k in ("mae", "rmse", "mae_baseline", "rmse_baseline")])


def weather_coverage_by_fold(folds: DataFrame, weather: Sequence[str]) -> DataFrame:
    """Rows with all, some or no weather values per fold and role."""
    have = sum([F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in weather], F.lit(0))
    return folds.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.count_if(have == len(weather)).alias("complete"),
        F.count_if((have > 0) & (have < len(weather))).alias("incomplete"), F.count_if(have == 0).alias("missing"))


# Bounds of the promotion review. Fixed values.
GATE_DAYS, GATE_FORECASTS, GATE_MARKETS, GATE_ECE, GATE_WIN_RATE = 90, 2000, 35, 0.05, 50.0


def promotion_gate(stats: DataFrame, margin: float = 0.02) -> DataFrame:
    """One-row evidence (days, forecasts, markets, macro_ece, win_rate_pct, ci_low, mean_delta) to a verdict."""
    c = F.col
    checks = {"days_ok": c("days") >= GATE_DAYS, "forecasts_ok": c("forecasts") >= GATE_FORECASTS,
              "markets_ok": c("markets") >= GATE_MARKETS, "ece_ok": c("macro_ece") <= GATE_ECE,
              "win_rate_ok": c("win_rate_pct") >= GATE_WIN_RATE,
              "non_inferior": (c("ci_low") > -margin) & (c("mean_delta") >= 0)}
    flags = [F.coalesce(e, F.lit(False)).alias(k) for k, e in checks.items()]
    out = stats.select("*", *flags)
    all_ok = F.lit(True)
    for k in checks:
        all_ok = all_ok & F.col(k)
    return out.withColumn("verdict", F.when(all_ok, "READY_FOR_GOVERNANCE_REVIEW").otherwise("CONTINUE_SHADOW_MONITORING"))
