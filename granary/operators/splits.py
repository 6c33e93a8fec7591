"""Temporal splits, purging and leakage audits. Roles are columns; no rows move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.distributed import day_quantile, row_scalar
from granary.functions.windows import series_window
from granary.schemas import SERIES

DATE = "reported_date"


def _on_or_after(date, cutoff: Column) -> Column:
    """NULL dates compare false, so their rows are kept."""
    return F.coalesce(F.col(date) >= cutoff, F.lit(False)) if isinstance(date, str) else F.coalesce(
        date >= cutoff, F.lit(False))


def global_time_split(df: DataFrame, target_date: str, test_ratio: float = 0.2,
                      cutoff: str | None = None, drop_unseen: bool = False) -> DataFrame:
    """Column role in (train, purged, test): purged train rows have a target on or after the cutoff."""
    cut = (F.lit(cutoff).cast("date") if cutoff else
           F.date_from_unix_date(F.floor(day_quantile(df, DATE, 1 - test_ratio)).cast("int")))
    role = (F.when(F.col(DATE) >= cut, "test").when(_on_or_after(target_date, cut), "purged")
            .otherwise("train"))
    out = df.select("*", role.alias("role"), cut.alias("cutoff"))
    if not drop_unseen:
        return out
    seen = out.filter("role = 'train'").select(*SERIES).distinct().withColumn("_seen", F.lit(True))
    return (out.join(seen, list(SERIES), "left")
            .filter("role <> 'test' OR _seen").drop("_seen"))


def rows_per_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year(DATE).alias("year")).agg(F.count("*").alias("n"))


def _folds(df: DataFrame, candidates: Sequence[Column]) -> DataFrame:
    """Every row once per fold that uses it; candidates are structs or NULL."""
    return df.select("*", F.explode(F.array(*candidates)).alias("_f")).filter("_f IS NOT NULL").select(
        *df.columns, F.col("_f.fold").alias("fold"), F.col("_f.role").alias("role"))


def _fold(i, cond_train: Column, cond_val: Column) -> list[Column]:
    tag = lambda role: F.struct(F.lit(i).alias("fold"), F.lit(role).alias("role"))
    return [F.when(cond_train, tag("train")), F.when(cond_val, tag("val"))]


def walk_forward_splits(df: DataFrame, n: int = 4, min_frac: float = 0.5, gap: int = 7) -> DataFrame:
    """Expanding folds between the min_frac date quantile and the last day, in equal widths."""
    stats = row_scalar(df.agg(F.percentile(F.unix_date(DATE).cast("double"), float(min_frac)).alias("lo"),
                              F.max(F.unix_date(DATE)).cast("double").alias("hi")))
    day = F.unix_date(DATE).cast("double")
    edge = lambda i: stats["lo"] + (stats["hi"] - stats["lo"]) * (i / n)
    cands = []
    for i in range(n):
        upper = day < edge(i + 1) if i < n - 1 else day <= stats["hi"]
        cands += _fold(i, day < edge(i) - gap, (day >= edge(i)) & upper)
    return _folds(df, cands)


def per_series_chrono_split(df: DataFrame, val_ratio: float = 0.2) -> DataFrame:
    """First floor(n * (1 - r)) rows of each series train; series too short for one go to val."""
    n = F.count("*").over(Window.partitionBy(*SERIES))
    train = F.row_number().over(series_window()) <= F.floor(n * (1 - val_ratio))
    return df.select("*", F.when(train, "train").otherwise("val").alias("role"))


def tail_val_split(df: DataFrame, frac: float = 0.15, gap: int = 7) -> DataFrame:
    """Validation at the end of time; rows inside the gap before it take role gap."""
    cut = day_quantile(df, DATE, 1 - frac)
    day = F.unix_date(DATE)
    role = F.when(day >= cut, "val").when(day < cut - gap, "fit").otherwise("gap")
    return df.select("*", role.alias("role"))


def tail_rows_split(df: DataFrame, frac: float = 0.15, gap_rows: int = 5) -> DataFrame:
    """The same by row position within each series, for data without usable dates."""
    pos = F.row_number().over(series_window()) - 1
    start = F.floor(F.count("*").over(Window.partitionBy(*SERIES)) * (1 - frac))
    role = F.when(pos >= start, "val").when(pos < start - gap_rows, "fit").otherwise("gap")
    return df.select("*", role.alias("role"))


def quantile_cv(df: DataFrame, probs: Sequence[float] = (0.4, 0.6, 0.8)) -> DataFrame:
    """Expanding folds cut at date quantiles; the last fold validates on the rest."""
    q = df.agg(F.percentile(F.unix_date(DATE).cast("double"), [float(p) for p in probs])).scalar()
    day = F.unix_date(DATE).cast("double")
    cands = []
    for i in range(len(probs)):
        val = day >= q[i]
        if i + 1 < len(probs):
            val = val & (day < q[i + 1])
        cands += _fold(i, day < q[i], val)
    return _folds(df, cands)


def purge_by_target_date(df: DataFrame, split, target_date: str | None, horizon: int,
                         tolerance: int = 3) -> DataFrame:
    """Column purged: the target (or the latest it could be) reaches the split date."""
    cut = split if isinstance(split, Column) else F.lit(split).cast("date")
    if target_date and target_date in df.columns:
        leak = _on_or_after(target_date, cut)
    else:
        leak = F.coalesce(F.col(DATE) > F.date_sub(cut, horizon + tolerance), F.lit(False))
    return df.select("*", leak.alias("purged"))


def purge_masks(df: DataFrame, split: str, target_date: str) -> DataFrame:
    """clean_train, is_eval and leaks flags for one split date."""
    cut = F.to_date(F.lit(split))
    before = F.coalesce(F.col(DATE) < cut, F.lit(False))
    leaks = before & _on_or_after(target_date, cut)
    return df.select("*", (before & ~leaks).alias("clean_train"),
                     _on_or_after(DATE, cut).alias("is_eval"), leaks.alias("leaks"))


def named_period_split(df: DataFrame, periods: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Rows tagged with every (fold, role) whose inclusive date range holds them."""
    cands = [F.when(F.col(DATE).between(F.lit(a).cast("date"), F.lit(b).cast("date")),
                    F.struct(F.lit(fold).alias("fold"), F.lit(role).alias("role")))
             for fold, role, a, b in periods]
    return _folds(df, cands)


def year_split(df: DataFrame, train_to: int = 2014, val_to: int = 2016) -> DataFrame:
    y = F.col("year")
    return df.select("*", F.when(y <= train_to, "train").when(y <= val_to, "val").otherwise("test").alias("role"))


def rolling_origin_folds(df: DataFrame, val_years: Sequence[int] = (2012, 2013, 2014, 2015, 2016),
                         first_year: int = 2000) -> DataFrame:
    """Expanding year folds, all in one frame: train on the years before, validate on the year."""
    y = F.col("year")
    cands = []
    for i, v in enumerate(val_years, start=1):
        cands += _fold(i, (y >= first_year) & (y < v), y == v)
    return _folds(df, cands)


# --- audits -----------------------------------------------------------------------

def leakage_audit(split: DataFrame, target_date: str, features: Sequence[str] = (), target: str = "") -> DataFrame:
    """(check, passed) rows from one aggregate over a frame with a role column."""
    train = F.col("role") == "train"
    test = F.col("role") == "test"
    stats = split.agg(
        F.max(F.when(train, F.col(DATE))).alias("train_max"), F.min(F.when(test, F.col(DATE))).alias("test_min"),
        F.max(F.when(train, F.col(target_date))).alias("train_target_max"),
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"))
    c = F.col
    checks = {
        "train_before_test": c("train_max") < c("test_min"),
        "no_train_target_in_test": F.coalesce(c("train_target_max") < c("test_min"), F.lit(True)),
        "both_sides_filled": (c("n_train") > 0) & (c("n_test") > 0),
        "target_not_a_feature": F.lit(target not in set(features)),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(e, F.lit(False)).alias("passed"))
                      for n, e in checks.items()])
    return stats.select(F.explode(pairs).alias("p")).select("p.*")


def fold_audit(folds: DataFrame) -> DataFrame:
    """Per fold: train years end before the validation year and the validation is one year."""
    train, val = F.col("role") == "train", F.col("role") == "val"
    y = F.col("year")
    stats = folds.groupBy("fold").agg(
        F.max(F.when(train, y)).alias("train_last"), F.min(F.when(val, y)).alias("val_first"),
        F.max(F.when(val, y)).alias("val_last"), F.count_if(train).alias("n_train"), F.count_if(val).alias("n_val"))
    return stats.select("*", F.coalesce((F.col("train_last") < F.col("val_first")) & (F.col("val_first") == F.col("val_last")),
                                        F.lit(False)).alias("passed"))


def lag_audit(panel: DataFrame, lag: str = "yield_lag1", value: str = "yield_kg_ha",
              keys: Sequence[str] = ("district", "season")) -> DataFrame:
    """Compare a row lag with the value of the calendar year before."""
    before = panel.select(*keys, (F.col("year") + 1).alias("year"), F.col(value).alias("_true"))
    joined = panel.join(before, [*keys, "year"], "left")
    have = F.col(lag).isNotNull() & F.col("_true").isNotNull()
    return joined.agg(
        F.count("*").alias("n_rows"), F.count_if(have).alias("compared"),
        F.count_if(have & (F.abs(F.col(lag) - F.col("_true")) > 1e-6)).alias("mismatches"),
        F.count_if(F.col(lag).isNotNull() & F.col("_true").isNull()).alias("year_gaps"))


def group_overlap(split: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Series only in train, only in test, in both, and the rows of test-only series."""
    per = split.groupBy(*keys).agg(F.count_if(F.col("role") == "train").alias("tr"),
                                   F.count_if(F.col("role") == "test").alias("te"))
    tr, te = F.col("tr") > 0, F.col("te") > 0
    return per.agg(F.count_if(tr & ~te).alias("train_only"), F.count_if(te & ~tr).alias("test_only"),
                   F.count_if(tr & te).alias("common"),
                   F.coalesce(F.sum(F.when(te & ~tr, F.col("te"))), F.lit(0)).alias("rows_in_test_only"))


def backtest_origins(df: DataFrame, n: int, seed: str, start: str, end: str, min_history: int = 30,
                     history: int = 60, max_gap: int = 7, ahead: int = 5) -> DataFrame:
    """n pseudo-random eligible origins with the last rows of their history.

    An md5 of seed and key gives every engine the same draw; the n smallest are
    a bounded top-n. History rows join on (series, row number) only.
    """
    w = series_window()
    f = w.rowsBetween(1, ahead)
    rows = df.select(
        *SERIES, DATE, "modal_price", F.row_number().over(w).alias("rn"),
        F.lead(DATE).over(w).alias("actual_date"), F.lead("modal_price").over(w).alias("actual_price"),
        F.when(F.count("modal_price").over(f) == ahead,
               F.max("modal_price").over(f) - F.min("modal_price").over(f)).alias("actual_range"))
    gap = F.datediff("actual_date", DATE)
    inside = lambda c: F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), *SERIES, F.col(DATE).cast("string")))
    origins = (rows.filter((F.col("rn") >= min_history) & gap.between(1, max_gap) & inside(DATE) & inside("actual_date"))
               .withColumn("draw", draw).orderBy("draw").limit(n))
    wanted = origins.select(
        *SERIES, F.col(DATE).alias("origin_date"), "actual_date", "actual_price", "actual_range",
        F.explode(F.sequence(F.greatest(F.col("rn") - history + 1, F.lit(1)), F.col("rn"))).alias("rn"))
    past = rows.select(*SERIES, "rn", F.col(DATE).alias("history_date"), F.col("modal_price").alias("history_price"))
    return past.join(wanted, [*SERIES, "rn"])


def seen_and_volume_flags(split: DataFrame, top_share: float = 0.2) -> DataFrame:
    """Test rows with: series seen in train, market among the largest by test rows."""
    test = split.filter("role = 'test'")
    seen = split.filter("role = 'train'").select(*SERIES).distinct().withColumn("_seen", F.lit(True))
    counts = test.groupBy("market").agg(F.count("*").alias("n"))
    # ranks one row per market, not the data
    ranked = counts.select("market", F.row_number().over(Window.orderBy(F.desc("n"), "market")).alias("rank"))
    keep = F.greatest(F.lit(1), F.floor(counts.agg(F.count("*")).scalar() * top_share))
    big = ranked.filter(F.col("rank") <= keep).select("market", F.lit(True).alias("_big"))
    return (test.join(seen, list(SERIES), "left").join(big, "market", "left")
            .select(*test.columns, F.coalesce("_seen", F.lit(False)).alias("seen"),
                    F.coalesce("_big", F.lit(False)).alias("high_volume")))
