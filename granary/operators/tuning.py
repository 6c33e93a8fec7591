"""Tuning from sums: one pass over the rows gives every ridge fit of a grid, a second one all of its errors.

A ridge fit needs only X'X and X'y. They are summed per year once, with missing values as 0 and an indicator beside
each number, so that a fold's own median can be put in afterwards. Running sums over the years are the training
sums of every expanding fold, and a fit of any penalty, with any feature left out, is one Cholesky solve of a
matrix as wide as the features. The second pass scores each validation row with all fits of its fold at once and
keeps sums of errors. Both passes combine inside the tasks: what is shuffled and what reaches the driver has the size
(years x features^2) and (fits), not that of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.models import SEED, assemble
from granary.session import in_arrow, materialize


class Design:
    """Columns of the model matrix: numbers with 0 for a missing one, their missing marks, categories, 1 and the label."""

    def __init__(self, numeric: Sequence[str], categories: dict[str, list[str]], label: str):
        self.numeric, self.categories, self.label = list(numeric), categories, label
        self.names = [*numeric, *(f"{c}={v}" for c, values in categories.items() for v in values)]
        self.width = len(self.names)

    def columns(self) -> list[str]:
        return [*self.numeric, *self.categories, self.label]

    def matrix(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Rows of features, and of missing marks for the numbers."""
        values = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in self.numeric]
        numbers = np.column_stack(values) if values else np.empty((batch.num_rows, 0))
        missing = np.isnan(numbers)
        marks = [np.array(batch.column(c).to_pylist(), object) == v for c, vs in self.categories.items() for v in vs]
        return np.column_stack([np.where(missing, 0.0, numbers), *(m.astype(float) for m in marks)]), missing.astype(float)


def design_of(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str) -> Design:
    """The categories are a dictionary of the table; they are collected, sorted by name."""
    seen = {c: sorted(r[0] for r in rows.select(c).distinct().collect() if r[0] is not None) for c in categorical}
    return Design(numeric, seen, label)


def year_sums(rows: DataFrame, design: Design, year: str = "year") -> DataFrame:
    """(year, i, j, value): the sums of products of every two columns of [features, missing marks, 1, label]."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            features, missing = design.matrix(batch)
            label = batch.column(design.label).cast(pa.float64()).to_numpy(zero_copy_only=False)
            whole = np.column_stack([features, missing, np.ones(len(label)), label])
            years = batch.column(year).to_numpy(zero_copy_only=False)
            for y in np.unique(years):
                part = whole[years == y]
                held[int(y)] = held.get(int(y), 0) + part.T @ part
        for y, sums in held.items():
            i, j = np.nonzero(np.triu(np.ones_like(sums)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), y)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], ["year", "i", "j", "value"])
    usable = rows.filter(F.col(design.label).isNotNull() & F.col(year).isNotNull()).select(F.col(year).cast("long").alias(year), *design.columns())
    return in_arrow(usable, stage, "year bigint, i int, j int, value double").groupBy("year", "i", "j").agg(F.sum("value").alias("value"))


def fold_medians(rows: DataFrame, design: Design, firsts: Sequence[int], year: str = "year") -> dict[int, np.ndarray]:
    """Medians of the numbers over the years before each fold's first, all in one pass; 0 where there are none."""
    names = [(v, c) for v in firsts for c in design.numeric]
    found = rows.filter(F.col(design.label).isNotNull()).agg(*[F.percentile_approx(F.when(F.col(year) < v, F.col(c)), 0.5, 100_000).alias(f"{v}_{k}")
                       for k, (v, c) in enumerate(names)]).first()
    values = dict(zip(names, found, strict=True))
    return {v: np.array([float(values[v, c] or 0.0) for c in design.numeric]) for v in firsts}


def solve_ridge(sums: np.ndarray, design: Design, medians: np.ndarray, alphas: Sequence[float], dropped: Sequence[str] = ()) -> np.ndarray:
    """(alphas x (features + intercept)) coefficients of ridge fits on standardised columns, from the training sums.

    A column without spread gets 0. The label is centred, so the intercept is not penalised.
    """
    d, k = design.width, len(design.numeric)
    put = np.zeros((d + 2, d + k + 2))  # [imputed features, 1, label] from the summed columns
    put[:d, :d] = np.eye(d)
    put[:k, d:d + k] = np.diag(medians)
    put[d, d + k] = put[d + 1, d + k + 1] = 1.0
    gram = put @ sums @ put.T
    n = gram[d, d]
    mean = gram[:, d] / n
    cov = gram / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov)[:d], 0.0))
    scale = np.maximum(np.sqrt(np.diag(gram)[:d] / n), 1e-300)
    used = np.flatnonzero((spread > 1e-9 * scale) & ~np.isin([x.split("=")[0] for x in design.names], list(dropped)))
    unit = cov[np.ix_(used, used)] / np.outer(spread[used], spread[used])
    target = cov[used, d + 1] / spread[used]
    out = np.zeros((len(alphas), d + 1))
    for row, alpha in enumerate(alphas):
        lower = np.linalg.cholesky(n * unit + alpha * np.eye(len(used)))
        beta = np.linalg.solve(lower.T, np.linalg.solve(lower, n * target)) / spread[used]
        out[row, used] = beta
        out[row, d] = mean[d + 1] - mean[used] @ beta
    return out


def ridge_fits(rows: DataFrame, design: Design, folds: Sequence[tuple[str, int, int]], alphas: Sequence[float],
               ablations: Sequence[str | None] = (None,), year: str = "year") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per fold (name, first and last validation year) the medians and the coefficients of (ablation, alpha) in that order."""
    width = design.width + len(design.numeric) + 2
    by_year: dict[int, np.ndarray] = {}
    for r in year_sums(rows, design, year).collect():
        by_year.setdefault(r.year, np.zeros((width, width)))[r.i, r.j] = r.value
    by_year = {y: s + np.triu(s, 1).T for y, s in by_year.items()}
    medians = fold_medians(rows, design, sorted({v for _, v, _ in folds}), year)
    fits = {}
    for name, first, _ in folds:
        before = [s for y, s in by_year.items() if y < first]
        if not before:
            raise ValueError(f"fold {name!r} has no rows before {first}")
        sums = np.sum(before, axis=0)
        fits[name] = medians[first], np.concatenate([solve_ridge(sums, design, medians[first], alphas, [a] if a else ()) for a in ablations])
    return fits


def ridge_grid(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, baseline: str, actual: str,
               folds: Sequence[tuple[str, int, int]], alphas: Sequence[float], ablations: Sequence[str | None] = (None,),
               year: str = "year") -> DataFrame:
    """(fold, dropped, alpha, n, mae, rmse, bias, r2, best) of every fit; ``best`` marks a fold's smallest MAE among the full fits."""
    spark = rows.sparkSession
    design = design_of(rows, numeric, categorical, label)
    fits = ridge_fits(rows, design, folds, alphas, ablations, year)
    models = [(a, x) for a in ablations for x in alphas]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: np.zeros((len(models), 6)) for name, *_ in folds}
        for batch in batches:
            features, missing = design.matrix(batch)
            y, base, years = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (actual, baseline, year))
            for name, first, last in folds:
                here = (years >= first) & (years <= last)
                if not here.any():
                    continue
                medians, coefficients = fits[name]
                x = features[here].copy()
                x[:, :len(medians)] += missing[here] * medians
                e = base[here, None] + x @ coefficients[:, :-1].T + coefficients[:, -1] - y[here, None]
                ones = np.ones_like(e)
                held[name] += np.stack([ones.sum(0), np.abs(e).sum(0), (e * e).sum(0), e.sum(0), y[here].sum() * ones[0], (y[here] ** 2).sum() * ones[0]], 1)
        for name, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(models)), pa.array(range(len(models)), pa.int32()), *(pa.array(s) for s in sums.T)],
                                             ["fold", "model", "n", "a", "s", "b", "y", "yy"])
    usable = rows.filter(F.col(actual).isNotNull() & F.col(baseline).isNotNull()).select(
        *dict.fromkeys([*design.columns(), baseline, actual]), year)
    sums = in_arrow(usable, stage, "fold string, model int, n double, a double, s double, b double, y double, yy double").groupBy("fold", "model").agg(
        *[F.sum(c).alias(c) for c in ("n", "a", "s", "b", "y", "yy")]).filter("n > 0")
    names = spark.createDataFrame([(i, a or "none", float(x)) for i, (a, x) in enumerate(models)], "model int, dropped string, alpha double")
    n = F.col("n")
    out = sums.join(names, "model").select(
        "fold", "dropped", "alpha", n.cast("long").alias("n"), (F.col("a") / n).alias("mae"), F.sqrt(F.col("s") / n).alias("rmse"), (F.col("b") / n).alias("bias"),
        (1 - F.col("s") / F.nullif(F.col("yy") - F.col("y") * F.col("y") / n, F.lit(0.0))).alias("r2"))
    out = materialize(out, "ridge-grid")
    best = out.filter("dropped = 'none'").groupBy("fold").agg(F.min_by("alpha", F.struct("mae", "alpha")).alias("_best"))
    return out.join(best, "fold").withColumn("best", (F.col("dropped") == "none") & (F.col("alpha") == F.col("_best"))).drop("_best")


def tree_grid(train: DataFrame, val: DataFrame, features: Sequence[str], label: str, depths: Sequence[int], rates: Sequence[float],
              trees: Sequence[int]) -> DataFrame:
    """(depth, rate, trees, mae, best): one boosted fit per depth and rate; every number of trees is a prefix of it."""
    tr, va = (materialize(assemble(d.filter(F.col(label).isNotNull()), features).select("features", label), "tree-grid") for d in (train, val))
    made = []
    for depth in depths:
        for rate in rates:
            model = GBTRegressor(featuresCol="features", labelCol=label, lossType="absolute", maxIter=max(trees), maxDepth=depth, stepSize=rate, seed=SEED,
                                 minInstancesPerNode=3, subsamplingRate=0.8).fit(tr)
            losses = model.evaluateEachIteration(va, "absolute")
            made += [(depth, float(rate), n, float(losses[n - 1])) for n in trees]
    least = min(m[3] for m in made)
    best = next(m for m in made if m[3] == least)
    return train.sparkSession.createDataFrame([(*m, m == best) for m in made], "depth int, rate double, trees int, mae double, best boolean")
