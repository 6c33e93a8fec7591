"""Ridge fits from sums equal the library's fits; grids, ablations and folds in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import metrics as M
from granary.operators import models as J
from granary.operators import tuning as G
from granary.session import materialize

NUMERIC, CATEGORICAL = ["a", "b", "c"], ["d", "s"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(7)
    made = []
    for i in range(900):
        a, b, c = (float(x) for x in draw.normal(size=3))
        d, s = f"d{i % 7}", "sw"[i % 2]
        y = 3 * a - b + (i % 7) + draw.normal()
        made.append((1990 + i % 10, a, b if i % 9 else None, 5.0, d if i % 50 else None, s, y, 10.0, 10.0 + y))
    return materialize(spark.createDataFrame(made, "year int, a double, b double, c double, d string, s string, delta double, baseline double, y double"), "rows")


@pytest.mark.parametrize("alpha", [0.01, 1.0, 300.0])
def test_coefficients_equal_the_fitted_ridge(spark, rows, alpha):
    # without missing values both impute nothing; categories unseen in training score as 0 in both
    full = rows.filter("b IS NOT NULL AND d IS NOT NULL")
    train, val = full.filter("year < 1997"), full.filter("year >= 1997")
    prep = J.prep_pipeline(NUMERIC, CATEGORICAL).fit(train)
    want = J.fit_delta_ridge(prep.transform(train).select("features", "delta"), "delta", alpha).transform(prep.transform(val))
    design = G.design_of(full, NUMERIC, CATEGORICAL, "delta")
    medians, fits = G.ridge_fits(full, design, [("v", 1997, 1999)], [alpha])["v"]
    cells = {n: x for n, x in zip([*design.names, "1"], fits[0], strict=True)}
    mine = sum((F.col(c) * cells[c] for c in NUMERIC), F.lit(cells["1"]))
    for c in CATEGORICAL:
        mine = mine + sum(F.when(F.col(c) == v, cells[f"{c}={v}"]).otherwise(0.0) for v in design.categories[c])
    assert cells["c"] == 0.0
    assert want.select(F.max(F.abs(mine - F.col("pred_delta")))).first()[0] < 1e-8


def test_grid_equals_plain_fits_with_medians_and_ablation(rows):
    data = [r.asDict() for r in rows.collect()]
    folds, alphas = [("late", 1997, 1999), ("one", 1995, 1995)], [0.5, 50.0]
    got = {(r.fold, r.dropped, r.alpha): r for r in G.ridge_grid(rows, NUMERIC, CATEGORICAL, "delta", "baseline", "y", folds, alphas, (None, "a", "d")).collect()}
    assert len(got) == 12 and sum(r.best for r in got.values()) == 2
    for name, first, last in folds:
        train = [r for r in data if r["year"] < first]
        test = [r for r in data if first <= r["year"] <= last]
        known = sorted(r["b"] for r in train if r["b"] is not None)
        medians = {"a": 0.0, "b": known[-(-len(known) // 2) - 1], "c": 5.0}
        levels = [("d", f"d{i}") for i in range(7)] + [("s", "s"), ("s", "w")]
        for dropped in ("none", "a", "d"):
            def matrix(rs, dropped=dropped, medians=medians):
                cols = [[medians[c] if r[c] is None else r[c] for r in rs] for c in NUMERIC if c != dropped]
                cols += [[float(r[c] == v) for r in rs] for c, v in levels if c != dropped]
                return np.array(cols).T
            x, z = matrix(train), matrix(test)
            y = np.array([r["delta"] for r in train])
            mean, spread = x.mean(0), x.std(0)
            keep = spread > 1e-9
            unit = (x - mean)[:, keep] / spread[keep]
            for alpha in alphas:
                beta = np.linalg.solve(unit.T @ unit + alpha * np.eye(keep.sum()), unit.T @ (y - y.mean()))
                e = y.mean() + ((z - mean)[:, keep] / spread[keep]) @ beta + 10.0 - np.array([r["y"] for r in test])
                r = got[name, dropped, alpha]
                assert r.n == len(test) and abs(r.mae - np.abs(e).mean()) < 1e-9 and abs(r.rmse - np.sqrt((e * e).mean())) < 1e-9 and abs(r.bias - e.mean()) < 1e-9
    for name, *_ in folds:
        full = {a: got[name, "none", a].mae for a in alphas}
        assert [a for a in alphas if got[name, "none", a].best] == [min(full, key=full.get)]


def test_sums_do_not_shuffle_rows(rows):
    design = G.design_of(rows, NUMERIC, CATEGORICAL, "delta")
    sums = G.year_sums(rows, design)
    per_year = (design.width + 3 + 2) * (design.width + 3 + 3) // 2
    assert sums.count() == 10 * per_year
    with pytest.raises(ValueError, match="no rows before"):
        G.ridge_fits(rows, design, [("first", 1990, 1990)], [1.0])


def test_bootstrap_draws_equal_a_plain_loop(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(M, "CLUSTER_BLOCK", 4)
    values = [(f"c{i:02d}", float(i), None if i == 3 else float(i * i % 7)) for i in range(11)]
    frame = spark.createDataFrame(values, "cluster string, b double, m double")
    got = {r.rep: (r.b, r.m) for r in M.bootstrap_replicates(frame, "cluster", ["b", "m"], 70, "s").collect()}
    want = {}
    for rep in range(1, 71):
        picked = [int(hashlib.md5(f"s|{rep}|{j}".encode()).hexdigest()[:8], 16) % 11 for j in range(11)]
        want[rep] = (sum(values[i][1] for i in picked), sum(values[i][2] or 0.0 for i in picked))
    assert got == want
    assert M.bootstrap_replicates(frame.limit(0), "cluster", ["b", "m"], 5).count() == 0
