import math
import zlib

import numpy as np
import pytest

from granary.llm import ann, quality, queries


def brute(rows, k, every):
    """Exact neighbours of (id, vector) rows."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(1))
            out[i] = sorted({(float(a), int(b)) for a, b in zip(d, ids) if b != i})[:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, near in want.items():
        limit = near[-1][0] if near else 0
        hits += sum(s <= limit + 1e-12 for _, s in got.get(q, []))
        total += len(near)
    return hits / max(total, 1)


def by_query(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def test_recall_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, 10, 100)
    got = by_query(queries.QUERIES["op8_neighbours"](spark, folder))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    assert recall(got, want) >= 0.9
    where = dict(rows)
    for q, near in got.items():
        for v, s in near:
            assert s == pytest.approx(math.dist(where[q], where[v]), abs=1e-12)


def test_ann_edges(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.round(draw.normal(size=3), 2)]) for i in range(300)]
    rows += [(i, [1.0, -0.0, 2.0]) for i in range(300, 500)] + [(0, rows[0][1])]
    bad = [(900, None), (1000, [0.0, 0.0, 0.0]), (1100, [1.0, float("nan"), 0.0]), (1200, [1.0, None, 1.0]), (1300, [float("inf"), 1.0, 1.0]),
           (1400, [1.0, 2.0]), (1500, []), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, score int").repartition(4)
    stored = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got, want = by_query(ann.nearest(frame, 10, 50)), brute(stored, 10, 50)
    assert set(got) == set(want)
    assert recall(got, want) == 1.0
    assert [v for v, _ in got[400]] == [*range(300, 310)] and got[400][0][1] == 0
    few = ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), 10, 1)
    assert {k: [v for v, _ in n] for k, n in by_query(few).items()} == {0: [1], 1: [0]}
    assert ann.nearest(frame.limit(0)).count() == 0
    assert ann.nearest(frame.where("vec_id = 900")).count() == 0


def test_recall_where_parts_are_left_out(spark):
    # 100 parts: no structure at all, and clusters, of which few parts are enough
    draw = np.random.default_rng(5)
    plain = draw.normal(size=(12_800, 64))
    clusters = draw.normal(size=(400, 64))[draw.integers(0, 400, 12_800)] + 0.2 * draw.normal(size=(12_800, 64))
    for x in (plain, clusters):
        x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        got, hits = by_query(ann.nearest(frame, 10, 100)), 0
        for i in range(0, len(x), 100):
            d = ((x - x[i]) ** 2).sum(1)
            d[i] = np.inf
            hits += len({v for v, _ in got[i]} & set(np.argpartition(d, 9)[:10].tolist()))
        print("recall", hits / (10 * len(got)))
        assert len(got) == 128 and hits / (10 * len(got)) >= 0.9


def test_probes_are_measured():
    draw = np.random.default_rng(6)
    plain, clusters = draw.normal(size=(4096, 64)), draw.normal(size=(200, 64))[draw.integers(0, 200, 4096)] + 0.1 * draw.normal(size=(4096, 64))
    many, few = (ann.measured_probes(ann.learn(x[256:], 64), x[:256], x[256:], 10) for x in (plain, clusters))
    assert few < 16 < many <= 64


def test_parts_are_balanced():
    x = np.random.default_rng(1).normal(size=(2000, 8))
    label = ann.balanced_parts(x, ann.neighbours(x, 8), 16)
    assert np.bincount(label, minlength=16).max() <= math.ceil(2000 / 16 * 1.05)


def test_quality_on_held_out(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op4_quality"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, r.predicted, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    bad, good = ([s for s, _, m in held if m == c] for c in (0, 1))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([p == m for _, p, m in held])
    kept = np.mean([p == 1 for _, p, m in held if m == 1])
    print(auc, accuracy, kept)
    assert auc > 0.95 and accuracy > 0.95 and kept > 0.98


def test_quality_edges(spark):
    texts = [None, "", " \n", "x", "word " * 50_000, "a|b|c\n" * 30, "\U0001F642" * 40]
    docs = spark.createDataFrame([(i, t, "e", "s", 0) for i, t in enumerate(texts)] + [(None, "x", None, None, None), (3, "x", "e", "s", 0)],
                                 "doc_id long, text string, score string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0), (4, 1, 0), (5, None, 1), (5, 0, 0), (6, 1, 0), (77, 1, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows)
    for part in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in quality.scored(docs, part).collect()} <= {0.5, 1.0}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_fit_equals_numpy(spark):
    draw = np.random.default_rng(4)
    x = {c: draw.normal(size=(200, len(quality.NAMES))) + c for c in (0, 1)}
    frame = spark.createDataFrame([(v.tolist(), c) for c, rows in x.items() for v in rows], "x array<double>, quality int")
    model = quality.fit(frame)
    pooled = sum(np.cov(v.T) * 199 for v in x.values()) / 398
    d = len(quality.NAMES)
    density = []
    for c in (0, 1):
        cov = 0.9 * np.cov(x[c].T) + 0.1 * pooled
        cov = 0.99 * cov + 0.01 * np.trace(cov) / d * np.eye(d)
        z = x[0] - x[c].mean(0)
        density.append(math.log(0.5) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    assert model.score(x[0]) == pytest.approx(1 / (1 + np.exp(-(density[1] - density[0]) / d)))
