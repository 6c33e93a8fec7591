import random
import re

import numpy as np
import pytest

from granary.llm import graph, jaccard, queries


def words_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def expected(rows, width, p, q):
    """Components by comparing every pair."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * q >= (len(sets[i]) + len(sets[j]) - both) * p:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(n):
        if texts and draw.random() < 0.7:
            w = draw.choice(texts[-40:]).split()
            for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8])):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            if draw.random() < 0.3:
                w += draw.choices(vocabulary, k=draw.randrange(1, 9))
        else:
            w = draw.choices(vocabulary, k=draw.choice([1, 2, 3, 4, 8, 15, 30, 60, 120, 300, 900]))
        texts.append(" ".join(w))
        rows.append((i, texts[-1].title() if draw.random() < 0.2 else texts[-1]))
    return rows


@pytest.mark.parametrize("width,p,q", [(4, 85, 100), (5, 80, 100), (1, 60, 100)])
def test_equals_all_pairs(spark, width, p, q):
    rows = corpus(width, 500) + [(1000, None), (1001, ""), (1002, " \t"), (3, "w1 w2 w3 w4 w5"), (None, "w1 w2 w3 w4 w5 w6"),
                                 (None, "W1 w2\x0bw3 w4 w5 w6"), (2000, "é É x"), (2001, "É É x"), (2002, "é É  X")]
    frame = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, size string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.near_copies(frame, width, p, q).collect()), key=str)
    assert got == expected(rows, width, p, q)


def groups_of_copies(n):
    """Three groups of n near copies: the second and third lie a little below the threshold from the first, one member of the third links."""
    draw = random.Random(7)
    base = [f"u{i}" for i in range(200)]
    second, third = list(base), list(base)
    for i in range(0, 200, 20):
        second[i] = f"s{i}"
    for i in range(5, 150, 18):
        third[i] = f"t{i}"
    rows = []
    for g, words in enumerate((base, second, third)):
        for i in range(n):
            copy = list(words)
            copy[draw.randrange(160, 200)] = f"c{g}_{i}"
            rows.append((g * 1000 + i, " ".join(copy)))
    between = [w if i > 60 else b for i, (w, b) in enumerate(zip(third, base))]
    return rows + [(5000, " ".join(between))]


def test_groups_of_copies_just_below_the_threshold(spark):
    rows = groups_of_copies(60)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in jaccard.near_copies(frame, 4, 85, 100).collect()), key=str)
    assert got == expected(rows, 4, 85, 100)
    assert 2 <= len({r[2] for r in got}) < 60


def test_empty(spark):
    assert jaccard.near_copies(spark.createDataFrame([], "doc_id long, text string"), 4, 85, 100).count() == 0


def test_linked_sets_share_a_signature():
    draw = np.random.default_rng(1)
    for size in [*range(1, 40), 80, 200, 700, 3000]:
        for p, q in ((85, 100), (80, 100), (60, 100)):
            for _ in range(6):
                x = np.unique(draw.integers(0, 2 ** 64, size, np.uint64))
                gone = draw.integers(0, 1 + size * (q - p) // q)
                y = draw.permutation(x)[gone:]
                room = max(0, size * q // p - size) if gone == 0 else 0
                y = np.unique(np.concatenate([y, draw.integers(0, 2 ** 64, draw.integers(0, room + 1), np.uint64)]))
                both = len(np.intersect1d(x, y))
                if both * q >= (len(x) + len(y) - both) * p and not np.array_equal(x, y):
                    shared = np.intersect1d(jaccard.signatures(x, p, q), jaccard.signatures(y, p, q)).size
                    assert shared >= jaccard._least_shared(len(x), len(y), p, q) >= 1


def test_least_shared_as_a_column(spark):
    from pyspark.sql import functions as F
    sizes = [*range(1, 45), 66, 67, 68, 80, 99, 100, 131, 800, 999, 1000, 1249, 20_000]
    for p, q in ((85, 100), (80, 100), (60, 100)):
        rows = spark.createDataFrame([(n,) for n in sizes], "size long")
        rows = jaccard._bands_of_sizes(rows, p, q)
        pairs = rows.alias("x").join(rows.alias("y"), (F.least("x.size", "y.size") * q >= F.greatest("x.size", "y.size") * p))
        got = pairs.select("x.size", "y.size", jaccard._least_shared_column("x", "y", p, q).alias("least")).collect()
        assert len(got) > len(sizes) and all(least == jaccard._least_shared(x, y, p, q) for x, y, least in got)


def test_components(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(50)] + [(draw.randrange(200, 400), draw.randrange(200, 400)) for _ in range(150)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(edges + [(None, 3), (9, 9)], "a long, b long")
    got = dict(graph.components(frame).collect())
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(frame.limit(0)).count() == 0


def test_query_equals_sql(spark, folder):
    from compare import compare, duck
    assert compare(spark, duck(folder), queries.QUERIES["op2_jaccard_join"], queries.SQL["op2_jaccard_join"], folder) is None


def texts_with_a_passage(n):
    """n long texts that have only a passage of 60 words in common, and for three of them a near copy each that keeps the passage."""
    draw = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(n):
        words = [f"d{i}_{j}" for j in range(draw.randrange(1500, 1800))]
        at = draw.randrange(1400)
        rows.append((i, " ".join(words[:at] + passage + words[at:])))
    for i in range(3):
        words = rows[i][1].split()
        for at in range(0, 1400, 60):
            words[at] = f"e{i}_{at}"
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_a_common_passage_brings_no_unlike_texts_together(spark, monkeypatch):
    rows = texts_with_a_passage(60)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    met, saved = [], jaccard.saved

    def counted(df, name, **options):
        back = saved(df, name, **options)
        if name == "open":
            x, y = back.select("sign", "number", "root"), back.selectExpr("sign", "number AS other", "root AS other_root")
            met.append(x.join(y, "sign").where("number < other AND root <> other_root").count())
        return back
    monkeypatch.setattr(jaccard, "saved", counted)
    got = sorted((tuple(r) for r in jaccard.near_copies(frame, 5, 80, 100).collect()), key=str)
    assert got == expected(rows, 5, 80, 100)
    assert len({r[2] for r in got}) == 60
    assert met and met[0] < 60


def test_signatures_left_out_are_fewer_than_any_link_shares(spark):
    for p, q in ((85, 100), (80, 100), (60, 100)):
        sizes = [*range(1, 500), 999, 1000]
        rows = jaccard._bands_of_sizes(spark.createDataFrame([(n,) for n in sizes], "size long"), p, q)
        for x, needs in rows.select("size", jaccard._least_with_any_column(p, q)).collect():
            assert 1 <= needs <= min(jaccard._least_shared(x, y, p, q) for y in range(-(-x * p // q), x * q // p + 1))
