import math
import random

import pytest
from compare import compare, duck

from granary.llm import queries, search, unigram


def test_search_equals_sql(spark, folder):
    assert compare(spark, duck(folder), queries.QUERIES["op5_search"], queries.SQL["op5_search"], folder) is None


def brute(docs, asked, k):
    split = [(d, (t or "").encode().lower().split()) for d, t in docs]
    mean, df = sum(len(w) for _, w in split) / len(split), {}
    for _, w in split:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = {}
    for q, text in asked:
        query, best = sorted(set((text or "").encode().lower().split())), {}
        for d, w in split:
            score = 0.0
            for term in query:
                tf = w.count(term)
                if tf:
                    score += math.log(1 + (len(docs) - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score > 0 and d is not None and d != q:
                best[d] = max(best.get(d, 0), score)
        out[q] = sorted(((-round(s, 6), d) for d, s in best.items()))[:k]
    return {q: v for q, v in out.items() if v}


def test_search_edges(spark):
    draw = random.Random(1)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}" for _ in range(3000)]
    docs = [(i, " ".join(draw.choices(vocabulary, k=draw.choice([1, 3, 20, 80])))) for i in range(600)]
    docs += [(600 + i, docs[0][1]) for i in range(60)] + [(None, "w1 w2"), (700, None), (701, ""), (3, "w5 w5 W6"), (3, docs[3][1]), (702, "w1 " * 40_000)]
    asked = [(d, t) for d, t in docs if d is not None and d % 50 == 0] + [(999, "w1 nowhere"), (998, None), (997, "nowhere")]
    frame = spark.createDataFrame([(t, d, 1.0) for d, t in docs], "text string, doc_id long, score double").repartition(3)
    got = {}
    for r in search.top_documents(frame, spark.createDataFrame(asked, "query_id long, text string"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 6), r.doc_id))
    assert {q: [v[1:] for v in sorted(rows)] for q, rows in got.items()} == brute(docs, asked, 10)
    empty = frame.limit(0)
    assert search.top_documents(empty, empty.selectExpr("doc_id query_id", "text")).count() == 0


def test_search_ids_repeated_across_shards(spark, monkeypatch):
    # shards of four rows in one task; ids 1 and 2 are in every shard, no shard holds a repeat of its own
    docs = []
    for n in range(12):
        docs += [(1, "red fox " + "pad " * n), (2, "red " + "pad " * n), (100 + n, "red fox den " + "pad " * (3 + n)), (200 + n, "fox " + "pad " * n)]
    asked = [(999, "red fox den"), (998, "fox"), (1, "red fox")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    in_arrow = search.in_arrow

    def small_shards(df, stage, schema):
        def run(batches):
            search.SHARD_DOCS = 4
            yield from stage(batches)
        return in_arrow(df, run, schema)
    monkeypatch.setattr(search, "in_arrow", small_shards)
    got = {}
    for r in search.top_documents(frame, spark.createDataFrame(asked, "query_id long, text string"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -round(r.score, 6), r.doc_id))
    assert {q: [v[1:] for v in sorted(rows)] for q, rows in got.items()} == brute(docs, asked, 10)


def test_pruning_skips_blocks_and_loses_nothing(monkeypatch):
    import numpy as np
    monkeypatch.setattr(search, "BLOCK", 8)
    draw = np.random.default_rng(2)
    docs = [draw.zipf(1.3, draw.integers(5, 200)) % 5000 for _ in range(2000)]
    found, freqs = zip(*(np.unique(d, return_counts=True) for d in docs))
    shard = search.Shard(list(range(2000)), list(found), list(freqs), 100.0)
    asked = list(range(0, 2000, 100))
    scored, real = [], shard._score
    shard._score = lambda active, *rest: (scored.append(len(active)), real(active, *rest))
    lists = {}
    for k in (5, 2000):
        lists[k] = search.Best(len(asked), k)
        shard.search(np.array(asked), [found[q] for q in asked], [np.ones(len(found[q])) for q in asked], lists[k])
        if k == 5:
            assert sum(scored) < shard.blocks * len(asked)
    for i, q in enumerate(asked):
        order = np.lexsort((lists[2000].ids[i], -lists[2000].scores[i]))[:5]
        assert lists[5].ids[i].tolist() == lists[2000].ids[i][order].tolist() and q not in lists[5].ids[i]


def plain_count(word, scores, byte):
    """Tokens of the best segmentation, one word by itself."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + scores[word[s:end]], -(best[s][1] - 0) + -1) for s in range(end) if word[s:end] in scores]
        options = [(a, -b) for a, b in options]
        if word[end - 1] not in scores:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * byte, best[end - 1][1] + n))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    return unigram.zipf_scores(public_tokenizers.path(unigram.VOCABULARY))


def test_scores_are_a_distribution(vocabulary):
    scores, byte = vocabulary
    assert sum(map(math.exp, scores.values())) <= 1 and byte < min(scores.values())


def test_counts_equal_plain_segmentation(spark, vocabulary, folder):
    draw = random.Random(4)
    texts = [None, "", " \t\n", "the the\x0bthe", "汉字 naïve 🙂🙂", "a" * 3000, "x▁y", "".join(draw.choices("etaoin éß汉", k=2000)), "\x1c\x85 z"]
    frame = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "the", 5), (3, texts[3], 5)], "doc_id long, text string, n long")
    table = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "1L AS n")
    frame = frame.union(table)
    known = {}
    want = sorted(((d, n, len((t or "").encode().split()), sum(
        known.setdefault(w, plain_count("▁" + w.decode(), *vocabulary)) for w in (t or "").encode().split())) for d, t, n in frame.collect()), key=str)
    got = sorted((tuple(r) for r in unigram.counted(frame).collect()), key=str)
    assert got == want
    assert unigram.counted(frame.limit(0)).count() == 0
    assert queries.QUERIES["op7_token_counts"](spark, folder).count() == table.count()


def test_trie_restarts(vocabulary, monkeypatch):
    words = ["▁" + w for w in ("the", "then", "there", "thereafter", "zebra", "zebras")]
    whole = unigram.Trie(*vocabulary)
    want = [whole.insert(w) for w in words]
    assert want == [plain_count(w, *vocabulary) for w in words]
    monkeypatch.setattr(unigram, "NODES", 3)
    monkeypatch.setattr(unigram, "KEPT_WORDS", 1)
    small = unigram.Trie(*vocabulary)
    assert [small.counts([w[1:]])[0][1] for w in words] == want
