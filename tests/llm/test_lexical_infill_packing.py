import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from compare import compare, duck
from tokenizers import Tokenizer

from granary.llm import infill, lexical, packing, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_ranked", "op12_infill"])
def test_equals_sql(spark, folder, name):
    assert compare(spark, duck(folder), queries.QUERIES[name], queries.SQL[name], folder) is None


def brute_ranking(docs, items, k):
    split = [(d, TERM.findall((t or "").translate(ASCII_LOWER))) for d, t in docs]
    full = [w for _, w in split if w]
    total, words = len(full), sum(map(len, full))
    df = {}
    for w in full:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    out = {}
    for item, text in items:
        best = {}
        for d, w in split:
            score = 0
            for term in TERM.findall((text or "").translate(ASCII_LOWER)):
                tf = w.count(term)
                if tf:
                    m = 25 + 75 * len(w) * total // words
                    score += math.floor(1000 * math.log((2 * total + 2) / (2 * df[term] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if d is not None and score > 0:
                best[d] = max(score, best.get(d, 0))
        out[item] = sorted((-s, d) for d, s in best.items())[:k]
    return {i: v for i, v in out.items() if v}


def results(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r.item_id, r["rank"])):
        got.setdefault(r.item_id, []).append((-r.score, r.doc_id))
        assert r["rank"] == len(got[r.item_id])
    return got


def test_ranking_edges(spark, monkeypatch):
    draw = random.Random(3)
    vocabulary = [f"w{int(draw.paretovariate(0.7))}é" for _ in range(800)]
    docs = [(i, ", ".join(draw.choices(vocabulary, k=draw.choice([1, 3, 20, 80])))) for i in range(500)]
    docs += [(600 + i, docs[0][1]) for i in range(40)] + [(None, docs[0][1]), (700, None), (701, ""), (702, " -- "), (3, docs[4][1]), (3, docs[3][1])]
    docs += [(703, "W1é " * 40_000 + "x" * 70_000), (704, "汉字İ naïve ÉÉ")]
    items = [(i, docs[i][1]) for i in range(0, 500, 25)] + [(900, "W1É w1é w1é;w2é"), (901, None), (902, "nowhere"), (None, "w1é"), (903, docs[0][1] * 3), (904, "汉字İ")]
    frame = spark.createDataFrame([(1.0, t, d, 7) for d, t in docs], "score double, text string, doc_id long, rank int").repartition(3)
    asked = spark.createDataFrame([(t, i, 0) for i, t in items], "text string, item_id long, n long")
    want = brute_ranking(docs, [i for i in items if i[0] is not None], 10)
    assert results(lexical.ranked(frame, asked, 10)) == want
    in_arrow = lexical.in_arrow

    def small_shards(df, stage, schema):
        def run(batches):
            lexical.SHARD_DOCS, lexical.FIRST, lexical.PIECE = 7, 2, 50
            yield from stage(batches)
        return in_arrow(df, run, schema)
    monkeypatch.setattr(lexical, "in_arrow", small_shards)
    assert results(lexical.ranked(frame, asked, 10)) == want
    monkeypatch.undo()
    assert lexical.ranked(frame.limit(0), asked, 10).count() == 0
    assert lexical.ranked(frame, asked.limit(0), 10).count() == 0


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "".join(random.Random(1).choices("ab ,Cé", k=5000)).encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 16)
    assert lexical.term_counts(text) == whole


def test_reading_stops_before_the_lists_end_and_loses_nothing(monkeypatch):
    monkeypatch.setattr(lexical, "FIRST", 16)
    draw = np.random.default_rng(2)
    texts = [np.unique(draw.zipf(1.4, draw.integers(5, 200)) % 3000, return_counts=True) for _ in range(5000)]
    sizes, n = np.array([len(t) for t, _ in texts]), np.array([f.sum() for _, f in texts])
    shard = lexical.Shard(np.arange(5000), n, pa.array([str(t) for ts, _ in texts for t in ts]), np.concatenate([f for _, f in texts]), sizes, 5000, int(n.sum()))
    longest = np.argsort(-np.diff(shard.start))[:400]
    for i in range(40):
        terms = draw.choice(longest, 6, replace=False)
        gains = draw.integers(1, 5000, 6)
        full = np.zeros(5000, np.int64)
        for t, g in zip(terms, gains, strict=True):
            docs, impact = shard.list_of(int(t))
            full[docs] += impact * g
        ids, scores = lexical.best_of(*shard.search(terms, gains, 10, 0), 10)
        order = np.lexsort((np.arange(5000), -full))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
        least = int(scores[4])
        ids, scores = shard.search(terms, gains, 10, least)
        assert sorted(ids.tolist()) == np.flatnonzero(full >= max(least, full[order[-1]])).tolist()
    # one list decides: the others are left as soon as all kept documents are met
    shard.read = 0
    shard.search(longest[:2], np.array([1_000_000, 1]), 3, 0)
    assert shard.read < len(shard.list_of(int(longest[0]))[0]) + len(shard.list_of(int(longest[1]))[0])


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (lines[:low], lines[low:high], lines[high:]))
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def test_infill_edges(spark, monkeypatch):
    draw = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\nb", "é汉🙂\nß\n\nx", "<P>", "a\n<M>\nb", "<P", "<S\n>", "P>\n<", "<<P\n<S<", "\r\n\r\n", "x" * 50_000, "line\n" * 20_000, "\x00\n\x7f"]
    texts += ["".join(draw.choices("ab\n<>PSMé", [4, 4, 3, 1, 1, 1, 1, 1, 2], k=draw.randint(1, 60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, None), (5, "a\nb"), (5, "a\nb")]
    frame = spark.createDataFrame([(t, 1, d) for d, t in rows], "text string, n long, doc_id long").repartition(2)
    want = sorted(((d, *plain_infill(d, t), t or "") for d, t in rows), key=str)

    def got():
        made = infill.restored(infill.transformed(frame))
        return sorted((tuple(r) for r in made.collect()), key=str)
    assert got() == want
    in_arrow = infill.in_arrow

    def small_blocks(df, stage, schema):
        def run(batches):
            infill.BLOCK = 3
            yield from stage(batches)
        return in_arrow(df, run, schema)
    frame = frame.where("length(text) < 1000")
    want = [w for w in want if 0 < len(w[-1]) < 1000 or (len(w[-1]) == 0 and w[0] == 1)]
    monkeypatch.setattr(infill, "in_arrow", small_blocks)
    assert got() == want
    assert infill.restored(infill.transformed(frame.limit(0))).count() == 0
    assert {r.form for r in infill.transformed(frame, rate=0).collect()} == {"plain"}


def filled(plan, counts):
    """Check a plan's places: every piece once, sequences without gaps or overlaps; the number of sequences."""
    seen = {length: np.zeros(n, bool) for length, n in counts.items()}
    parts = {}
    for length, first, n, per, sequence, offset in plan.runs:
        assert not seen[length][first:first + n].any()
        seen[length][first:first + n] = True
        for i in range(n):
            parts.setdefault(sequence + i // per, []).append((offset + i % per * length, length))
    assert all(v.all() for v in seen.values())
    for part in parts.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert set(parts) == set(range(plan.sequences))
    return plan.sequences


def first_fit(lengths, capacity):
    rooms = []
    for s in sorted(lengths, reverse=True):
        for i, room in enumerate(rooms):
            if room >= s:
                rooms[i] -= s
                break
        else:
            rooms.append(capacity - s)
    return len(rooms)


@pytest.mark.parametrize("low,high,n", [(1, 101, 3000), (26, 80, 2000), (30, 40, 2000), (1, 9, 2000), (51, 100, 500), (100, 101, 50), (20, 21, 333), (5, 6, 1)])
def test_plan_places_every_piece_once(low, high, n):
    lengths = np.random.default_rng(low).integers(low, high, n)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)}
    used = filled(packing.Plan(counts, 100), counts)
    assert -(-int(lengths.sum()) // 100) <= used <= math.ceil(1.01 * first_fit(lengths.tolist(), 100)) + 1
    filled(packing.Plan(counts, 100, groups=5), counts)


def test_configurations_beat_best_fit():
    # 6 of 52, 6 of 27, 6 of 25, 12 of 21 by first fit decreasing leave room that 52+27+21 and 27+27+25+21 would not
    counts = {52: 600, 29: 600, 27: 600, 21: 1200, 25: 0}
    lengths = [s for s, n in counts.items() for _ in range(n)]
    made = packing.Plan(counts, 100)
    assert filled(made, counts) <= first_fit(lengths, 100)


def test_words_equal_the_library(spark, folder):
    path = public_tokenizers.path(packing.VOCABULARY)
    library, words = Tokenizer.from_file(path), packing.Words(path)
    draw = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += [None, "", " \t\n\v\f\r", "0", "0 00 a0b", "Don't STOP'S İstanbul ΣΑΣ.", "é é. ́x a b c\x85d", "<|endoftext|> x<|startoftext|>y", "x" * 5000, "a,b. c!? (d) ''s", "汉字。 ק. ꙮ, 𞤀."]
    texts += ["".join(draw.choices("aZé0 .'\n<|>汉́ß", k=40)) for _ in range(300)]
    ids, offsets = words.texts(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 0]


def check_packed(rows, docs, capacity):
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start:start + capacity]
            want.append((d, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(v <= capacity for v in at.values())
    assert sum(at.values()) / capacity <= len(at) <= math.ceil(1.02 * first_fit([w[3] for w in want], capacity)) + 1


def test_packing_whole_table(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check_packed(queries.QUERIES["op13_packing"](spark, folder).collect(), docs, 2048)


def test_packing_edges(spark):
    docs = [(i, "word " * n) for i, n in enumerate([1, 7, 15, 16, 31, 32, 33, 300])] + [(None, None), (None, ""), (3, "word " * 16), (3, "word " * 16)] + [(50 + i, "a b c") for i in range(200)]
    frame = spark.createDataFrame([(t, 1, d, 2) for d, t in docs], "text string, row int, doc_id long, length int").repartition(3)
    rows = packing.pieces(frame, 16, with_ids=True)
    made = packing.packed(rows, 16)
    check_packed(made.collect(), docs, 16)
    whole = packing.sequences(made).collect()
    assert sorted(i for r in whole for i in r.ids) == sorted(i for r in rows.collect() for i in r.ids) and max(len(r.ids) for r in whole) <= 16
    assert packing.packed(packing.pieces(frame.limit(0), 16), 16).count() == 0
