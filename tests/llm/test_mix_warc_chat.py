import hashlib
import io

import pytest
from compare import compare, duck

from granary.llm import chat, mixing, queries, warc


@pytest.mark.parametrize("key", ["op9_mix", "op3_warc"])
def test_query_equals_sql(spark, folder, key):
    assert compare(spark, duck(folder), queries.QUERIES[key], queries.SQL[key], folder) is None


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, n_chars long")


def test_mix_edges(spark):
    rows = [(i, "w " * (i % 7), None if i % 5 == 0 else "ab"[i % 2], "x", 3) for i in range(200)]
    rows += [(None, "one two", "c", "x", 1), (None, None, "c", "x", 1), (7, "w " * 7, "b", "x", 1), (7, "w " * 7, "b", "x", 1)]
    got = mixing.mix(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for source in (None, "a", "b", "c"):
        part = [r for r in got if r.source == source]
        assert sum(r.size for r in part) == part[0].source_size
        assert sum(r.taken for r in part) == int(part[0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in part)
    targets = {r.source: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert mixing.mix(docs(spark, [])).count() == 0
    whole = mixing.mixed_documents(docs(spark, rows))
    assert whole.columns == ["doc_id", "text", "source", "target", "n_chars"]
    per = {}
    for r in got:
        if r.taken:
            per[r.doc_id, r.source] = per.get((r.doc_id, r.source), 0) + -(-r.taken // r.size)
    seen = {}
    for r in whole.collect():
        seen[r.doc_id, r.source] = seen.get((r.doc_id, r.source), 0) + 1
    assert all(abs(seen[k] - n) <= 1 for k, n in per.items()) and set(seen) == set(per)


def test_targets_are_a_level(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 300, "e": 20, "f": 5}
    got = {r.source: r.target for r in mixing.targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weight = dict(zip(sorted(sizes), [5, 2, 1, 5, 2, 1]))
    want, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not above:
            break
        want |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    want |= {s: left * weight[s] / total for s in open_}
    assert got == pytest.approx(want)


def test_warc_edges(spark):
    long = "é" * 600
    rows = [(1, "u", long), (2, None, long), (5, "http://a/\r\nX: y é", long), (None, "n", long), (3, "u", "x"), (4, "u", "x"), (6, "u", None), (7, "u", ""),
            (8, "u", "z\r\n\r\n\x00" * 400), (8, "u", "z\r\n\r\n\x00" * 400), (9, "u", "b" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(warc.archived(pages).collect(), key=lambda r: (r.page_id is not None, r.page_id))
    assert len(got) == len(rows)
    for r in got:
        payload = next(h for p, _, h in rows if p == r.page_id) or ""
        assert r.payload_digest == hashlib.sha1(payload.encode()).hexdigest()
        assert r.payload_bytes == len(payload.encode())
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == kinds[2] == kinds[None] == ("revisit", 5)
    assert all(kinds[i] == ("response", None) for i in (3, 4, 5, 6, 7, 8, 9))
    assert warc.archived(pages.limit(0)).count() == 0


def test_warc_faults_are_found():
    good = warc.record(1, "u", b"payload", None) + warc.record(2, "u", b"payload", 1)
    assert [f["WARC-Type"] for f, _ in warc.records(io.BytesIO(good))] == ["response", "revisit"]
    with pytest.raises(Exception):
        list(warc.records(io.BytesIO(good[:-9])))
    other = warc.record(1, "u", b"payl0ad", None)
    real = dict(next(warc.records(io.BytesIO(good)))[0])
    fields, block = next(warc.records(io.BytesIO(other)))
    assert fields["WARC-Block-Digest"] != real["WARC-Block-Digest"]
    with pytest.raises(ValueError):
        warc._page(real, block)


TEXTS = ["", None, "</s>[INST] ok [/INST]", "\\</s>\\\\<\\s>", "<<s>s>", "a\nb", "[", "[/INST]", "é\U0001F642", "<|endoftext|>", "x " * 3000]


def test_escape_is_reversible():
    for text in TEXTS:
        text = text or ""
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def want(turns):
    everything = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    learned = "".join(text or "" for role, text in turns if role == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(everything), len(learned), sha(learned)


def test_chat_edges(spark):
    convs = {i: [("user", t), ("assistant", t), (None, t), ("assistant", t), ("a\nb</s>", "x")] for i, t in enumerate(TEXTS)}
    convs[None] = [("system", "s"), ("user", "u")]
    convs[99] = [("assistant" if i % 2 else "user", f"t{i}") for i in range(3000)]
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    rows.append((100, None, "user", "late"))
    rows += [(100, 0, "user", "twice")] * 2
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in chat.read_back(chat.assembled(chat.format_turns(frame))).collect()}
    convs[100] = [("user", "twice")] * 2 + [("user", "late")]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want(turns)
        assert r.formatted_chars == sum(len(chat.escape(a or "")) + len(chat.escape(b or "")) + sum(map(len, chat.CONTROLS)) for a, b in turns)
    assert chat.read_back(chat.assembled(chat.format_turns(frame.limit(0)))).count() == 0


def test_chat_query(spark, folder):
    got = {r.conv_id: r for r in queries.QUERIES["op6_chat"](spark, folder).collect()}
    turns = {-1: [("user", TEXTS[2]), ("assistant", TEXTS[2])]}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(turns)
    for c, t in turns.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want(t)
