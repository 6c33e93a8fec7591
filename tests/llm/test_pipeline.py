import re
import sys

import corpus_pipeline
from test_bpe import LIBRARY
from test_jaccard import expected

from granary.llm import mixing, quality, secrets
from granary.llm.common import table


def test_stages_against_plain_versions(spark, folder):
    docs = table(spark, folder, "documents")
    names, rows = docs.columns, {}
    kept = corpus_pipeline.keep_good_quality(spark, docs, folder)
    good = {r.doc_id: r.text for r in kept.collect()}
    marks = {r.doc_id: r.quality for r in table(spark, folder, "labels").collect()}
    clean = {d for d, q in marks.items() if q == 1}
    assert len(clean & set(good)) >= 0.98 * len(clean) and len([d for d in good if marks.get(d) == 0]) <= 0.1 * sum(q == 0 for q in marks.values())
    one = corpus_pipeline.keep_one_of_near_copies(spark, kept, folder)
    want = {d for d, _, c in expected(list(good.items()), 5, 80, 100) if d == c}
    got = {r.doc_id: r.text for r in one.collect()}
    assert set(got) == want and one.columns == names
    red = corpus_pipeline.redact_secrets(spark, one, folder)
    pattern = re.compile(r"AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}")
    hidden = {r.doc_id: r.text for r in red.collect()}
    assert hidden == {d: pattern.sub(secrets.MASK, t) for d, t in got.items()} and red.columns == names
    mix = corpus_pipeline.mix_sources(spark, red, folder)
    assert mix.columns == names
    takes = {r.doc_id: -(-r.taken // r.size) for r in mixing.mix(red).collect() if r.taken}
    times = {}
    for r in mix.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == takes
    coded = corpus_pipeline.encode(spark, mix, folder)
    for r in coded.collect():
        assert list(r.token_ids) == LIBRARY.encode_ordinary(hidden[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_tokens", "token_ids"] and out.count() > 0


def test_repeated_rows_and_extra_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "e", "s", 1, True), (1, text, "e", "s", 1, True), (2, text, "e", "s", 1, True), (None, "x y", None, None, None, None), (3, None, None, None, None, None),
            (3, None, None, None, None, None), (4, "", "e", "s", 0, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, times boolean")
    out = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 4, None]
    assert corpus_pipeline.redact_secrets(spark, docs, "").count() == len(rows)
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {1, 2, None}
    for stage in (corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.redact_secrets, corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert stage(spark, docs.limit(0), "").count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).count() == len(rows)


def test_entry_lists_all():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert "granary.llm" in sys.modules
