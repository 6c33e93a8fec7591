"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import ann, bpe, chat, infill, jaccard, lexical, mixing, packing, quality, search, secrets, unigram, warc
from granary.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_copies(table(spark, folder, "documents"), width=4, p=85, q=100)


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).drop("url")


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op5_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return search.top_documents(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)


@query
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"),
                                    F.lit("</s>[INST] ok [/INST]"))
    return chat.read_back(chat.assembled(chat.format_turns(turns.union(planted))))


@query
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.counted(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"), k=10, every=100)


@query
def op9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).drop("source")


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents")).withColumn("value_sha256", F.sha2("value", 256)).drop("value")


@query
def op11_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


@query
def op12_infill(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.restored(infill.transformed(table(spark, folder, "documents").select("doc_id", "text"), seed=7, rate=100, spm=50))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


@query
def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(packing.pieces(table(spark, folder, "documents").select("doc_id", "text"), capacity=2048), capacity=2048)


SQL["op9_mix"] = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, ''))) AS key FROM documents),
per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM per_source),
ranked AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0) AS words_left,
    sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left,
    row_number() OVER (ORDER BY source_size::DOUBLE / w, source NULLS LAST) AS place
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT min(place) AS open_at FROM ranked WHERE words_left * w <= cap * w_left),
goals AS (
  SELECT r.source, r.source_size,
    CASE WHEN r.place >= open_at THEN (o.words_left * r.w / o.w_left)::DOUBLE ELSE r.cap END AS target
  FROM ranked r CROSS JOIN opened LEFT JOIN ranked o ON o.place = open_at),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
    CAST(floor(floor(g.target) / greatest(g.source_size, 1)) AS BIGINT) AS epochs,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

SQL["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d
"""

SQL["op2_jaccard_join"] = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1),
    lambda i: array_to_string(words[i:i + 3], ' '))) END AS features FROM split),
features AS MATERIALIZED (SELECT doc_id, hash(unnest(features)) AS f FROM sets),
sizes AS MATERIALIZED (SELECT doc_id, CAST(len(features) AS BIGINT) AS n FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM features a JOIN features b ON a.f = b.f AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT e.y, r.seen FROM reach r JOIN edges e ON e.x = r.doc_id)
SELECT s.doc_id, s.n AS n_shingles, min(r.seen) AS component_id FROM sizes s JOIN reach r USING (doc_id) GROUP BY ALL
"""

SQL["op5_search"] = """
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
stats AS (SELECT count(*) AS total, sum(len(words)) / count(*) AS mean FROM split),
postings AS MATERIALIZED (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM split) GROUP BY ALL),
weights AS MATERIALIZED (
  SELECT doc_id, term, ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)))::DOUBLE AS w
  FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM postings), stats),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(d.w), 6) AS score
  FROM weights q JOIN weights d ON q.term = d.term AND q.doc_id <> d.doc_id WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL["op11_ranked"] = """
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
totals AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS words FROM lowered WHERE len(terms) > 0),
postings AS MATERIALIZED (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM lowered) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

SQL["op12_infill"] = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS lines,
    sha256('7:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents),
numbers AS (
  SELECT doc_id, text, lines, CAST(len(lines) AS BIGINT) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2,
    ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4 FROM drawn),
cut AS (
  SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high FROM numbers),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle,
    array_to_string(lines[high + 1:], '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
