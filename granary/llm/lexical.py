"""Ranked lexical search by NRA: impact-sorted lists read from the top, score intervals per document, no random access.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A forward index holds
each document's distinct terms with their frequencies; document and term totals and the document frequencies of the terms
asked for are counted over it. An impact is ``10^9 tf div (1000 tf + 8 m)`` with ``m = 25 + (75 n N) div L``, a term's
weight ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a score the sum of weight times impact over an item's terms, repeats
included: all integers, so that ties are exact.

A shard is a bounded number of documents of one task; its lists are sorted by impact. An item reads its lists in
blocks from the top. The lower score of a document sums what has been read of it, the upper one adds the next impact of each
list in which it was not met. Once the next impacts together are below the k-th best lower score, no unmet document can
be a result, and only documents whose upper score reaches the k-th are kept. Reading goes on, in the lists that some kept
document was not met in, until every kept interval is a single score: membership, ties and scores are then final. The k-th
score passes from shard to shard of a task as the next one's start, and the best k of all tasks are the answer, exactly.

Items are read in blocks by every shard, from the shared folder. Results with equal scores are ordered by doc_id. Null and
empty texts have no terms: such documents count for nothing, such items have no results. Rows with a null id are
counted but are no results; of rows that repeat an item's id the smallest text asks, of those that repeat a
document's id each is counted and the best is the result. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import in_arrow, qualified, saved, slices
from granary.session import scratch_path

#: Every separator becomes a blank and A-Z a-z; the bytes of characters beyond ASCII stay.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Bytes of text counted at once; documents and postings that end a shard; documents per task.
PIECE, SHARD_DOCS, SHARD_POSTINGS, TASK_DOCS = 1 << 20, 32_768, 3_000_000, 131_072
#: Postings of the first block of a list (later ones double); items scored at once; items in one pass.
FIRST, ITEM_ROWS, ITEMS_AT_ONCE = 256, 128, 1 << 18
#: Groups in which the tasks' results are merged first.
MERGES = 64


def term_counts(text: bytes) -> Counter:
    """Terms of a text and how often each occurs."""
    clean = text.translate(CLEAN)
    if len(clean) <= PIECE:
        return Counter(clean.split())
    total, at = Counter(), 0
    while at < len(clean):
        to = len(clean)
        if at + PIECE < to:
            to = clean.rfind(b" ", at + 1, at + PIECE)
            if to < 0:
                to = clean.find(b" ", at + PIECE)
                to = len(clean) if to < 0 else to
        total.update(clean[at:to].split())
        at = to
    return total


def forward_index(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, terms, tf) per row of (key, text)."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts = [term_counts(text or b"") for text in batch.column("text").cast(pa.binary()).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum(list(map(len, counts)), dtype=np.int64)]), pa.int32())
            terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
            tf = pa.array([n for c in counts for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([sum(c.values()) for c in counts], pa.int64()),
                 *(pa.ListArray.from_arrays(offsets, x) for x in (terms, tf))], [key, "n", "terms", "tf"])
    return in_arrow(rows.select(key, "text"), stage, f"{key} bigint, n bigint, terms array<string>, tf array<bigint>")


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, terms: pa.Array, tf: np.ndarray, sizes: np.ndarray, docs: int, words: int):
        encoded = terms.dictionary_encode()
        self.terms, of = encoded.dictionary, encoded.indices.to_numpy()
        self.ids, self.width, self.lists = ids, len(ids), {}
        self.codes, self.id_of = np.unique(ids, return_inverse=True)
        m = 25 + 75 * n * docs // words
        self.owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.owner])
        self.order = np.argsort(of, kind="stable")
        self.start = np.searchsorted(of[self.order], np.arange(len(self.terms) + 1))
        self.read = 0

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a term, largest impact first."""
        if term not in self.lists:
            at = self.order[self.start[term]:self.start[term + 1]]
            at = at[np.argsort(-self.impact[at], kind="stable")]
            self.lists[term] = self.owner[at], self.impact[at]
        return self.lists[term]

    def kth(self, lower: np.ndarray, k: int) -> int:
        """The k-th largest lower score, 0 while fewer documents are met; of a repeated id the largest counts."""
        if len(self.codes) < self.width:
            best = np.zeros(len(self.codes), np.int64)
            np.maximum.at(best, self.id_of, lower)
            lower = best
        return int(np.partition(lower, -k)[-k]) if len(lower) >= k else 0

    def search(self, terms: np.ndarray, gains: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all documents that may be among the k best, none below ``least``; scores are exact."""
        lists = [(*self.list_of(t), g) for t, g in zip(terms.tolist(), gains.tolist(), strict=True)]
        lower = np.zeros(self.width, np.int64)
        at, heads = [0] * len(lists), [int(impact[0]) * gain for _, impact, gain in lists]
        kept, alive = None, None
        active, block = list(range(len(lists))), FIRST
        while active:
            for i in active:
                docs, impact, gain = lists[i]
                to = min(at[i] + block, len(docs))
                met, more = docs[at[i]:to], impact[at[i]:to]
                if kept is not None:
                    mine = alive[met]
                    met, more = met[mine], more[mine]
                lower[met] += more * gain
                self.read += to - at[i]
                at[i] = to
                heads[i] = int(impact[to]) * gain if to < len(docs) else 0
            block *= 2
            active = [i for i in active if heads[i] > 0]
            above = max(least, self.kth(lower, k))
            # a list leaves when every kept document was met in it, or when it ends
            unmet = sum(heads[i] for i in active)
            if kept is None and (unmet < above or not active):
                kept = np.flatnonzero(lower > 0)
            if kept is not None:
                # next impacts of the lists in which a document was already met are no part of its upper score
                alive = np.zeros(self.width, bool)
                kept = kept[lower[kept] + unmet >= above]
                alive[kept] = True
                inside = np.zeros(self.width, np.int64)
                for i in active:
                    met = lists[i][0][:at[i]]
                    inside[met[alive[met]]] += heads[i]
                out = lower[kept] + unmet - inside[kept] < above
                alive[kept[out]] = False
                kept = kept[~out]
                active = [i for i in active if np.count_nonzero(alive[lists[i][0][:at[i]]]) < len(kept)]
        if kept is None:
            return self.ids[:0], lower[:0]
        return self.ids[kept], lower[kept]


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (id, score), ties by id, each id with its best score."""
    order = np.lexsort((-scores, ids))
    ids, scores = ids[order], scores[order]
    once = np.ones(len(ids), bool)
    once[1:] = ids[1:] != ids[:-1]
    ids, scores = ids[once], scores[once]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _shards(batches: Iterator[pa.RecordBatch], docs: int, words: int) -> Iterator[Shard]:
    held: list[pa.RecordBatch] = []

    def built() -> Shard:
        table = pa.Table.from_batches(held)
        terms, tf = (table.column(c).combine_chunks() for c in ("terms", "tf"))
        ids, n = (table.column(c).to_numpy() for c in ("doc_id", "n"))
        return Shard(ids, n, terms.flatten(), tf.flatten().to_numpy(), np.diff(terms.offsets.to_numpy()), docs, words)
    rows = postings = 0
    for batch in batches:
        sizes = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy())
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = min(int(np.searchsorted(sizes, before + SHARD_POSTINGS - postings)) + 1, at + SHARD_DOCS - rows, batch.num_rows)
            held.append(batch.slice(at, to - at))
            rows, postings, at = rows + to - at, postings + int(sizes[to - 1] - before), to
            if rows >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield built()
                held, rows, postings = [], 0, 0
    if held:
        yield built()


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) for items (item_id, text) against documents (doc_id, text)."""
    spark = docs.sparkSession
    forward = saved(forward_index(docs, "doc_id"), "forward")
    total, words = forward.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = forward_index(items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min("text").alias("text")), "item_id")
    asked = saved(asked.select("item_id", F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("item_id", "t.terms", "t.tf").toDF(
        "item_id", "term", "times"), "asked")
    found = forward.select(F.explode("terms").alias("term")).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1)))
    weighed = asked.join(found, "term").select("item_id", F.struct("term", (weight * F.col("times")).alias("gain")).alias("t")).where("t.gain > 0")
    weighed = saved(weighed.groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "item_id", F.col("t.term").alias("terms"), F.col("t.gain").alias("gains")), "weighed")
    passes = max(1, -(-weighed.count() // ITEMS_AT_ONCE))
    folder = scratch_path(spark, "items")
    weighed.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(passes)).cast("int")).write.partitionBy("pass").parquet(folder)
    place = qualified(spark, folder)
    # a task reads several partitions and keeps one list of the k best for all their shards; nothing is shuffled for that
    rows = forward.where("doc_id IS NOT NULL AND n > 0").coalesce(max(1, -(-total // TASK_DOCS)))

    def search_pass(number: int):
        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(place)
            source = pyarrow.dataset.dataset(f"{base}/pass={number}", filesystem=store, format="parquet")
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for shard in _shards(batches, total, words):
                for part in source.to_batches(batch_size=ITEM_ROWS, batch_readahead=1, fragment_readahead=1, use_threads=False):
                    _ask(shard, part, k, best)
                del shard  # before the next one is built
            for item, (ids, scores) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids), pa.array(scores)], ["item_id", "doc_id", "score"])
        return stage
    schema = "item_id bigint, doc_id bigint, score bigint"
    if not total or weighed.isEmpty():
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    merged = functools.reduce(DataFrame.union, (in_arrow(rows, search_pass(n), schema) for n in range(passes)))
    # the same id always falls in one group, so its best score is known there
    for group in ([F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))], []):
        order = Window.partitionBy("item_id", *group).orderBy(F.desc("score"), "doc_id")
        merged = merged.groupBy("item_id", "doc_id").agg(F.max("score").alias("score")) if group else merged
        merged = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return merged.select("item_id", "rank", "doc_id", "score")


def _ask(shard: Shard, part: pa.RecordBatch, k: int, best: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Add a shard's documents to the k best of a block of items."""
    terms, gains = part.column("terms"), part.column("gains")
    at = pc.index_in(terms.flatten(), value_set=shard.terms).fill_null(-1).to_numpy()
    gain = gains.flatten().to_numpy()
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy())])
    for item, first, last in zip(part.column("item_id").to_pylist(), cuts, cuts[1:], strict=False):
        here = at[first:last] >= 0
        if not here.any():
            continue
        ids, scores = best.get(item, (np.empty(0, np.int64),) * 2)
        more = shard.search(at[first:last][here], gain[first:last][here], k, int(scores[-1]) if len(scores) == k else 0)
        if len(more[0]):
            best[item] = best_of(np.concatenate([ids, more[0]]), np.concatenate([scores, more[1]]), k)
