"""Pack documents into sequences of a fixed number of tokens by linear grouping, small documents by best fit.

A document is its token ids and a closing id; one that is longer than a sequence is cut into whole sequences and a rest. How
well pieces fit depends on their lengths alone, so the plan is made from the number of pieces of each length, at most one
number per possible length, however many documents there are:

* Lengths above ``capacity / LARGE`` are sorted, cut into ``GROUPS`` groups of equal cardinality and rounded up to the
  longest of their group.
* For these few sizes the fewest sequences are found as a linear program over configurations, with columns generated by a
  knapsack; a configuration is used the whole number of times.
* Actual pieces take the places of their group, longest first, so that a sequence's free room is known exactly.
* What rounding left over, and all small pieces, longest first, go to the sequence with the least room that holds them, many
  equal pieces and many sequences of equal room at once; where none does, a new sequence opens.

The plan is a list of runs: the pieces of one length from rank ``first`` on, ``per`` to a sequence, go to the sequences from
``sequence`` on at ``offset``. A run of equal room is halved in room at least whenever it takes pieces, so their number is
bounded by the capacity and the groups (some 75,000 for 2048 tokens), not by the data. Ranks come from Spark: the
pieces of one length, however many, are dealt to about as many ranges as a range has rows, counted per range, and numbered
inside it. No task sees all pieces of a length and no document passes through the driver.

A null text is an empty one, a single closing id. Null and repeated ids and repeated rows are packed each. Other columns
are not looked at. An empty table gives no rows. Sequence ids run from 0 without gaps.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm.common import in_arrow, saved, slices

VOCABULARY, CLOSING = "word_bpe_49k.json", 0
#: Pieces above capacity / LARGE are grouped, into so many groups; gain of a configuration, in sequences, not worth a step.
LARGE, GROUPS, TOLERANCE = 4, 128, 3e-4
#: A word that stands alone between two others as one id; words encoded in one text; words a worker remembers.
BETWEEN, AT_ONCE, KEPT_WORDS = "0", 64, 300_000
#: Ends that are never joined to the letters before them; alphabets whose letters all Unicode versions agree on.
ENDS, LETTERS_BELOW = ".,;:!?)", "԰"


class Words:
    """Token ids of blank-separated words by the tokenizers library, each word once.

    The vocabulary drops blanks and joins nothing across them, so a text's ids are those of its words, one after the other.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.between = self.library.encode(BETWEEN, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        # few at a time: the library's own record of a text is many times its ids
        return [np.array(e.ids, "<u4") for at in range(0, len(texts), AT_ONCE)
                for e in self.library.encode_batch_fast(texts[at:at + AT_ONCE], add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        plain, other = [], []
        for w in words:
            (other if BETWEEN in w or "<|" in w or len(w) > 1000 else plain).append(w)
        groups = [plain[at:at + AT_ONCE] for at in range(0, len(plain), AT_ONCE)]
        for group, ids in zip(groups, self._encoded([f" {BETWEEN} ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.between[0])
            if len(self.between) != 1 or len(cuts) != len(group) - 1:
                other += group
                continue
            data, start = ids.tobytes(), 0
            for word, cut in zip(group, [*cuts.tolist(), len(ids)], strict=True):
                self.known[word] = data[4 * start:4 * cut]
                start = cut + 1
        for at in range(0, len(other), AT_ONCE):
            for word, ids in zip(other[at:at + AT_ONCE], self._encoded(other[at:at + AT_ONCE]), strict=True):
                self.known[word] = ids.tobytes()

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        parts = []
        for w in words:
            if w.isascii():
                w = w.lower()
            stem, end = w[:-1], w[-1:]
            parts.append((stem, end) if end in ENDS and stem.isalpha() and max(stem) < LETTERS_BELOW else (w, ""))
        self._learn([w for w in {p for pair in parts for p in pair} if w not in self.known])
        return [self.known[stem] + self.known[end] for stem, end in parts]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its closing id, and the offsets of the texts in them."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        encoded = split.flatten().dictionary_encode()
        spelled = self.ids(encoded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(spelled), "<u4")
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled)) // 4
        of = encoded.indices.to_numpy()
        size = lengths[of]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(lengths) - lengths)[of] - ends + size, size)
        last = np.append(0, ends)[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
        return np.insert(flat[at], last, CLOSING), np.append(0, last + np.arange(1, len(texts) + 1))


@functools.lru_cache(maxsize=1)
def words_of(path: str) -> Words:
    """One vocabulary per worker, with the words its tasks have met; Spark's tasks are the only threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(path)


def pieces(docs: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, text to written rows (doc_id, piece, start, length, ids_crc32, row), and ``ids`` where they are asked for."""
    path = path or public_tokenizers.path(VOCABULARY)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in slices(batches, "text"):
            ids, offsets = words.texts(batch.column("text"))
            size = np.diff(offsets)
            count = -(-size // capacity)
            owner = np.repeat(np.arange(len(size)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(size[owner] - start, capacity)
            at = offsets[owner] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"
    made = in_arrow(docs.select("doc_id", "text"), stage, schema + ", ids array<int>" * with_ids)
    return saved(made.withColumn("row", F.monotonically_increasing_id()), "pieces")


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (places per size) and how often each is used, at most what the demand fills.

    A linear program over all configurations: the one that the current prices of the sizes make worth most, a knapsack,
    enters the basis until none is worth more than a sequence. Uses are rounded down.
    """
    n = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    uses = demand / np.diag(basis)
    back = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = back >= 0
    for _ in range(50 * n):
        prices = np.linalg.solve(basis.T, np.ones(n))
        layers, worth = [], np.zeros(capacity + 1)
        for _ in range(int(capacity // sizes.min())):
            options = np.where(fits, worth[np.maximum(back, 0)] + prices[:, None], -1.0)
            choice = options.argmax(axis=0)
            better = options[choice, np.arange(capacity + 1)]
            layers.append(np.where(better > worth + 1e-12, choice, -1))
            worth = np.maximum(worth, better)
        if worth[capacity] <= 1 + TOLERANCE:
            break
        column, room = np.zeros(n), capacity
        for layer in reversed(layers):
            if layer[room] >= 0:
                column[layer[room]] += 1
                room -= int(sizes[layer[room]])
        change = np.linalg.solve(basis, column)
        steps = np.divide(uses, change, out=np.full(n, np.inf), where=change > 1e-9)
        leaves = int(steps.argmin())
        uses = np.maximum(uses - steps[leaves] * change, 0)
        uses[leaves] = steps[leaves]
        basis[:, leaves] = column
    left = demand.copy()
    made = []
    for i in np.argsort(-uses):
        column = np.rint(basis[:, i]).astype(np.int64)
        needed = column > 0
        times = int(min(np.floor(uses[i] + 1e-7), (left[needed] // column[needed]).min()))
        if times > 0:
            left -= column * times
            made.append((column, times))
    return made


class Plan:
    """Runs (length, first, count, per, sequence, offset) that pack so many pieces of each length."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = GROUPS):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self.used = dict.fromkeys(counts, 0)
        #: Runs of sequences by their room: (first sequence, number); rooms in use, sorted.
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []
        large = {s: n for s, n in sorted(counts.items(), reverse=True) if s > capacity // LARGE and n}
        self._whole(large.pop(capacity, 0))
        if large:
            self._grouped(large, groups)
        for length in sorted(counts, reverse=True):
            self._best_fit(length, counts[length] - self.used[length])

    def _place(self, length: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, per, sequence, offset))
        self.used[length] += count

    def _free(self, room: int, sequence: int, number: int) -> None:
        if room and number:
            if room not in self.open:
                self.open[room] = []
                bisect.insort(self.rooms, room)
            self.open[room].append((sequence, number))

    def _whole(self, count: int) -> None:
        if count:
            self._place(self.capacity, count, 1, self.sequences, 0)
            self.sequences += count

    def _grouped(self, large: dict[int, int], groups: int) -> None:
        lengths, numbers = np.array(list(large)), np.array(list(large.values()))
        ends = np.cumsum(numbers)
        each = -(-int(ends[-1]) // groups)
        cuts = np.append(np.arange(0, ends[-1], each), ends[-1])
        rounded = lengths[np.searchsorted(ends, cuts[:-1], side="right")]
        at = cuts[:-1].copy()
        # two groups whose longest pieces are equal are one size
        sizes, of = np.unique(rounded, return_inverse=True)
        demand = np.bincount(of, np.diff(cuts)).astype(np.int64)
        members = {i: np.flatnonzero(of == i).tolist() for i in range(len(sizes))}
        ranks = ends - numbers
        taken: dict[int, int] = {}
        for column, times in configurations(sizes, demand, self.capacity):
            places = [i for i in np.flatnonzero(column)[::-1].tolist() for _ in range(column[i])]
            # (sequences already given a piece, offset so far), cut finer place by place
            parts = [(self.sequences, times, 0)]
            self.sequences += times
            for size in places:
                finer = []
                for sequence, number, offset in parts:
                    while number:
                        group = members[size][0]
                        if at[group] == cuts[group + 1]:
                            members[size].pop(0)
                            continue
                        which = int(np.searchsorted(ends, at[group], side="right"))
                        length = int(lengths[which])
                        n = int(min(number, ends[which] - at[group], cuts[group + 1] - at[group]))
                        self.runs.append((length, int(at[group] - ranks[which]), n, 1, sequence, offset))
                        taken[length] = taken.get(length, 0) + n
                        finer.append((sequence, n, offset + length))
                        at[group] += n
                        sequence, number = sequence + n, number - n
                parts = finer
            for sequence, number, offset in parts:
                self._free(self.capacity - offset, sequence, number)
        # the ranks that the configurations left over, length by length
        for group, cut in enumerate(cuts[1:]):
            while at[group] < cut:
                which = int(np.searchsorted(ends, at[group], side="right"))
                n = int(min(ends[which], cut) - at[group])
                length, first = int(lengths[which]), int(at[group] - ranks[which])
                self.used[length] = first
                self._best_fit(length, n)
                at[group] += n
        self.used.update({int(s): int(n) for s, n in zip(lengths, numbers, strict=True)})

    def _best_fit(self, length: int, count: int) -> None:
        while count:
            i = bisect.bisect_left(self.rooms, length)
            if i == len(self.rooms):
                self._free(self.capacity, self.sequences, -(-count // (self.capacity // length)))
                self.sequences += -(-count // (self.capacity // length))
                continue
            room = self.rooms[i]
            sequence, number = self.open[room].pop()
            if not self.open[room]:
                del self.open[room], self.rooms[i]
            per = room // length
            full = min(number, count // per)
            if full:
                self._place(length, full * per, per, sequence, self.capacity - room)
                self._free(room - per * length, sequence, full)
                count -= full * per
            elif count:
                self._place(length, count, count, sequence, self.capacity - room)
                self._free(room - count * length, sequence, 1)
                full, count = 1, 0
            self._free(room, sequence + full, number - full)


def ranked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Written pieces with ``rank``, the place from 0 among the pieces of their length."""
    ranges = F.ceil(F.sqrt("count")).cast("long")
    dealt = rows.join(counts.select("length", ranges.alias("ranges")), "length").withColumn(
        "range", F.pmod(F.xxhash64("row"), F.col("ranges"))).drop("ranges")
    dealt = saved(dealt, "dealt")
    per_range = dealt.groupBy("length", "range").count()
    earlier = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("length", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "range").orderBy("row")
    numbered = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(saved(offsets, "offsets"), ["length", "range"]).withColumn("rank", F.col("rank") + F.col("before")).drop("range", "before")


def packed(rows: DataFrame, capacity: int = 2048, groups: int = GROUPS) -> DataFrame:
    """Written pieces with their ``sequence_id`` and ``offset``, without ``row``."""
    counts = saved(rows.groupBy("length").count(), "lengths")
    plan = Plan({r["length"]: r["count"] for r in counts.collect()}, capacity, groups)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (length, first) as one number: ranks of a length end where those of the next one start
        by_length = np.unique(runs[:, 0])
        base = np.append(0, np.cumsum([runs[runs[:, 0] == s, 2].sum() for s in by_length]))
        first = base[np.searchsorted(by_length, runs[:, 0])] + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = base[np.searchsorted(by_length, length)] + rank
            run = np.searchsorted(first, at, side="right") - 1
            at = at - first[run]
            per, sequence, offset = runs[run, 3:].T
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence + at // per), pa.array(offset + at % per * length)], [*kept, "sequence_id", "offset"])
    kept = [c for c in rows.columns if c != "row"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return in_arrow(ranked(rows, counts), stage, f"{schema}, sequence_id bigint, offset bigint")


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) of packed pieces that carry their ids: what a training step reads.

    A group is one sequence, at most the capacity in tokens.
    """
    piece = F.struct("offset", "doc_id", "ids")
    return rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
