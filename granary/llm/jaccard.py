"""Exact Jaccard join of documents on word n-grams by PartEnum signatures.

Two sets of sizes x and y with |x AND y| / |x OR y| >= s differ in at most (1 - s) / (1 + s) * (x + y) features. Sets are
put into bands of sizes whose ends differ by the factor s, so linked sets lie in one band or in neighbouring ones;
the signatures of scope j serve the links whose larger set is in band j, hence a set signs for its own band and
for the next. In a scope with at most k differing features the feature domain (64-bit hashes of n-grams) is cut into n1
first-level parts of n2 cells each. Some part holds at most k2 = 1 of the differences, so if every n2 - 1 of the n2 cells
of a part are enumerated as one signature, two linked sets share one. Bands with few differences take n2 = 4, which
makes their signatures hold more features; the others n2 = 2, with some parts to spare: then a set with no more
empty cells than there are spare ones need not sign for empty cells, for it shares a cell that is not empty.

After one shuffle by signature only shared signatures remain. Pairs are not enumerated within them: every text is
compared with one bucket leader (the smallest text of a bucket), the one it shares most signatures with, if these are half
of what a link needs; components are made of the links found, and only pairs of a bucket that lie in different components are compared after that, once
a bound has let them pass: the parities of 512 counts of features differ in at most as many places as the sets. So
no link between different components is lost, and a large group of near copies costs one comparison per member.
If a set shares at least t signatures with whatever it may link with, it does without those t - 1 of its own that
most others have: by one order of all signatures, the rarest one that two linked sets share is left to both. So
a passage that many unlike texts contain does not bring them together.

Texts are compared as classes of equal sets; a task signs for each class once. Null and empty texts have size 0, are
linked with nothing and are their own component; null ids are allowed, their rows are linked like others and carry
the smallest id reachable (null if there is none). Rows that repeat an id are documents of their own, with the same
id. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import discard, in_arrow, saved, slices
from granary.llm.graph import components

#: Differences below which four cells per part are used; spare cells of the other scopes.
SMALL_K, SPARE = 15, 5
#: Distinct texts of which a task remembers that it has signed for them.
REMEMBERED = 200_000
PARITY_BITS = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; of all words, if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for at in range(width):
        out = (out ^ hashes[at:at + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


@functools.lru_cache(maxsize=None)
def bands(p: int, q: int) -> list[int]:
    """First sizes of the bands for the similarity p / q, up to a size no text reaches."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] * q // p + 1)
    return starts


@functools.lru_cache(maxsize=4096)
def scope(band: int, p: int, q: int) -> tuple[int, int, int]:
    """Cells, cells per part and spare cells for links whose larger set is in a band; no cells where only equal sets link."""
    largest = bands(p, q)[band + 1] - 1
    k = 2 * largest * (q - p) // (q + p)
    if not k:
        return 0, 0, 0
    if k < SMALL_K:
        return 4 * ((k + 2) // 2), 4, 0
    n1 = (k + 1 + SPARE + 1) // 2
    return 2 * n1, 2, 2 * n1 - k - 1


@functools.lru_cache(maxsize=4096)
def _borders(cells: int) -> np.ndarray:
    return np.array([(i << 64) // cells for i in range(1, cells)], np.uint64)


def signatures(features: np.ndarray, p: int, q: int) -> np.ndarray:
    """The signatures of one non-empty sorted set."""
    size, starts, out = len(features), bands(p, q), []
    band = int(np.searchsorted(starts, size, "right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(features + np.uint64(1)), dtype=np.uint64)])
    for at in (band, band + 1) if size * q // p >= starts[band + 1] else (band,):
        cells, per_part, spare = scope(at, p, q)
        if not cells:
            continue
        cuts = np.concatenate([[0], np.searchsorted(features, _borders(cells)), [size]])
        values, used = np.diff(sums[cuts]), np.diff(cuts) > 0
        if per_part == 4:  # each three of a part's four cells
            values = np.repeat(values.reshape(-1, 4).sum(axis=1, dtype=np.uint64), 4) - values
            used[:] = True
        elif cells - used.sum() > spare:
            used[:] = True
        label = np.arange(cells, dtype=np.uint64) + np.uint64(at << 44)
        out.append(_mixed(values ^ _mixed(label + np.uint64(1)))[used])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parities(features: np.ndarray) -> np.ndarray:
    counts = np.bincount((features >> np.uint64(64 - 9)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.empty(0, np.uint64)]) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))


def _name(features: np.ndarray) -> bytes:
    return hashlib.blake2b(features.tobytes(), digest_size=16).digest()


def sets(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """(doc_id, text) to (doc_id, size, class, parity, signs); signs are null where the task has signed for the class."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches, "text"):
            rows = [shingles(text, width) for text in batch.column("text").to_pylist()]
            names, signs = [_name(x) for x in rows], []
            for x, name in zip(rows, names, strict=True):
                signs.append(np.empty(0, np.uint64) if name in seen or not len(x) else signatures(x, p, q))
                seen.add(name)
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, rows), pa.int64()), pa.array(names, pa.binary()),
                 _lists([parities(x).view(np.uint64) for x in rows]), _lists(signs)],
                ["doc_id", "size", "class", "parity", "signs"])
    return in_arrow(docs, stage, "doc_id bigint, size bigint, class binary, parity array<bigint>, signs array<bigint>")


def _features(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text) to (class, features)."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [shingles(text, width) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_name, rows), pa.binary()), _lists(rows)], ["class", "features"])
    return in_arrow(docs, stage, "class binary, features array<bigint>")


def _may_link(x: str, y: str, p: int, q: int) -> Column:
    """Bounds on sizes and parities; true for every linked pair."""
    low, high = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    differ = sum(F.bit_count(F.col(f"{x}.parity")[i].bitwiseXOR(F.col(f"{y}.parity")[i])) for i in range(PARITY_BITS // 64))
    return (low * q >= high * p) & (differ * (q + p) <= (low + high) * (q - p))


def _least_shared(x: int, y: int, p: int, q: int) -> int:
    """Signatures that linked sets of sizes x and y share at least.

    They differ in at most d features, so all but d cells of a scope are equal; a set leaves out no more empty ones
    than the scope has to spare.
    """
    low, high, d = min(x, y), max(x, y), (x + y) * (q - p) // (q + p)
    starts = bands(p, q)
    band_low, band_high = (int(np.searchsorted(starts, n, "right")) - 1 for n in (low, high))
    least = 0
    for at in {band_high, band_low + 1}:
        if band_low < at - 1 or at == band_high + 1 and low * q // p < starts[at]:
            continue
        cells, per_part, spare = scope(at, p, q)
        if cells:
            least += max(1, cells - d - spare) if per_part == 2 else 1
    return max(1, least)


def _least_shared_column(x: str, y: str, p: int, q: int) -> Column:
    """``_least_shared`` of two rows with the columns size and row_band, for sets whose sizes may link.

    The larger set's band serves the pair, and the next one too where both are of one band and both sign for the next.
    """
    low = F.when(F.col(f"{x}.size") <= F.col(f"{y}.size"), F.col(f"{x}.row_band")).otherwise(F.col(f"{y}.row_band"))
    high = F.when(F.col(f"{x}.size") <= F.col(f"{y}.size"), F.col(f"{y}.row_band")).otherwise(F.col(f"{x}.row_band"))
    differ = F.floor((F.col(f"{x}.size") + F.col(f"{y}.size")) * (q - p) / (q + p))

    def of(room: Column) -> Column:
        return F.when(room < 0, 0).when(room == 0, 1).otherwise(F.greatest(room - differ, F.lit(1)))
    both = (low["band"] == high["band"]) & low["signs_next"]
    return F.greatest(of(high["room"]) + F.when(both, of(high["next_room"])).otherwise(0), F.lit(1))


def _least_with_any_column(p: int, q: int) -> Column:
    """``_least_shared`` of a row with the columns size and row_band and whatever set its own may link with, at least.

    The scopes of a pair leave least room for the largest set of a range: the largest of the own band (served by both scopes),
    the largest of the next band (by the next scope), or the band's first size, which does not sign for the next band.
    """
    size, band = F.col("size"), F.col("row_band")
    largest = F.floor(size * q / p)

    def of(room: Column, other: Column) -> Column:
        return F.when(room < 0, 0).when(room == 0, 1).otherwise(F.greatest(room - F.floor((size + other) * (q - p) / (q + p)), F.lit(1)))
    own = F.least(largest, band["end"] - 1)
    return F.greatest(F.least(of(band["room"], own) + F.when(band["signs_next"], of(band["next_room"], own)).otherwise(0),
                              of(band["room"], band["first"]), F.when(band["signs_next"], of(band["next_room"], largest))), F.lit(1))


def _bands_of_sizes(classes: DataFrame, p: int, q: int) -> DataFrame:
    """The classes and row_band: the band of the size, its sizes, whether such a set signs for the next, and the room of both scopes.

    The room is the number of cells less the spare ones, 0 where cells are enumerated three by three, -1 where none are.
    A table of some hundred bands, whatever the input.
    """
    starts = bands(p, q)

    def room(band: int) -> int:
        cells, per_part, spare = scope(band, p, q)
        return (cells - spare if per_part == 2 else 0) if cells else -1
    of = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(starts[b]).cast("long").alias("first"), F.lit(starts[b + 1]).cast("long").alias("end"),
                            F.lit(room(b)).cast("long").alias("room"), F.lit(room(b + 1)).cast("long").alias("next_room"))
                   for b in range(len(starts) - 2)))
    own = F.get(F.filter(of, lambda s: (s["first"] <= F.col("size")) & (F.col("size") < s["end"])), F.lit(0))
    rows = classes.withColumn("_band", own)
    return rows.withColumn("row_band", F.struct("_band.band", "_band.first", "_band.end", "_band.room", "_band.next_room",
                                                (F.floor(F.col("size") * q / p) >= F.col("_band.end")).alias("signs_next"))).drop("_band")


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """Those of the written pairs (a, b) of class numbers that link, compared by their whole sets."""
    wanted = classes.join(pairs.select(F.col("a").alias("number")).union(pairs.select("b")).distinct(), "number")
    # written, so that its size is known when the joins with texts and sets are planned
    wanted = saved(wanted.select("number", "class", F.col("doc_id").alias("_id")), "wanted")
    texts = docs.join(wanted.select("_id").distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    full = saved(_features(texts, width).join(wanted.select("class", "number"), "class").select("number", "features"), "features")
    x, y = (full.select(F.col("number").alias(c), F.col("features").alias(f"{c}_set")) for c in "ab")
    common = F.size(F.array_intersect("a_set", "b_set"))
    both = pairs.join(x, "a").join(y, "b")
    links = saved(both.where(common * q >= (F.size("a_set") + F.size("b_set") - common) * p).select("a", "b").distinct(), "links")
    discard(full)
    return links


def _numbered(rows: DataFrame) -> DataFrame:
    """(class, number, doc_id, size, parity) of the sets that are not empty.

    A class has the number of its smallest row; where rows of different texts share an id, that of its hash.
    """
    classes = rows.where("size > 0").groupBy("class").agg(
        F.min("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("parity").alias("parity"))
    alone = F.count("*").over(Window.partitionBy("row")) == 1
    return classes.select("class", F.when(alone, F.col("row")).otherwise(_negative(F.xxhash64("class"))).alias("number"),
                          "doc_id", "size", "parity")


def _negative(x: Column) -> Column:
    return x.bitwiseOR(F.lit(-(1 << 63)))


def near_copies(docs: DataFrame, width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of documents; links are similarities of at least p / q.

    ``docs`` has doc_id (long) and text. component_id is the smallest doc_id reachable by links.
    """
    docs = docs.select("doc_id", "text")
    signing = saved(sets(docs, width, p, q).withColumn("row", F.coalesce("doc_id", _negative(F.xxhash64("class")))), "sets")
    classes = saved(_numbered(signing), "classes")
    rows = saved(signing.select("doc_id", "size", "class", "row"), "rows")

    by_sign = Window.partitionBy("sign").orderBy("row")
    signed = signing.select(F.explode("signs").alias("sign"), "row")
    shared = signed.select("sign", "row", F.lag("row").over(by_sign).alias("before"),
                           F.lead("row").over(by_sign).alias("after")).where("before IS NOT NULL OR after IS NOT NULL")
    named = rows.where("size > 0").select("row", "class").distinct().join(classes.select("class", "number"), "class").select("row", "number")
    # one exchange by signature serves the distinct rows and the window
    whole = Window.partitionBy("sign")
    shared = shared.select("sign", "row").join(named, "row").select("sign", "number").repartition("sign").distinct()
    buckets = saved(shared.select("sign", "number", F.min("number").over(whole).alias("leader"), F.max("number").over(whole).alias("top"))
                    .where("leader <> top").drop("top"), "buckets")
    discard(signing)

    banded = saved(_bands_of_sizes(classes.select("number", "size", "parity"), p, q).withColumn("needs", _least_with_any_column(p, q)), "banded")
    about = lambda c: banded.withColumnRenamed("number", c).alias(f"c{c}")
    # one comparison per class at first: with the leader it shares most signatures with. If these are not even half of what
    # linked sets share (other leaders may have the rest), their sets are not fetched; the pairs below include such pairs
    first = buckets.where("number <> leader").groupBy(F.col("leader").alias("a"), F.col("number").alias("b")).count()
    first = first.groupBy("b").agg(F.max(F.struct("count", "a")).alias("best")).select(F.col("best.a").alias("a"), "b", F.col("best.count").alias("shared"))
    likely = _may_link("ca", "cb", p, q) & (F.col("shared") * 2 >= _least_shared_column("ca", "cb", p, q))
    first = saved(first.join(about("a"), "a").join(about("b"), "b").where(likely).select("a", "b"), "pairs")
    links = _linked(first, docs, classes, width, p, q)
    roots = components(links)

    rooted = buckets.join(roots, F.col("number") == F.col("node"), "left").select(
        "sign", "number", F.coalesce("root", "number").alias("root")).repartition("sign")
    mixed = rooted.select("*", F.min("root").over(whole).alias("low"), F.max("root").over(whole).alias("high"),
                          F.count("*").over(whole).alias("times")).where("low <> high")
    commonest = Window.partitionBy("number").orderBy(F.desc("times"), "sign")
    ranked = mixed.select("sign", "number", "root", "times").join(banded.select("number", "needs"), "number").withColumn(
        "place", F.row_number().over(commonest)).where(F.col("place") >= F.col("needs"))
    open_rows = saved(ranked.select("sign", "number", "root").join(banded, "number"), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    # of what linked sets share, the one that leaves out more lacks all that is left out; the least number that remains
    # comes with the pair, so pairs are counted and dropped without leaving the JVM
    least = _least_shared_column("x", "y", p, q) - F.greatest("x.needs", "y.needs") + 1
    second = x.join(y, (F.col("x.sign") == F.col("y.sign")) & (F.col("x.number") < F.col("y.number"))
                    & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", p, q)).select(
        F.col("x.number").alias("a"), F.col("y.number").alias("b"), least.alias("least"))
    second = second.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("least").alias("least")).where("shared >= least").select("a", "b")
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = saved(second.join(tried, ["a", "b"], "left_anti"), "pairs")
    discard(open_rows, buckets)
    if not second.isEmpty():
        more = _linked(second, docs, classes, width, p, q)
        if not more.isEmpty():
            roots = components(links.union(more))

    ids = classes.select("class", "number", "doc_id").join(roots, F.col("number") == F.col("node"), "left").select(
        "class", "doc_id", F.coalesce("root", "number").alias("root"))
    lowest = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    ids = ids.join(lowest, "root").select("class", "component_id")
    return rows.select("doc_id", F.col("size").alias("n_shingles"), "class").join(ids, "class", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))
