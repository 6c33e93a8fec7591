"""Approximate nearest neighbours by learned partitions.

A bounded sample of distinct vectors gets its exact neighbour graph; the graph is cut into parts of equal size: seeded
by balanced halving of the vectors along their main direction, then refined by moving vertices to the part that
holds most of their neighbours, as far as the parts' room allows. A softmax classifier learns vertex -> share of
the neighbours in each part. Every vector of the table is then put into its most probable part, queries go to
several of their most probable parts, and the candidates there are ranked by exact distances in double precision.

How many parts a query visits is measured, not fixed: some vectors of the sample are kept out of the graph and the fit,
and their exact neighbours in the rest of it tell how many of the most probable parts hold ``RECALL`` of them. Vectors
without structure need most of the parts. In a table larger than the sample the neighbours are nearer than
those in the sample, so the number errs to the safe side.

Equal vectors share one entry: the smallest ids of a vector are kept, as many as a result can hold (k, and one
more as a query leaves itself out), so a vector that a third of the rows share costs one distance per query.
Vectors that are null, zero or hold a null or non-finite component take no part, neither do those of another
length than the most frequent one and rows without id; an empty table gives no rows. Rows that repeat an id with
another vector are candidates of their own; those with the query's id are never results. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import in_arrow, saved

#: Bound of the sample that the parts are learned from; neighbours per vertex; rows per part; least parts a query visits.
SAMPLE, GRAPH_K, PART_ROWS, PROBES = 8_192, 10, 128, 24
#: Share of the held-out vectors' neighbours that the visited parts hold; held-out vectors at most.
RECALL, HELD_OUT = 0.95, 512
ROUNDS, STEPS = 12, 300
#: Rows of a part that one task holds at once, and parts are dealt to at least as many groups.
BLOCK = 4_096


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Exact k nearest other rows of each row, in blocks."""
    out, norms = [], (x * x).sum(1)
    for at in range(0, len(x), 256):
        d = norms - 2 * x[at:at + 256] @ x.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def halved(x: np.ndarray, parts: int) -> np.ndarray:
    """Equal parts by halving along the direction of largest variance."""
    label = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), parts, 0)]
    while todo:
        rows, n, first = todo.pop()
        if n == 1:
            label[rows] = first
            continue
        centred = x[rows] - x[rows].mean(0)
        order = rows[np.argsort(centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1], kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], n // 2, first), (order[cut:], n - n // 2, first + n // 2)]
    return label


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Parts of nearly equal size that keep neighbours together."""
    label, room = halved(x, parts), int(np.ceil(len(x) / parts * 1.05))
    sizes = np.bincount(label, minlength=parts)
    for _ in range(ROUNDS):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        moved = 0
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if sizes[best[v]] < room:
                sizes[label[v]] -= 1
                sizes[best[v]] += 1
                label[v], moved = best[v], moved + 1
        if not moved:
            break
    return label


class Router:
    """Softmax regression on the vector and its squares' sum: probabilities of the parts."""

    def __init__(self, centre: np.ndarray, scale: float, weights: np.ndarray):
        self.centre, self.scale, self.weights = centre, scale, weights

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.concatenate([z, (z * z).mean(1, keepdims=True), np.ones((len(z), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self._inputs(x) @ self.weights

    @classmethod
    def fit(cls, x: np.ndarray, wanted: np.ndarray) -> Router:
        """Full-batch Adam on the cross entropy with the wanted shares of each row."""
        centre = x.mean(0)
        out = cls(centre, float(max((x - centre).std(), 1e-12)), np.zeros((x.shape[1] + 2, wanted.shape[1])))
        inputs, first, second = out._inputs(x), 0.0, 0.0
        for step in range(1, STEPS + 1):
            s = inputs @ out.weights
            s = np.exp(s - s.max(1, keepdims=True))
            grad = inputs.T @ (s / s.sum(1, keepdims=True) - wanted) / len(x) + 1e-5 * out.weights
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
            out.weights -= 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-9)
        return out


def learn(sample: np.ndarray, parts: int) -> Router:
    """The router of a sample."""
    graph = neighbours(sample, min(GRAPH_K, len(sample) - 1))
    label = balanced_parts(sample, graph, parts)
    wanted = np.zeros((len(sample), parts))
    near = np.concatenate([label[graph], label[:, None]], axis=1)
    np.add.at(wanted, (np.repeat(np.arange(len(sample)), near.shape[1]), near.ravel()), 1 / near.shape[1])
    return Router.fit(sample, wanted)


def measured_probes(router: Router, held: np.ndarray, rest: np.ndarray, k: int) -> int:
    """The least number of parts that hold ``RECALL`` of the exact k nearest rows of the held-out ones."""
    parts, norms, places = router.scores(rest).argmax(1), (rest * rest).sum(1), []
    for at in range(0, len(held), 256):
        q = held[at:at + 256]
        near = np.argpartition(norms - 2 * q @ rest.T, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-router.scores(q), axis=1, kind="stable"), axis=1)
        places.append(np.take_along_axis(place, parts[near], axis=1).ravel())
    places = np.sort(np.concatenate(places))
    return int(places[int(np.ceil(RECALL * len(places))) - 1]) + 1


def learned(entries: DataFrame, parts: int, k: int, probes: int) -> tuple[Router | None, int]:
    """The router of a bounded sample of the vectors and the parts to visit, at least ``probes``; fitted in one task."""
    if parts < 2:
        return None, 1
    sample = entries.orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).select("vector")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, visits = np.concatenate([_matrix(b.column("vector")) for b in batches if b.num_rows]), parts
        held = min(HELD_OUT, len(x) // 8) if parts > probes else 0
        router = learn(x[held:], parts)
        if held:
            visits = max(probes, measured_probes(router, x[:held], x[held:], min(k, len(x) - held)))
        yield pa.RecordBatch.from_arrays([pa.array([router.centre.tolist()]), pa.array([router.scale]), pa.array([router.weights.ravel().tolist()]),
                                          pa.array([visits], pa.int32())], ["centre", "scale", "weights", "visits"])
    fitted = in_arrow(sample, stage, "centre array<double>, scale double, weights array<double>, visits int").first()
    return Router(np.array(fitted.centre), fitted.scale, np.array(fitted.weights).reshape(-1, parts)), fitted.visits


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part, of the most frequent length."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = vectors.select("vec_id", x.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vector", lambda v: v != 0.0))
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return good.join(F.broadcast(length.select("n")), F.size("vector") == F.col("n"), "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by ``every``; at least ``probes`` parts are visited."""
    rows = saved(usable(vectors), "vectors")
    # -0.0 equals 0.0; both are one vector
    plain = F.transform("vector", lambda v: v + F.lit(0.0))
    # the limit per vector is taken within each task before the shuffle
    lowest = Window.partitionBy("vector").orderBy("vec_id")
    entries = rows.select("vec_id", plain.alias("vector")).distinct().withColumn("nth", F.row_number().over(lowest)).where(
        F.col("nth") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = saved(entries, "entries")
    count = entries.count()
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    if not count:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    parts = max(1, min(count // PART_ROWS, min(count, SAMPLE) // 32))
    router, visits = learned(entries, parts, k, probes)

    def route(column: str, n: int):
        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if router is None or not batch.num_rows:
                    best = np.zeros((batch.num_rows, 1), np.int32)
                else:
                    scores = router.scores(_matrix(batch.column("vector")))
                    best = np.argpartition(-scores, min(n, parts - 1), axis=1)[:, :n].astype(np.int32)
                at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(best.ravel())], [*batch.schema.names, column])
        return stage

    indexed = in_arrow(entries, route("part", 1), "vector array<double>, ids array<bigint>, part int")
    asked = in_arrow(queries, route("part", visits), "query_id bigint, vector array<double>, part int")
    # parts are split into blocks of rows by hash, and queries are copied to each block of their parts
    blocks = max(1, -(-count // parts // BLOCK))
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("vector"), F.lit(blocks)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = indexed.groupBy("part", "block").cogroup(asked.groupBy("part", "block"))
    schema = "query_id bigint, vec_id bigint, score double"

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if left.num_rows and right.num_rows:
            x, ids = _matrix(left["vector"].combine_chunks()), left["ids"].to_pylist()
            for query_id, q in zip(right["query_id"].to_pylist(), _matrix(right["vector"].combine_chunks()), strict=True):
                d = np.sqrt(((x - q) ** 2).sum(1))
                # entries up to the k + 1 nearest, with all ties: each holds one id at least
                near = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)])
                got = sorted((float(d[i]), v) for i in near for v in ids[i] if v != query_id)[:k]
                found.append((np.full(len(got), query_id), np.array([v for _, v in got], np.int64), np.array([s for s, _ in got], float)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0)] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = pairs.applyInArrow(rank, schema).dropDuplicates(["query_id", "vec_id", "score"])
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
