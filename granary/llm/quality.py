"""Text quality by a regularised quadratic discriminant over document statistics.

A text becomes ``len(NAMES)`` statistics, shares as smoothed log odds and sizes as logarithms. Class means and
covariances come from sums over all labelled training rows, added up by Spark; each covariance is shrunk
towards the pooled one and towards a multiple of the identity, and factored once (Cholesky). The score of a text is
the logistic of the difference of its Mahalanobis log densities plus the log ratio of the class shares, divided by
the number of statistics so that clear cases still differ.

Null and empty texts have statistics too (all counts 0) and are scored like others. Labels that are null or of a
document that does not exist count for nothing, repeated labels and documents once each; with labels of one class
only every score is that class, with none 0.5. Rows with a null id are never held out and have no label. An empty
table gives no rows. Other columns than the text are no inputs; ``keep_good`` returns them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import in_arrow, saved, slices

NAMES = ("words", "word_length", "line_words", "upper", "digits", "stops", "symbols", "marks", "bars", "blanks",
         "all_upper_words", "odd_words", "ended_lines", "distinct_words", "top_word", "same_as_before", "distinct_lines")
#: Shares of the pooled covariance and of the identity in a class covariance.
POOLED, RIDGE = 0.1, 0.01

_STOPS, _MARKS = b".,;:'\"()-?", b"!"
_COMMON = np.zeros(256, bool)
_COMMON[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b" \t\n\r\x0b\x0c", *_STOPS, *_MARKS, *b"|"]] = True
_BYTES = np.arange(256)
_UPPER, _LOWER, _DIGIT = ((_BYTES >= a) & (_BYTES <= b) for a, b in ((65, 90), (97, 122), (48, 57)))
_BLANK = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_LEAD = (_BYTES & 0xC0) != 0x80


def _odds(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (max(whole - part, 0) + 0.5))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, read as a whole."""
    text = text or ""
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars, upper = int(counts[_LEAD].sum()), int(counts[_UPPER].sum())
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    often = Counter(words)
    n = len(words)
    odd = sum(1 for w in often for _ in range(often[w]) if not w.strip(".,;:!?'\"()").isalpha()) if n else 0
    return [
        math.log1p(n), math.log1p(chars / max(n, 1)), math.log1p(n / max(len(lines), 1)),
        _odds(upper, upper + int(counts[_LOWER].sum())), _odds(int(counts[_DIGIT].sum()), chars),
        _odds(sum(int(counts[b]) for b in _STOPS), chars), _odds(int(counts[~_COMMON].sum()), chars),
        _odds(int(counts[33]), chars), _odds(int(counts[124]), chars), _odds(int(counts[_BLANK].sum()), chars),
        _odds(sum(c for w, c in often.items() if len(w) > 1 and w.isupper()), n), _odds(odd, n),
        _odds(sum(line.rstrip()[-1] in ".!?" for line in lines), len(lines)), _odds(len(often), n),
        _odds(max(often.values(), default=0), n), _odds(sum(map(str.__eq__, words, words[1:])), n),
        _odds(len(set(lines)), len(lines))]


def _matrix(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return np.array([statistics(t) for t in batch.column(text).to_pylist()], float).reshape(-1, len(NAMES))


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, x)."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = _matrix(batch, "text")
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["doc_id", "x"])
    return in_arrow(docs.select("doc_id", "text"), stage, "doc_id bigint, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Discriminant:
    """Means, Cholesky factors and log priors of the classes 0 and 1."""

    def __init__(self, sums: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        total = sum(n for n, _, _ in sums.values())
        self.only = None if len(sums) == 2 else float(next(iter(sums), 0.5))
        self.classes: list[tuple[np.ndarray, np.ndarray, float]] = []
        if self.only is not None:
            return
        spread = {c: xx - np.outer(x, x) / n for c, (n, x, xx) in sums.items()}
        pooled = sum(spread.values()) / max(total - 2, 1)
        for c in (0, 1):
            n, x, _ = sums[c]
            cov = (1 - POOLED) * spread[c] / max(n - 1, 1) + POOLED * pooled
            size = np.trace(cov) / len(x)
            cov = (1 - RIDGE) * cov + RIDGE * max(size, 1e-6) * np.eye(len(x))
            factor = np.linalg.cholesky(cov)
            constant = math.log(n / total) - np.log(np.diag(factor)).sum()
            self.classes.append((x / n, np.linalg.inv(factor), constant))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        bad, good = (constant - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, constant in self.classes)
        return 1 / (1 + np.exp(-np.clip((good - bad) / x.shape[1], -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """From (x, quality): counts, sums and sums of products per class, added in Spark; a few hundred numbers come back."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    index = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs))
    terms = F.concat(F.array(F.lit(1.0)), F.col("x"), F.transform(index, lambda p: F.get("x", p.i) * F.get("x", p.j)))
    rows = labelled.where(F.col("quality").isin(0, 1)).select("quality", F.posexplode(terms)).groupBy("quality", "pos").agg(F.sum("col").alias("total"))
    found: dict[int, np.ndarray] = {}
    for quality, pos, total in rows.collect():
        found.setdefault(int(quality), np.zeros(1 + d + len(pairs)))[pos] = total
    sums = {}
    for c, v in found.items():
        xx = np.zeros((d, d))
        for (i, j), value in zip(pairs, v[1 + d:], strict=True):
            xx[i, j] = xx[j, i] = value
        sums[c] = int(v[0]), v[1:1 + d], xx
    return Discriminant(sums)


def _training(stats: DataFrame, labels: DataFrame) -> DataFrame:
    marks = labels.select(F.col("doc_id").alias("labelled"), "quality").where(~held_out(F.col("doc_id")))
    return stats.join(marks, F.col("doc_id") == F.col("labelled")).select("x", "quality")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; the held-out third gives no labels."""
    stats = saved(with_statistics(docs), "statistics")
    model = fit(_training(stats, labels))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])
    return in_arrow(stats, stage, "doc_id bigint, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of documents that score at least ``least``, with all their columns; fitted on all but held-out labels."""
    wanted = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("labelled")).distinct()
    some = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("labelled"), "left_semi")
    model = fit(_training(with_statistics(some), labels))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(model.score(_matrix(batch, "text")) >= least))
    return in_arrow(docs, stage, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
