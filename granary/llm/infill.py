"""Fill-in-middle documents: every byte of a batch is moved by a displacement, found by prefix sums.

A text is a sequence of lines. Two cuts, drawn from the digest of the seed and the document's id, part its lines into
prefix, middle and suffix; the output has the three in one of two other orders, each behind its mark. A batch of texts is
one run of bytes: the scan for line ends gives the cuts, a difference array holds, where a part starts, how much farther
than the part before it is moved, its running sum is each byte's shift, and one scatter writes all outputs at once. The way
back scans an output for its marks, builds the inverse displacement in the same way and gathers the bytes. Both directions
work in blocks of ``BLOCK`` bytes, so that a very long text costs its own size and little more.

A null text is an empty one. Texts without lines and texts that hold a mark stay plain. Of a null id the digest takes the
seed alone. Repeated rows are transformed each, and alike. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import in_arrow, slices

#: Marks of prefix, suffix and middle, all of MARK bytes.
PREFIX, SUFFIX, MIDDLE, MARK = b"<P>", b"<S>", b"<M>", 3
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
#: Bytes moved at once.
BLOCK = 1 << 20


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, nulls as empty, and the offsets of its rows."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def as_texts(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
    return texts.cast(pa.string())


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of every mark that lies within one row."""
    if len(data) < MARK:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.flatnonzero((data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]))
    at = at[np.isin(data[at + 1], [m[1] for m in (PREFIX, SUFFIX, MIDDLE)])]
    row = np.searchsorted(offsets, at, side="right") - 1
    whole = at + MARK <= offsets[row + 1]
    return row[whole], at[whole]


def displaced(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Blocks of the bytes 0 to size with each byte's other place; part i, from starts[i] on, is moved by shifts[i]."""
    steps = np.diff(shifts, prepend=0)
    shift = 0
    for low in range(0, size, BLOCK):
        high = min(low + BLOCK, size)
        first, last = np.searchsorted(starts, (low, high))
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, starts[first:last] - low, steps[first:last])
        difference[0] += shift
        moved = np.cumsum(difference)
        shift = int(moved[-1])
        yield slice(low, high), moved + np.arange(low, high)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions after line feeds, the first of each row's in that list, and the number of lines per row."""
    ends = np.flatnonzero(data == 10) + 1
    first = np.searchsorted(ends, offsets[:-1], side="right")
    feeds = np.searchsorted(ends, offsets[1:], side="right") - first
    open_end = (offsets[1:] > offsets[:-1]) & (data[np.maximum(offsets[1:] - 1, 0)] != 10) if len(data) else np.zeros(len(feeds), bool)
    return ends, first, feeds + open_end


def cut_after(lines: np.ndarray, count: np.ndarray, ends: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte position after so many lines of each row."""
    last = np.append(ends, 0)[np.minimum(first + lines - 1, len(ends))] if len(ends) else np.zeros(len(lines), np.int64)
    return np.where(lines == 0, offsets[:-1], np.where(lines == count, offsets[1:], last))


def moved(data: np.ndarray, offsets: np.ndarray, b: np.ndarray, c: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of rows whose prefix ends at b and whose middle ends at c, with their offsets."""
    a, d = offsets[:-1], offsets[1:]
    out = np.concatenate([[0], np.cumsum(d - a + np.where(form == PLAIN, 0, 3 * MARK))])
    o = out[:-1] - a
    last = np.where(form == PLAIN, 0, 3 * MARK + d - c)
    prefix = np.choose(form, (o, o + MARK, o + 2 * MARK + d - c))
    suffix = np.choose(form, (o, o + 2 * MARK + b - c, o + MARK + a - c))
    made = np.empty(out[-1], np.uint8)
    for part, place in displaced(np.stack([a, b, c], 1).ravel(), np.stack([prefix, o + last, suffix], 1).ravel(), len(data)):
        made[place] = data[part]
    rows = np.flatnonzero(form != PLAIN)
    psm = form[rows] == PSM
    second = out[rows] + MARK + np.where(psm, (b - a)[rows], (d - c)[rows])
    third = out[rows] + 2 * MARK + (b - a + d - c)[rows]
    for at, first_form, other in ((out[rows], PREFIX, SUFFIX), (second, SUFFIX, PREFIX), (third, MIDDLE, MIDDLE)):
        for i in range(MARK):
            made[at + i] = np.where(psm, first_form[i], other[i])
    return made, out


def put_back(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs and their forms, with their offsets."""
    row, at = marks(data, offsets)
    at = at[form[row] != PLAIN].reshape(-1, 3)
    o, end = offsets[:-1], offsets[1:]
    rows = np.flatnonzero(form != PLAIN)
    # parts of an output: from, to; a plain one is all prefix
    begin, stop = np.stack([o, end, end], 1), np.stack([end, end, end], 1)
    begin[rows] = at + MARK
    stop[rows] = np.column_stack([at[:, 1:], end[rows]])
    order = np.array([[0, 1, 2], [0, 2, 1], [1, 2, 0]])[form]  # which part is prefix, middle, suffix
    begin, stop = np.take_along_axis(begin, order, 1), np.take_along_axis(stop, order, 1)
    ends = np.cumsum((stop - begin).ravel())
    starts = ends - (stop - begin).ravel()
    back = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for part, place in displaced(starts, begin.ravel() - starts, len(back)):
        back[part] = data[place]
    return back, np.concatenate([[0], ends[2::3]])


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, text to (doc_id, n, form, prefix_chars, middle_chars, output).

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of these with the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select("doc_id", "text", digest.alias("digest")).select("doc_id", "text", *draws)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = as_bytes(batch.column("text"))
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            ends, first, n = line_ends(data, offsets)
            cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            b, c = (cut_after(lines, n, ends, first, offsets) for lines in cuts)
            plain = (np.diff(offsets) == 0) | (h3 % 100 >= rate)
            plain[marks(data, offsets)[0]] = True
            form = np.where(plain, PLAIN, np.where(h4 % 100 < spm, SPM, PSM))
            leads = (data & 0xC0) != 0x80
            chars = [[None if p else int(np.count_nonzero(leads[x:y])) for p, x, y in zip(plain, start, stop, strict=True)]
                     for start, stop in ((offsets[:-1], b), (b, c))]
            made, out = moved(data, offsets, b, c, form)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(np.array(FORMS)[form]),
                 *(pa.array(x, pa.int64()) for x in chars), as_texts(made, out)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return in_arrow(rows, stage, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, form string, "
                    "prefix_chars bigint, middle_chars bigint, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """The same rows with ``restored``, the texts read back from ``output`` and ``form`` alone."""
    if "restored" in outputs.columns:
        raise ValueError("the outputs already have a column named restored")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "output"):
            form = pc.index_in(batch.column("form"), value_set=pa.array(FORMS)).to_numpy()
            back = as_texts(*put_back(*as_bytes(batch.column("output")), form))
            yield pa.RecordBatch.from_arrays([*batch.columns, back], [*batch.schema.names, "restored"])
    return in_arrow(outputs, stage, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema.fields) + ", restored string")
