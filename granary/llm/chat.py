"""Chat formatting at token level: segments encoded apart, reserved ids spliced in, masks by prefix sums.

Template, one turn after the other: ``<s>`` ROLE ``[INST]`` TEXT ``[/INST]`` ``</s>``. Each of the four marks is one reserved id
above the vocabulary; role and text are encoded each by itself as ordinary text, so that no content can produce a
reserved id. In the texts (and roles) control strings are escaped as well, so that the formatted string reads
back too: every backslash is doubled and a backslash is put after the first character of every control string.

Turns are formatted where they lie, with one Arrow stage; then rows are partitioned by conversation and sorted, and a
stage walks the sorted rows: a conversation's offsets are running sums of the lengths of its segments, its mask
starts and ends at such offsets. A conversation is never held as a whole, however many turns it has.

Turns are ordered by turn, nulls last, then role and text; repeated rows are turns of their own. Null text and null
role are empty; rows with a null conv_id form one conversation with that id. An empty table gives no rows. Other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import in_arrow

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Control strings in the order of their reserved ids, which follow the vocabulary's last one.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
LEARNED_ROLE = "assistant"
#: Turns formatted at once.
ROWS = 1024

_CONTROL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Double backslashes and break control strings after their first character."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_LOADED: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    if path not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb").read().splitlines())}
        _LOADED[path] = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def reserved(path: str) -> dict[str, int]:
    """The control strings' ids."""
    return {c: encoding(path).max_token_value + 1 + i for i, c in enumerate(CONTROLS)}


def assemble(role: str, text: str, words: tiktoken.Encoding, ids: dict[str, int]) -> tuple[list[int], list[int]]:
    """Token ids of one turn and its segments' lengths: mark, role, mark, text, marks."""
    who, what = words.encode_ordinary(escape(role)), words.encode_ordinary(escape(text))
    start, open_, close, end = (ids[c] for c in CONTROLS)
    return [start, *who, open_, *what, close, end], [1, len(who), 1, len(what), 2]


def format_turns(turns: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, turn, role, text, token_ids and segments (the lengths of mark, role, mark, text, marks) per turn."""
    path = path or public_tokenizers.path(VOCABULARY)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids = encoding(path), reserved(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                made = [assemble(role or "", text or "", words, ids) for role, text in zip(
                    batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array([m[i] for m in made], pa.list_(pa.int32())) for i in (0, 1))],
                    [*batch.schema.names, "token_ids", "segments"])
    return in_arrow(turns.select("conv_id", "turn", "role", "text"), stage,
                    "conv_id bigint, turn bigint, role string, text string, token_ids array<int>, segments array<int>")


def in_order(formatted: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, one after the other."""
    return formatted.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "text")


def assembled(formatted: DataFrame) -> DataFrame:
    """conv_id, turn, token_ids, loss_mask, first: the token sequence of each conversation in pieces of one turn.

    ``first`` is the offset of the piece in its conversation, a running sum of the pieces before; the mask is 1 on the
    text segment of assistant turns, found by running sums of the segments.
    """
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, first = object(), 0
        for batch in batches:
            masks, firsts = [], []
            for conv_id, role, segments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "segments")), strict=True):
                if conv_id != conv:
                    conv, first = conv_id, 0
                ends = np.cumsum(segments)
                steps = np.zeros(ends[-1] + 1, np.int8)
                if role == LEARNED_ROLE:
                    steps[ends[2]] += 1
                    steps[ends[3]] -= 1
                masks.append(np.cumsum(steps[:-1], dtype=np.int8).tobytes())
                firsts.append(first)
                first += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("token_ids"), pa.array(masks, pa.binary()),
                 pa.array(firsts, pa.int64())], ["conv_id", "turn", "token_ids", "loss_mask", "first"])
    return in_arrow(in_order(formatted).select("conv_id", "turn", "role", "token_ids", "segments"), stage,
                    "conv_id bigint, turn bigint, token_ids array<int>, loss_mask binary, first bigint")


class _Reader:
    """Reads the turns of one conversation from its tokens and mask, piece by piece."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars, self.place = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, tokens: list[int], mask: bytes, first: int, words: tiktoken.Encoding, ids: dict[str, int]) -> None:
        if first != self.place or len(mask) != len(tokens):
            raise ValueError(f"conversation {self.conv_id}: piece at {first}, expected {self.place}")
        self.place += len(tokens)
        marks = [(i, t) for i, t in enumerate(tokens) if t >= ids[CONTROLS[0]]]
        if [t for _, t in marks] != [ids[c] for c in CONTROLS]:
            raise ValueError(f"conversation {self.conv_id}: a turn's marks are out of order")
        (a, _), (b, _), (c, _), _ = marks
        role, text = words.decode(tokens[a + 1:b]), words.decode(tokens[b + 1:c])
        self.turns += 1
        self.chars += len(role) + len(text) + sum(map(len, CONTROLS))
        self.all.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        if 1 in mask:
            low, high = mask.index(1), mask.rindex(1) + 1
            learned = unescape(words.decode(tokens[low:high]))
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each conversation, read from the tokens and masks of ``assembled`` alone, in its order of rows."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, now = encoding(path), reserved(path), None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            done = []
            for conv_id, tokens, mask, first in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "token_ids", "loss_mask", "first")), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Reader(conv_id)
                now.take(tokens, mask, first, words, ids)
            if done:
                yield packed(done)
        if now is not None:
            yield packed([now.row()])
    return in_arrow(pieces, stage, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
