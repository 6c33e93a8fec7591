"""Byte-level BPE by recursive DuckDB queries inside each partition.

A text is cut into pre-tokens by the vocabulary's pattern. The distinct pre-tokens of a partition become
token-position rows (word, position, token id); a recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of minimum rank until no word has a pair left. Decoding joins
token-position rows with the pieces and aggregates them in order.

Words are independent, so one recursion serves all words of a slice, and a worker keeps the ids of words it has
seen (at most ``KEPT_WORDS``, then it starts afresh). Words longer than ``LONG`` bytes take a second form of the
query: it contracts all occurrences of a word's minimum pair at once unless one of these merges would make a pair of lower
rank, and it is restarted every ``ROUNDS`` rounds, so that the rows a
recursion collects stay bounded. Both forms give the ids of the plain leftmost-first merging.

Null texts are read as empty; empty texts have no ids. Repeated rows are encoded each. Other columns pass
through ``encode`` and ``decode`` untouched; the names of the new columns are arguments.
"""

from __future__ import annotations

import array
import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import hand_back, in_arrow, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct pre-tokens in one recursive query, pre-tokens a worker remembers, bytes of a long one, rounds per restart.
CHUNK_WORDS, KEPT_WORDS, LONG, ROUNDS = 30_000, 400_000, 200, 64
#: Tokens in one decoding query.
CHUNK_TOKENS = 1 << 20

CONTRACT = """
WITH RECURSIVE s(it, w, p, t) AS (
  SELECT 0, w, p, t FROM start
  UNION ALL
  (WITH n AS (SELECT it, w, p, t, lead(t) OVER o AS next, lag(p) OVER o AS before
              FROM s WINDOW o AS (PARTITION BY w ORDER BY p)),
        best AS (SELECT w, min((k, p)) AS m FROM n JOIN merges ON l = t AND r = next GROUP BY w)
   SELECT it + 1, n.w, n.p, CASE WHEN n.p = m[2] THEN m[1] ELSE t END
   FROM n JOIN best USING (w) WHERE before IS NULL OR before <> m[2])
)
SELECT w, list(t ORDER BY p) AS ids
FROM s SEMI JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) USING (w, it) GROUP BY w
"""

CONTRACT_LONG = f"""
WITH RECURSIVE s(it, w, p, t) AS (
  SELECT 0, w, p, t FROM start
  UNION ALL
  (WITH n AS (SELECT it, w, p, t, lead(t) OVER o AS next, lag(p) OVER o AS before, row_number() OVER o AS i,
                lag(t) OVER o AS left_of, lead(t, 2) OVER o AS right_of
              FROM s WINDOW o AS (PARTITION BY w ORDER BY p)),
        found AS (SELECT w, p, i, k, left_of, right_of, min(k) OVER (PARTITION BY w) AS low
                  FROM n JOIN merges ON l = t AND r = next),
        runs AS (SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY p) AS run, min(p) OVER (PARTITION BY w) AS first
                 FROM found WHERE k = low),
        risky AS (SELECT w FROM runs JOIN lower ON l = left_of AND r = runs.k AND lower.k < runs.k
                  UNION SELECT w FROM runs JOIN lower ON l = runs.k AND r = right_of AND lower.k < runs.k
                  UNION SELECT w FROM runs JOIN lower ON l = runs.k AND r = runs.k AND lower.k < runs.k),
        picks AS (SELECT w, p, k FROM (
                    SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY p) AS nth FROM runs)
                  WHERE CASE WHEN w IN (FROM risky) THEN p = first ELSE nth % 2 = 1 END)
   SELECT it + 1, n.w, n.p, coalesce(a.k, t)
   FROM n SEMI JOIN picks ON n.w = picks.w
   LEFT JOIN picks a ON a.w = n.w AND a.p = n.p LEFT JOIN picks b ON b.w = n.w AND b.p = n.before
   WHERE b.p IS NULL AND it < {ROUNDS})
)
SELECT w, list(t ORDER BY p) AS ids, any_value(it) AS it
FROM s SEMI JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) USING (w, it) GROUP BY w
"""

DECODE = "SELECT d, array_to_string(list(piece ORDER BY p), '') AS text FROM tokens JOIN pieces USING (id) GROUP BY d"

# Letters, numbers and blanks below U+0250 (fixed by Unicode): within them the standard matcher, which is twice as
# fast, splits as the pattern does.
_L, _N, _S = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", r"0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_LATIN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[ɐ-\U0010ffff]")
_FULL = regex.compile(public_tokenizers.PATTERN)


def pretokens(text: str) -> list[str]:
    """Matches of the vocabulary's pattern."""
    return (_FULL if _BEYOND.search(text) else _LATIN).findall(text)


class ByteBpe:
    """One vocabulary in one worker's own DuckDB connection; texts in, ids as little-endian 32-bit bytes out."""

    def __init__(self, path: str):
        ranks = {base64.b64decode(token): int(rank)
                 for token, rank in map(bytes.split, open(path, "rb").read().splitlines())}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        merges = {name: array.array("i") for name in "lrk"}  # flat: a worker has little memory beside the executor's
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None:
                    for column, value in zip(merges.values(), (left, right, rank), strict=True):
                        column.append(value)
        self._load("merges", **{name: pa.array(np.frombuffer(x, np.int32)) for name, x in merges.items()})
        self.db.sql("CREATE TABLE lower AS FROM merges WHERE k < greatest(l, r)")
        # a piece is any byte string: DuckDB gets it as text with one character per byte
        self._load("pieces", id=pa.array(ranks.values(), pa.int32()),
                   piece=pa.array([token.decode("latin-1") for token in ranks]))

    def _load(self, name: str, **columns) -> None:
        self.db.register("loading", pa.table(columns))
        self.db.sql(f"CREATE TABLE {name} AS FROM loading")
        self.db.unregister("loading")

    def _contract(self, query: str, words: list[np.ndarray]) -> pa.Table:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        ends = np.cumsum(lengths)
        self.db.register("start", pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), lengths),
            "p": (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32),
            "t": np.concatenate(words)}))
        return self.db.sql(query).to_arrow_table()

    def _learn(self, words: list[str]) -> None:
        """Add the ids of new words to those known."""
        spelled = [self.of_byte[np.frombuffer(word.encode(), np.uint8)] for word in words]
        short = [i for i, s in enumerate(spelled) if len(s) <= LONG]
        for at in range(0, len(short), CHUNK_WORDS):
            part = short[at:at + CHUNK_WORDS]
            got = self._contract(CONTRACT, [spelled[i] for i in part])
            ids = got["ids"].combine_chunks()
            cuts, flat = (ids.offsets.to_numpy() * 4).tolist(), ids.values.to_numpy().astype("<u4").tobytes()
            for n, w in enumerate(got["w"].to_pylist()):
                self.known[words[part[w]]] = flat[cuts[n]:cuts[n + 1]]
        for i in (i for i, s in enumerate(spelled) if len(s) > LONG):
            state = spelled[i]
            while True:
                got = self._contract(CONTRACT_LONG, [state])
                state = got["ids"].combine_chunks().values.to_numpy().astype(np.int32)
                if got["it"][0].as_py() < ROUNDS:
                    break
            self.known[words[i]] = state.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [pretokens(text) if text else [] for text in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self._learn(sorted(new))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Each id string's bytes; slices of a long one are decoded one after the other."""
        out = [b""] * len(ids)
        flat, owner = np.frombuffer(b"".join(ids), "<u4").astype(np.int32), np.repeat(
            np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        for at in range(0, len(flat), CHUNK_TOKENS):
            part = slice(at, at + CHUNK_TOKENS)
            self.db.register("tokens", pa.table({
                "d": owner[part], "p": np.arange(len(flat[part]), dtype=np.int32), "id": flat[part]}))
            got = self.db.sql(DECODE).to_arrow_table()
            for d, text in zip(got["d"].to_pylist(), got["text"].to_pylist(), strict=True):
                out[d] += text.encode("latin-1")
        return out


_LOADED: dict[str, ByteBpe] = {}


def vocabulary(path: str) -> ByteBpe:
    """The worker's copy of a vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
        hand_back()  # what the loading took
    return _LOADED[path]


def _with_column(batch: pa.RecordBatch, values: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def _schema(df: DataFrame, column: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), column])


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", path: str | None = None) -> DataFrame:
    """All columns and the text's ids as array<int>."""
    path = path or public_tokenizers.path(VOCABULARY)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            coded = vocabulary(path).encode(batch.column(text).to_pylist())
            values = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
            yield _with_column(batch, pa.ListArray.from_arrays(ends, values), ids)
    return in_arrow(df, stage, _schema(df, f"`{ids}` array<int>"))


def decode(df: DataFrame, ids: str = "token_ids", data: str = "decoded", path: str | None = None) -> DataFrame:
    """All columns and the bytes of the ids; null ids are read as none."""
    path = path or public_tokenizers.path(VOCABULARY)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [np.array(x or [], "<u4").tobytes() for x in part.column(ids).to_pylist()]
                yield _with_column(part, pa.array(vocabulary(path).decode(rows), pa.binary()), data)
    return in_arrow(df, stage, _schema(df, f"`{data}` binary"))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """All columns but the text, and n_tokens, ids_sha256, decoded_sha256.

    Ids are hashed as little-endian unsigned 32-bit integers, then decoded in the same task, so that they need
    not leave it.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rest = [c for c in df.columns if c != text]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            words = vocabulary(path)
            coded = words.encode(batch.column(text).to_pylist())
            back = words.decode(coded)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array([len(x) // 4 for x in coded], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in coded]),
                 pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                [*rest, "n_tokens", "ids_sha256", "decoded_sha256"])
    kept = df.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("string").alias(text))
    schema = _schema(df.select(*(F.col(f"`{c}`") for c in rest)),
                     "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return in_arrow(kept, stage, schema)
