"""Token counts of a unigram vocabulary by dynamic programming over a trie of pre-tokens.

A pre-token is a word (run of characters other than ASCII blanks) behind the word mark of the vocabulary. Its tokens are
the segmentation into pieces of the largest total log probability, of equal ones that with fewer tokens. The forward score
of a prefix depends on nothing behind it, so a task inserts its distinct new pre-tokens in a trie and scores each
node once, whatever the number of words below it; a terminal's token count is kept per word, and a document's count is
the sum over its words. A character that is no piece falls back to one token per UTF-8 byte.

The vocabulary file lists pieces by rank and has no probabilities; they are taken by Zipf's law, 1 / (rank * H), bytes
last. Null and empty texts count 0. Repeated rows are counted each. Other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from granary.llm.common import in_arrow, slices

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: Words a worker remembers and nodes a trie may have before either starts afresh.
KEPT_WORDS, NODES = 400_000, 400_000


def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """Log probability of each piece, and that of a byte."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = sum(1 / r for r in range(1, len(pieces) + 257))
    return {p: -math.log(r * total) for r, p in enumerate(pieces, 1)}, -math.log((len(pieces) + 256) * total)


class Trie:
    """Forward scores and token counts of the prefixes of the words inserted."""

    def __init__(self, scores: dict[str, float], byte: float):
        self.scores, self.byte = scores, byte
        self.longest = max(map(len, scores), default=1)
        self.known: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, word: str) -> int:
        """The token count of a word; nodes that an earlier word has made are not scored again."""
        path, find = [0], self.next.get
        for end in range(1, len(word) + 1):
            key = (path[-1], word[end - 1])
            node = find(key)
            if node is None:
                node = self.next[key] = len(self.best)
                self._score(word, end, path)
            path.append(node)
        return self.count[path[-1]]

    def _score(self, word: str, end: int, path: list[int]) -> None:
        top, tokens = -math.inf, 0
        for start in range(max(0, end - self.longest), end):
            piece = self.scores.get(word[start:end])
            if piece is not None:
                score, n = self.best[path[start]] + piece, self.count[path[start]] + 1
                if score > top or score == top and n < tokens:
                    top, tokens = score, n
        if word[end - 1] not in self.scores:
            size = len(word[end - 1].encode())
            score, n = self.best[path[end - 1]] + size * self.byte, self.count[path[end - 1]] + size
            if score > top or score == top and n < tokens:
                top, tokens = score, n
        self.best.append(top)
        self.count.append(tokens)

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = [Counter((text or "").encode().split()) for text in texts]
        for word in sorted(set().union(*found).difference(self.known)):
            if len(self.best) > NODES:
                self._clear()
            self.known[word] = self.insert(MARK + word.decode())
        return [(c.total(), sum(n * self.known[w] for w, n in c.items())) for c in found]


_LOADED: dict[str, Trie] = {}


def counted(df: DataFrame, text: str = "text", pretokens: str = "n_pretokens", tokens: str = "n_tokens", path: str | None = None) -> DataFrame:
    """All columns but the text, and the numbers of pre-tokens and tokens."""
    path = path or public_tokenizers.path(VOCABULARY)
    rest = [c for c in df.columns if c != text]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LOADED:
            _LOADED[path] = Trie(*zipf_scores(path))
        for batch in slices(batches, text):
            counts = _LOADED[path].counts(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), *(pa.array([c[i] for c in counts], pa.int64()) for i in (0, 1))], [*rest, pretokens, tokens])
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != text]
    return in_arrow(df, stage, ", ".join([*schema, f"`{pretokens}` bigint", f"`{tokens}` bigint"]))
