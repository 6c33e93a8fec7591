import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from granary.llm import bpe, queries

RANKS = {base64.b64decode(a): int(b) for a, b in map(
    bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb").read().splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CASES = [None, "", " ", "  \n\t x", "it's we'll 'S", "naïve œuvre ½ ² ３", "汉字汉字" * 900, "a" * 5000, "ab" * 3000 + "é",
         "\x00\x1c\x85   z", "<|endoftext|> </s>", "🙂" * 50, "x  ", "Ünï 12³ ..!!  \r\n end ",
         "".join(random.Random(5).choices("etaoinshrdlu", k=2500)), "ǅ ɏ ɐ ʰ ͅ ٣"]


def expected(text):
    return np.array(LIBRARY.encode_ordinary(text or ""), "<u4").tobytes()


def test_ids_equal_the_library():
    words = bpe.ByteBpe(public_tokenizers.path(bpe.VOCABULARY))
    got = words.encode(CASES)
    assert got == [expected(text) for text in CASES]
    assert words.decode(got) == [(text or "").encode() for text in CASES]


def test_split_equals_pattern():
    draw = random.Random(3)
    alphabet = "".join(map(chr, range(0x250))) + "ɐaa  '''sstrevmld 　汉"
    for _ in range(3000):
        text = "".join(draw.choices(alphabet, k=draw.randrange(12)))
        assert bpe.pretokens(text) == bpe._FULL.findall(text), repr(text)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(CASES + ["x  "])] + [(None, "x", None)],
                                 "doc_id long, text string, n_tokens_ string")


def test_frame_round_trip(spark, cases):
    rows = bpe.round_trip(cases).collect()
    assert len(rows) == len(CASES) + 2
    texts = dict(enumerate([*CASES, "x  "])) | {None: "x"}
    for r in rows:
        want = expected(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(cases)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert bpe.round_trip(cases.limit(0)).count() == 0


def test_query(spark, folder):
    rows = queries.QUERIES["op1_bpe_round_trip"](spark, folder).collect()
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(expected(texts[r.doc_id])).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
