import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shale.llm import op2_sentencepiece as op

PATH = public_tokenizers.path(op.MODEL)
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = [
    "", " ", "a", "  two  blanks   here ", "line\nfeeds\n\nand\ttabs\r\n", "▁literal ▁▁", "<s> </s> <unk> <0x41>", "日本語のテキスト and emoji 😀👍🏽",
    "Ünïcödé žluťoučký кириллица ελληνικά", " " * 300, "=" * 200 + "-" * 77, "a" * 501, "ab" * 300, "\x00\x01​﻿", "1234567890 3.14",
    "x" * 37 + " " * 41 + "y", "The quick brown fox " * 50, "　  mixed", "____________ ******** ########", "aaaa aaab aabb  abab", "\n" * 50,
]


def reference(texts):
    return [LIB.encode(t, add_bos=True, add_eos=True) for t in texts]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_equals_the_library():
    rng = random.Random(1)
    alphabet = "aabbcde  \n.,=-_tionthe éß▁😀0"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(3000)]
    own = op.Codec(PATH)
    ids, counts = own.encode(texts)
    assert split(ids, counts) == reference(texts)
    assert [x.decode() for x in own.decode(ids, counts)] == [LIB.decode(x) for x in reference(texts)]


@pytest.mark.parametrize("char", [" ", "a", "=", "-", "\n", "0", "é", "ab", "the", "\\", "//", "*"])
def test_runs(char):
    own, texts = op.Codec(PATH), [char * n for n in range(1, 140)]
    ids, counts = own.encode(texts)
    assert split(ids, counts) == reference(texts)


def test_query_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "same text", "x"), (3, "same text", "x"), (None, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op.digests(df).collect()}
    want = set()
    for i, text, _ in rows:
        ids = LIB.encode(text or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIB.decode(ids).encode()).hexdigest()))
    assert got == want
    assert op.digests(df).count() == 5 and op.digests(df.limit(0)).count() == 0
    assert {r.decoded for r in op.encode_documents(df).collect()} == {"", "same text", "word " * 30_000}
