import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shale.llm import op7_token_files as op
from shale.llm import pfor
from shale.llm.wordbook import WordBook

LIB = Tokenizer.from_file(public_tokenizers.path(op.MODEL))


def reference(texts):
    return [LIB.encode(t, add_special_tokens=False).ids + [op.END_ID] for t in texts]


def test_equals_the_library(monkeypatch):
    rng = random.Random(2)
    alphabet = "aabbcde'stre  \n\n.,=-_tion éß▁0😀　" + "\t\r" * 1
    texts = ["", " ", "\n", "a  b   c", "it's  we'll\n\n x", "<|endoftext|> x<|endoftext|>", "a\t  b", "a\xa0 b", "tail  ", "\r\n a", "x" * 9000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(4000)]
    texts += ["".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    odd = "".join(chr(c) for c in (0x7F, 0x80, 0x85, 0x9F, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x200F, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF))
    texts += ["".join(rng.choice("ab  \n" + odd) for _ in range(rng.randrange(1, 12))) for _ in range(1000)]
    texts += [" ".join("w" * k + str(k) for k in range(55, 75)), "é" * 31 + " " + "é" * 32 + " " + "é" * 33]
    own = op.Encoder(public_tokenizers.path(op.MODEL))
    ids, counts = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == reference(texts)
    # From the book, from a slice of a column with nulls, and after words were forgotten.
    monkeypatch.setattr(op, "KEPT_WORDS", 100)
    column = pa.array([None, "x", *texts[:500], None, ""]).slice(1, 502)
    ids, counts = own.encode_column(column)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == reference([t or "" for t in column.to_pylist()])


def test_words_with_equal_hashes(monkeypatch):
    """Bytes decide: words whose hashes clash are encoded alone."""
    monkeypatch.setattr(WordBook, "hashes", staticmethod(lambda raw, start, size: size.astype(np.uint64) % np.uint64(3)))
    texts = ["one two three four", " a bb ccc dddd eeeee", "one two"] * 2
    own = op.Encoder(public_tokenizers.path(op.MODEL))
    for _ in range(2):
        ids, counts = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == reference(texts)


@pytest.mark.parametrize("percentile", [0.5, 0.9, 0.95, 1.0])
def test_blocks_round_trip(percentile):
    rng = np.random.default_rng(3)
    cases = [np.zeros(0), np.array([7]), np.full(256, 9), np.arange(257), rng.integers(0, 50_257, 10_000), rng.zipf(1.3, 5_000) % 50_257, rng.integers(0, 1 << 32, 999), np.array([0, (1 << 32) - 1] * 300)]
    for ids in cases:
        start, body = pfor.encode_blocks(ids.astype(np.uint32), percentile)
        assert (pfor.decode_blocks(start, body, len(ids)) == ids).all()
        for k in range(0, len(start), 7):  # a block alone
            assert (pfor.decode_blocks(start[k : k + 1], body, 256)[: len(ids) - 256 * k] == ids[256 * k : 256 * k + 256]).all()


def test_files(spark, monkeypatch):
    monkeypatch.setattr(op, "SEGMENT_IDS", 100)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat\n", "Ünï"]) for _ in range(rng.randrange(0, 200)))) for i in range(-20, 200)]
    rows += [(None, "null id"), (500, None), (501, ""), (7, "twice"), (7, "twice"), (900, "long " * 40_000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    path = op.new_path(spark, "t")
    op.write_shards(docs, path, shards=5)
    got = sorted(map(tuple, op.read_shards(spark, path).collect()), key=lambda r: r[1])
    want, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):  # no id has two texts
        ids = reference([text or ""])[0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    empty = op.new_path(spark, "t")
    op.write_shards(docs.limit(0), empty)
    assert op.read_shards(spark, empty).count() == 0


def test_shards_follow_the_bytes():
    assert op.shard_count(0, 8) == op.shard_count(10 * op.SHARD_BYTES // 2, 8) == 8
    assert op.shard_count(100 << 40, 200) == (100 << 40) // op.SHARD_BYTES
