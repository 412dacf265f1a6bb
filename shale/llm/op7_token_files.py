"""Token ids in binary files: patched frame-of-reference segments in ascending doc_id order.

Documents are range-partitioned and sorted by doc_id (ties by the first 16 characters, then by a hash of the text; a null
doc_id comes first and keeps a flag), each partition is tokenised with the tokenizers library and written as a shard: rows
(shard, segment, ids of the shard before it, n_ids, payload), the payload being a segment of :mod:`shale.llm.pfor`. Spark's
own writer stores the rows, so shards live in any store that Spark can reach, are committed whole, and a retried task
replaces its own. Readers number the ids of all documents by a prefix sum over shards.

Null and empty texts hold just the end id. Repeated rows are documents of their own. An empty table gives no segments
and an empty result. Extra columns are not read.

Texts are cut before blanks and line feeds that follow another character, where the pre-tokeniser always splits. The cuts of
a chunk are numbered in its Arrow buffer (:mod:`shale.llm.wordbook`), and the library encodes each distinct one once per
worker. Cuts of more than 64 bytes, and texts with other white space or control characters as a whole, go to it each time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shale.llm import pfor
from shale.llm.arrow import chunks, spread
from shale.llm.common import new_path, table
from shale.llm.wordbook import CLASH, WordBook, padded

MODEL, END_ID = "byte_bpe_50k.json", 2
KEPT_WORDS, JOINED = 1_500_000, 100
#: A segment is closed once it has this many ids.
SEGMENT_IDS = 1 << 20
#: Bytes after which there may be white space other than blanks and line feeds (there the cuts might not be the pre-tokeniser's),
#: or a control character: by themselves, or as the first of the ranges below.
ALONE = np.zeros(256, dtype=bool)
ALONE[[*range(10), *range(11, 32), 127]] = True
LEADS = np.zeros(256, dtype=bool)
LEADS[[0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
#: Code points of other white space, of C1 controls and of signs without width, each as a range of its UTF-8 bytes.
ODD = [
    tuple(int.from_bytes(chr(c).encode().ljust(3, pad), "big") for c, pad in ((first, b"\0"), (last, b"\xff")))
    for first, last in ((0x80, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x2060), (0x3000, 0x3000), (0xFEFF, 0xFEFF))
]


def odd_places(raw: np.ndarray) -> np.ndarray:
    """Where in a padded buffer such a character begins."""
    lead = np.flatnonzero(LEADS[raw[:-8]])
    code = raw[lead].astype(np.int32) << 16 | raw[lead + 1].astype(np.int32) << 8 | raw[lead + 2]
    odd = np.zeros(len(lead), dtype=bool)
    for first, last in ODD:
        odd |= (code >= first) & (code <= last)
    return np.concatenate([np.flatnonzero(ALONE[raw[:-8]]), lead[odd]])


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 in one padded buffer, and the n + 1 places where they begin and end; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return padded(raw), at - at[0]


class Encoder:
    def __init__(self, model_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_file)
        # In this vocabulary each character of a token stands for a byte.
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.id_bytes = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            self.id_bytes[i] = len(name)
        self._forget()

    def _forget(self) -> None:
        self.book = WordBook()
        self.ids, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, one after the other, and each word's number of ids."""
        # Words that begin with white space and end otherwise are encoded joined; the bytes of the ids tell them apart.
        blank = np.array([w[0] in b" \n" and w[-1] not in b" \n" for w in words], dtype=bool)
        joined, alone = np.flatnonzero(blank), np.flatnonzero(~blank)
        pieces = [words[i] for i in joined]
        texts = [b"".join(pieces[i : i + JOINED]).decode() for i in range(0, len(pieces), JOINED)] + [words[i].decode() for i in alone]
        found = [np.array(x.ids, dtype=np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*found, np.zeros(0, np.int32)])
        order = np.concatenate([joined, alone])
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words))[order])
        after = np.searchsorted(np.cumsum(self.id_bytes[ids]), ends, side="left") + 1
        size, start = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        start[order], size[order] = np.r_[0, after[:-1]], np.diff(after, prepend=0)
        return ids[spread(start, size)], size

    def encode_column(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids; with the end id, if any."""
        raw, at = buffer(texts)
        blank = (raw[:-8] == 32) | (raw[:-8] == 10)
        cut = np.zeros(len(raw) - 8, dtype=bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        for i in np.unique(np.searchsorted(at, odd_places(raw), side="right")) - 1:
            cut[at[i] : at[i + 1]] = False
        cut[at[:-1][at[:-1] < at[1:]]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.r_[start, len(cut)])
        if self.book.n > KEPT_WORDS:
            self._forget()
        which, new = self.book.numbers(raw, start, size)
        word = raw.tobytes()
        slices = lambda own: [word[a:b] for a, b in zip(start[own].tolist(), (start[own] + size[own]).tolist(), strict=True)]
        if len(new):
            ids, n = self._encoded(slices(new))
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.len = np.concatenate([self.ids, ids]), np.concatenate([self.len, n.astype(np.int32)])
        all_ids, first, sizes = self.ids, self.at[which], self.len[which]
        if len(own := np.flatnonzero(which == CLASH)):  # long words, texts that can't be cut: not kept
            ids, n = self._encoded(slices(own))
            first[own], sizes[own] = len(all_ids) + np.cumsum(n) - n, n
            all_ids = np.concatenate([all_ids, ids])
        ids = all_ids[spread(first, sizes)]
        ends = np.r_[0, np.cumsum(sizes, dtype=np.int64)][np.searchsorted(start, at)]
        counts = np.diff(ends)
        if end is None:
            return ids, counts
        total = counts + 1
        out = np.full(int(total.sum()), end, dtype=ids.dtype)
        out[spread(np.cumsum(total) - total, counts)] = ids
        return out, total

    def encode(self, texts: list[str], end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_column(pa.array(texts, pa.string()), end)


@lru_cache(maxsize=2)
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


#: Bytes of text in a shard, at most on average.
SHARD_BYTES = 512 << 20


def shard_count(total_bytes: int, least: int) -> int:
    return max(least, -(-total_bytes // SHARD_BYTES))


def write_shards(docs: DataFrame, path: str, model_file: str | None = None, shards: int | None = None, percentile: float = pfor.PERCENTILE) -> None:
    """Writes the ids of docs' (doc_id, text) to path: as many shards as Spark has shuffle partitions, and more beyond SHARD_BYTES of text in each."""
    file = model_file or public_tokenizers.path(MODEL)
    n = shards or shard_count(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0], int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, segment, before = encoder(file), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            docs, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            row = {"shard": [shard], "segment": [segment], "before": [before], "n_ids": [len(ids)], "payload": [pfor.encode_segment(docs, counts, ids, percentile)]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())]))

        for batch in chunks(batches, "text"):
            ids, counts = own.encode_column(batch.column("text"))
            held.append((batch.column("doc_id").to_numpy(zero_copy_only=False), counts, ids.astype(np.uint32)))
            if sum(len(x[2]) for x in held) >= SEGMENT_IDS:
                batch = close()
                before, segment = before + batch.column("n_ids")[0].as_py(), segment + 1
                yield batch
        if held:
            yield close()

    # Equal ids (null above all) may be many: they are dealt out by their texts, and equal rows by their place.
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text", F.substring("text", 1, 16).alias("_p"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_i"))
    ordered = keyed.repartitionByRange(n, "doc_id", "_p", "_h", "_i").sortWithinPartitions("doc_id", "_p", "_h", "_i").select("doc_id", "text")
    ordered.mapInArrow(run, "shard int, segment int, before long, n_ids long, payload binary").write.option("compression", "uncompressed").parquet(path)


#: Stands for a null doc_id in the files; comes first.
NULL_ID = -(1 << 63)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files at path."""
    files = spark.read.parquet(path)
    # One row per shard, of which there are as many as partitions were written: small enough to broadcast.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = shards.select("shard", F.coalesce(before, F.lit(0)).alias("first"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payload in zip(batch.column("at").to_pylist(), batch.column("payload"), strict=True):
                docs, counts, ids = pfor.decode_segment(payload.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                raw, cuts = ids.astype("<u4").tobytes(), (4 * ends).tolist()
                sums = [zlib.crc32(raw[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
                names = pa.array(docs, mask=docs == NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(at + ends - counts), pa.array(counts.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    joined = files.join(F.broadcast(offsets), "shard").select((F.col("first") + F.col("before")).alias("at"), "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op7")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
