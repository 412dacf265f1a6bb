"""Quality classifier: a factorisation machine.

Inputs of a document are its words (each occurrence one input, hashed into :data:`BUCKETS`, of value 1 / sqrt(words)),
and its structure: shares of upper-case letters, signs, digits, blanks, line feeds and other bytes, distinct words,
repeated neighbours, mean word length, and its length, each cut into steps of value 1. The model is

    w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

with :data:`RANK` factors; the sum over pairs is half of (sum v x)^2 - sum (v x)^2, so scoring takes linear time. It is
fitted by AdaGrad on log loss on the driver, on about :data:`SAMPLE` labelled documents and :data:`WORDS` words of two bytes at
most (documented bounds; of a document all words count). Labels, lang, source and doc_id are no inputs.

Null and empty texts have no words and the structure of an empty text; without labels of both kinds all scores are the
labels' mean (0 if there are none). Repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm.arrow import chunks, texts_of
from shale.llm.common import apart_from, stored, table
from shale.llm.learning import held_out, sampled, sigmoid
from shale.llm.tokens import word_hashes

SAMPLE, WORDS, BUCKETS, RANK, STEPS = 8_000, 16_000_000, 1 << 15, 6, 12
EPOCHS, BATCH, RATE, DECAY = 8, 200, 0.1, 1e-5
N_STRUCTURE = 11
SIZE = BUCKETS + N_STRUCTURE * STEPS

#: Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 blank, 4 line feed, 5 sign, 6 beyond ASCII.
CLASSES = np.full(256, 5, dtype=np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58], CLASSES[[9, 11, 12, 13, 32]], CLASSES[10], CLASSES[128:] = 0, 1, 2, 3, 4, 6


def inputs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word, each text's number of words, and (texts, N_STRUCTURE) structure inputs."""
    h, length, n = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    raw = [t.encode("utf-8", "replace") for t in texts]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    kinds = CLASSES[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int64)
    shares = np.bincount(np.repeat(np.arange(len(texts)), size) * 7 + kinds, minlength=7 * len(texts)).reshape(-1, 7) / np.maximum(size, 1)[:, None]
    by = np.lexsort((h, doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    distinct = np.bincount(doc[by], weights=new, minlength=len(texts)) / np.maximum(n, 1)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    neighbours = np.bincount(doc, weights=again, minlength=len(texts)) / np.maximum(n, 1)
    mean = np.bincount(doc, weights=length, minlength=len(texts)) / np.maximum(n, 1)
    values = np.c_[shares, distinct, neighbours, mean / 20, np.log1p(n) / 14]
    # Shares matter most near their ends, so steps follow the square root.
    step = np.minimum((np.sqrt(np.clip(values, 0, 1)) * STEPS).astype(np.int64), STEPS - 1)
    return (h % np.uint64(BUCKETS)).astype(np.int32), n, (BUCKETS + np.arange(N_STRUCTURE) * STEPS + step).astype(np.int32)


class Machine:
    def __init__(self, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.03, (SIZE, RANK)).astype(np.float32)

    def _sums(self, words, n, structure):
        """Linear part, sum v x and sum (v x)^2 of each text."""
        x = 1 / np.sqrt(np.maximum(n, 1)).astype(np.float32)
        full = np.flatnonzero(n)
        line = self.w[structure].sum(axis=1)
        own = self.v[structure]
        s, q = own.sum(axis=1), (own * own).sum(axis=1)
        if len(full):
            start = (np.cumsum(n) - n)[full]
            v = self.v[words]
            line[full] += np.add.reduceat(self.w[words], start) * x[full]
            s[full] += np.add.reduceat(v, start, axis=0) * x[full, None]
            q[full] += np.add.reduceat(v * v, start, axis=0) * (x * x)[full, None]
        return x, line, s, q

    def raw(self, words, n, structure) -> np.ndarray:
        _, line, s, q = self._sums(words, n, structure)
        return self.bias + line + 0.5 * (s * s - q).sum(axis=1)

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 8) -> None:
        """texts: (words, structure) of each."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                words = np.concatenate([texts[i][0] for i in own])
                n = np.array([len(texts[i][0]) for i in own])
                structure = np.stack([texts[i][1] for i in own])
                x, line, s, q = self._sums(words, n, structure)
                e = (sigmoid(self.bias + line + 0.5 * (s * s - q).sum(axis=1)) - y[own]).astype(np.float32) / len(own)
                ids = np.r_[words, structure.ravel()]
                value = np.r_[np.repeat(x, n), np.ones(structure.size, np.float32)]
                doc = np.r_[np.repeat(np.arange(len(own)), n), np.repeat(np.arange(len(own)), N_STRUCTURE)]
                used, place = np.unique(ids, return_inverse=True)
                slope = e[doc] * value
                dw = np.bincount(place, weights=slope, minlength=len(used)).astype(np.float32) + DECAY * self.w[used]
                dv = np.stack([np.bincount(place, weights=slope * (s[doc, k] - self.v[ids, k] * value), minlength=len(used)) for k in range(RANK)], axis=1).astype(np.float32) + DECAY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(e.sum()) ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.bias -= RATE * float(e.sum()) / gb**0.5


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, column: str = "quality") -> Machine | float:
    """A machine, or the labels' mean where they are all the same; docs (doc_id, text), labels (doc_id, column)."""
    chosen = sampled(labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(column).cast("int").alias("y")), "doc_id", SAMPLE)
    own = docs.join(F.broadcast(chosen), "doc_id").select("text", "y")  # bounded by SAMPLE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words, n, structure = inputs(texts_of(batch))
            ends = np.cumsum(n).tolist()
            parts = [words[a:b].astype("<u2").tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([r.tobytes() for r in structure.astype("<i4")], pa.binary()), batch.column("y")], ["words", "structure", "y"])

    found = stored(own.mapInArrow(run, "words binary, structure binary, y int"), "op8")
    words = found.agg(F.sum(F.octet_length("words")) / 2).first()[0] or 0
    if words > WORDS:
        found = found.where(F.pmod(F.xxhash64("words"), F.lit(1 << 20)) < int((1 << 20) * WORDS / words))
    rows = found.collect()  # bounded by SAMPLE and WORDS
    y = np.array([r.y for r in rows], dtype=np.float32)
    if not len(rows) or len(set(y.tolist())) < 2:
        return float(y.mean()) if len(rows) else 0.0
    rows = sorted(rows, key=lambda r: (bytes(r.words), r.y))
    machine = Machine()
    machine.fit([(np.frombuffer(r.words, "<u2").astype(np.int32), np.frombuffer(r.structure, "<i4")) for r in rows], np.array([r.y for r in rows], dtype=np.float32))
    return machine


def score(docs: DataFrame, model: Machine | float) -> DataFrame:
    """docs' columns but text, and score (in place of a column of that name)."""
    rows, rest = apart_from(docs, "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE * (RANK + 1) numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in chunks(batches, "text"):
            texts = texts_of(batch)
            p = np.full(len(texts), own) if isinstance(own, float) else sigmoid(own.raw(*inputs(texts)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(p)], ["_row", "score"])

    return rows.mapInArrow(run, rows.select("_row").schema.add("score", "double")).select(*rest, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    train = ~held_out("doc_id", 5, 0)
    model = learn(spark, docs.where(train), table(spark, sf_dir, "labels").where(train))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
