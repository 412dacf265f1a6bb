"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Folding: lower case, compatibility forms and accents to their base letters, Cyrillic and Greek look-alikes to Latin,
digits and signs that stand for letters (``0 1 3 4 5 7 @ $``) to these; ``l`` and ``i`` become one letter, since ``1``
stands for either. Everything else that isn't a letter separates words.

The lexicon is learned from labelled documents: words and word beginnings of 4 to 8 letters, weighted by the log odds of
appearing in a toxic document; entries need a z-value of :data:`LEAST_Z`. Documents with the same least shingle hash
count once, so that copies of a document don't make its words toxic. Exception phrases (an entry with the word before or
after it) are those that occur in clean documents at least :data:`EXCEPT` times and hardly ever in toxic ones; they
match instead of the entry and weigh nothing. At each place the longest entry counts.

The score is a logistic function of the matched weight and of that weight per length, fitted on the same sample. The
sample is at most about :data:`SAMPLE` labelled documents (a documented bound), and the lexicon grows with nothing else. Null and empty texts have no matches and get the score of a text without any; without labels of both kinds all
scores are 0. Repeated rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm.arrow import chunks, texts_of
from shale.llm.common import apart_from, stored, table
from shale.llm.learning import held_out, logistic, sampled, sigmoid
from shale.llm.tokens import shingle_hashes, word_hashes

SAMPLE, LEAST_Z, EXCEPT = 20_000, 3.3, 5
STEMS = range(4, 9)
#: Look-alikes of Latin letters, and signs used for letters. Fixed values.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнιονραβετκυχγ", "aeopcyxijsdhkmtbhiovpabetkuxy", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": " ", "l": "i", "ł": "i"}


class _Folds(dict):
    """Code point to its folded form, filled as code points are met."""

    def __missing__(self, code: int) -> str:
        c = chr(code).lower()
        base = unicodedata.normalize("NFKD", c)[:1].lower()
        c = LOOKALIKES.get(base, base) if base else " "
        c = SIGNS.get(c, c)
        self[code] = out = c if c.isalpha() else "" if unicodedata.category(c) in ("Mn", "Cf") else " "
        return out


FOLDS = _Folds()


def folded(text: str) -> str:
    return f" {text.translate(FOLDS)} "


def features(text: str) -> set[str]:
    words = set(folded(text).split())
    return {w for w in words if len(w) >= STEMS[0]} | {w[:k] for w in words for k in STEMS if len(w) > k}


class Lexicon:
    """weights: folded entry to weight; exceptions: folded phrases."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = ()):
        self.found = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.found.add_word(" " + entry, weight)
        for phrase in exceptions:
            self.found.add_word(" " + phrase, 0.0)
        self.empty = not len(self.found)
        if not self.empty:
            self.found.make_automaton()

    def matched(self, text: str) -> float:
        if self.empty:
            return 0.0
        # A blank ends one word and starts the next: doubled, it serves both.
        return sum(w for _, w in self.found.iter_long(f" {'  '.join(folded(text).split())} "))


def _weights(rows: list, n_toxic: int, n_clean: int) -> dict[str, float]:
    out: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.feature), r.feature)):
        w = math.log((r.t + 0.5) / (n_toxic + 1)) - math.log((r.c + 0.5) / (n_clean + 1))
        if any(out.get(r.feature[:k], -1) >= 0.8 * w for k in STEMS if k < len(r.feature)):
            continue  # its beginning says as much
        out[r.feature] = w
    return out


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[str], list[float]]:
    """Lexicon, exception phrases and calibration, from docs (doc_id, text) and labels (doc_id, toxic)."""
    chosen = sampled(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic"), "doc_id", SAMPLE)
    # The sample is bounded, so it can be broadcast.
    own = docs.where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words, _, counts = word_hashes(texts_of(batch))
            h, n = shingle_hashes(words, counts, 5)
            least = np.zeros(len(n), dtype=np.uint64)
            least[n > 0] = np.minimum.reduceat(h, (np.cumsum(n) - n)[n > 0]) if len(h) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least.view(np.int64))], [*batch.schema.names, "least"])

    sample = stored(own.mapInArrow(signed, "text string, toxic int, least long").groupBy("least").agg(F.min(F.struct("text", "toxic")).alias("x")).select("x.*"), "op4")
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}, [], []

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            c: Counter = Counter()
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                c.update((f, toxic) for f in features(text))
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([c[k] for k in keys], pa.int64())], ["feature", "toxic", "n"])

    sums = sample.mapInArrow(counted, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    weights = _weights(sums.where(z >= LEAST_Z).collect(), n[1], n[0])

    entries = Lexicon(weights)

    def phrases(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            c: Counter = Counter()
            for text, toxic in zip(texts_of(batch), batch.column("toxic").to_pylist(), strict=True):
                words = folded(text).split() if entries.matched(text) else []
                hits = [i for i, w in enumerate(words) if w in weights or any(w[:k] in weights for k in STEMS)]
                c.update({(f"{words[i - 1]}  {words[i]}", toxic) for i in hits if i} | {(f"{words[i]}  {words[i + 1]}", toxic) for i in hits if i + 1 < len(words)})
            keys = list(c)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([c[k] for k in keys], pa.int64())], ["phrase", "toxic", "n"])

    by = sample.mapInArrow(phrases, "phrase string, toxic int, n long").groupBy("phrase").pivot("toxic", [0, 1]).agg(F.sum("n"))
    clean, toxic = F.coalesce(F.col("0"), F.lit(0)), F.coalesce(F.col("1"), F.lit(0))
    safe = by.where((clean >= EXCEPT) & (toxic * n[0] <= 0.1 * clean * n[1])).select("phrase").collect()
    exceptions = sorted(r.phrase for r in safe)
    lexicon = Lexicon(weights, exceptions)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            x = inputs(lexicon, texts_of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("toxic")], ["a", "b", "toxic"])

    rows = np.array([tuple(r) for r in sample.mapInArrow(measured, "a double, b double, toxic int").collect()])
    return weights, exceptions, logistic(rows[:, :2], rows[:, 2]).tolist()


def inputs(lexicon: Lexicon, texts: list[str]) -> np.ndarray:
    """Matched weight (log scale) and weight per hundred words."""
    total = np.array([lexicon.matched(t) for t in texts], dtype=np.float64)
    words = np.array([t.count(" ") + 1 for t in texts], dtype=np.float64)
    return np.c_[np.log1p(np.maximum(total, 0)), np.sqrt(100 * np.maximum(total, 0) / (words + 20))]


def score(docs: DataFrame, model: tuple[dict[str, float], list[str], list[float]]) -> DataFrame:
    """docs' columns but text, and score (in place of a column of that name)."""
    rows, rest = apart_from(docs, "score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded with the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, exceptions, fit = shared.value
        lexicon = Lexicon(weights, exceptions)
        for batch in chunks(batches, "text"):
            texts = texts_of(batch)
            p = sigmoid(np.c_[inputs(lexicon, texts), np.ones(len(texts))] @ np.array(fit)) if fit else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(p)], ["_row", "score"])

    return rows.mapInArrow(run, rows.select("_row").schema.add("score", "double")).select(*rest, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    train = ~held_out("doc_id", 5, 0)
    model = learn(spark, docs.where(train), table(spark, sf_dir, "labels").where(train))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
