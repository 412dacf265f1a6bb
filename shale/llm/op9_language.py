"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree of depth :data:`ORDER` holds how often each byte followed each
context. A byte costs -log2 of its share among the context's bytes; a context that never saw it costs its escape (PPM
method C: distinct bytes over count plus distinct bytes) and passes to the next shorter one, down to a uniform order.
Statistics are frozen after learning, so a text's code length under each language is the exact sum of its bytes' costs,
and the least code length names the language. The score is the share of the winner when code lengths are turned into
probabilities, as if the text had at most :data:`EVIDENCE` bytes.

Symbols are the bytes of UTF-8, with A-Z folded, and all digits and all blanks as one each. The trees of all languages
lie in sparse tables, one for each order: a context's or gram's bytes are its exact key, and its entries are the languages
that have it. A text's costs are worked out from the shortest order up: in each, a language that has the context adds its
escape, and one that has the gram takes the gram's cost.

Every language in the learning set is learned, from about :data:`PER_LANGUAGE` documents and :data:`BYTES` bytes of text at
most (documented bounds of the sample; whole documents are chosen by a hash of their id). The model's size follows
the sample: some tens of MB for each hundred languages.

Null texts and texts without a letter (Unicode category L) are ``und`` with score 0, as are all texts if there is nothing to
learn from. Repeated rows are answered one by one; an empty table gives an empty result; ties go to the first language
by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm.arrow import chunks, spread, texts_of
from shale.llm.common import apart_from, stored, table
from shale.llm.learning import held_out
from shale.llm.wordbook import KeyTable

ORDER = 4
PER_LANGUAGE, BYTES, EVIDENCE = 600, 2 << 20, 60
#: Bytes of text, and costs (grams times languages), that are worked on at a time.
CHUNK, COSTS = 1 << 20, 1 << 23
LETTER = r"\p{L}"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58], FOLD[[9, 10, 11, 12, 13]] = 48, 32


def raw_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each after ORDER blanks, and each text's number of them."""
    own = [b" " * ORDER + t.encode("utf-8", "replace") for t in texts]
    return FOLD[np.frombuffer(b"".join(own), dtype=np.uint8)], np.array([len(x) for x in own], dtype=np.int64)


def grams(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER before it as one number (the last byte lowest), and each text's number of bytes."""
    g = np.zeros(max(len(raw) - ORDER, 0), dtype=np.uint64)
    for k in range(ORDER + 1):
        g |= raw[k : len(raw) - ORDER + k].astype(np.uint64) << np.uint64(8 * (ORDER - k))
    n = size - ORDER
    return g[spread(np.cumsum(size) - size, n)], n


def _last(g: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of grams."""
    return g & np.uint64((1 << 8 * n) - 1)


class Entries:
    """For keys, the languages that have them, each with a number."""

    def __init__(self, keys: np.ndarray, languages: np.ndarray, values: np.ndarray):
        by = np.lexsort((languages, keys))
        own, first, count = np.unique(keys[by], return_index=True, return_counts=True)
        self.table, self.first, self.count = KeyTable(own), first, count
        self.languages, self.values = languages[by].astype(np.int32), values[by].astype(np.float32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in keys, language, value) of all entries."""
        at = self.table.find(keys)
        known = np.flatnonzero(at >= 0)
        at = at[known]
        entry = spread(self.first[at], self.count[at])
        return np.repeat(known, self.count[at]), self.languages[entry], self.values[entry]


class Model:
    """Costs in bits, for all languages at once."""

    def __init__(self, names: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language, grams of ORDER + 1 bytes and how often each occurs."""
        self.names, self.orders = names, []
        language = np.repeat(np.arange(len(names)), [len(g) for g, _ in counts])
        g, c = np.concatenate([g for g, _ in counts]).astype(np.uint64), np.concatenate([c for _, c in counts]).astype(np.float64)
        for k in range(ORDER + 1):  # contexts of k bytes
            gram, own, n = self._sums(_last(g, k + 1), language, c)
            context, whose, total = self._sums(gram >> np.uint64(8), own, n)
            kinds = self._sums(gram >> np.uint64(8), own, np.ones(len(n)))[2]
            # In the order of (context, language) grams lie as their contexts do, kinds of them to each.
            of = np.empty(len(gram), dtype=np.int64)
            of[np.lexsort((own, gram >> np.uint64(8)))] = np.repeat(np.arange(len(kinds)), kinds.astype(np.int64))
            both = total + kinds
            self.orders.append((Entries(context, whose, np.log2(both) - np.log2(kinds)), Entries(gram, own, np.log2(both[of]) - np.log2(n))))

    @staticmethod
    def _sums(key: np.ndarray, language: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums by (key, language), in their order."""
        by = np.lexsort((language, key))
        key, language, value = key[by], language[by], value[by]
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (language[1:] != language[:-1])])
        return key[first], language[first], np.add.reduceat(value, first)

    def costs(self, g: np.ndarray) -> np.ndarray:
        """(grams, languages) costs of each gram's last byte."""
        cost = np.full((len(g), len(self.names)), 8.0, dtype=np.float32)  # the uniform order
        for k, (escapes, seen) in enumerate(self.orders):
            at, language, bits = escapes.of(_last(g, k + 1) >> np.uint64(8))
            cost[at, language] += bits
            at, language, bits = seen.of(_last(g, k + 1))
            cost[at, language] = bits
        return cost

    def bits(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) code lengths."""
        g, n = grams(*raw_bytes(texts))
        doc = np.repeat(np.arange(len(texts)), n)
        out = np.zeros((len(texts), len(self.names)))
        step = max(1, COSTS // len(self.names))
        for at in range(0, len(g), step):  # a part of all grams at a time; each distinct one is looked up once
            own, back = np.unique(g[at : at + step], return_inverse=True)
            of = doc[at : at + step]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[of[first]] += np.add.reduceat(self.costs(own)[back], first, axis=0, dtype=np.float64)
        return out

    def answer(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each text."""
        bits = self.bits(texts)
        n = np.array([len(t.encode("utf-8", "replace")) for t in texts])
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
        return bits.argmin(axis=1), 1 / np.exp2(-gap).sum(axis=1)


def learn(docs: DataFrame) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]] | None:
    """Statistics of docs (doc_id, text, lang), for Model."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row for each language
    if not sizes:
        return None
    share = [min(1.0, PER_LANGUAGE / r.n, BYTES / max(r.bytes, 1)) for r in sizes]
    chance = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    by_language = F.map_from_arrays(F.array(*[F.lit(r.lang) for r in sizes]), F.array(*[F.lit(x) for x in share]))
    sample = stored(known.where(chance < F.try_element_at(by_language, F.col("lang"))).select("lang", "text"), "op9")

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            texts, langs = texts_of(batch), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                g, n = np.unique(grams(*raw_bytes([t for t, x in zip(texts, langs, strict=True) if x == lang]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "g", "n"])

    # Bounded with the sample.
    rows = sample.mapInArrow(counted, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    code, g, n = langs.indices.to_numpy(), rows.column("g").to_numpy(), rows.column("n").to_numpy()
    found = langs.dictionary.to_pylist()
    names = sorted(found)
    by = np.argsort(code, kind="stable")
    parts = np.split(by, np.cumsum(np.bincount(code, minlength=len(found)))[:-1]) if names else []
    return (names, [(g[parts[i]].view(np.uint64), n[parts[i]]) for i in map(found.index, names)]) if names else None


_BUILT: dict = {}


def _model(token: str, stats) -> Model:
    """The worker's model, built once from the statistics."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Model(*stats)
    return _BUILT[token]


def predict(docs: DataFrame, stats) -> DataFrame:
    """docs' columns but text, lang_pred and score (in place of columns of those names)."""
    rows, rest = apart_from(docs, "lang_pred", "score")
    shared, token = docs.sparkSession.sparkContext.broadcast(stats), uuid.uuid4().hex  # bounded with the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            names, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            letters = pc.fill_null(pc.match_substring_regex(batch.column("text"), LETTER), False)
            ok = np.flatnonzero(letters.to_numpy(zero_copy_only=False))
            if len(ok) and shared.value is not None:
                model = _model(token, shared.value)
                which, score[ok] = model.answer(texts_of(batch.take(pa.array(ok))))
                for i, k in zip(ok.tolist(), which.tolist(), strict=True):
                    names[i] = model.names[k]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(names, pa.string()), pa.array(score)], ["_row", "lang_pred", "score"])

    return rows.mapInArrow(run, rows.select("_row").schema.add("lang_pred", "string").add("score", "double")).select(*rest, "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    test = held_out("doc_id", 3, 1)
    return predict(docs.select("doc_id", "text"), learn(docs.where(~test))).select("doc_id", test.alias("held_out"), "lang_pred", "score")
