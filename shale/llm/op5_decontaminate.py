"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Words are runs of anything but the six ASCII blanks, A-Z lower-cased; shingles are five words (an item of fewer words
is one shingle of its own length). An item is found in a document if at least 0.8 of the item's distinct shingles occur
there.

Plain MinHash compares sets of like size; test items are short and documents long. So the search is one of containment:
items are partitioned by size (powers of two). An item's sketch is its :data:`SKETCH` least shingle hashes, or all of
them if it has no more; a partition's threshold is the largest hash in its sketches. Of a document, the hashes up to a
partition's threshold are looked up in that partition's sketches, whatever the document's length. The share of an item's
sketch that is met estimates the containment without bias; candidates reach the similarity less :data:`SLACK` (exactly the
similarity where the sketch is the whole set: nothing is lost there; beyond, an item at 0.8 is missed once in 10,000).
Candidates are verified by the shingles themselves.

A benchmark of up to :data:`BROADCAST_BYTES` of text travels to the workers, and each reads its documents once. A larger
one is joined by hash: the workers get the partitions' thresholds and a bitmap of the sketches (:data:`BITMAP` bits, whatever
the benchmark's size), and only document hashes that pass both are shuffled; candidates are joined with their texts by id.
Null texts and items without words match nothing, repeated rows are answered one by one, and empty tables give empty results.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm.arrow import chunks, texts_of
from shale.llm.common import apart_from, kept, packed, stored, table
from shale.llm.tokens import shingle_hashes, word_hashes

SIZE, SIMILARITY, SKETCH, SLACK = 5, 0.8, 64, 0.25
BROADCAST_BYTES = 32 << 20
#: Bits of the sketches' bitmap, as a power of two (16 MB).
BITMAP = 27
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def shingles(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


class Sketches:
    """Sketches of items, by shingle length and size class."""

    def __init__(self, texts: list[str | None]):
        self.size = [min(SIZE, len(words_of(t))) for t in texts]
        parts = defaultdict(list)
        self.sketch: list[np.ndarray] = []
        self.full: list[int] = []
        for i, text in enumerate(texts):
            h, _, n = word_hashes([text or ""])
            h = np.unique(shingle_hashes(h, n, self.size[i])[0]) if self.size[i] else np.zeros(0, np.uint64)
            self.full.append(len(h))
            self.sketch.append(h[:SKETCH])
            if len(h):
                parts[self.size[i], len(h).bit_length()].append(i)
        self.parts = []
        for (size, _), items in sorted(parts.items()):
            h = np.concatenate([self.sketch[i] for i in items])
            owner = np.repeat(items, [len(self.sketch[i]) for i in items])
            by = np.argsort(h, kind="stable")
            self.parts.append((size, h[by], owner[by], h.max()))

    def need(self, i: int, similarity: float) -> int:
        """Sketch hashes that a candidate must meet."""
        exact = self.full[i] <= SKETCH
        share = similarity if exact else similarity - SLACK
        return max(1, math.ceil(share * len(self.sketch[i]) - 1e-9))

    def candidates(self, texts: list[str], similarity: float) -> list[tuple[int, int]]:
        """(text, item) pairs."""
        words, _, counts = word_hashes(texts)
        found, by_size = [], {}
        for size, known, owner, most in self.parts:
            if size not in by_size:
                h, n = shingle_hashes(words, counts, size)
                by_size[size] = h, np.repeat(np.arange(len(texts)), n)
            h, doc = by_size[size]
            low = h <= most
            h, doc = h[low], doc[low]
            first = np.searchsorted(known, h)
            hit = known[np.minimum(first, len(known) - 1)] == h
            h, doc, first = h[hit], doc[hit], first[hit]
            many = np.searchsorted(known, h, side="right") - first
            place = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            met = np.unique(np.stack([np.repeat(doc, many), owner[place], known[place].view(np.int64)], axis=1), axis=0)
            pairs, n = np.unique(met[:, :2], axis=0, return_counts=True)
            found += [(int(d), int(i)) for (d, i), c in zip(pairs, n, strict=True) if c >= self.need(int(i), similarity)]
        return found


def contained(item: list[bytes], doc: list[bytes]) -> tuple[int, int]:
    """The item's distinct shingles, and those of them in the document."""
    size = min(SIZE, len(item))
    own = shingles(item, size)
    return len(own), len(own & shingles(doc, size))


class Search:
    """All items of a benchmark that travels to the workers."""

    def __init__(self, names: list[int], texts: list[str | None], similarity: float):
        self.names, self.similarity = names, similarity
        self.sketches, self.words = Sketches(texts), [words_of(t) for t in texts]

    def hits(self, docs: list[str]) -> list[tuple[int, int, int, int]]:
        """(place in docs, item_id, n_shingles, n_found) of the items found."""
        last, out = (-1, []), []
        for d, i in sorted(self.sketches.candidates(docs, self.similarity)):
            last = last if last[0] == d else (d, words_of(docs[d]))
            n, found = contained(self.words[i], last[1])
            if found >= self.similarity * n - 1e-9:
                out.append((d, self.names[i], n, found))
        return out


def _shared(items: DataFrame, most: int) -> Broadcast | None:
    """The items for all workers, or None if they have more than `most` bytes."""
    if items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0] > most:
        return None
    own = items.select(F.col("item_id").cast("long"), "text").collect()  # bounded by the check above
    return items.sparkSession.sparkContext.broadcast(([r.item_id for r in own], [r.text for r in own]))


_BUILT: dict = {}


def _search(token: str, data: Broadcast, similarity: float) -> Search:
    """The worker's search, built once from the items."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Search(*data.value, similarity)
    return _BUILT[token]


RESULT = ("item_id", "n_shingles", "n_found")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs' columns but text, and :data:`RESULT` (longs), for each document and each of items (item_id, text) in it.

    Columns of docs that are called like those of RESULT are left out.
    """
    data = _shared(items, broadcast_bytes)
    if data is None:
        return _joined(docs, items, similarity)
    (rows, rest), token = apart_from(docs, *RESULT), uuid.uuid4().hex
    schema = rows.select("_row").schema
    for name in RESULT:
        schema = schema.add(name, "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(token, data, similarity)
        for batch in chunks(batches, "text"):
            out = search.hits(texts_of(batch))
            at = pa.array([x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(at), *[pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)]], ["_row", *RESULT])

    return rows.mapInArrow(run, schema).select(*rest, *RESULT)


def _bitmap(sketches: DataFrame) -> np.ndarray:
    """A bit for each hash's first BITMAP bits: at most 2 ** (BITMAP - 6) rows of 64 bits."""
    slot = F.shiftrightunsigned("_h", 64 - BITMAP)
    words = sketches.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_h, {64 - BITMAP}) & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), dtype=np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _joined(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """For benchmarks of any size: sketches and document hashes meet in a join."""
    rows, rest = apart_from(docs, *RESULT)
    found = stored(rows.withColumn("_rid", F.monotonically_increasing_id()), "op5")
    own = stored(items.select(F.col("item_id").cast("long"), F.col("text").alias("_item")).withColumn("_iid", F.monotonically_increasing_id()), "op5")

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sketches(batch.column("_item").to_pylist())
            iid = batch.column("_iid").to_pylist()
            rows = [(int(h), iid[i], s.size[i], s.need(i, similarity), s.full[i].bit_length()) for i, own in enumerate(s.sketch) for h in own.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["_h", "_iid", "_size", "_need", "_class"])

    sketches = kept(own.mapInArrow(sketch, "_h long, _iid long, _size long, _need long, _class long"))
    # Five sizes, some twenty classes each; the order of unsigned hashes is that of signed ones with the first bit turned.
    unsigned = F.col("_h").bitwiseXOR(F.lit(-(1 << 63)))
    most = sketches.groupBy("_size", "_class").agg(F.max(unsigned).alias("most")).collect()
    limits = {size: np.uint64(max(r.most for r in most if r._size == size) + (1 << 63)) for size in sorted({r._size for r in most})}
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(sketches))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in chunks(batches, "text"):
            words, _, counts = word_hashes(texts_of(batch))
            rid = batch.column("_rid").to_numpy()
            for size, limit in limits.items():
                h, n = shingle_hashes(words, counts, size)
                slot = h >> np.uint64(64 - BITMAP)
                ok = (h <= limit) & (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1) == 1)
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), pa.array(np.repeat(rid, n)[ok]), pa.array(np.full(int(ok.sum()), size))], ["_h", "_rid", "_size"])

    hashes = found.select("_rid", "text").mapInArrow(hashed, "_h long, _rid long, _size long").distinct()
    pairs = hashes.join(sketches.drop("_class"), ["_h", "_size"]).groupBy("_rid", "_iid").agg(F.count("*").alias("_n"), F.max("_need").alias("_need")).where("_n >= _need")
    both = pairs.select("_rid", "_iid").join(own, "_iid").join(found, "_rid").select("_row", "text", "item_id", "_item")
    schema = both.select("_row").schema
    for name in RESULT:
        schema = schema.add(name, "long")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            n = np.array([contained(words_of(i), words_of(t)) for i, t in zip(batch.column("_item").to_pylist(), batch.column("text").to_pylist(), strict=True)], dtype=np.int64)
            ok = pa.array(np.flatnonzero(n[:, 1] >= similarity * n[:, 0] - 1e-9))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(ok) for c in ["_row", "item_id"]], pa.array(n[:, 0]).take(ok), pa.array(n[:, 1]).take(ok)], ["_row", *RESULT])

    return both.mapInArrow(verify, schema).select(*rest, *RESULT)


def decontaminate(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the documents that hold an item; all their columns."""
    data = _shared(items, broadcast_bytes)
    if data is not None:
        rows, token = packed(docs).select("_row", "text"), uuid.uuid4().hex

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = _search(token, data, similarity)
            for batch in chunks(batches, "text"):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[x[0] for x in search.hits(texts_of(batch))]] = False
                yield pa.RecordBatch.from_arrays([batch.column("_row").filter(pa.array(clean))], ["_row"])

        return rows.mapInArrow(run, rows.select("_row").schema).select("_row.*")
    found = stored(packed(docs).withColumn("_rid", F.monotonically_increasing_id()), "decontaminate")
    hits = _joined(found.select("_rid", "text"), items, similarity).select("_rid").distinct()
    return found.join(hits, "_rid", "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found", F.round(F.col("n_found") / F.col("n_shingles"), 6).alias("containment"))


FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


def hits_sql(source: str, items: str = "benchmark") -> str:
    """DuckDB: (rid, item, n_shingles, n_found) of the rows (rid, text) of source."""
    return f"""
    with i as (select row_number() over () as item, {FOLDED} as ws from {items}),
    s as (select item, least({SIZE}, len(ws)) as size, ws from i where len(ws) > 0),
    q as (select distinct item, size, array_to_string(ws[k:k + size - 1], chr(32)) as g from (select *, unnest(range(1, len(ws) - size + 2)) as k from s)),
    z as (select distinct size from q),
    d as (select rid, {FOLDED} as ws from {source}),
    p as (select distinct rid, size, array_to_string(ws[k:k + size - 1], chr(32)) as g from (select rid, size, ws, unnest(range(1, len(ws) - size + 2)) as k from d, z where len(ws) >= size)),
    n as (select item, count(*) as n from q group by item),
    f as (select rid, item, count(*) as f from p join q using (size, g) group by rid, item)
    select rid, item, n::bigint as n_shingles, f::bigint as n_found from f join n using (item) where f >= {SIMILARITY} * n - 1e-9"""


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, text from documents), h as ({hits_sql('d')}),
b as (select row_number() over () as item, item_id from benchmark)
select doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) as containment from h join d using (rid) join b using (item)"""
