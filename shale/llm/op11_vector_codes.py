"""Vector code compression: product quantisation with integer codebooks, exact at every step.

Components become integers, floor(256 * x), and vectors are cut into equal consecutive parts. Each part position has a codebook,
which starts as that part of the first vectors by vec_id; each round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces an entry by the floored mean of its parts.

The codebooks (parts x entries x length integers, whatever the number of vectors) travel to the workers. These compute all
distances of an Arrow batch by the norm expansion |x|^2 - 2 x.c + |c|^2 with int64 matrix products, and take the first least one.
Sums and counts are gathered in each task and merged by a grouped shuffle, so a round moves tasks x codebook rows only. Floats
never add up: results don't depend on partitioning.

Defined cases: null vectors, and those with null, NaN or infinite components, are dropped. The dimension is that of the kept
vector with the least vec_id (null ids last; then the lesser vector); vectors of another dimension, and empty ones, have no
code in these books and are dropped too. A dimension that isn't a multiple of the parts is filled up with zeros. Fewer vectors
than entries give as many entries as vectors. Integers are held within +-2**24 (|x| <= 65,536), so no sum overflows. Repeated
rows and ids count one by one; an empty table gives an empty result. Other columns, whatever they are called, go through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shale.llm.common import stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
LIMIT = 1 << 24
#: Vectors whose distances are held at a time.
TOGETHER = 1 << 13
#: Labels whose sums are broadcast, at most (about 32 MB); more are joined by shuffle.
BROADCAST = 1 << 20


def integers(vectors: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, (len(places), dimension) int64) of the vectors that are kept; without a dimension all must have one."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), dtype=np.int64)
    flat = vectors.flatten()  # leaves out what null lists hold
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
    ends = np.cumsum(lengths)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if dimension is not None:
        keep &= lengths == dimension
    at = np.flatnonzero(keep)
    width = dimension if dimension is not None else int(lengths[at[0]]) if len(at) else 0
    rows = values[(ends - lengths)[at][:, None] + np.arange(width)] if len(at) else np.zeros((0, width))
    return at, np.clip(np.floor(SCALE * rows), -LIMIT, LIMIT).astype(np.int64)


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """(n, parts, length) of the rows, filled up with zeros."""
    length = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * length - x.shape[1]))).reshape(len(x), parts, length)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (n, parts), of cut rows."""
    codes, least = np.empty(x.shape[:2], dtype=np.int64), np.empty(x.shape[:2], dtype=np.int64)
    for k, book in enumerate(books):
        own = np.ascontiguousarray(x[:, k])
        d = (book * book).sum(axis=1)[None, :] - 2 * (own @ book.T)
        codes[:, k] = d.argmin(axis=1)
        least[:, k] = np.take_along_axis(d, codes[:, k : k + 1], axis=1)[:, 0] + (own * own).sum(axis=1)
    return codes, least


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            yield batch.slice(at, TOGETHER)


def first_vectors(vectors: DataFrame, n: int) -> np.ndarray:
    """(at most n, dimension) integers of the kept vectors with the least vec_ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("embedding")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(rows), 0), dtype=np.int64)
            for width in np.unique(lengths[lengths > 0]).tolist():
                at, x = integers(rows, width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), lists], ["vec_id", "x"])

    kept = vectors.select("vec_id", "embedding").mapInArrow(run, T.StructType([vectors.schema["vec_id"], T.StructField("x", T.ArrayType(T.LongType()))]))
    order = [F.col("vec_id").asc_nulls_last(), F.col("x").asc()]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((0, 0), dtype=np.int64)
    own = kept.where(F.size("x") == len(first[0].x)).orderBy(*order).limit(n).collect()  # n rows, whatever the table's size
    return np.array([r.x for r in own], dtype=np.int64)


def _sums(vectors: DataFrame, books: np.ndarray, dimension: int) -> DataFrame:
    """(cell, count, total): for each component of each entry, the number of its parts and their sum."""
    parts, entries, length = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in _slices(batches):
            x = cut(integers(batch.column("embedding"), dimension)[1], parts)
            codes = nearest(x, books)[0]
            for k in range(parts):
                counts[k] += np.bincount(codes[:, k], minlength=entries)
                np.add.at(totals[k], codes[:, k], x[:, k])
        used = np.flatnonzero(np.repeat(counts.ravel(), length))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.repeat(counts.ravel(), length)[used]), pa.array(totals.ravel()[used])], ["cell", "count", "total"])

    partial = vectors.select("embedding").mapInArrow(run, "cell long, count long, total long")
    return partial.groupBy("cell").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Codebooks (parts, entries, length) of vectors (vec_id, embedding), and the dimension; (0 entries, 0) if none is kept."""
    first = first_vectors(vectors, entries)
    dimension = first.shape[1]
    books = np.ascontiguousarray(cut(first, parts).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        rows = _sums(vectors, books, dimension).collect()  # a row for each integer of the codebooks, at most
        flat = books.ravel()
        for r in rows:
            flat[r["cell"]] = r["total"] // r["count"]
    return books, dimension


def encoded(vectors: DataFrame, books: np.ndarray, dimension: int) -> DataFrame:
    """vectors' columns but embedding, and ``codes`` array<int>, ``error`` long, for the vectors that have a code."""
    rest = [c for c in vectors.columns if c not in ("embedding", "codes", "error")]
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`") for c in rest])
    rows = vectors.select(row.alias("_row"), "embedding")
    schema = T.StructType([rows.schema["_row"], T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    parts = books.shape[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            if not books.shape[1]:
                continue
            at, x = integers(batch.column("embedding"), dimension)
            codes, least = nearest(cut(x, parts), books)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * parts), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(at)), lists, pa.array(least.sum(axis=1))], ["_row", "codes", "error"])

    return rows.mapInArrow(run, schema).select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], "codes", "error")


def decoded(rows: DataFrame, books: np.ndarray, dimension: int) -> DataFrame:
    """rows (codes, ...) with ``vector`` array<double>: the middle of the cells that the codes' entries stand for."""
    schema = T.StructType([f for f in rows.schema.fields if f.name != "vector"]).add("vector", T.ArrayType(T.DoubleType()))
    rest = [c for c in rows.columns if c != "vector"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            codes = np.asarray(batch.column("codes").flatten(), dtype=np.int64).reshape(batch.num_rows, len(books))
            x = books[np.arange(len(books))[None, :], codes].reshape(batch.num_rows, -1)[:, :dimension]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimension), pa.array(((x + 0.5) / SCALE).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], lists], [*rest, "vector"])

    return rows.mapInArrow(run, schema)


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books, dimension = trained(vectors)
    digit = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    coded = encoded(vectors, books, dimension).select("vec_id", "label", F.array_join(F.transform("codes", digit), "").alias("code"), "error")
    coded = stored(coded, "op11")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned_sql(books: str) -> str:
    """DuckDB: (rid, part, x, entry, distance) of the parts' nearest entries."""
    return f"""
    select rid, part, x, arg_min(entry, (d, entry)) as entry, min(d) as d from (
      select p.rid, p.part, p.x, b.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda k: (p.x[k] - b.c[k]) * (p.x[k] - b.c[k])))::bigint as d
      from p join {books} b using (part)) group by rid, part, x"""


def _round_sql(k: int) -> str:
    return f"""
    a{k} as materialized ({_assigned_sql(f'b{k}')}),
    m{k} as (select part, entry, k, sum(x[k])::bigint as s, count(*)::bigint as n from a{k}, unnest(range(1, len(x) + 1)) as r(k) group by all),
    u{k} as (select part, entry, list((s - ((s % n) + n) % n) // n order by k) as c from m{k} group by part, entry),
    b{k + 1} as materialized (select b.part, b.entry, coalesce(u.c, b.c) as c from b{k} b left join u{k} u using (part, entry))"""


#: A dimension that is a multiple of the parts, the same for all vectors, and distinct ids are taken for granted here.
ORACLE = f"""
with v as (select row_number() over (order by vec_id) as rid, vec_id, label, [floor({SCALE} * x::double)::bigint for x in embedding] as x from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select rid, part, x[part * (len(x) // {PARTS}) + 1 : (part + 1) * (len(x) // {PARTS})] as x from v, unnest(range(0, {PARTS})) as r(part)),
b0 as materialized (select part, (rid - 1)::bigint as entry, x as c from p where rid <= {ENTRIES}),
{','.join(_round_sql(k) for k in range(ROUNDS))},
a as materialized ({_assigned_sql(f'b{ROUNDS}')}),
e as (select rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) as code, sum(d)::bigint as error from a group by rid),
s as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b{ROUNDS})
select v.vec_id, e.code, e.error, (sum(e.error) over (partition by v.label))::bigint as label_error, s.codebooks_sha256
from v join e using (rid), s"""
