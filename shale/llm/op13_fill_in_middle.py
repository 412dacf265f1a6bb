"""Fill-in-middle transformation by SQL of an embedded DuckDB on each Arrow batch.

A text is cut into n units (a word with the blanks before it, or the blanks at the end), of which two places chosen by a hash
of the seed and doc_id make a prefix, a middle and a suffix. Documents that are drawn for it are rewritten as
``<S>suffix<P>prefix<M>middle`` (spm) or ``<P>prefix<S>suffix<M>middle`` (psm); the others stay plain, and so do empty texts and
texts that hold a marker, so that :func:`restored` gives back every text exactly.

A batch is registered as a DuckDB table in chunks of bounded size, rewritten by one SQL statement and returned as Arrow; no row
passes through Python. DuckDB runs one thread in its task, within :data:`MEMORY`, and never writes to disk.

Null texts count as empty; a null doc_id hashes as the empty string; repeated rows are answered alike; an empty table gives an
empty result. Columns of any name go through untouched, except that text and those of :data:`MADE` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shale.llm.arrow import chunks
from shale.llm.common import table

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MEMORY = "1GB"

#: What :func:`transformed` adds to a row, or puts in place of a column of that name.
MADE = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}


def transform_sql(source: str, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> str:
    """DuckDB: (i, doc_id, n, form, prefix_chars, middle_chars, output) of the rows (i, doc_id, text) of source."""
    group = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::ubigint"
    marked = " or ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
    with hashed as (select i, doc_id, coalesce(text, '') as t, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h from {source}),
    units as (select *, regexp_extract_all(t, '{UNIT}') as u, {group(0)} as h1, {group(1)} as h2, {group(2)} as h3, {group(3)} as h4 from hashed),
    drawn as (select *, len(u)::bigint as n, (h1 % (len(u) + 1)::ubigint)::bigint as a, (h2 % (len(u) + 1)::ubigint)::bigint as b,
              case when t = '' or {marked} or h3 % 100 >= {fim_percent} then 'plain' when h4 % 100 < {spm_percent} then 'spm' else 'psm' end as form from units),
    parts as (select i, doc_id, n, form, t,
              case when form <> 'plain' then array_to_string(list_slice(u, 1, least(a, b)), '') end as p,
              case when form <> 'plain' then array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') end as m,
              case when form <> 'plain' then array_to_string(list_slice(u, greatest(a, b) + 1, n), '') end as s from drawn)
    select i, doc_id, n, form, length(p)::bigint as prefix_chars, length(m)::bigint as middle_chars,
           case form when 'plain' then t when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                     else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end as output from parts"""


def _between(start: str, end: str | None) -> str:
    at = f"(strpos(output, '{start}') + {len(start)})"
    return f"substr(output, {at})" if end is None else f"substr(output, {at}, strpos(output, '{end}') - {at})"


def restore_sql(source: str) -> str:
    """DuckDB: the columns of source and ``restored``, the text that output and form were made from."""
    last = _between(MIDDLE, None)
    psm = f"{_between(PREFIX, SUFFIX)} || {last} || {_between(SUFFIX, MIDDLE)}"
    spm = f"{_between(PREFIX, MIDDLE)} || {last} || {_between(SUFFIX, PREFIX)}"
    return f"select *, case form when 'psm' then {psm} when 'spm' then {spm} else output end as restored from {source}"


def digest_sql(source: str) -> str:
    """DuckDB: the contract's columns of the rows (i, doc_id, text) of source."""
    return f"""
    select i, doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(restored) as restored_sha256
    from ({restore_sql(f'({transform_sql(source)})')})"""


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:")
    con.execute(f"set threads = 1; set memory_limit = '{MEMORY}'; set temp_directory = ''")
    return con


def _by_sql(docs: DataFrame, inputs: list[str], sql: str, made: dict[str, T.DataType]) -> DataFrame:
    """docs with the columns made, computed by sql over ``batch`` (i, inputs), in place of any of those names."""
    rest = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*rest, *[T.StructField(k, v) for k, v in made.items()]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, types = _connection(), {"string": pa.string(), "bigint": pa.int64()}
        for own in chunks(batches, inputs[-1]):
            columns = [pa.array(range(own.num_rows), pa.int64()), *[own.column(c) for c in inputs]]
            con.register("batch", pa.Table.from_arrays(columns, ["i", *inputs]))
            out = con.sql(f"select * from ({sql}) order by i").to_arrow_table()
            con.unregister("batch")
            new = [out.column(k).cast(types[v.simpleString()]).combine_chunks() for k, v in made.items()]
            arrays = [own.column(f.name) for f in rest] + new
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return docs.mapInArrow(run, schema)


def transformed(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) with the rewritten text, and :data:`MADE`."""
    sql = f"select i, n, form, prefix_chars, middle_chars, output as text from ({transform_sql('batch', seed, fim_percent, spm_percent)})"
    return _by_sql(docs, ["doc_id", "text"], sql, MADE | {"text": T.StringType()}).select(*docs.columns, *[c for c in MADE if c not in docs.columns])


def restored(rows: DataFrame) -> DataFrame:
    """What :func:`transformed` gave, with the texts as they were before it (null ones empty)."""
    sql = f"select i, restored as text from ({restore_sql('(select i, form, text as output from batch)')})"
    return _by_sql(rows, ["form", "text"], sql, {"text": T.StringType()}).select(*rows.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) as doc_id", "text")
    digests = {"output_sha256": T.StringType(), "restored_sha256": T.StringType()}
    return _by_sql(docs, ["doc_id", "text"], digest_sql("batch"), MADE | digests).drop("text")


ORACLE = f"select * exclude (i) from ({digest_sql('(select 0 as i, doc_id, text from documents)')})"
