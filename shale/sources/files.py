"""Files with names of their own: a data source that writes one file for each row, in the tasks, and commits them all at once.

    frame.select("file", "content").write.format("named_files").option("path", folder).mode("append").save()

A task writes beside the folder, under ``_writing/<job>/<task attempt>``; only when every task is done does the commit move the files to
their names, and a job that fails leaves none. A file of a name that is there is replaced. The folder may be in any store that
Arrow's file systems know (shared disks, HDFS, S3); reading it back is Spark's (:func:`shale.sources.captured_bodies`).

The commit knows what lies at the top of each task's folder, not the files: a folder that one task alone has written, and that isn't there
yet, is moved whole. Only the files of other folders are moved one by one; their names are taken from the tasks' folders.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from shale.functions import text as tx
from shale.sources import sinks

FORMAT = "named_files"
SCHEMA = "file string, content binary"


def _opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _names(system, at: str, base: str) -> list[str]:
    """The names below base of the files at a path, which may be one."""
    from pyarrow import fs

    info = system.get_file_info(at)
    found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    return [posixpath.relpath(x.path, base) for x in found if x.type == fs.FileType.File]


#: Files that are moved at a time; bytes of contents that are read into one batch.
MOVED, READ_BYTES = 16, 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: where it is, and the names at the top of that."""

    at: str = ""
    tops: list[str] = field(default_factory=list)


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_writing/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = _opened(self.path)
        at = posixpath.join(self.job, uuid.uuid4().hex)
        names: set[str] = set()
        folders: set[str] = set()
        for row in iterator:
            name = posixpath.normpath(row["file"])
            if name.startswith(("/", "../", "_writing")) or name in ("..", "."):
                raise ValueError(f"not a name inside the folder: {row['file']!r}")
            if name in names:
                raise ValueError("two rows have the same file name")
            names.add(name)
            target = posixpath.join(root, at, name)
            if (folder := posixpath.dirname(target)) not in folders:
                system.create_dir(folder)
                folders.add(folder)
            with system.open_output_stream(target) as f:
                f.write(bytes(row["content"] or b""))
        return Written(at, sorted({n.split("/", 1)[0] for n in names}))

    def commit(self, messages: list[Written]) -> None:
        system, root = _opened(self.path)
        from pyarrow import fs

        written = [m for m in messages if m.tops]
        tasks = Counter(top for m in written for top in m.tops)
        below = lambda m, top: _names(system, posixpath.join(root, m.at, top), posixpath.join(root, m.at))
        shared = {(m.at, top): below(m, top) for m in written for top in m.tops if tasks[top] > 1}
        if max(Counter(n for names in shared.values() for n in names).values(), default=0) > 1:
            self._clear(system, root)
            raise ValueError("two rows have the same file name")
        there = {x.base_name: x for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name != "_writing"}
        if self.overwrite:
            for found in there.values():
                (system.delete_dir if found.type == fs.FileType.Directory else system.delete_file)(found.path)
            there = {}
        with ThreadPoolExecutor(MOVED) as pool:
            for m in written:
                whole = [top for top in m.tops if tasks[top] == 1 and top not in there]
                single = [n for top in m.tops if tasks[top] > 1 or top in there for n in shared.get((m.at, top)) or below(m, top)]
                for folder in {posixpath.dirname(posixpath.join(root, n)) for n in single}:
                    system.create_dir(folder)
                for _ in pool.map(lambda n, at=m.at: system.move(posixpath.join(root, at, n), posixpath.join(root, n)), [*whole, *single]):
                    pass
        self._clear(system, root)

    def abort(self, messages: list[Written]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        own = posixpath.join(root, self.job)
        if system.get_file_info(own).type == fs.FileType.Directory:
            system.delete_dir(own)
        outer = posixpath.join(root, "_writing")
        if system.get_file_info(outer).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(outer)):
            system.delete_dir(outer)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write_named(frame: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes frame (file, content: string or binary), a file for each row."""
    spark = frame.sparkSession
    spark.dataSource.register(NamedFiles)
    rows = frame.select(F.col("file").cast("string").alias("file"), F.col("content").cast("binary").alias("content"))
    rows.write.format(FORMAT).option("path", path).mode("overwrite" if overwrite else "append").save()


def write_chunks(records: DataFrame, path: str, site: str, stamp: Column, label: Column, order: list[str], size: int = 20) -> None:
    """JSON arrays of at most `size` records each: <site>/chunks/<stamp>_<label>-<n>.json under path.

    Records of a label get their places in one distributed sort, so that no list holds more than a chunk.
    """
    from shale import storage

    named = records.withColumns({"_stamp": stamp, "_label": tx.safe_name(label)})
    places = storage.ranked(named, [F.col("_stamp"), F.col("_label"), *[F.col(c) for c in order]], "_n")
    first = places.groupBy("_stamp", "_label").agg(F.min("_n").alias("_first"))
    number = F.floor((F.col("_n") - F.col("_first")) / size)
    rows = places.join(first, ["_stamp", "_label"]).select("_stamp", "_label", number.alias("_chunk"), "_n", F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("_r"))
    lists = rows.groupBy("_stamp", "_label", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_n", F.to_json("_r").alias("j")))).alias("_l"))
    content = F.concat(F.lit("[\n"), F.array_join(F.transform("_l", lambda x: x["j"]), ",\n"), F.lit("\n]\n"))
    file = tx.chunk_name(F.lit(site), F.col("_stamp"), F.concat_ws("-", "_label", F.col("_chunk").cast("string")))
    write_named(lists.select(file.alias("file"), content.alias("content")), path)


def capture_files(requests: DataFrame) -> DataFrame:
    """(file, content): the files of each captured request, in the folder of its slug.

    requests: slug, method, url, headers (array of 'Name: value'), request_body (JSON or null), status, content_type, response_headers
    (map), body, and other columns, which go into the metadata. Cookies and the like never do: sensitive_values_stored is false.
    """
    at = lambda name: F.concat(F.col("slug"), F.lit("/"), name if isinstance(name, Column) else F.lit(name))
    body_name = F.concat(F.lit("response_body."), tx.extension(F.col("content_type")))
    head = F.concat(F.lit("HTTP status: "), F.coalesce(F.col("status").cast("string"), F.lit("None")))
    headers = F.transform(F.map_entries(F.coalesce("response_headers", F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    known = ("slug", "method", "url", "headers", "request_body", "status", "content_type", "response_headers", "body")
    more = [F.col(f"`{c}`") for c in requests.columns if c not in known]
    metadata = F.to_json(F.struct("slug", F.upper("method").alias("method"), F.col("url").alias("request_url"), "status", "content_type", F.octet_length("body").alias("body_length"), body_name.alias("response_body_file"), *more, F.lit(False).alias("sensitive_values_stored")), {"ignoreNullFields": "false"})
    line = lambda x: F.concat(x, F.lit("\n")).cast("binary")
    file = lambda name, content: F.struct(at(name).alias("file"), content.alias("content"))
    files = F.array(
        file("request.curl", line(sinks.curl(F.col("method"), F.col("url"), F.col("headers"), F.col("request_body")))),
        file("request_body.json", F.when(F.col("request_body").isNotNull(), line(F.col("request_body")))),
        file("response_headers.txt", line(F.array_join(F.concat(F.array(head), headers), "\n"))),
        file(body_name, F.col("body").cast("binary")), file("metadata.json", line(metadata)),
    )
    return requests.select(F.explode(F.filter(files, lambda x: x["content"].isNotNull())).alias("x")).select("x.*")


def read_named(spark: SparkSession, path: str) -> DataFrame:
    """(file, content) of the files under path, by their names below it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = re.sub("^(file:)?/+", "/", path).rstrip("/")
    return rows.select(F.regexp_replace("path", rf"^.*?\Q{base}\E/", "").alias("file"), "content")


def read_listed(names: DataFrame, path: str) -> DataFrame:
    """(file, content) of the files with these names (column file) under path: opened in the tasks, so that nobody lists the folder."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(path.rstrip("/"))
        held: dict[str, bytes] = {}
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.binary())], ["file", "content"])
        for given in batches:
            for name in map(posixpath.normpath, given.column("file").to_pylist()):
                with system.open_input_stream(posixpath.join(root, name)) as f:
                    content = f.read()
                if held and (size + len(content) > READ_BYTES or name in held):
                    yield batch()
                    held, size = {}, 0
                held[name] = content
                size += len(content)
        if held:
            yield batch()

    return names.select("file").mapInArrow(read, SCHEMA)
