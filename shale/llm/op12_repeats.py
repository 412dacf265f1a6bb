"""Repeated passages by a depth-limited radix sort of suffixes: bytes of a string of 50 that also starts in an earlier document.

Texts are UTF-8 bytes. A suffix counts through its first :data:`THRESHOLD` bytes, a window. Windows are sorted by
most-significant-digit passes, and a pass drops every group that has members of one document only; the groups that are left
after the last pass are exactly the repeated windows. A window's bytes go if an equal window starts in a document of a smaller
doc_id.

First digit. A window is dealt out by a digit that its bytes determine: the least hash among its pieces of :data:`PIECE` bytes,
mixed once more, since least hashes crowd the low end and buckets follow the digits' first bits. Windows that follow each other
mostly have that piece in common; such a run is one segment, so that a sixteenth of the bytes' number has to be moved, not all
of them.

Four readings of the texts, in chunks (a row each; the chunk is a compressed Arrow stream):

1. A chunk sends the digits of its windows, shortened to a few bytes, to the digits' buckets. These answer which digits occur in
   more than one document; all others are done with.
2. A chunk sends hashes of the distinct segments of the digits that are left, with the least doc_id that has them in the chunk. A
   bucket answers which segments an earlier document has as a whole, and asks for the bytes of the others, if their digit has
   different segments: of each from its first document only.
3. A chunk sends these bytes. A bucket orders the windows of a digit by the further digits, eight bytes a pass, and answers
   with a bit for each window of which an earlier document has another.
4. A chunk puts together the removed runs of its documents.

Only distinct segments of a chunk travel, so a passage in a third of all documents costs a bucket one entry for each chunk. A
digit with more than :data:`HOT` segments (a phrase in ever new surroundings) is dealt out by its segments, and then by whole
windows, each from one document of a chunk. Nothing is held in one place but a chunk, or a bucket, whose number grows with the
bytes.

Defined cases: null texts count as empty; texts shorter than a window keep everything; rows of equal doc_id don't remove each
other, and null ids count as the largest; an empty table gives an empty result; other columns, whatever they are called, go
through. A removed run may begin or end inside a character, so what is left is binary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shale.llm.arrow import spread
from shale.llm.common import identified, stored, table
from shale.llm.tokens import BASE, INVERSE, mixed
from shale.storage import cleaned, settings

THRESHOLD, PIECE = 50, 20
#: Bytes of text in a chunk, and of windows that are hashed at a time; windows in a segment, at most (a bit each).
CHUNK_BYTES, BLOCK, RUN = 4 << 20, 1 << 18, 64
#: Segments of a digit from which its windows are dealt out one by one; bytes of text for a bucket; buckets, at least.
HOT, BUCKET_BYTES, BUCKETS = 2048, 16 << 20, 256
#: Bytes of a bucket's segments that are compared at a time, unless one route has more: they take a hundred times that in numbers.
JUDGED_BYTES = 1 << 20
#: Bytes of a bucket's rows that reach a worker at a time: they lie in the executor's and the worker's memory at once.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
LAST = np.int64(2**63 - 1)
KEY = ("file", "row")
BYTES = pa.binary()


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Hashes of any stretches of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.back = _powers(len(raw) + 1, INVERSE)
        self.total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(len(raw), BASE), out=self.total[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.back[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` values in a row."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


class Segments:
    """The runs of windows of one digit, of all texts of a chunk: start, n (windows), digit, content (hash), doc (place)."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.end = np.cumsum(self.size)
        found: list[tuple[np.ndarray, ...]] = []
        windows = len(self.raw) - THRESHOLD + 1
        for at in range(0, max(windows, 0), BLOCK):
            found.append(self._block(at, min(BLOCK, windows - at)))
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
        self.start, self.n, self.digit, self.content = parts
        self.doc = np.searchsorted(self.end, self.start, side="right")

    def _block(self, at: int, n: int) -> tuple[np.ndarray, ...]:
        raw = self.raw[at : at + n + THRESHOLD - 1]
        h = Hashes(raw)
        least = _least(h.of(slice(0, len(raw) - PIECE + 1), slice(PIECE, None)), THRESHOLD - PIECE + 1)
        # Windows that reach into the next text are none.
        last = self.end[(self.end > at) & (self.end - THRESHOLD + 1 < at + n)] - at
        whole = np.zeros(n + 1, dtype=np.int32)
        np.add.at(whole, np.clip(last - THRESHOLD + 1, 0, n), 1)
        np.add.at(whole, np.clip(last, 0, n), -1)
        whole = np.cumsum(whole[:n]) == 0
        new = np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])]
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, n])
        keep = whole[first]
        first, length = first[keep], length[keep]
        pieces = -(-length // RUN)
        step = spread(np.zeros(len(first), np.int64), pieces)
        first, length = np.repeat(first, pieces) + step * RUN, np.minimum(np.repeat(length, pieces) - step * RUN, RUN)
        return first + at, length, mixed(least[first]), h.of(first, first + length + THRESHOLD - 1)

    def bytes_of(self, which: np.ndarray) -> np.ndarray:
        return self.raw[spread(self.start[which], self.n[which] + THRESHOLD - 1)]

    def distinct(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(by, new): places of segments in order of (digit, content, doc_id), and where a distinct one begins."""
        by = among[np.lexsort((ids[self.doc[among]], self.content[among], self.digit[among]))]
        d, c = self.digit[by], self.content[by]
        return by, np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])][: len(by)]


def _texts(chunk: pa.RecordBatch | pa.Table) -> tuple[list[bytes], np.ndarray]:
    texts = chunk.column("text").cast(pa.binary()).to_pylist()
    ids = chunk.column("doc_id").fill_null(int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
    return [x or b"" for x in texts], ids


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
    """The chunks, each with its key: the file and place of its first row. They follow the rows alone, however these come in batches."""

    def whole(parts: list[pa.RecordBatch]) -> tuple[tuple[int, int], pa.RecordBatch]:
        chunk = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        rid = chunk.column("_rid")[0].as_py()
        return (rid["file"], rid["row"]), chunk

    held: list[pa.RecordBatch] = []
    room = CHUNK_BYTES
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(size[start - 1]) if start else 0
            end = int(np.searchsorted(size, before + room, side="right"))
            end = max(end, start if held else start + 1)
            if end > start:
                held.append(batch.slice(start, end - start))
                room -= int(size[end - 1]) - before
                start = end
            if start < batch.num_rows:
                yield whole(held)
                held, room = [], CHUNK_BYTES
    if held:
        yield whole(held)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of an ascending array."""
    edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def _numbers(values: Iterable[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=kind)


def _packed(values: np.ndarray) -> bytes:
    """Ascending numbers as their differences, the bytes of one weight after the other: most of these are zero."""
    steps = np.diff(values, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Dealing:
    """How digits are shortened, and which bucket has them; both follow the bytes of all texts."""

    def __init__(self, total_bytes: int):
        self.bucket_bits = max(BUCKETS - 1, total_bytes // BUCKET_BYTES).bit_length()
        self.bits = min(64, max(32, (total_bytes // 16).bit_length() + 8))  # by chance, one digit in 256 has another's short form

    def short(self, digits: np.ndarray) -> np.ndarray:
        return digits >> np.uint64(64 - self.bits)

    def bucket(self, digits: np.ndarray) -> np.ndarray:
        return (digits >> np.uint64(64 - self.bucket_bits)).astype(np.int64)


def _digits(deal: Dealing, texts: list[bytes], ids: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, short digits, what) of a chunk; what: distinct segments of the digit (127 at most), and 128 if in two documents."""
    own = Segments(texts)
    by, new = own.distinct(ids, np.arange(len(own.start)))
    short, doc = deal.short(own.digit[by]), ids[own.doc[by]]
    first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]][: len(by)])
    if not len(first):
        return
    what = np.minimum(np.add.reduceat(new.astype(np.int64), first), 127)
    what += 128 * (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
    found = short[first]
    for bucket, run in _by_bucket((found >> np.uint64(deal.bits - deal.bucket_bits)).astype(np.int64)):
        yield bucket, _packed(found[run]), what[run].astype(np.uint8).tobytes()


def _by_key(batches: Iterable[pa.RecordBatch], key: str = "bucket") -> Iterator[pa.Table]:
    """The rows of each bucket, from batches in order of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for value, run in _by_bucket(batch.column(key).to_numpy()):
            own = batch.slice(run.start, run.stop - run.start)
            if held and held[0].column(key)[0].as_py() != value:
                yield pa.Table.from_batches(held)
                held = []
            held.append(own)
    if held:
        yield pa.Table.from_batches(held)


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a bucket, its short digits that occur in several documents; those with many segments are marked."""
    for rows in _by_key(batches):
        own = [_unpacked(x) for x in rows.column("digits").to_pylist()]
        digit, chunk = np.concatenate(own), np.repeat(np.arange(len(own)), list(map(len, own)))
        what = _numbers(rows.column("what").to_pylist(), "u1").astype(np.int64)
        by = np.argsort(digit, kind="stable")
        new = np.r_[True, digit[by][1:] != digit[by][:-1]]
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        many = (np.diff(np.r_[first, len(by)]) > 1) | (np.maximum.reduceat(what[by], first) >= 128)
        hot = np.add.reduceat(what[by] % 128, first) > HOT
        keep = np.zeros(len(by), dtype=bool)
        keep[by] = many[group]
        marked = np.zeros(len(by), dtype=np.uint8)
        marked[by] = hot[group]
        digit, chunk, marked = digit[keep], chunk[keep], marked[keep]
        runs = list(_by_bucket(chunk))
        at = pa.array([c for c, _ in runs], pa.int64())
        columns = [rows.column(k).take(at).combine_chunks() for k in KEY]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([_packed(digit[r]) for _, r in runs], BYTES), pa.array([marked[r].tobytes() for _, r in runs], BYTES)], [*KEY, "digits", "hot"])


PAIR = np.dtype([("digit", "u8"), ("content", "u8")])
ANSWER = np.dtype([("digit", "u8"), ("content", "u8"), ("mask", "u8")])
ASK = np.dtype([("digit", "u8"), ("content", "u8"), ("hot", "u1")])


def _pairs(digit: np.ndarray, content: np.ndarray) -> np.ndarray:
    out = np.empty(len(digit), dtype=PAIR)
    out["digit"], out["content"] = digit, content
    return out


def _ranks(*pairs: np.ndarray) -> list[np.ndarray]:
    """Numbers in place of (digit, content), the same for equal ones."""
    d, c = (np.concatenate([p[k] for p in pairs]) for k in ("digit", "content"))
    by = np.lexsort((c, d))
    rank = np.empty(len(by), dtype=np.int64)
    rank[by] = np.cumsum(np.r_[True, (d[by][1:] != d[by][:-1]) | (c[by][1:] != c[by][:-1])][: len(by)]) - 1
    return np.split(rank, np.cumsum([len(p) for p in pairs])[:-1])


SEGMENT = {"digit": "u8", "content": "u8", "least": "i8", "hot": "u1"}


def _left(deal: Dealing, texts: list[bytes], ids: np.ndarray, left: pa.Table) -> Iterator[tuple[int, dict[str, bytes]]]:
    """(bucket, segments by column) of a chunk's distinct segments whose digits are left."""
    own = Segments(texts)
    digits = [_unpacked(x) for x in left.column("digits").to_pylist()]
    if not digits or not len(own.start):
        return
    digits, hot = np.concatenate(digits), _numbers(left.column("hot").to_pylist(), "u1")
    by = np.argsort(digits)
    digits, hot = digits[by], hot[by]
    short = deal.short(own.digit)
    at = np.minimum(np.searchsorted(digits, short), len(digits) - 1)
    by, new = own.distinct(ids, np.flatnonzero(digits[at] == short))
    which = by[new]  # a distinct segment's first document has the least id
    rows = {"digit": own.digit[which], "content": own.content[which], "least": ids[own.doc[which]], "hot": hot[at[which]]}
    bucket = deal.bucket(np.where(rows["hot"] == 1, mixed(rows["digit"] ^ rows["content"]), rows["digit"]))
    by = np.argsort(bucket, kind="stable")
    for b, run in _by_bucket(bucket[by]):
        yield b, {k: rows[k][by[run]].astype(kind).tobytes() for k, kind in SEGMENT.items()}


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of a bucket: answers on segments that an earlier document has, and asks for the bytes of others."""
    for rows in _by_key(batches):
        e = {k: _numbers(rows.column(k).to_pylist(), kind) for k, kind in SEGMENT.items()}
        chunk = np.repeat(np.arange(rows.num_rows), [len(x) for x in rows.column("hot").to_pylist()])
        by = np.lexsort((e["least"], e["content"], e["digit"]))
        digit, content, least = (e[k][by] for k in ("digit", "content", "least"))
        other = np.r_[True, digit[1:] != digit[:-1]]
        new = other | np.r_[True, content[1:] != content[:-1]]
        first, number, group = np.flatnonzero(new), np.cumsum(new) - 1, np.cumsum(other) - 1
        later = least > least[first][number]
        several = np.bincount(group[first])[group] > 1
        asked = ~later & (several | (e["hot"][by] == 1))
        own: dict[int, list[bytes]] = {}
        for k, some in ((0, later), (1, asked)):
            at = by[some]
            at = at[np.argsort(chunk[at], kind="stable")]
            out = np.zeros(len(at), dtype=(ANSWER, ASK)[k])
            out["digit"], out["content"] = e["digit"][at], e["content"][at]
            if k:
                out["hot"] = e["hot"][at]
            else:
                out["mask"] = ~np.uint64(0)
            for c, run in _by_bucket(chunk[at]):
                own.setdefault(c, [b"", b""])[k] = out[run].tobytes()
        at = pa.array(list(own), pa.int64())
        columns = [rows.column(k).take(at).combine_chunks() for k in KEY]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[k] for x in own.values()], BYTES) for k in (0, 1)]], [*KEY, "answers", "asks"])


ENTRY = {"digit": "u8", "content": "u8", "least": "i8", "n": "u1", "from": "u1", "route": "u8"}


def _entries(deal: Dealing, texts: list[bytes], ids: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, dict[str, bytes], bytes, bytes]]:
    """(bucket, entries by column, their bytes, answers that are known here) of the segments that a chunk is asked for."""
    if not len(asks):
        return
    own = Segments(texts)
    mine, wanted = _ranks(_pairs(own.digit, own.content), asks)
    marks = np.zeros(max(int(mine.max()), int(wanted.max())) + 1, dtype=np.uint8)
    marks[wanted] = 1 + asks["hot"]
    by, new = own.distinct(ids, np.flatnonzero(marks[mine]))
    which = by[new]
    of = {"digit": own.digit[which], "content": own.content[which], "least": ids[own.doc[which]], "n": own.n[which]}
    many = marks[mine[which]] == 2
    rows = {k: v[~many] for k, v in of.items()} | {"from": np.zeros((~many).sum(), np.int64), "route": of["digit"][~many]}
    raw, size = [own.bytes_of(which[~many])], [own.n[which[~many]] + THRESHOLD - 1]
    known = np.zeros(0, dtype=ANSWER)
    if many.any():  # window by window, each of one document only
        h = np.flatnonzero(many)
        e = np.repeat(h, own.n[which[h]])
        j = spread(np.zeros(len(h), np.int64), own.n[which[h]])
        start = own.start[which[e]] + j
        route = _stretches(own.raw, start, THRESHOLD)
        order = np.lexsort((of["least"][e], route))
        first = np.r_[True, route[order][1:] != route[order][:-1]]
        later = of["least"][e[order]] > of["least"][e[order[first]]][np.cumsum(first) - 1]
        known = _answers(of["digit"][e[order[later]]], of["content"][e[order[later]]], j[order[later]])
        kept = order[~later]  # all of the least document's, since each asks for itself
        more = {k: of[k][e[kept]] for k in ("digit", "content", "least")} | {"n": np.ones(len(kept), np.int64), "from": j[kept], "route": route[kept]}
        rows = {k: np.concatenate([v, more[k]]) for k, v in rows.items()}
        raw.append(own.raw[spread(start[kept], np.full(len(kept), THRESHOLD))])
        size.append(np.full(len(kept), THRESHOLD))
    raw, size = np.concatenate(raw), np.concatenate(size)
    begin = np.cumsum(size) - size
    bucket = deal.bucket(rows["route"])
    by = np.argsort(bucket, kind="stable")
    for b, run in _by_bucket(bucket[by]):
        e = by[run]
        yield b, {k: rows[k][e].astype(kind).tobytes() for k, kind in ENTRY.items()}, raw[spread(begin[e], size[e])].tobytes(), known.tobytes()
        known = known[:0]


def _answers(digit: np.ndarray, content: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(j), dtype=ANSWER)
    out["digit"], out["content"], out["mask"] = digit, content, np.uint64(1) << j.astype(np.uint64)
    return out


def _stretches(raw: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of stretches of one size, which may lie anywhere."""
    h = np.zeros(len(start), dtype=np.uint64)
    for k in range(size):
        h = (h + raw[start + k].astype(np.uint64) + np.uint64(1)) * BASE
    return mixed(h)


def earlier(group: np.ndarray, raw: np.ndarray, start: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a window of the same group (numbers) and bytes has a lesser `least`: MSD radix sort through THRESHOLD bytes.

    A pass orders the windows that are left by (group so far, next eight bytes) and drops groups with one `least` only.
    """
    out = np.zeros(len(start), dtype=bool)
    left = np.arange(len(start))
    for depth in range(0, THRESHOLD, 8):
        digit = np.zeros(len(left), dtype=np.uint64)
        for k in range(depth, min(depth + 8, THRESHOLD)):
            digit = (digit << np.uint64(8)) | raw[start[left] + k].astype(np.uint64)
        by = np.lexsort((digit, group))
        g, d = group[by], digit[by]
        new = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])][: len(by)]
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        if not len(first):
            return out
        own = least[left[by]]
        low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
        keep = (low != high)[number]
        left, group = left[by[keep]], number[keep]
        if depth + 8 >= THRESHOLD:
            out[left] = own[keep] > low[group]
    return out


def judged(e: dict[str, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """Of the entries of a bucket, a mask each: the windows of which an earlier document has another."""
    size = e["n"].astype(np.int64) + THRESHOLD - 1
    begin = np.cumsum(size) - size
    masks = np.zeros(len(size), dtype=np.uint64)
    by = np.argsort(e["route"], kind="stable")
    route, total = e["route"][by], np.cumsum(size[by])
    last = np.flatnonzero(np.r_[route[1:] != route[:-1], True][: len(by)])  # the routes' last entries
    start = 0
    while start < len(by):
        before = total[start - 1] if start else 0
        fits = np.searchsorted(total[last], before + JUDGED_BYTES, side="right") - 1
        end = int(last[max(fits, np.searchsorted(last, start))]) + 1
        own = by[start:end]
        masks[own] = _judged({k: v[own] for k, v in e.items()}, raw[spread(begin[own], size[own])])
        start = end
    return masks


def _judged(e: dict[str, np.ndarray], raw: np.ndarray) -> np.ndarray:
    """:func:`judged`, of whole routes."""
    size = e["n"].astype(np.int64) + THRESHOLD - 1
    begin = np.cumsum(size) - size
    whole = Hashes(raw).of(begin, begin + size) if len(size) else np.zeros(0, np.uint64)
    by = np.lexsort((e["least"], whole, e["route"]))
    route, same = e["route"][by], whole[by]
    new = np.r_[True, (route[1:] != route[:-1]) | (same[1:] != same[:-1])][: len(by)]
    kept = by[new]
    number = np.cumsum(new) - 1
    masks = np.zeros(len(size), dtype=np.uint64)
    full = np.where(e["n"] == RUN, ~np.uint64(0), (np.uint64(1) << np.minimum(e["n"], RUN - 1).astype(np.uint64)) - np.uint64(1))
    # Equal segments: all windows of those that an earlier document has.
    later = e["least"][by] > e["least"][kept][number]
    masks[by[later]] = full[by[later]]
    # Different segments of a digit: window by window.
    group = np.cumsum(np.r_[True, e["route"][kept][1:] != e["route"][kept][:-1]]) - 1 if len(kept) else number
    several = (np.bincount(group) > 1)[group] if len(kept) else np.zeros(0, bool)
    kept_s, group_s = kept[several], group[several]
    n = e["n"][kept_s].astype(np.int64)
    owner, j = np.repeat(np.arange(len(kept_s)), n), spread(np.zeros(len(n), np.int64), n)
    gone = earlier(group_s[owner], raw, begin[kept_s][owner] + j, e["least"][kept_s][owner])
    own = np.zeros(len(size), dtype=np.uint64)
    np.bitwise_or.at(own, kept_s[owner[gone]], np.uint64(1) << j[gone].astype(np.uint64))
    # What the least entry of equal segments has learnt holds for all of them.
    masks[by] |= own[kept][number]
    return masks


def _answered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_key(batches):
        e = {k: _numbers(rows.column(k).to_pylist(), kind) for k, kind in ENTRY.items()}
        chunk = np.repeat(np.arange(rows.num_rows), [len(x) for x in rows.column("n").to_pylist()])
        masks = judged(e, _numbers(rows.column("raw").to_pylist(), "u1"))
        hit = np.flatnonzero(masks)
        answers = np.empty(len(hit), dtype=ANSWER)
        answers["digit"], answers["content"] = e["digit"][hit], e["content"][hit]
        answers["mask"] = masks[hit] << e["from"][hit].astype(np.uint64)
        known = rows.column("known").to_pylist()
        own: dict[int, bytes] = {i: x for i, x in enumerate(known) if x}
        for c, run in _by_bucket(chunk[hit]):
            own[c] = own.get(c, b"") + answers[run].tobytes()
        at = pa.array(list(own), pa.int64())
        columns = [rows.column(k).take(at).combine_chunks() for k in KEY]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(own.values()), BYTES)], [*KEY, "answers"])


def covered(texts: list[bytes], ids: np.ndarray, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the removed runs of a chunk's texts, as places in all of them."""
    own = Segments(texts)
    n = len(own.raw)
    edge = np.zeros(n + 1, dtype=np.int32)
    by, new = own.distinct(ids, np.arange(len(own.start)))
    if len(by):
        doc = ids[own.doc[by]]
        number, first = np.cumsum(new) - 1, np.flatnonzero(new)
        later = by[doc > doc[first][number]]  # not the segment's first document in this chunk
        np.add.at(edge, own.start[later], 1)
        np.add.at(edge, own.start[later] + own.n[later] + THRESHOLD - 1, -1)
        if len(answers):
            mine, told = _ranks(_pairs(own.digit[by[first]], own.content[by[first]]), answers)
            mask = np.zeros(max(int(mine.max()), int(told.max())) + 1, dtype=np.uint64)
            np.bitwise_or.at(mask, told, answers["mask"])
            mask = mask[mine][number]
            some = np.flatnonzero(mask)
            which, masks = by[some], mask[some]
            for j in range(RUN):
                on = which[(((masks >> np.uint64(j)) & np.uint64(1)) == 1) & (own.n[which] > j)]
                if len(on):
                    np.add.at(edge, own.start[on] + j, 1)
                    np.add.at(edge, own.start[on] + j + THRESHOLD, -1)
    gone = np.r_[False, np.cumsum(edge[:n]) > 0, False]
    # A run ends with its text.
    change = gone[1:] != gone[:-1]
    inner = own.end[(own.end > 0) & (own.end < n)]
    cut = inner[gone[inner] & gone[inner + 1]]
    starts = np.sort(np.concatenate([np.flatnonzero(change & gone[1:]), cut]))
    ends = np.sort(np.concatenate([np.flatnonzero(change & gone[:-1]), cut]))
    return np.searchsorted(own.end, starts, side="right"), starts, ends


def _stream(chunk: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(chunk)
    return sink.getvalue().to_pybytes()


def _chunk_of(rows: pa.Table) -> pa.Table:
    pa.default_memory_pool().release_unused()  # what earlier chunks have taken
    return pa.ipc.open_stream(rows.column("chunk")[0].as_py()).read_all()


MADE = ("kept", "spans", "n_bytes")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def without_repeats(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """docs' columns but text, ``kept`` binary (the bytes that are left), ``spans`` (the removed runs), and ``n_bytes`` of the text.

    from_files: see :func:`~shale.llm.common.identified`.
    """
    with cleaned(docs.sparkSession):
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    deal = Dealing(total)
    rest = [c for c in docs.columns if c not in ("text", *MADE)]
    rows = identified(docs, from_files, "repeats")
    row = F.struct(F.lit(True).alias("_"), *[F.col("_row")[c].alias(c) for c in rest])
    rows = rows.select("_rid", row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = "file long, row long"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, place), chunk in _cut(batches):
            own = chunk.select(["_row", "doc_id", "text"])
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([place]), pa.array([_stream(own)], BYTES)], [*KEY, "chunk"])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                out = list(_digits(deal, *_texts(_chunk_of(row))))
                buckets, digits, what = zip(*out, strict=True) if out else ((), (), ())
                keys = [pa.array([row.column(k)[0].as_py()] * len(out), pa.int64()) for k in KEY]
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *keys, pa.array(digits, BYTES), pa.array(what, BYTES)], ["bucket", *KEY, "digits", "what"])

    def sent(left: pa.Table, out: list[tuple], columns: list[str]) -> pa.Table:
        """Rows to buckets, with the chunk's key."""
        at = [left.column(k)[0].as_py() for k in KEY] if out else [0, 0]
        keys = {"bucket": pa.array([x[0] for x in out], pa.int64())} | {k: pa.array([v] * len(out), pa.int64()) for k, v in zip(KEY, at, strict=True)}
        return pa.table(keys | {c: pa.array([x[1][c] for x in out], BYTES) for c in columns})

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(_left(deal, *_texts(_chunk_of(left)), right)) if left.num_rows and right.num_rows else []
        return sent(left, out, list(SEGMENT))

    def third(left: pa.Table, right: pa.Table) -> pa.Table:
        asks = _numbers(right.column("asks").to_pylist(), ASK)
        out = _entries(deal, *_texts(_chunk_of(left)), asks) if left.num_rows and len(asks) else []
        return sent(left, [(b, e | {"raw": raw, "known": known}) for b, e, raw, known in out], [*ENTRY, "raw", "known"])

    whole = T.StructType([rows.schema["_row"], T.StructField("kept", T.BinaryType()), T.StructField("spans", SPANS), T.StructField("n_bytes", T.LongType())])

    def fourth(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = _chunk_of(left)
        texts, ids = _texts(chunk)
        doc, start, end = covered(texts, ids, _numbers(right.column("answers").to_pylist(), ANSWER))
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        offset = np.cumsum(size) - size
        raw, kept = b"".join(texts), []
        each = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))]
        for i in range(len(texts)):
            own = slice(each[i], each[i + 1])
            edges = [int(offset[i]), *np.stack([start[own], end[own]], axis=1).ravel().tolist(), int(offset[i] + size[i])]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        spans = pa.StructArray.from_arrays([pa.array(start - offset[doc]), pa.array(end - offset[doc])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(each.astype(np.int32)), spans)
        return pa.table({"_row": chunk.column("_row"), "kept": pa.array(kept, BYTES), "spans": lists, "n_bytes": pa.array(size)})

    # The chunks are stored once, so that all readings have the same ones, whatever executors come and go meanwhile.
    packed = stored(rows.mapInArrow(pack, f"{key}, chunk binary"), "repeats-chunks")
    dealt = lambda frame: frame.repartition("bucket").sortWithinPartitions("bucket")
    fields = lambda columns: ", ".join(f"`{k}` binary" for k in columns)
    met = lambda right: packed.groupBy(*KEY).cogroup(right.groupBy(*KEY))
    # Each reading ends with what it told, stored: what it has shuffled is off the disks when the next one begins.
    digits = packed.mapInArrow(first, f"bucket long, {key}, digits binary, what binary")
    with settings(docs.sparkSession, BATCH):
        left = stored(dealt(digits).mapInArrow(_shared, f"{key}, digits binary, hot binary"), "repeats-left")
        segments = met(left).applyInArrow(second, f"bucket long, {key}, {fields(SEGMENT)}")
        told = stored(dealt(segments).mapInArrow(_told, f"{key}, answers binary, asks binary"), "repeats-told")
        entries = met(told.select(*KEY, "asks")).applyInArrow(third, f"bucket long, {key}, {fields([*ENTRY, 'raw', 'known'])}")
        answers = stored(dealt(entries).mapInArrow(_answered, f"{key}, answers binary"), "repeats-answers").unionByName(told.drop("asks"))
    out = met(answers).applyInArrow(fourth, whole)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rest], *MADE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), from_files=True)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
