"""Patched frame-of-reference blocks.

A segment holds the ids of whole documents:

    magic "PFR1" | n_docs u32 | n_ids u64 | doc_id i64 * n_docs | ids of each document u32 * n_docs |
    index: first byte of each block in the body u32 * n_blocks | body

The ids are cut into blocks of 256 (the last one is padded with its first id). A block is

    minimum u32 | width u8 | n_exceptions u8 | packed 32 * width bytes | places u8 * n | values u32 * n

The minimum is subtracted; the width is the bits of the value at the chosen percentile of the block; the rest above
that width are exceptions, stored in full with their places. All numbers are little-endian. n_exceptions fits a byte
because the percentile is at least 50 %. Blocks can be decoded alone through the index.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK, HEAD, MAGIC = 256, 6, b"PFR1"
PERCENTILE = 0.95


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) values below 2 ** width as (n, 32 * width) bytes."""
    n = len(v)
    lanes = np.ascontiguousarray(v.reshape(n, 64, 4).transpose(1, 0, 2)).astype(np.uint64)
    out = np.zeros((width, n, 4), dtype=np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.transpose(1, 0, 2)).astype("<u8").view(np.uint8).reshape(n, 32 * width)


def _unpack(raw: np.ndarray, width: int) -> np.ndarray:
    n = len(raw)
    words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").reshape(n, width, 4).transpose(1, 0, 2))
    mask, out = np.uint64((1 << width) - 1), np.empty((64, n, 4), dtype=np.uint32)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - shift))
        out[j] = x & mask
    return out.transpose(1, 0, 2).reshape(n, BLOCK)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and body."""
    if not 0.5 <= percentile <= 1:
        raise ValueError("the percentile is from 0.5 to 1")
    if not len(ids):
        return np.zeros(0, np.uint32), b""
    ids = ids.astype(np.uint32)
    full = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[len(ids) // BLOCK * BLOCK - (len(ids) % BLOCK == 0)], np.uint32)]).reshape(-1, BLOCK)
    low = full.min(axis=1)
    v = full - low[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = _bits(np.partition(v, at, axis=1)[:, at])
    over = (v.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    n_over = over.sum(axis=1)
    size = HEAD + 32 * width + 5 * n_over
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), dtype=np.uint8)
    head = np.empty((len(v), HEAD), dtype=np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    head[:, 4], head[:, 5] = width, n_over
    body[start[:, None] + np.arange(HEAD)] = head
    inside = np.where(over, 0, v)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        body[(start[own] + HEAD)[:, None] + np.arange(32 * w)] = _pack(inside[own], int(w))
    row, place = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    first = start[row] + HEAD + 32 * width[row]
    body[first + nth] = place
    values = v[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(first + n_over[row] + 4 * nth)[:, None] + np.arange(4)] = values
    return start.astype(np.uint32), body.tobytes()


def decode_blocks(start: np.ndarray, body: bytes, n_ids: int) -> np.ndarray:
    raw, start = np.frombuffer(body, dtype=np.uint8), start.astype(np.int64)
    if not len(start):
        return np.zeros(0, np.uint32)
    head = raw[start[:, None] + np.arange(HEAD)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, n_over = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    v = np.zeros((len(start), BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        v[own] = _unpack(raw[(start[own] + HEAD)[:, None] + np.arange(32 * w)], int(w))
    row = np.repeat(np.arange(len(start)), n_over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
    first = start[row] + HEAD + 32 * width[row]
    values = np.ascontiguousarray(raw[(first + n_over[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    v[row, raw[first + nth]] = values
    return (v + low[:, None]).ravel()[:n_ids]


def encode_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    start, body = encode_blocks(ids, percentile)
    head = MAGIC + struct.pack("<IQ", len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), start.astype("<u4").tobytes(), body])


def decode_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, ids of each document, and all ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment")
    n_docs, n_ids = struct.unpack_from("<IQ", raw, 4)
    at = 16
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    counts = np.frombuffer(raw, "<u4", n_docs, at := at + 8 * n_docs)
    start = np.frombuffer(raw, "<u4", -(-n_ids // BLOCK), at := at + 4 * n_docs)
    return doc_ids, counts, decode_blocks(start, raw[at + 4 * len(start) :], n_ids)
