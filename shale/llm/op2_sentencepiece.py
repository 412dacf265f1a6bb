"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The texts of a chunk are cut at places that no piece spans (before a run of blanks that follows another character, and
around line feeds). The distinct cuts become one flat array of symbols. A round looks up the rank of every adjacent
pair, takes the least rank of each word (segmented minimum), merges its leftmost non-overlapping occurrences at once
and compacts the array, until no word has a pair left. Where a simultaneous merge could create a pair that ranks before
the merged one, that word merges only its first occurrence in the round, so the result is that of the sequential
algorithm. Characters without a piece fall back to byte pieces.

Null and empty texts give just the begin and end ids and decode to the empty text. Rows are independent: repeated
rows, ties and extra columns need no care, and an empty table gives an empty result. The vocabulary is read with the
sentencepiece library; encoding and decoding run here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm.arrow import chunks, spread, texts_of
from shale.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NEVER = np.int64(1) << 40
#: Encoded words that a worker keeps for later chunks.
KEPT_WORDS = 500_000


class Codec:
    """One vocabulary; encodes and decodes lists of texts."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.n, self.bos, self.eos = n, sp.bos_id(), sp.eos_id()
        pieces = {}
        surface: list[bytes] = []
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                surface.append(bytes([value]))
            elif sp.is_control(i):
                surface.append(b"")
            elif sp.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                pieces[piece] = i
                surface.append(piece.replace(SPACE, " ").encode())
        order = sorted(pieces.values(), key=lambda i: (-sp.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        self.char_id = n + np.arange(0x110000, dtype=np.int64)  # n + code point: a character without a piece
        for c, i in pieces.items():
            if len(c) == 1:
                self.char_id[ord(c)] = i
        keys, ranks, merged = [], [], []
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    ranks.append(rank[i])
                    merged.append(i)
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.ranks, self.merged = (np.array(x, dtype=np.int64)[by] for x in (keys, ranks, merged))
        # Where pieces hold blanks only at their start, and no line feed, texts can be cut there.
        can_cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.cut = re.compile(r" *[^ \n]+| +|\n" if can_cut else r"(?s).+")
        lengths = np.array([len(x) for x in surface], dtype=np.int64)
        self.surface, self.surface_len = np.frombuffer(b"".join(surface), dtype=np.uint8), lengths
        self.surface_at = np.cumsum(lengths) - lengths
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.at, self.len = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of symbol pairs; NEVER where they don't merge. Symbols from n on have no piece."""
        key = np.where((left < self.n) & (right < self.n), left * self.n + right, -1)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[i] == key
        return np.where(found, self.ranks[i], NEVER), np.where(found, self.merged[i], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and each word's number of symbols. Words are not empty."""
        flat = "".join(words).replace(" ", SPACE)
        sym = self.char_id[np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        name = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.repeat(np.arange(len(words)), size)
        same = word[:-1] == word[1:]
        rank, to = np.full(len(sym), NEVER), np.full(len(sym), -1, dtype=np.int64)
        rank[:-1], to[:-1] = self.pairs(sym[:-1], sym[1:])
        rank[:-1][~same] = NEVER
        while len(name):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            live = least < NEVER
            if live.sum() < 0.7 * len(live):  # finished words leave
                keep = np.repeat(live, size)
                done.append((name[~live], size[~live], sym[~keep]))
                name, size, sym, rank, to, least = name[live], size[live], sym[keep], rank[keep], to[keep], least[live]
                if not len(name):
                    break
                live = np.ones(len(name), dtype=bool)
            word = np.repeat(np.arange(len(name)), size)
            hit = np.flatnonzero((rank == least[word]) & (rank < NEVER))
            if not len(hit):
                done.append((name, size, sym))
                break
            # leftmost non-overlapping: every second one of a run of neighbours
            first = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            many = np.bincount(word[hit], minlength=len(name)) > 1
            if many.any():
                hit = self._in_turn(hit, many, word, sym, to, least)
            sym[hit] = to[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            size = size - np.bincount(word[hit], minlength=len(name))
            place = (np.cumsum(keep) - 1)[hit]
            sym, word = sym[keep], word[keep]
            rank, to = rank[keep], to[keep]
            near = np.zeros(len(sym), dtype=bool)
            near[place] = near[place[place > 0] - 1] = True
            redo = np.flatnonzero(near)
            inside = redo[redo + 1 < len(sym)]
            inside = inside[word[inside] == word[inside + 1]]
            rank[redo] = NEVER
            rank[inside], to[inside] = self.pairs(sym[inside], sym[inside + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        name, size, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        start = np.cumsum(size) - size
        by = np.argsort(name, kind="stable")
        return sym[spread(start[by], size[by])], size[by]

    def _in_turn(self, hit, many, word, sym, to, least) -> np.ndarray:
        """Without the later merges of words where an earlier one may make a pair that goes first."""
        own = hit[many[word[hit]]]
        last, m = len(sym) - 1, to[own]
        chosen = np.zeros(len(sym) + 2, dtype=bool)
        chosen[own] = True
        right, left, before = np.minimum(own + 2, last), np.maximum(own - 1, 0), np.maximum(own - 2, 0)
        early = (own + 2 <= last) & (word[right] == word[own]) & (self.pairs(m, sym[right])[0] < least[word[own]])
        early |= (own > 0) & (word[left] == word[own]) & (self.pairs(sym[left], m)[0] < least[word[own]])
        met = (own > 1) & chosen[before] & (word[before] == word[own])
        early |= met & (self.pairs(to[before], m)[0] < least[word[own]])
        if not early.any():
            return hit
        alone = np.zeros(len(many), dtype=bool)
        alone[word[own[early]]] = True
        first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
        return hit[first | ~alone[word[hit]]]

    def _learn(self, words: list[str]) -> None:
        sym, size = self.merge(words)
        odd = sym >= self.n
        if odd.any():  # byte fallback
            out: list[np.ndarray] = []
            places = np.flatnonzero(odd)
            owner = np.repeat(np.arange(len(size)), size)[places]
            before = 0
            for p, w in zip(places, owner, strict=True):
                raw = chr(int(sym[p]) - self.n).encode("utf-8", "replace")
                out += [sym[before:p], self.byte_id[np.frombuffer(raw, dtype=np.uint8)]]
                size[w] += len(raw) - 1
                before = p + 1
            sym = np.concatenate([*out, sym[before:]])
        first = len(self.at)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.len = np.concatenate([self.ids, sym]), np.concatenate([self.len, size])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and each text's number of ids; begin and end ids included."""
        cut = self.cut.findall
        words = [cut(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        flat = [w for own in words for w in own]
        if len(self.place) > KEPT_WORDS:
            self._forget()
        if new := list(set(flat).difference(self.place)):
            self._learn(new)
        which = np.fromiter(map(self.place.__getitem__, flat), dtype=np.int64, count=len(flat))
        sizes = self.len[which]
        ids = self.ids[spread(self.at[which], sizes)]
        owner = np.repeat(np.arange(len(texts)), [len(x) for x in words])
        counts = np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64)
        total = counts + 2
        out = np.empty(int(total.sum()), dtype=np.int64)
        start = np.cumsum(total) - total
        out[start], out[start + total - 1] = self.bos, self.eos
        out[spread(start + 1, counts)] = ids
        return out, total

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts as UTF-8, of counts[i] ids each."""
        size = self.surface_len[ids]
        raw = self.surface[spread(self.surface_at[ids], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.cumsum(counts)]
        out, before = [], 0
        for end in ends.tolist():
            text = raw[before:end]
            out.append(text[1:] if text[:1] == b" " else text)  # the blank that encoding puts before a text
            before = end
        return [x if _valid(x) else x.decode("utf-8", "replace").encode() for x in out]


def _valid(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    return Codec(model_file)


SCHEMA = "doc_id long, ids array<int>, decoded string"


def encode_documents(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of docs' (doc_id, text): the ids with begin and end id, and the text they decode to."""
    path = model_file or public_tokenizers.path(MODEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, "text"):
            ids, counts = own.encode(texts_of(batch))
            at = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
            lists = pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))
            decoded = [x.decode() for x in own.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of docs, without moving the ids out of the workers."""
    path = model_file or public_tokenizers.path(MODEL)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in chunks(batches, "text"):
            ids, counts = own.encode(texts_of(batch))
            raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            sums = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip([0, *ends], ends, strict=False)]
            texts = [hashlib.sha256(x).hexdigest() for x in own.decode(ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(sums), pa.array(texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
