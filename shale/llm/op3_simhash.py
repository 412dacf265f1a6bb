"""SimHash near-duplicates by a binary trie self-join.

Words are runs of anything but the six ASCII blanks, after lower-casing A-Z. A text's shingles (repeats included) are
hashed with XXH64, seed 42; a fingerprint bit is 1 if it is set in over half of the hashes. A text of fewer words than
a shingle has one shingle, its whole word sequence; a text without words has the fingerprint 0, which links like any
other. Wider fingerprints, as documents are deduplicated by, come from the hashes of distinct shingles, mixed anew for each
further 64 bits.

The join is partitioned by the pigeonhole principle: two bit strings that differ in at most k bits agree in one of k + 1
blocks. Each fingerprint goes into k + 1 tries, turned so that another block comes first, and a trie is dealt out by the
value of that block. A subtree with more than :data:`SUBTREE` members is dealt out again as pairs of its own subtrees
that are within the budget, round after round, so no task holds an unbounded group. Links are reduced to the groups of
a subtree where they are found; groups join across tasks by alternating stars (:func:`components`).

Rows stay apart by their own key: repeated rows, repeated or null ids are all answered. A component's id is its least
non-null doc_id. Null texts count as empty. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shale.llm import prefix, trie
from shale.llm.arrow import chunks, texts_of
from shale.llm.common import cleaned, count, dropped, empty, identified, kept, stored, table

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Members of a subtree that one task joins; members of smaller ones that are joined at a time; bits by which a larger one is split.
SUBTREE, TOGETHER, SPLIT_BITS = 1 << 17, 1 << 15, 6
#: Hashes whose bits are unpacked at a time.
SLICE = 1 << 14


def hashes(text: str, size: int) -> list[int]:
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    if len(words) <= size:
        return [digest(joined, SEED)]
    first = np.r_[0, ends[:-1]][: len(words) - size + 1].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(first, (ends[size - 1 :] - 1).tolist(), strict=True)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """An independent hash from a hash (the finaliser of SplitMix64)."""
    if not k:
        return h
    z = h + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bit_matrix(found: Iterable[np.ndarray | list[int]], n: int, words: int) -> np.ndarray:
    """(n, 64 * words) bits, most significant first, of the n texts' hashes."""
    sums = np.zeros((n, 64 * words), dtype=np.int64)
    count = np.zeros(n, dtype=np.int64)
    for i, own in enumerate(found):
        count[i] = len(own)
        for at in range(0, len(own), SLICE):
            h = np.array(own[at : at + SLICE], dtype=np.uint64)
            for k in range(words):
                raw = _mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8)
                sums[i, 64 * k : 64 * k + 64] += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int32)
    return 2 * sums > count[:, None]


def as_longs(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 * w bits as w signed longs."""
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs' columns but text, and ``fp`` long."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            bits = bit_matrix((hashes(t, size) for t in texts_of(batch)), batch.num_rows, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(as_longs(bits)[:, 0])], [*rest, "fp"])

    return docs.mapInArrow(run, docs.select(*rest).schema.add("fp", T.LongType()))


def _tries(value: Column, bits: int, budget: int, name: int) -> list[Column]:
    """The budget + 1 turns of a bit string (the low `bits` bits of a long), left-aligned, with the length of the block in front."""
    out, at = [], 0
    for k in range(budget + 1):
        length = (bits * (k + 1)) // (budget + 1) - at
        aligned = F.shiftleft(value, 64 - bits)
        turned = aligned if not at else F.shiftleft(aligned, at).bitwiseOR(F.shiftleft(F.shiftrightunsigned(aligned, bits - at), 64 - bits))
        out.append(F.struct(F.lit(name * (budget + 1) + k).alias("trie"), F.lit(length).alias("d"), turned.alias("bits")))
        at += length
    return out


KEY = ("trie", "d", "x", "low")
#: Columns with the bits by which candidates are judged.
CHECKED = ("_c0", "_c1")


def _keyed(rows: DataFrame) -> DataFrame:
    """low: the lesser of the two prefixes that the group joins; x: their difference."""
    prefix = F.expr("shiftrightunsigned(bits, 64 - d)")
    return rows.withColumn("low", F.least(prefix, prefix.bitwiseXOR(F.col("x"))))


def _split(rows: DataFrame, budget: int, limit: int) -> DataFrame:
    """rows with subtrees of more than limit members dealt out as pairs of their subtrees."""
    rows = _keyed(rows.withColumn("x", F.lit(0).cast("long")))
    for _ in range(64 // SPLIT_BITS + 1):
        large = kept(rows.groupBy(*KEY).count().where((F.col("count") > limit) & (F.col("d") < 64)).select(*KEY))
        if empty(large):
            break
        step = F.least(F.lit(SPLIT_BITS), 64 - F.col("d"))
        masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
        parts = rows.join(large, list(KEY), "left_semi").withColumn("_step", step).withColumn("_m", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        parts = parts.where(F.expr("_m < shiftleft(1L, _step)")).withColumn("x", F.expr("shiftleft(x, _step) | _m")).withColumn("d", F.col("d") + F.col("_step"))
        parts = _keyed(parts.where(F.bit_count("x") <= budget).drop("_step", "_m"))
        rows = rows.join(large, list(KEY), "left_anti").unionByName(parts)
    return rows


def links(nodes: DataFrame, values: list[Column], bits: int, budget: int, most: int, limit: int = SUBTREE) -> DataFrame:
    """(u, v, size of v): links that connect nodes (node, :data:`CHECKED` where they are) as far as their fingerprints link.

    Candidates differ in at most budget bits in one of the values (the low `bits` bits of longs); a link is a difference of at
    most `most` bits in the columns CHECKED together, or in the value itself where there are none. Each group is a star around its
    least node, or around the least by ``size`` (a column, where it is).
    """
    own = [c for c in ("node", "size", *CHECKED) if c in nodes.columns]
    turned = F.array(*[t for i, v in enumerate(values) for t in _tries(v, bits, budget, i)])
    rows = nodes.select(*own, F.explode(turned).alias("_t")).select(*own, "_t.*")
    rows = _split(rows, budget, limit).repartition(*KEY).sortWithinPartitions(*KEY)

    def join(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        col = lambda c: whole.column(c).to_numpy()
        bits_ = col("bits").view(np.uint64)
        keys = [col(c) for c in KEY]
        by = np.lexsort((bits_, *keys[::-1]))
        keys = [k[by] for k in keys]
        group = np.cumsum(np.r_[0, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        bits_, node = bits_[by], col("node")[by]
        prints = np.stack([col(c)[by].view(np.uint64) for c in CHECKED], axis=1) if CHECKED[0] in own else bits_[:, None]
        at = group, keys[1].astype(np.int64), keys[2] != 0, bits_, prints
        label = trie.self_join(*at, budget, most)
        # The least member stands for a group, so that all tries name the same one.
        size = col("size")[by] if "size" in own else np.zeros(len(node), dtype=np.int64)
        order = np.lexsort((node, size, label))
        first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
        middle = np.empty(len(node), dtype=np.int64)
        middle[label[first]] = first
        middle = middle[label]
        i = np.flatnonzero(node[middle] != node)
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[middle[i]]), pa.array(size[middle[i]])], ["u", "v", "size"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) + batch.num_rows > TOGETHER:
                # The last group may go on in the next batch.
                whole = pa.Table.from_batches([*held, batch]).combine_chunks()
                keys = [whole.column(c).to_numpy() for c in KEY]
                changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                if len(changes):
                    cut = int(changes[-1]) + 1
                    yield from join(whole.slice(0, cut).to_batches())
                    held = whole.slice(cut).to_batches()
                    continue
            held.append(batch)
        if held:
            yield from join(held)

    return rows.mapInArrow(run, "u long, v long, size long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root): the least node of each linked node's component; a root has no row itself. Alternating large and small stars."""
    now = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        with cleaned(now.sparkSession):
            state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.withColumnRenamed("v", "root")
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, kept(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        dropped(before)


def with_components(prints: DataFrame, limit: int = SUBTREE) -> DataFrame:
    """prints (doc_id, fp long) with component_id: fingerprints of at most 2 different bits are linked."""
    nodes = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))).select(F.col("fp").alias("node"), "least")
    stars = components(links(nodes.select("node"), [F.col("node")], 64, 2, 2, limit)).withColumnRenamed("u", "node")
    rooted = nodes.select("node", "least").join(stars, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by = rooted.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    return prints.join(by, "fp")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    prints = stored(fingerprints(docs), "op3")
    return with_components(prints).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicates of whole documents, as the pipeline removes them: words of a shingle, and their Jaccard similarity.
SIZE, SIMILARITY = 5, 0.8
#: At that similarity a bit differs with a chance of 0.15. Candidates differ in at most BUDGET bits in one of TABLES parts of
#: BITS bits, and in at most NEAR of 128. Of simulated pairs at just 0.8 that finds 99.5 %, and more above.
WORDS, TABLES, BITS, BUDGET, NEAR = 4, 40, 20, 1, 34
#: Parts for more and more documents: (bits, budget) and how many of them find as many pairs as the first ones. A walk looks at few
#: nodes besides the candidates while the budget is small, so longer parts come before larger budgets.
SHAPES = {(BITS, BUDGET): TABLES, (22, 1): 60, (24, 1): 90, (32, 2): 90, (36, 3): 60, (44, 4): 90}
#: Chance candidates of a document in a part, at most, as far as there are longer parts: as many as the walk's nodes cost anyway.
CHANCE = 64
#: Parts whose tries are on the disks at a time.
ROUND = 8
#: Candidates whose keys are broadcast, at most (about 32 MB); bytes of text whose sets are held at a time.
BROADCAST, SETS_BYTES = 1 << 20, 1 << 20


def shape(n: int) -> tuple[int, int]:
    """(bits, budget) of a part for n documents: the first of SHAPES that leave each of them CHANCE chance candidates in a part, at most."""
    fits = (s for s in SHAPES if n * sum(math.comb(s[0], k) for k in range(s[1] + 1)) <= CHANCE << s[0])
    return next(fits, list(SHAPES)[-1])


def distinct(text: str, size: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    return np.unique(np.array(hashes(text, size), dtype=np.uint64))


def places(width: int, tables: int) -> list[np.ndarray]:
    """The bits of a fingerprint that each of so many parts takes: those of one order have none in common."""
    rng, per = np.random.default_rng(SEED), 64 * WORDS // width
    orders = [np.arange(64 * WORDS)] + [rng.permutation(64 * WORDS) for _ in range(-(-tables // per) - 1)]
    return [o[i * width : (i + 1) * width] for o in orders for i in range(per)][:tables]


def set_prints(docs: DataFrame, width: int = BITS, tables: int = TABLES) -> DataFrame:
    """docs' columns but text, ``_key`` (digest of the set of shingles), ``size`` of it, ``_parts`` (tables longs of width bits), and CHECKED."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*rest).schema.add("_key", T.BinaryType()).add("size", T.LongType()).add("_parts", T.ArrayType(T.LongType()))
    for c in CHECKED:
        schema = schema.add(c, T.LongType())
    own = places(width, tables)
    weights = np.left_shift(np.int64(1), np.arange(width - 1, -1, -1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SETS_BYTES):
            found = [distinct(t, SIZE) for t in texts_of(batch)]
            bits = bit_matrix(found, len(found), WORDS)
            parts = np.stack([bits[:, at] @ weights for at in own], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * tables), pa.array(parts.ravel()))
            keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            sizes, longs = pa.array(list(map(len, found)), pa.int64()), as_longs(bits)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], keys, sizes, lists, *[pa.array(longs[:, k]) for k in range(len(CHECKED))]], [*rest, "_key", "size", "_parts", *CHECKED])

    return docs.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, _set) of docs (node, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SETS_BYTES):
            own = [distinct(t, SIZE).view(np.int64) for t in texts_of(batch)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "_set"])

    return docs.select("node", "text").mapInArrow(run, "node long, _set array<long>")


def _sets(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, _set) of wanted's nodes, stored."""
    wanted = kept(wanted.select("node").distinct().join(nodes.select("node", F.col("_best")["_rid"].alias("_rid")), "node"))
    if count(wanted) <= BROADCAST:  # else the texts are shuffled
        wanted = F.broadcast(wanted)
    return stored(shingle_sets(rows.select("_rid", "text").join(wanted, "_rid").select("node", "text")), "dedup-sets")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of distinct shingles have this Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("_set").alias("_a")), "u").join(sets.select(F.col("node").alias("v"), F.col("_set").alias("_b")), "v")
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common * (1 + similarity) >= similarity * (F.size("_a") + F.size("_b")) - 1e-6).select("u", "v")


def _gathered(found: DataFrame) -> DataFrame:
    """(u, v): of links (u, v, size) those that connect the same nodes by few pairs: a node with the least of its middles, and these with it.

    The tries put a large group together anew in each of their turns, around other middles.
    """
    found = kept(found.distinct())
    least = F.min(F.struct("size", "v")).over(Window.partitionBy("u"))["v"]
    placed = kept(found.withColumn("_m", least).select("u", "v", F.col("_m").alias("m")))
    dropped(found)
    pairs = placed.select("u", F.col("m").alias("v")).unionByName(placed.select(F.col("v").alias("u"), F.col("m").alias("v")))
    out = kept(pairs.where("u <> v").distinct())
    dropped(placed)
    return out


def similar(nodes: DataFrame, rows: DataFrame, similarity: float, limit: int, bits: int = BITS, budget: int = BUDGET, parts: int = TABLES) -> DataFrame:
    """(u, root): the components of nodes (node, size, _parts, CHECKED, _best) by verified links that connect all candidates that are similar.

    Each member of a group of candidates is compared with the group's smallest set first. What that connects needs no other
    link, so a dense group doesn't cost the square of its size: pages whose template alone makes them similar are all linked to
    the smallest of them. The members of groups that this doesn't settle are joined by their prefixes (:mod:`shale.llm.prefix`):
    edited copies with what they all go back to, then all that can be similar across the components so far. Of pages that a
    common template makes candidates, but not similar, no pairs arise there.
    """
    tables = [F.col("_parts")[i] for i in range(parts)]
    # A document has a row in every trie; only those of some parts are shuffled together, and gone before the next ones are.
    rounds = [kept(links(nodes, tables[i : i + ROUND], bits, budget, NEAR, limit).distinct()) for i in range(0, parts, ROUND)]
    stars = _gathered(reduce(DataFrame.unionByName, rounds))
    for found in rounds:
        dropped(found)
    first = _verified(stars, _sets(stars.select(F.explode(F.array("u", "v")).alias("node")), nodes, rows), similarity)
    label = components(first)
    roots = lambda x: label.select(F.col("u").alias(x), F.col("root").alias(f"{x}r"))
    rooted = stars.join(roots("u"), "u", "left").join(roots("v"), "v", "left")
    apart = F.coalesce("ur", "u") != F.coalesce("vr", "v")
    unsettled = rooted.groupBy("v").agg(F.max(apart).alias("_open")).where("_open").select("v")
    members = kept(stars.join(unsettled, "v", "left_semi").select(F.explode(F.array("u", "v")).alias("node")).distinct())
    if empty(members):
        return label
    sets = _sets(members, nodes, rows)
    prefixes = prefix.entries(sets, similarity)
    for found in (lambda: prefix.stars(prefixes), lambda: prefix.candidates(prefixes, label.withColumnRenamed("u", "node"), similarity)):
        more = kept(_verified(kept(found()), sets, similarity))
        if not empty(more):  # what is connected so far takes a row for each node, not its links
            label = components(label.select("u", F.col("root").alias("v")).unionByName(more))
    return label


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, limit: int = SUBTREE, from_files: bool = False) -> DataFrame:
    """docs with one document of each near-duplicate group: that with the least doc_id (null last; ties: any one).

    A link is an exact Jaccard similarity of the sets of distinct five-word shingles; a group is what links connect. The
    tries of the sets' fingerprints find the candidates (see :data:`TABLES` for what they miss), and each is verified. All
    other columns stay as they are. from_files: see :func:`~shale.llm.common.identified`.
    """
    rows = identified(docs, from_files, "dedup")
    bits, budget = shape(count(docs))
    parts = SHAPES[bits, budget]
    prints = stored(set_prints(rows.select(F.col("doc_id").cast("long"), "_rid", "text"), bits, parts), "dedup")
    # One row for each set of shingles, however many copies it has, with the document to keep.
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rid")).alias("_best")
    nodes = prints.groupBy("_key").agg(*[F.first(c).alias(c) for c in ("size", "_parts", *CHECKED)], best)
    nodes = kept(nodes.select(F.monotonically_increasing_id().alias("node"), "size", "_parts", *CHECKED, "_best"))
    stars = similar(nodes, rows, similarity, limit, bits, budget, parts).withColumnRenamed("u", "node")
    rooted = nodes.select("node", "_best").join(stars, "node", "left")
    first = rooted.groupBy(F.coalesce("root", "node")).agg(F.min("_best")["_rid"].alias("_rid"))
    return rows.select("_rid", "_row").join(first.select("_rid"), "_rid", "left_semi").select("_row.*")
