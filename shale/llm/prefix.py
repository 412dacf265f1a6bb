"""Exact candidates of a set similarity join: prefixes of sets whose elements are ordered by how frequent they are.

Two sets of a Jaccard similarity of t or more share an element within the first n - ceil(t n) + 1 of either, whatever the order, as
long as it is the same for both. Here elements of more than :data:`FREQUENT` sets come last, so that

* pairs that share another element of their prefixes are found by it, and such an element has few sets; and
* of all other pairs only the frequent elements can be common, at most the lesser set's number of them. Pages of one template are
  thus no candidates unless the template alone makes them similar.

No pair of the similarity is lost, and no element is left out, however many sets have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shale.llm.common import count, kept

#: Sets of an element from which it counts as frequent; frequent elements that travel to the workers (8 MB).
FREQUENT, BROADCAST = 32, 1 << 20


def prefix_length(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


#: Elements that are ordered at a time.
TOGETHER = 1 << 18


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most TOGETHER elements in _set, or one set if that alone has more."""
    for batch in batches:
        at = np.asarray(batch.column("_set").offsets, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + TOGETHER, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


ENTRY = "element long, frequent boolean, node long, n long, h long"


def _entries(sets: DataFrame, frequent: np.ndarray, similarity: float) -> DataFrame:
    """:data:`ENTRY` of the prefixes; frequent: those elements, ascending. h: how many of the set's n elements are frequent."""
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in slices(batches):
            lists = batch.column("_set")
            n = np.diff(np.asarray(lists.offsets, dtype=np.int64))
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            at = np.searchsorted(often, flat)
            late = (often[np.minimum(at, len(often) - 1)] == flat) if len(often) else np.zeros(len(flat), bool)
            h = np.bincount(owner, weights=late, minlength=len(n)).astype(np.int64)
            by = np.lexsort((flat, late, owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            need = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            by = by[place < need[owner]]  # owner is ascending, so it is the same in either order
            of = owner[by]
            columns = [pa.array(flat[by]), pa.array(late[by]), batch.column("node").take(pa.array(of)), pa.array(n[of]), pa.array(h[of])]
            yield pa.RecordBatch.from_arrays(columns, ["element", "frequent", "node", "n", "h"])

    return sets.select("node", "_set").mapInArrow(run, ENTRY)


def _entries_joined(sets: DataFrame, frequent: DataFrame, similarity: float) -> DataFrame:
    """The same where the frequent elements are too many for the workers: they are joined by shuffle."""
    each = sets.select("node", F.explode("_set").alias("element")).join(frequent.select("element", F.lit(True).alias("_often")), "element", "left")
    own = each.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("_often").isNotNull().alias("frequent"), "element"))).alias("_all"))
    n = F.size("_all").cast("long")
    need = (n - F.ceil(similarity * n - 1e-9) + 1).cast("int")
    own = own.select("node", n.alias("n"), F.size(F.filter("_all", lambda x: x["frequent"])).cast("long").alias("h"), F.explode(F.slice("_all", F.lit(1), need)).alias("_e"))
    return own.select("_e.element", "_e.frequent", "node", "n", "h")


def entries(sets: DataFrame, similarity: float, frequent: int = FREQUENT, broadcast: int = BROADCAST) -> DataFrame:
    """The prefixes of sets (node, _set array<long> of distinct elements), stored: (element, frequent, node, n elements, h frequent ones)."""
    counts = sets.select(F.explode("_set").alias("element")).groupBy("element").agg(F.count("*").alias("_sets")).where(F.col("_sets") > frequent)
    often = kept(counts.select("element"))
    if count(often) <= broadcast:
        return kept(_entries(sets, np.sort(often.toArrow().column("element").to_numpy()), similarity))
    return kept(_entries_joined(sets, often, similarity))


def stars(found: DataFrame) -> DataFrame:
    """(u, v): of each frequent element the sets that have it in their prefix, with the one of them that has least of its own.

    Edited copies of a text are linked through that text, which has nothing but what many have: these pairs, a few for each set,
    are worth a look before all others.
    """
    often = found.where("frequent")
    middle = often.groupBy("element").agg(F.min(F.struct((F.col("n") - F.col("h")).alias("own"), "n", "node"))["node"].alias("_v"))
    pairs = often.join(middle, "element").where(F.col("node") != F.col("_v"))
    return pairs.select(F.greatest("node", "_v").alias("u"), F.least("node", "_v").alias("v")).distinct()


def candidates(found: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """(u, v): every two of the sets with these prefixes that have different roots (node, root; else its own) and can be similar."""
    rooted = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    some = rooted.groupBy("element").agg(F.min("n").alias("_n"), F.min("root").alias("_a"), F.max("root").alias("_b"))
    some = some.where("_a <> _b").select("element", "_n")
    t = F.lit(similarity)
    # A pair that meets in a frequent element shares frequent elements only, or it meets in another too.
    enough = lambda h, n, m: ~F.col("frequent") | (h * (1 + t) >= t * (n + m) - 1e-6)
    able = kept(rooted.join(some, "element").where(enough(F.col("h"), F.col("n"), F.col("_n"))).drop("_n"))
    a = able.select("element", "frequent", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "h")])
    b = able.select("element", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "h")])
    pairs = a.join(b, "element").where((F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")))
    pairs = pairs.where((F.least("n_a", "n_b") >= t * F.greatest("n_a", "n_b") - 1e-6) & enough(F.least("h_a", "h_b"), F.col("n_a"), F.col("n_b")))
    return pairs.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()
