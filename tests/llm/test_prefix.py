import random

import numpy as np
import pytest

from shale.llm import op3_simhash as op
from shale.llm import prefix, trie


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("broadcast", [1 << 20, -1])
@pytest.mark.parametrize("frequent", [0, 3, 32])
def test_no_pair_is_lost(spark, monkeypatch, broadcast, frequent):
    monkeypatch.setattr(prefix, "TOGETHER", 70)
    rng = random.Random(frequent)
    template = rng.sample(range(10_000), 60)
    sets = []
    for i in range(160):
        kind = i % 4
        if kind == 0:  # a template and something of its own
            own = set(template[: rng.randrange(40, 61)]) | {20_000 + 100 * i + k for k in range(rng.randrange(30))}
        elif kind == 1 and i > 8:  # an edited copy
            own = set(sets[rng.randrange(len(sets))][2])
            own -= set(rng.sample(sorted(own), min(len(own) - 1, rng.randrange(0, 9))))
            own |= {50_000 + 100 * i + k for k in range(rng.randrange(9))}
        else:
            own = set(rng.sample(range(3000), rng.randrange(1, 50)))
        sets.append((i, i if i % 5 else 0, sorted(own)))
    frame = spark.createDataFrame(sets, "node long, root long, _set array<long>").repartition(3)
    roots = frame.select("node", "root").where("node <> root")
    found = {(r.u, r.v) for r in prefix.candidates(prefix.entries(frame, 0.8, frequent, broadcast), roots, 0.8).collect()}
    assert all(u > v for u, v in found)
    want = {(b[0], a[0]) for a in sets for b in sets if a[0] < b[0] and a[1] != b[1] and jaccard(set(a[2]), set(b[2])) >= 0.8}
    assert len(want) > 20 and want <= found
    assert prefix.candidates(prefix.entries(frame.limit(0), 0.8, frequent, broadcast), roots, 0.8).count() == 0


def test_template_pages_make_no_pairs(spark):
    """Pages of 300 common and 55 own words (similarity 0.73) are candidates of each other, but no pairs arise from them."""
    template, counts = [f"t{i}" for i in range(300)], []
    for n in (100, 400):
        rows = [(i, " ".join(template + [f"p{i}x{k}" for k in range(55)])) for i in range(n)]
        rows += [(n, rows[0][1] + " edit"), (n + 1, rows[1][1] + " one more")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        sets = op.shingle_sets(docs.withColumnRenamed("doc_id", "node"))
        pairs = prefix.candidates(prefix.entries(sets, 0.8), sets.select("node").withColumn("root", sets.node), 0.8).collect()
        assert {(r.u, r.v) for r in pairs} == {(n, 0), (n + 1, 1)}
        counts.append({r.doc_id for r in op.deduplicate(docs).collect()})
    assert counts == [set(range(100)), set(range(400))]


def test_similar_through_the_smallest(spark):
    """Pages that only their template makes similar are one group, found without comparing all pairs."""
    template = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(template + [f"p{i}x{k}" for k in range(10 + i % 20)])) for i in range(150)]
    kept = op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in kept] == [0]


def test_shape_follows_the_number_of_documents():
    assert op.shape(0) == op.shape(10**6) == (op.BITS, op.BUDGET)
    shapes = [op.shape(10**k) for k in range(4, 12)]
    assert shapes == sorted(shapes) and shapes[-1][0] <= 64 and shapes[-1] > shapes[2]


@pytest.mark.parametrize("found", op.SHAPES)
def test_parts_find_similar_documents(found):
    """Of pairs at a similarity of just 0.8, whose bits differ with a chance of 0.15, hardly any differ too much in all parts."""
    differ = np.random.default_rng(4).random((5000, 64 * op.WORDS)) < 0.1516
    near = np.zeros(len(differ), bool)
    for at in op.places(found[0], op.SHAPES[found]):
        near |= differ[:, at].sum(axis=1) <= found[1]
    assert near.mean() >= 0.99


def test_walk_grows_slower_than_documents(monkeypatch):
    """What tries compare for a document grows by less than twice from 200,000 documents to twelve times as many."""
    seen, members = [], trie._members
    monkeypatch.setattr(trie, "_members", lambda *a: seen.append(members(*a)) or seen[-1])

    def compared(n):
        bits, budget = op.shape(n)
        length, size = bits // (budget + 1), n >> bits // (budget + 1)
        seen.clear()
        rng = np.random.default_rng(n)
        own = np.sort(rng.integers(0, 1 << bits - length, size, dtype=np.uint64)) << np.uint64(64 - bits)
        one = np.zeros(size, dtype=np.int64)
        trie.self_join(one, one + length, one > 0, own, rng.integers(0, 1 << 63, (size, 2), dtype=np.uint64), budget, op.NEAR)
        return op.SHAPES[bits, budget] * (budget + 1) * sum(len(i) for i, _ in seen) / size

    assert compared(2_500_000) < 2 * compared(208_000) < 5000


def test_longer_parts_find_the_same(spark):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        w = [f"g{g}w{i}" for i in range(80)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(w[: rng.choice([72, 66, 40])] + ["new"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id for r in op.deduplicate(docs).collect()}
    plain = op.shape
    try:
        op.shape = lambda n: (44, 4)
        assert {r.doc_id for r in op.deduplicate(docs).collect()} == want
    finally:
        op.shape = plain


def test_edited_copies_make_few_pairs(spark):
    """Copies with a tenth of their words changed are similar to the text that they go back to, mostly not to each other."""
    import random

    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        at = rng.randrange(300 - 22)
        w[at : at + 22] = [f"e{i}x{k}" for k in range(22)]
        rows.append((i, " ".join(w)))
    sets = op.shingle_sets(spark.createDataFrame(rows, "node long, text string"))
    found = prefix.entries(sets, 0.8)
    stars = {(r.u, r.v) for r in prefix.stars(found).collect()}
    assert stars == {(i, 0) for i in range(1, 300)}
    roots = sets.where("node > 0").select("node").withColumn("root", sets.node * 0)
    assert prefix.candidates(found, roots, 0.8).count() == 0
    assert [r.doc_id for r in op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]
