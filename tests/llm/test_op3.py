import os
import random
import time

import numpy as np
import pytest
import xxhash

from shale.llm import op3_simhash as op
from shale.llm import trie


def fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, most=2):
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_prints(rng, n):
    seeds = [rng.getrandbits(64) for _ in range(max(1, n // 8))]
    out = set()
    while len(out) < n:
        x = rng.choice(seeds)
        for _ in range(rng.randrange(0, 4)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def labels_of(n, u, v):
    return trie.groups(n, np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)).tolist()


@pytest.mark.parametrize("seed", range(6))
def test_self_join(seed):
    rng = random.Random(seed)
    prints = near_prints(rng, 400)
    if seed == 5:
        prints = sorted({rng.getrandbits(10) << 30 for _ in range(400)})  # one dense group
    bits = np.array(prints, dtype=np.uint64)
    zero = np.zeros(len(bits), dtype=np.int64)
    got = trie.self_join(zero, zero, zero > 0, bits, bits[:, None], 2, 2)
    assert got.tolist() == brute(prints)


@pytest.mark.parametrize("limit", [op.SUBTREE, 30])
def test_links(spark, limit):
    rng = random.Random(9)
    prints = near_prints(rng, 200) + sorted({rng.getrandbits(9) << 40 for _ in range(60)})
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    rows = [(i, x) for i, x in enumerate(signed)] + [(i + 1000, signed[0]) for i in range(20)] + [(None, signed[1])]
    got = {r.doc_id: r.component_id for r in op.with_components(spark.createDataFrame(rows, "doc_id long, fp long"), limit).collect()}
    want = brute(prints)
    assert [got[i] for i in range(len(prints))] == want
    assert got[1005] == want[0] and got[None] == want[1]


def test_query(spark, tmp_path):
    rng = random.Random(10)
    vocab = [f"w{i}" for i in range(500)]
    texts = [None, "", "  \n", "One", "one", "ONE two", "a b c", "A\tb\x0bC", "é É x", "nb\xa0sp b c", "long " * 30_000]
    for _ in range(40):
        w = [rng.choice(vocab) for _ in range(300)]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):
            v = list(w)
            v[rng.randrange(300)] = "changed"
            texts.append(" ".join(v))
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, texts[12], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    prints = [fingerprint(t) for t in texts]
    want = brute(prints)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, p in enumerate(prints):
        assert by[i].fingerprint == f"{p:016x}" and by[i].component_id == want[i]
    assert by[None].component_id == want[12]


def jaccard(a, b):
    s = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.mark.parametrize("limit", [op.SUBTREE])
def test_deduplicate(spark, limit):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(40):
        w = [rng.choice(vocab) for _ in range(400)]
        for k in range(rng.choice([1, 1, 2, 3, 12])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 3]) if k else 0):
                v[rng.randrange(400)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(v), f"src{g}", "extra"))
    for d in range(20):  # the same topic, but other texts
        rows.append((len(rows), " ".join(rng.choice(vocab) for _ in range(200)) + " " + rows[d][1][: len(rows[d][1]) // 3], "x", "y"))
    rows += [(None, rows[0][1], "x", "y"), (900, None, None, None), (901, None, None, None), (902, "short text", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, component_id string")
    out = op.deduplicate(docs, limit=limit)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    heads = {min(i for i, g in group.items() if g == k) for k in set(group.values())}
    assert heads <= kept and len(kept & set(group)) <= len(heads) + 2
    assert kept - set(group) == {r[0] for r in rows if r[0] is not None and r[0] not in group} - {901}
    assert op.deduplicate(docs.limit(0)).count() == 0


def test_deduplicate_repeated_passage(spark):
    """A passage repeated inside otherwise different documents doesn't make them near-duplicates."""
    rng = random.Random(12)
    rows = []
    passage = " ".join(f"p{i}" for i in range(12))
    for i in range(12):
        own = [f"d{i}x{rng.randrange(10**6)}" for _ in range(220)]
        rows.append((i, " ".join([passage] * 15 + own)))
    assert op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).count() == len(rows)


def test_deduplicate_recall(spark):
    """All pairs at a similarity of just 0.8 or more are joined, and none below."""
    rng = random.Random(13)
    rows, heads = [], set()
    for g in range(300):
        n = rng.randrange(40, 120)
        w = [f"g{g}w{i}" for i in range(n)]
        cut = rng.choice([round(n * x) for x in (0.75, 0.78, 0.8, 0.82, 0.9)]) + rng.randrange(2)
        v = w[:cut] + [f"new{g}"] * (n % 3)
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
        heads |= {2 * g} | ({2 * g + 1} if jaccard(rows[-2][1], rows[-1][1]) < 0.8 else set())
    assert 300 < len(heads) < 500
    assert {r.doc_id for r in op.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == heads


def test_rounds_of_parts(spark, monkeypatch):
    """Only some parts' tries are shuffled together; the result is that of all at once."""
    rows = [(i, " ".join(f"w{(i // 4) * 50 + k if k != i % 4 else -i}" for k in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked, links = [], op.links
    monkeypatch.setattr(op, "links", lambda nodes, values, *a: asked.append(len(values)) or links(nodes, values, *a))
    monkeypatch.setattr(op, "ROUND", 16)
    some = sorted(r.doc_id for r in op.deduplicate(docs).collect())
    assert asked == [16, 16, 8]
    monkeypatch.setattr(op, "ROUND", op.TABLES)
    assert some == sorted(r.doc_id for r in op.deduplicate(docs).collect()) and len(some) < 40


def test_deduplicate_leaves_no_shuffle_files(spark):
    """What the steps have shuffled is off the disks when each ends, and of the rounds of components only the last one is kept."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x and x.endswith(".data")}
    rows = [(i, " ".join(f"w{(i // 4) * 50 + k if k != i % 4 else -i}" for k in range(50))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = files()
    out = op.deduplicate(docs)
    for _ in range(100):  # they are removed in the background
        if files() - before:
            time.sleep(0.1)
    assert not files() - before
    assert out.count() < 40
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    kept = set(os.listdir(shared))
    chain = op.components(spark.range(60).selectExpr("id AS u", "id + 1 AS v"))
    assert {(r.u, r.root) for r in chain.collect()} == {(i, 0) for i in range(1, 61)}
    assert len(set(os.listdir(shared)) - kept) == 1
