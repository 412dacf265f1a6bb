import hashlib
import math
import random

import numpy as np

from shale.llm import op11_vector_codes as op


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error) of all kept rows, and the codebooks; plain Python."""
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    size = -(-dim // parts)
    pieces = lambda x: [(x + [0] * size * parts)[k * size : (k + 1) * size] for k in range(parts)]
    cut = [pieces(r[1]) for r in kept]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, book: min((dist(x, c), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(best(c[k], books[k])[1], []).append(c[k])
            books[k] = [[sum(z) // len(groups[j]) for z in zip(*groups[j], strict=True)] if j in groups else b for j, b in enumerate(books[k])]
    out = []
    for (i, _, label), c in zip(kept, cut, strict=True):
        near = [best(c[k], books[k]) for k in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in near), sum(d for d, _ in near), label))
    return out, books


def vectors(n, dim, seed=11):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for i in range(n)]


def check(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op.query(spark, str(tmp_path)).collect()
    out, books = brute(rows)
    totals = {}
    for *_, error, label in out:
        totals[label] = totals.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=key)


def test_equals_brute_force(spark, tmp_path):
    rows = vectors(300, 32)
    rows += [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] + [0.0] * 31, 1), (1003, [float("inf")] * 32, 2), (1004, [], 1), (-5, [0.1] * 31 + [None], 1)]
    rows += [(1005, [0.5] * 31, 2), (7, rows[7][1], 2), (7, [0.25] * 32, None), (None, [0.125] * 32, 1)] + [(2000 + i, [0.5] * 32, 1) for i in range(40)]
    check(spark, tmp_path, rows)


def test_odd_dimension_few_rows(spark, tmp_path):
    check(spark, tmp_path, vectors(9, 19, 5))


def test_empty(spark, tmp_path):
    check(spark, tmp_path, [(1, None, 1)])


def test_codes_give_vectors_back(spark):
    rows = vectors(200, 32)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, error string, _row string")
    books, dim = op.trained(docs, entries=64, rounds=2)
    coded = op.encoded(docs, books, dim)
    assert coded.columns == ["vec_id", "label", "_row", "codes", "error"] and coded.count() == 200
    back = {r.vec_id: r.vector for r in op.decoded(coded, books, dim).collect()}
    error = {r.vec_id: r.error for r in coded.collect()}
    for i, v, _ in rows:
        exact = sum((math.floor(256 * x) - (256 * y - 0.5)) ** 2 for x, y in zip(v, back[i], strict=True))
        assert abs(exact - error[i]) < 1e-3


def test_large_components_are_held():
    import pyarrow as pa

    at, x = op.integers(pa.array([[1e30, -1e30, 1.0]]), 3)
    assert at.tolist() == [0] and x.tolist() == [[op.LIMIT, -op.LIMIT, 256]]
