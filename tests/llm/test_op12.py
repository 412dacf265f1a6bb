import hashlib
import random
import time

import numpy as np
import pytest

from shale.llm import op12_repeats as op


def brute(rows):
    """(doc_id, n_bytes, removed runs, kept bytes) of all rows."""
    texts = [(op.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for (i, t), (own, _) in zip(texts, rows, strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
        spans = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((own, len(t), spans, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, kept string, bucket string").repartition(3)
    out = op.without_repeats(docs)
    assert out.columns == ["doc_id", "bucket", "kept", "spans", "n_bytes"]
    return sorted((str((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))) for r in out.collect()))


def corpus(seed=12, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    phrase, passage, edge = prose(5)[:26], prose(60), prose(30)[:50]
    rows = []
    for i in range(n):
        t = prose(rng.randrange(1, 120))
        kind = i % 8
        if kind == 1:
            t += " " + passage + prose(3)
        elif kind == 2:
            t = prose(2) + phrase + prose(20)
        elif kind == 3 and i > 10:
            t = rows[i - 3][1]
        elif kind == 4 and i > 10:
            own = (rows[i - 4][1] or "").split(" ")
            own[rng.randrange(len(own))] = "edit"
            t = " ".join(own)
        elif kind == 5:
            t = t[:80] + edge + t[80:]  # 50 bytes exactly
        elif kind == 6:
            t = t[:80] + edge[:49] + "é" + t[80:]
        rows.append((i * 3 % n, t))
    rows += [(500, None), (501, ""), (502, "short"), (503, "a" * 700), (504, "b" + "a" * 300), (505, "ab" * 400), (506, "ab" * 30), (507, passage[:50]), (508, passage[:49]), (None, passage), (None, prose(9) + passage[3:90])]
    return rows + [(503, "a" * 700), (3, passage), (3, passage), (509, "é😀漢" * 40), (510, "漢" + "é😀漢" * 30)]


@pytest.mark.parametrize("hot", [0, 3, 2048])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(op, "HOT", hot)  # 0: every digit is dealt out window by window
    monkeypatch.setattr(op, "CHUNK_BYTES", 6000)
    monkeypatch.setattr(op, "BLOCK", 700)
    rows = corpus()
    assert found(spark, rows) == sorted(map(str, brute(rows)))


def test_pieces_of_the_readings(monkeypatch):
    """All three readings without Spark: chunks, buckets and answers, against brute force."""
    import pyarrow as pa

    for seed, hot, size in ((1, 0, 1), (2, 2, 7), (3, 5000, 40), (4, 4, 200)):
        monkeypatch.setattr(op, "HOT", hot)
        rows = corpus(seed, 80)
        deal = op.Dealing(10_000)
        parts = [rows[k : k + size] for k in range(0, len(rows), size)]
        made = [([(t or "").encode() for _, t in p], np.array([op.LAST if i is None else i for i, _ in p], dtype=np.int64)) for p in parts]
        sent = sorted([(b, k, 0, d, w) for k, m in enumerate(made) for b, d, w in op._digits(deal, *m)])
        shorts = pa.table(dict(zip(("bucket", "file", "row", "digits", "what"), map(list, zip(*sent, strict=True)), strict=True)))
        shorts = shorts.cast(pa.schema([("bucket", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("digits", pa.binary()), ("what", pa.binary())]))
        left = pa.Table.from_batches(list(op._shared(shorts.to_batches(max_chunksize=5))))
        of = lambda t, k: t.filter(pa.compute.equal(t.column("file"), k))
        out = sorted([(b, k, 0, *[e[c] for c in op.SEGMENT]) for k, m in enumerate(made) for b, e in op._left(deal, *m, of(left, k))])
        table = lambda out, names: pa.table({n: pa.array([x[i] for x in out], pa.int64() if i < 3 else pa.binary()) for i, n in enumerate(["bucket", "file", "row", *names])})
        told = pa.Table.from_batches(list(op._told(table(out, op.SEGMENT).to_batches(max_chunksize=4))))
        asks = lambda k: op._numbers(of(told, k).column("asks").to_pylist(), op.ASK)
        out = sorted([(b, k, 0, *[e[c] for c in op.ENTRY], raw, known) for k, m in enumerate(made) for b, e, raw, known in op._entries(deal, *m, asks(k))])
        answers = pa.Table.from_batches(list(op._answered(table(out, [*op.ENTRY, "raw", "known"]).to_batches(max_chunksize=3))))
        answers = pa.concat_tables([answers, told.drop_columns("asks")])
        want = brute(rows)
        for k, m in enumerate(made):
            doc, start, end = op.covered(*m, op._numbers(of(answers, k).column("answers").to_pylist(), op.ANSWER))
            offset = np.cumsum([0, *map(len, m[0])])
            for i in range(len(m[0])):
                mine = [(int(s - offset[i]), int(e - offset[i])) for d, s, e in zip(doc, start, end, strict=True) if d == i]
                assert mine == want[k * size + i][2], (seed, k, i)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.without_repeats(docs).count() == 0


def test_query(spark, tmp_path):
    rows = corpus(5, 60)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, (tuple(r) for r in op.query(spark, str(tmp_path)).collect())))
    assert got == sorted(str((i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest())) for i, n, s, k in brute(rows))


def test_readings_leave_no_shuffle_files(spark):
    """Before the last reading begins, the ones before it have been run, and what they shuffled is off the disks."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    docs = spark.createDataFrame(corpus(5, 40), "doc_id long, text string").repartition(3)
    before = files()
    out = op.without_repeats(docs)
    left = lambda: {x for x in files() - before if x.endswith(".data")}
    for _ in range(100):  # they are removed in the background
        if left():
            time.sleep(0.1)
    assert not left()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1, plan


def test_chunks_follow_the_rows_alone(monkeypatch):
    """Readings of other batch sizes make the same chunks: each finds what the one before has told."""
    import pyarrow as pa

    monkeypatch.setattr(op, "CHUNK_BYTES", 1000)
    texts = [t for _, t in corpus(7, 60)]
    rows = pa.RecordBatch.from_pylist([{"text": t, "_rid": {"file": 1, "row": i}} for i, t in enumerate(texts)])
    made = [[(key, c.column("text").to_pylist()) for key, c in op._cut([rows.slice(i, n) for i in range(0, len(texts), n)])] for n in (1, 7, 20, len(texts))]
    assert all(x == made[0] for x in made) and [t for _, c in made[0] for t in c] == texts
    assert all(len(c) == 1 or sum(len((t or "").encode()) for t in c) <= 1000 for _, c in made[0])


def test_buckets_are_even():
    """No bucket has more than its share of the digits, whatever the texts: a worker holds one bucket."""
    rng = np.random.default_rng(12)
    own = op.Segments([bytes(rng.integers(97, 123, 400_000, dtype=np.uint8))])
    bucket = op.Dealing(1 << 20).bucket(np.unique(own.digit))
    count = np.bincount(bucket, minlength=op.BUCKETS)
    assert len(count) == op.BUCKETS and count.max() < 2 * count.mean(), count.max() / count.mean()


def test_a_bucket_is_judged_in_slices(monkeypatch):
    """Slices of whole routes give the masks of one slice, and take its memory, not the bucket's."""
    import tracemalloc

    rng = np.random.default_rng(5)
    n = 40_000
    e = {"digit": rng.integers(0, n // 4, n).astype("u8"), "content": np.arange(n, dtype="u8"), "least": rng.integers(0, 50, n), "n": rng.integers(1, 30, n).astype("u1"), "from": np.zeros(n, "u1")}
    e["route"] = e["digit"]
    raw = rng.integers(97, 99, int((e["n"].astype(int) + op.THRESHOLD - 1).sum()), dtype=np.uint8)
    raw[: len(raw) // 2] = 97

    def measured(limit):
        monkeypatch.setattr(op, "JUDGED_BYTES", limit)
        tracemalloc.start()
        masks = op.judged(e, raw)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return masks, peak

    (whole, most), (sliced, less) = measured(1 << 40), measured(1 << 16)
    assert whole.any() and (whole == sliced).all() and (op.judged(e, raw) == whole).all()
    assert less < most / 4, (less, most)
    assert op.judged({k: v[:0] for k, v in e.items()}, raw[:0]).tolist() == []
