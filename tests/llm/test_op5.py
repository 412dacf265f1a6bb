import random

import numpy as np
from pyspark.sql import functions as F

from shale.llm import op5_decontaminate as op
from shale.llm.tokens import shingle_hashes, word_hashes


def brute(docs, items):
    out = []
    for d, text, *_ in docs:
        for i, item in items:
            own, words = op.words_of(item), op.words_of(text)
            if own:
                n, found = op.contained(own, words)
                if found >= op.SIMILARITY * n - 1e-9:
                    out.append((d, i, n, found))
    return sorted(out, key=str)


def test_word_hashes():
    texts = ["", "a", "A  b\tc\x0bd", "é É \xa0", " a b c d e f ", "a b c d e f", "x" * 9999, "\n\n"]
    h, size, n = word_hashes(texts)
    flat = [w for t in texts for w in op.words_of(t)]
    assert n.tolist() == [len(op.words_of(t)) for t in texts] and size.tolist() == [len(w) for w in flat]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
    for k in (1, 2, 5):
        s, m = shingle_hashes(h, n, k)
        own = [sorted(x.tolist()) for x in np.split(s, np.cumsum(m)[:-1])]
        assert own[4] == own[5] and len(own[4]) == 7 - k


def test_search_both_ways(spark):
    rng = random.Random(12)
    vocab = [f"W{i}" for i in range(400)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(pick(rng.choice([1, 3, 5, 9, 40, 60, 150, 400])))) for i in range(40)] + [(98, None), (99, " "), (3, "repeated id of three words here")]
    docs = []
    for i in range(200):
        w = pick(rng.choice([0, 2, 50, 400, 3000]))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items)[1] or "").lower().split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                if own:
                    own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = own
        docs.append((i, "  ".join(w), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (7, docs[7][1], "x"), (None, docs[8][1], "x")]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    for limit in (op.BROADCAST_BYTES, 0):
        got = op.contaminated(frame.select("doc_id", "text"), bench, broadcast_bytes=limit).collect()
        assert sorted([(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got], key=str) == want
        clean = op.decontaminate(frame, bench, broadcast_bytes=limit)
        bad = {x[0] for x in want}
        assert sorted([tuple(r) for r in clean.collect()], key=str) == sorted([d for d in docs if d[0] not in bad], key=str)
    assert op.contaminated(frame.limit(0), bench).count() == 0 and op.decontaminate(frame, bench.limit(0)).count() == len(docs)
    clash = frame.select("doc_id", F.lit("mine").alias("item_id"), F.lit(1).alias("n_found"), F.lit(2).alias("n_shingles"), "text", F.lit(3).alias("a.b"))
    for limit in (op.BROADCAST_BYTES, 0):
        got = op.contaminated(clash, bench, broadcast_bytes=limit)
        assert sorted(got.columns) == sorted(["doc_id", "a.b", *op.RESULT])
        assert sorted([(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()], key=str) == want
        assert op.decontaminate(clash, bench, broadcast_bytes=limit).columns == clash.columns
        assert op.contaminated(clash, bench.limit(0), broadcast_bytes=limit).count() == 0
