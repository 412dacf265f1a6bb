import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np

from shale.llm import op4_toxicity as tox
from shale.llm import op8_quality as fm
from shale.llm import op9_language as ppm


def vocab(rng, letters, n=200):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n)]


# --- op4 ---


def test_folding():
    assert tox.folded("IDIOT").split() == tox.folded("1d10t").split() == tox.folded("іdіоt").split() == tox.folded("ïdïöt").split()
    assert tox.folded("cl0wn").split() == tox.folded("Ｃｌｏｗｎ").split() == tox.folded("c1own").split()
    lexicon = tox.Lexicon({"ciown": 2.0, "trash": 3.0}, ["trash  can"])
    for text, want in [("a clown", 2), ("clowns clown", 4), ("trash can", 0), ("trash, cans", 0), ("trash trash can", 3), ("untrash", 0), ("", 0)]:
        assert lexicon.matched(text) == want, text
    assert tox.Lexicon({}).matched("x") == 0


def corpus(rng, n=700):
    words, bad = vocab(rng, "abcdefghij"), ["idiot", "moron", "scumbag"]
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(3 * toxic):
            own.insert(rng.randrange(len(own)), rng.choice(bad + ["1d1ot", "mоron"]))
        if not toxic and i % 6 == 1:
            own.insert(3, "scumbag steve")
        docs.append((i, " ".join(own), "en", "x"))
        labels.append((i, 1 - toxic, toxic))
    return docs, labels


def test_toxicity_held_out(spark, tmp_path):
    docs, labels = corpus(random.Random(13))
    docs += [(9000, None, None, None), (9001, "", None, None), (None, "you idiot", None, None), (3, docs[3][1], "en", "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tox.query(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) >= 0.95 * len(held)
    clean = {r.doc_id: r for r in got}
    assert clean[9000].predicted == clean[9001].predicted == 0 and 0 <= clean[9001].score <= 1 and clean[None].predicted == 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.learn(spark, empty, none)
    assert tox.score(empty, model).count() == 0
    assert [r.score for r in tox.score(spark.createDataFrame([(1, "x")], empty.schema), model).collect()] == [0.0]


# --- op8 ---


def test_machine_is_the_pairwise_sum():
    machine = fm.Machine()
    rng = np.random.default_rng(14)
    machine.w = rng.normal(size=fm.SIZE).astype(np.float32)
    machine.v, machine.bias = rng.normal(size=(fm.SIZE, fm.RANK)).astype(np.float32), 0.5
    texts = ["one two two Three!", "", "x " * 40]
    words, n, structure = fm.inputs(texts)
    got = machine.raw(words, n, structure)
    at = 0
    for t, k in enumerate(n.tolist()):
        ids = [*words[at : at + k].tolist(), *structure[t].tolist()]
        x = [1 / math.sqrt(max(k, 1))] * k + [1.0] * fm.N_STRUCTURE
        at += k
        want = machine.bias + sum(machine.w[i] * v for i, v in zip(ids, x, strict=True))
        want += sum(float(machine.v[ids[i]] @ machine.v[ids[j]]) * x[i] * x[j] for i in range(len(ids)) for j in range(i))
        assert math.isclose(got[t], want, rel_tol=1e-3, abs_tol=1e-2)


def test_quality_held_out(spark, tmp_path):
    rng = random.Random(15)
    words = vocab(rng, "abcdefghijklm")
    docs, labels = [], []
    for i in range(800):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 150))]
        good = int(i % 4 != 0)
        text = " ".join(own) if good else rng.choice([" ".join(own).upper(), "*** ".join(own), " ".join([own[0]] * len(own))])
        docs.append((i, text))
        labels.append((i, good, 0))
    docs += [(9000, None), (9001, ""), (None, "x"), (3, docs[3][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = fm.query(spark, str(tmp_path)).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = fm.learn(spark, empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert model == 0.0 and fm.score(empty, model).count() == 0


def test_quality_bounds(spark, monkeypatch):
    """A very long text among many, columns with clashing names, and a sample bounded in words."""
    rng = random.Random(19)
    words = vocab(rng, "abcdefgh")
    docs = [(i, " ".join(rng.choice(words) for _ in range(50)).upper() if i % 2 else " ".join(rng.choice(words) for _ in range(50)), "mine", 7) for i in range(300)]
    docs += [(300, "Long " * 400_000, None, None), (301, "w" * 1_000_000, None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, score string, words int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(302)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(fm, "WORDS", 10_000)
    model = fm.learn(spark, frame.where("doc_id < 300"), labels)
    assert isinstance(model, fm.Machine)
    got = {r.doc_id: r for r in fm.score(frame.drop("score"), model).collect()}
    assert len(got) == 302 and got[5].words == 7 and all(0 <= r.score <= 1 for r in got.values())
    out = fm.score(frame, model)
    assert out.columns == ["doc_id", "words", "score"] and out.count() == 302


# --- op9 ---


def brute_bits(train: dict[str, list[str]], text: str) -> dict[str, float]:
    k_max = ppm.ORDER
    code = lambda t: ppm.FOLD[np.frombuffer(b" " * k_max + t.encode(), np.uint8)].tolist()
    out = {}
    for lang, texts in train.items():
        tree = defaultdict(Counter)
        for t in texts:
            c = code(t)
            for i in range(k_max, len(c)):
                for k in range(k_max + 1):
                    tree[tuple(c[i - k : i])][c[i]] += 1
        total, c = 0.0, code(text)
        for i in range(k_max, len(c)):
            for k in range(k_max, -1, -1):
                own = tree[tuple(c[i - k : i])]
                if own[c[i]]:
                    total -= math.log2(own[c[i]] / (sum(own.values()) + sum(1 for v in own.values() if v)))
                    break
                if sum(own.values()):
                    kinds = sum(1 for v in own.values() if v)
                    total -= math.log2(kinds / (sum(own.values()) + kinds))
            else:
                total += 8
        out[lang] = total
    return out


def test_code_lengths_and_predictions(spark, tmp_path, monkeypatch):
    rng = random.Random(16)
    train = {x: [" ".join(rng.choice(v) for _ in range(25)) for _ in range(80)] for x, v in {"aa": vocab(rng, "abcdeé"), "bb": vocab(rng, "fghijß"), "cc": vocab(rng, "аеорсв")}.items()}
    docs = [(i, t, x) for i, (x, t) in enumerate((x, t) for x, own in train.items() for t in own)]
    docs += [(9000, None, "aa"), (9001, "123 !", "bb"), (9002, "abc", None), (None, "fgh", None), (3, docs[3][1], "aa"), (9003, "日本", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    known = frame.where("doc_id is not null and doc_id < 9000").dropDuplicates(["doc_id"])
    names, counts = ppm.learn(known)
    assert names == sorted(train)
    model = ppm.Model(names, counts)
    texts = [train["aa"][0], "fgh xyz éé", "", "Zzz 日本 9", "a", "аеор " * 300]
    got = model.bits(texts)
    for t, row in zip(texts, got, strict=True):
        assert np.allclose(row, [brute_bits(train, t)[x] for x in names], rtol=1e-4, atol=1e-2)
    monkeypatch.setattr(ppm, "COSTS", 100)  # the same in small parts
    assert np.allclose(model.bits(texts), got, rtol=1e-5)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = ppm.query(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    truth = {i: x for i, _, x in docs if x and i < 9000}
    assert all(r.lang_pred == truth[r.doc_id] for r in rows if r.doc_id in truth)
    by = {r.doc_id: r for r in rows}
    assert by[9000].lang_pred == by[9001].lang_pred == "und" and by[9002].lang_pred == "aa" and by[None].lang_pred == "bb"
    assert {r.lang_pred for r in ppm.predict(frame.select("doc_id", "text"), None).collect()} == {"und"}


def test_letters_and_scripts(spark, tmp_path):
    """Any language that is there is learned, whatever its script; texts without a letter are und."""
    rng = random.Random(18)
    scripts = {f"s{i:02d}": "".join(chr(c) for c in range(first, first + 30)) for i, first in enumerate([0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x905, 0x985, 0xA05, 0xE01, 0x10D0, 0x1100, 0x3041, 0x30A1, 0x4E00, 0xAC00])}
    scripts |= {f"t{i:02d}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 9)) for i in range(60)}
    docs = [(i * 100 + k, " ".join(rng.choice(words) for _ in range(40)), x) for i, (x, words) in enumerate((x, vocab(rng, letters, 60)) for x, letters in scripts.items()) for k in range(12)]
    odd = ["² ½ ①", "١٢٣", "12 34", "!?", "⁂ ー"[:1], "ª", "ⅷ", "é", "日", " \n"]
    rows = docs + [(100_000 + i, t, None) for i, t in enumerate(odd)] + [(200_000, docs[0][1] * 5_000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in ppm.query(spark, str(tmp_path)).collect()}
    assert sum(by[i].lang_pred == x for i, _, x in docs) >= 0.98 * len(docs)
    for i, t in enumerate(odd):
        assert (by[100_000 + i].lang_pred == "und") == (not any(unicodedata.category(c)[0] == "L" for c in t)), t
    assert by[200_000].lang_pred == docs[0][2]
