import random
import re
from collections import Counter

from shale.llm import op10_quality_rules as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_measures(spark):
    rng = random.Random(18)
    parts = ["a", "b", "the", "of", "x#", "***", "é😀", "\n", "\n\n", "\t", "\x0b", "\xa0", " ", "- item", "wait...", "a b c ", "a b c\n"]
    texts = [None, "", " ", "one", "one two", "a b c a b c", "a a a a", "x " * 60_000, "\n" * 5000, "w" * 100_000]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 150))) for _ in range(300)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 150))) for _ in range(300)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    for r in op.measure(docs).collect():
        q = r._q
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.n_lines) == brute(r.text), r.text and r.text[:80]
    assert op.filter_documents(docs).columns == docs.columns and op.measure(docs.limit(0)).count() == 0


def test_verdicts(spark, tmp_path):
    rng = random.Random(19)
    good = " ".join(rng.choice(["the", "of", *[f"word{chr(97 + i)}" for i in range(26)]]) for _ in range(120))
    texts = {1: good, 2: good.upper().replace(" ", "!! "), 3: good.replace(" ", "### "), 4: "the same words " * 40, 5: " ".join(good.split()[:49]), 6: None, 7: "12 34 " + "9 8 7 6 5 " * 30}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op.query(spark, str(tmp_path)).collect()}
    assert {i for i, r in rows.items() if r.kept} == {1}
    assert {i for i, r in rows.items() if r.base_failed} == {4, 5, 6, 7}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in op.filter_documents(docs).collect()} == {1}
