import hashlib
import math
import random
import re
import time
from collections import defaultdict

from pyspark.sql import functions as F

from shale.llm import op6_pii as op

NATIVE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return (True, kind == 1 and all(int(x) <= 255 for x in m.split(".")), 12 <= len(d) <= 19 and luhn(d or "0"), 9 <= len(d) <= 15)[kind]


def base(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(NATIVE) for m in re.finditer(p, text) if valid(k, m[0]))


def entity(k, v):
    return (k, v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v))


def words(text):
    return [m for m in re.finditer(r"(?<![^\W_])[^\W\d_]{3,}(?![\d_])", text) if not re.match(r"[\w]", text[m.start() - 1 : m.start()] or " ")]


def terms_outside(text, spans):
    """Terms that overlap no span: (term, start, end)."""
    return [(m[0].lower(), m.start(), m.end()) for m in words(text) if not any(x < m.end() and m.start() < z for x, _, z in spans)]


def brute(rows):
    """All counts are of distinct texts; terms are judged and treated anywhere in a text with the entity."""
    texts = [t or "" for _, t in rows]
    n = len(set(texts))
    joint, ents, terms = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in set(texts):
        spans = base(t)
        for ent in {entity(k, t[s:e]) for s, k, e in spans}:
            ents[ent] += 1
            for term in {x[0] for x in terms_outside(t, spans)}:
                joint[ent, term] += 1
        for w in {m[0] for m in words(t.lower())}:
            terms[w] += 1
    out = []
    for t in texts:
        spans = base(t)
        own = {entity(k, t[s:e]) for s, k, e in spans}
        more = {}
        for term, s, e in terms_outside(t, spans) if own else ():
            for ent in own:
                n_et, n_e = joint[ent, term], ents[ent]
                if n_et >= op.SUPPORT and n_e < n:
                    d = math.log2(n_et * n / (n_e * terms[term])) / math.log2(n / n_e)
                    if d >= op.GENERALISE:
                        more[s, e] = max(more.get((s, e), 4), 5 if d >= op.REMOVE else 4)
        out.append(sorted([*spans, *[(s, k, e) for (s, e), k in more.items()]]))
    return out


def corpus():
    rng = random.Random(7)
    vocab = ["alpha", "beta", "gamma", "delta", "Straße", "épée", "omega", "the", "and", "of"]
    rows = []
    for i in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(5, 60))]
        if i % 9 == 0:  # a name beside one address
            k = i // 9 % 2
            w[2:2] = [["Quorra", "Zephyrine"][k], "Vellum", "writes", "from", f"q.vellum@mail{k}.example.com"]
        if i % 11 == 0:
            w.insert(1, rng.choice(["4111 1111 1111 1111", "10.0.0.255", "1.2.3.999", "+1 (555) 123-4567", "4111111111111112"]))
        rows.append((i, " ".join(w)))
    return rows


def test_base(spark):
    rng = random.Random(8)
    parts = ["a@b.c", "_d@e.f", "@", "x.y%", "4111 1111", "-1111-1111", "1.2.3.4", ".5.6", "256.1.1.1", "+49 ", "(0) 12", "3", "7", " ", "\n", "é😀", "00.0.0.1", "."]
    texts = [None, "", "9" * 60_000, "a" * 60_000, "+1" + " 2" * 20_000, "a@b." * 300, "1 2 3-4 " * 500]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    for r in op.scan(docs).collect():
        assert [(x.s, x.k, x.e) for x in r._base] == base(r.text or ""), r.text[:200]


def test_terms_and_redaction(spark):
    rows = corpus() + [(900, None), (901, "")] + corpus()[:20]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, [(x.s, x.k, x.e) for x in r._spans]) for r in op.with_terms(op.stored(op.scan(docs), "t"), docs).collect())
    want = sorted((i, spans) for (i, _), spans in zip(rows, brute(rows), strict=True))
    assert got == want
    assert any(k >= 4 for _, spans in want for _, k, _ in spans)
    clean = {(r.doc_id, r.text, r.lang) for r in op.sanitised(docs).collect()}
    expect = set()
    for (i, text), spans in zip(rows, brute(rows), strict=True):
        out, at = "", 0
        for s, k, e in spans:
            if s >= at:
                out += text[at:s] + op.LABELS[k]
            at = max(at, e)
        expect.add((i, None if text is None else out + text[at:], "x"))
    assert clean == expect


def test_edges(spark, tmp_path):
    for rows in ([], [(1, None), (1, None), (None, "mail a@b.co")]):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{len(rows)}/documents.parquet")
        got = op.query(spark, f"{tmp_path}/{len(rows)}").collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.base_sha256 == hashlib.sha256(b"" if r.doc_id else b"email:5:11").hexdigest()


def test_long_texts(spark):
    """Many matches in one text take time in proportion: 280 KB of addresses, and a name beside each of many more."""
    rows = [(0, "a@b.cc " * 40_000), (1, "Quorra q.v@mail.cc 9 " * 20_000), (2, "Quorra q.v@mail.cc x"), *[(i, f"words of text {i}") for i in range(3, 40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: r for r in op.with_terms(op.stored(op.scan(docs), "t"), docs).collect()}
    clean = {r.doc_id: r.text for r in op.sanitised(docs).collect()}
    assert time.monotonic() - start < 60
    assert [(x.s, x.e) for x in got[0]._spans] == [(7 * i, 7 * i + 6) for i in range(40_000)]
    assert [(x.s, x.k) for x in got[1]._spans][:4] == [(0, 5), (7, 0), (21, 5), (28, 0)] and len(got[1]._spans) == 40_000
    assert clean[0] == "[EMAIL] " * 40_000 and clean[1] == " [EMAIL] 9 " * 20_000


def disclosed(copies=0, far=0):
    """Rows in which a name stands with one address in three texts, that many words apart; one of them is copied."""
    rng = random.Random(9)
    pick = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(n))
    texts = [f"Quorra {pick(far)} writes from q.v@mail.example.com {pick(30)} regards Quorra" if far else f"{pick(9)} Quorra q.v@mail.example.com {pick(9)}" for _ in range(3)]
    return list(enumerate([*texts, *[pick(20) + f" x{i}" for i in range(2_000)], *[texts[0]] * copies]))


def test_copies_hide_nothing(spark):
    """One disclosing text, planted a thousand times."""
    rows = disclosed(copies=1_000)
    out = [r.text for r in op.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(out) == len(rows) and not any("Quorra" in t for t in out)


def test_terms_anywhere(spark):
    """A name far from the address is judged, and replaced at each of its places."""
    rows = disclosed(far=40)
    out = [r.text for r in op.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(out) == len(rows) and not any("Quorra" in t for t in out)


def test_many_entities_and_words_of_one_page(spark):
    """A directory in two versions: 4,000 addresses and 4,000 names that all disclose each other; no row for each two of them."""
    word = lambda i: "name" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    page = " ".join(f"{word(i)} u{i}@mail.example.com" for i in range(4_000))
    rows = [(0, page), (1, page + " again"), *[(i, f"words of text {i}") for i in range(2, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    start = time.monotonic()
    found = op.stored(op.scan(docs), "t")
    told = op.disclosing(found, docs)
    got = {r.doc_id: r for r in op.with_terms(found, docs).collect()}
    assert time.monotonic() - start < 120
    assert told.where(F.col("term").startswith("name")).count() == 8_000
    assert [x.k for x in got[0]._spans] == [5, 0] * 4_000 and len(got[1]._spans) >= 8_000
