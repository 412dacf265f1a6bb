import hashlib
import random
import re

from shale.llm import op13_fill_in_middle as op

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = UNIT.findall(t)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, t
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(13)
    parts = ["a", "bb", "é😀", "\n", "\t\t", " ", "\x0b", "\xa0", "\x00", "<", "P>", "<S", "S>", "word ", "\r\n"]
    out = [None, "", " ", "\n\n", "one", " one ", "<P>", "a <M> b", "<S <M", "w" * 100_000, "x y " * 60_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 80))) for _ in range(600)]


def test_equals_brute_force(spark):
    rows = [(i, t, "own", "clash") for i, t in enumerate(texts())] + [(3, "again and again", "x", "y"), (3, "again and again", "x", "y"), (None, "null id here", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, form string")
    out = op.transformed(docs)
    assert out.columns == ["doc_id", "text", "extra", "form", "n", "prefix_chars", "middle_chars"]
    found = sorted(map(str, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text, r.extra) for r in out.collect())))
    assert found == sorted(str((i, *brute(i, t), e)) for i, t, e, _ in rows)
    assert {r.form for r in out.select("form").collect()} == {"plain", "spm", "psm"}
    back = op.restored(out)
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(str((i, t or "")) for i, t, _, _ in rows)
    assert op.transformed(docs.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {tuple(r) for r in op.query(spark, str(tmp_path)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()}
    want = set()
    for i, t in rows:
        *digest, output = brute(i, t)
        want.add((i, *digest, sha(output), sha(t or "")))
    assert got == want
