import hashlib
import math
import random
import re
import string
import time

from shale.llm import op1_secrets as op

NATIVE = {
    "assign": r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"access": 16, "hex": 32}


def base(text):
    out = []
    for k, kind in enumerate(op.KINDS[:3]):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        for m in re.finditer(NATIVE[kind], text, flags):
            if (len(m[1]) >= 8) if kind == "assign" else (len(m[0]) >= LEAST[kind]):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def p_value(core, alphabet):
    v, a, n = [alphabet.index(c) for c in core], len(alphabet), len(core)
    chi, df = sum(a * v.count(x) ** 2 / n for x in set(v)) - n, a - 1
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    p1 = tail(((max(chi, 0) / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    high = [2 * x >= a for x in v]
    n1 = sum(high)
    mu = 1 + 2 * n1 * (n - n1) / n
    var = (mu - 1) * (mu - 2) / (n - 1)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
    p2 = 2 * tail(abs((runs - mu) / math.sqrt(var) if var > 0 else 9))
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    along = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False))
    p3 = 2 * tail(abs((along / spread + 1 / n) * math.sqrt(n) if spread > 0 else 9))
    h = -sum(math.log(max(p, 1e-30)) for p in (p1, p2, p3))
    return math.exp(-h) * (1 + h + h * h / 2)


def token_rows(rng):
    b64 = string.ascii_letters + string.digits + "+/"
    words = ["the", "quick", "onth", "ering", "tion", "ableness", "walking"]
    rows = []
    for i in range(400):
        text = " ".join("".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(20))
        if i % 10 == 0:
            text += " key " + "".join(rng.choice(b64) for _ in range(40)) + " end"
        if i % 17 == 0:
            text += " https://x/" + "_".join(rng.choice(words) for _ in range(8)) + "9"
        rows.append((i, text))
    return rows


def test_base_spans(spark):
    rng = random.Random(5)
    parts = ["token=", 'PassWord" : "', "api_key:", "apikey==", "secret", "AKIA", "abcdef0123456789", "Z9", " ", "\n", "é😀", "x.y-z/", "ſecret=abcdefgh1"]
    texts = [None, "", "token=secret:abcdefgh12", "password=" + "a" * 5000, "f" * 40_000, "AKIA" + "B" * 12 + "akia"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "token=12345678", "x"), (3, texts[3], "x")]
    got = op.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    for r in got:
        assert [(x.s, x.k, x.e) for x in r._base] == base(r.text or "")
        assert all((r.text or "")[x.s : x.e] == x.v for x in r._base)


def test_tests_and_report(spark):
    rng = random.Random(6)
    rows = token_rows(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scanned = op.scan(docs).cache()
    alphabets = [a for _, a in op.ENCODINGS]
    found, table = {}, {}
    for r in scanned.collect():
        want = [(m.start(), m.end()) for m in re.finditer(op.TOKEN, r.text) if not any(s < m.end() and m.start() < e for s, _, e in base(r.text))]
        assert {(x.s, x.e) for x in r._tokens} <= set(want)
        for x in r._tokens:
            core = x.v.rstrip("=")
            core = core.lower() if re.fullmatch("[A-Z][a-z]+", core) else core
            enc = next(i for i, a in enumerate(alphabets) if set(core) <= set(a))
            assert (x.enc, x.n) == (enc, len(core))
            assert math.isclose(x.p, p_value(core, alphabets[enc]), rel_tol=2e-2, abs_tol=1e-6)
            cls = math.floor(2 * math.log2(x.n))
            bin_ = min(op.BINS, math.floor(-op.PER_DECADE * math.log10(max(x.p, 1e-30))))
            t = table.setdefault((enc, cls, bin_), {"enc": enc, "len": cls, "bin": bin_, "c": 0, "same": 0, "pairs": 0, "n": x.n})
            t["c"] += 1
            t["same"] += sum(core.count(c) * (core.count(c) - 1) for c in set(core))
            t["pairs"] += x.n * (x.n - 1)
            t["n"] = min(t["n"], x.n)
            found[r.doc_id, x.s] = (enc, cls, bin_)
    cuts = op.decide(list(table.values()))
    assert cuts == op.thresholds(scanned)
    got = {(r.doc_id, x.s) for r in op.with_random(scanned, cuts).collect() for x in r._spans if x.k == 3}
    assert got == {k for k, (enc, cls, bin_) in found.items() if 10 ** (-bin_ / op.PER_DECADE) > cuts.get((enc, cls), 2)}
    planted = {i for i, t in rows if " key " in t}
    assert len({i for i, _ in got} & planted) >= 0.85 * len(planted)
    assert len([1 for i, _ in got if i not in planted]) <= 2


def test_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string"
    for rows in ([], [(1, None, None), (1, None, None), (None, "AKIA" + "Q7" * 8, "x")]):
        docs = spark.createDataFrame(rows, schema)
        docs.write.parquet(f"{tmp_path}/{len(rows)}/documents.parquet")
        got = op.query(spark, f"{tmp_path}/{len(rows)}").collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.base_sha256 == hashlib.sha256((b"" if r.doc_id else b"access:0:20")).hexdigest()


def test_long_texts(spark):
    """A token of a megabyte and many tokens in one text take time in proportion."""
    rng = random.Random(11)
    b64 = string.ascii_letters + string.digits + "+/"
    blob = "".join(rng.choices(b64, k=1_000_000))
    many = " ".join(f"token=Aa{i:08d} {''.join(rng.choices(b64, k=20))}" for i in range(20_000))
    docs = spark.createDataFrame([(0, f"data:{blob}= end"), (1, many)], "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: r for r in op.scan(docs).collect()}
    assert time.monotonic() - start < 60
    assert [(x.s, x.e, x.n) for x in got[0]._tokens] == [(5, 1_000_006, 1_000_000)]
    assert math.isclose(got[0]._tokens[0].p, p_value(blob, dict(op.ENCODINGS)["base64"]), rel_tol=2e-2)
    assert [(x.s, x.k, x.e) for x in got[1]._base] == base(many)
    assert {(x.s, x.e) for x in got[1]._tokens} == {m.span(1) for m in re.finditer(r" (\S{20})(?: |$)", many)}


def stratum(enc, n, c, bin_, words=()):
    """Rows of random tokens of the lengths n, c of each, and of rejected ones (length, count)."""
    cls = math.floor(2 * math.log2(max(n)))
    row = lambda n, c, b: {"enc": enc, "len": cls, "bin": b, "c": c, "same": 0.0, "pairs": 0, "n": n}
    return [row(x, c, bin_) for x in n] + [row(x, k, op.BINS) for x, k in words]


def test_report_at_any_corpus_size():
    """The same tokens are reported whether there are 40, 4,000 or 400,000 of them."""
    names = [name for name, _ in op.ENCODINGS]
    for enc, lengths in (("base62", (32, 38, 45)), ("base62", (40, 45)), ("base64", (40,)), ("base62", (46, 50))):
        e, cls = names.index(enc), math.floor(2 * math.log2(max(lengths)))
        for total in (40, 4_000, 400_000):
            got = op.decide(stratum(e, lengths, total // len(lengths), 1))
            assert got == {(e, cls): 0.0}, (enc, lengths, total)
            # one gross outlier closes no stratum
            assert (e, cls) in op.decide(stratum(e, lengths, total // len(lengths), 1, [(max(lengths), 1)]))


def test_own_length():
    """A short token is left alone, and doesn't take the longer ones of its stratum along."""
    e = [name for name, _ in op.ENCODINGS].index("base62")
    assert op.decide(stratum(e, (23, 30), 1_000, 1)) == {(e, 9, 30): 0.0}
    assert op.decide(stratum(e, (16, 18), 1_000, 1)) == {}
