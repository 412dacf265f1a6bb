"""Secret scan: fixed patterns, and a battery of randomness tests for other tokens. DataFrame functions only.

Base spans are the matches of three patterns. Other tokens (16 or more of ``A-Za-z0-9+/_-``, with ``=`` behind them, outside
base spans) get an encoding: the smallest alphabet that holds them (digits alone are numbers, no secrets). Three tests ask whether the token could be uniform random symbols
of that alphabet: chi-squared uniformity of the alphabet, runs above and below its middle, and lag-1 serial
correlation. Fisher's method joins them to one p-value.

False discoveries are controlled by length: tokens fall into strata (encoding, length class). Within a stratum,
Benjamini-Hochberg at level :data:`ALPHA` rejects the tokens that aren't random. The corpus tells how ordinary words
look (their index of coincidence), and so how probably such a word of that length passes the tests. A token that survives
is reported as a span of kind ``random`` only if that probability at its own length (tests at level ALPHA, however many
tokens there are) is at most ALPHA, and so is the share of words among its stratum's survivors that the rejected ones let
expect: short tokens of small alphabets can't be told from words and are left alone.

The strata table is bounded: encodings x lengths up to :data:`LONGEST` x :data:`BINS` rows, whatever the size of the corpus. Null and
empty texts have no spans; repeated rows are scanned one by one (and count each in the strata); an empty table gives
an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm import spans as sp
from shale.llm.common import stored, table, whole_text

KINDS = ("assign", "access", "hex", "random")
PATTERNS = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    r"AKIA[A-Z0-9]{12,}",
    r"(?<![0-9a-f])[0-9a-f]{32,}",
)
#: Of an assign match, all but the value.
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
MIN_VALUE = 8

#: Of "name=value" the value is a token of its own.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}=*"
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (name, alphabet) from small to large; the first that holds a token is its encoding. Digits alone are no encoding.
ENCODINGS = (
    ("hex", DIGIT + LOWER[:6]), ("HEX", DIGIT + UPPER[:6]), ("lower", LOWER), ("upper", UPPER), ("lower36", DIGIT + LOWER), ("upper36", DIGIT + UPPER),
    ("letters", LOWER + UPPER), ("base62", DIGIT + LOWER + UPPER), ("base64", DIGIT + LOWER + UPPER + "+/"), ("base64url", DIGIT + LOWER + UPPER + "-_"),
    ("mixed", DIGIT + LOWER + UPPER + "+/-_"),
)
WORDLIKE = tuple(i for i, (name, _) in enumerate(ENCODINGS) if name in ("lower", "upper", "letters"))
ALPHA, BINS, PER_DECADE = 0.05, 80, 4
#: Tokens above this length are judged as if they had it (the strata table stays bounded).
LONGEST = 1024
#: Words differ; a word may lie this share closer to randomness than the corpus' mean.
MARGIN = 0.5
#: Index of coincidence of ordinary words where the corpus has none.
COINCIDENCE = 0.065


def _upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z) by the rational approximation of Abramowitz and Stegun 7.1.26."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def _tested(tokens: Column) -> Column:
    """tokens (spans) as struct<s, e, v, k, enc, n, same, p>: encoding, tested length, sum of c * (c - 1), p-value."""

    def core(x: Column) -> Column:
        """Without padding; a capitalised word counts as lower case."""
        bare = F.regexp_replace(x["v"], "=+$", "")
        return F.when(bare.rlike(r"\A[A-Z][a-z]+\z"), F.lower(bare)).otherwise(bare)

    keep = lambda x, **more: F.struct(*[x[k].alias(k) for k in ("s", "e", "v", "k")], *[v.alias(k) for k, v in more.items()])

    def encoding(x: Column) -> Column:
        out = F.when(x.rlike(r"\A[0-9]*\z"), F.lit(-1))
        for i, (_, alphabet) in enumerate(ENCODINGS):
            out = out.when(x.rlike(r"\A[" + alphabet.replace("-", r"\-") + r"]+\z"), F.lit(i))
        return out.otherwise(F.lit(-1))

    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    step = F.transform(tokens, lambda x: keep(x, core=core(x)))
    step = F.transform(step, lambda x: keep(x, core=x["core"], enc=encoding(x["core"]), n=F.length(x["core"])))
    step = F.filter(step, lambda x: (x["enc"] >= 0) & (x["n"] >= 16))
    step = F.transform(step, lambda x: keep(x, enc=x["enc"], n=x["n"], core=x["core"], a=F.length(F.get(alphabets, x["enc"])), val=F.transform(F.split(x["core"], F.lit("")), lambda c: F.call_function("instr", F.get(alphabets, x["enc"]), c) - 1)))

    def sums(x: Column) -> Column:
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, i: acc + f(i))
        counts = F.transform(F.array_distinct(x["val"]), lambda c: F.size(F.filter(x["val"], lambda y: y == c)))
        mean = total(x["val"], lambda i: i) / x["n"]
        high = total(x["val"], lambda i: F.when(2 * i >= x["a"], 1.0).otherwise(0.0))
        places = F.sequence(F.lit(1), x["n"] - 1)
        at = lambda i: F.get(x["val"], i)
        changes = total(places, lambda i: F.when((2 * at(i) >= x["a"]) != (2 * at(i - 1) >= x["a"]), 1.0).otherwise(0.0))
        lagged = total(places, lambda i: at(i) * at(i - 1))
        return keep(x, enc=x["enc"], n=x["n"], a=x["a"], squares=total(counts, lambda c: c * c), mean=mean, high=high, runs=changes + 1, lagged=lagged, power=total(x["val"], lambda i: i * i), first=at(F.lit(0)), last=at(x["n"] - 1))

    step = F.transform(step, sums)

    def tests(x: Column) -> Column:
        n, df = x["n"].cast("double"), (x["a"] - 1).cast("double")
        chi = x["a"] * x["squares"] / n - n
        z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = x["high"] * (n - x["high"])
        mean_runs = 1 + 2 * both / n
        var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
        z_runs = F.when(var_runs > 0, (x["runs"] - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))
        spread = x["power"] - n * x["mean"] * x["mean"]
        along = x["lagged"] - x["mean"] * (2 * n * x["mean"] - x["first"] - x["last"]) + (n - 1) * x["mean"] * x["mean"]
        z_serial = F.when(spread > 0, (along / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        return keep(x, enc=x["enc"], n=x["n"], same=x["squares"] - n, z1=z_chi, z2=z_runs, z3=z_serial)

    step = F.transform(step, tests)
    tail = lambda p: F.greatest(p, F.lit(1e-30))
    step = F.transform(step, lambda x: keep(x, enc=x["enc"], n=x["n"], same=x["same"], h=-(F.ln(tail(_upper_tail(x["z1"]))) + F.ln(tail(2 * _upper_tail(F.abs(x["z2"])))) + F.ln(tail(2 * _upper_tail(F.abs(x["z3"])))))))
    return F.transform(step, lambda x: keep(x, enc=x["enc"], n=x["n"], same=x["same"], p=F.exp(-x["h"]) * (1 + x["h"] + x["h"] * x["h"] / 2)))


def length_class(n: Column) -> Column:
    """Two classes to a doubling of the length."""
    return F.floor(2 * F.log2(n.cast("double"))).cast("int")


def p_bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-PER_DECADE * F.log10(F.greatest(p, F.lit(1e-30))))).cast("int")


def scan(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and its columns ``_base`` (spans) and ``_tokens`` (tested tokens)."""
    t = whole_text("text")
    step = docs.withColumn("_t", t)
    for i, pattern in enumerate(PATTERNS):
        step = step.withColumn(f"_f{i}", sp.found(F.col("_t"), pattern))
    step = step.withColumn("_f9", sp.found(F.col("_t"), TOKEN))
    parts = [sp.located(F.col("_t"), F.col(f"_f{i}"), p, i) for i, p in enumerate(PATTERNS)]
    parts[0] = F.filter(parts[0], lambda x: F.length(F.regexp_replace(x["v"], ASSIGN_HEAD, "")) >= MIN_VALUE)
    step = step.withColumn("_base", sp.in_order(*parts)).withColumn("_more", sp.located(F.col("_t"), F.col("_f9"), TOKEN, 3))
    step = step.withColumn("_more", sp.apart(F.col("_base"), F.col("_more")))
    none = F.array().cast("array<struct<s:int,e:int,v:string,k:int,enc:int,n:int,same:double,p:double>>")
    step = step.withColumn("_tokens", F.when(F.size("_more") > 0, _tested(F.col("_more"))).otherwise(none))
    return step.drop("_t", "_more", "_f9", *[f"_f{i}" for i in range(len(PATTERNS))])


def thresholds(scanned: DataFrame) -> dict[tuple[int, ...], float]:
    """By stratum that may report tokens: the p-value above which a token counts as random.

    A stratum with tokens too short to be told from words has a third number in its key, the least length it reports.
    """
    tokens = scanned.select(F.explode("_tokens").alias("x")).select("x.*")
    own = F.least(F.col("n"), F.lit(LONGEST)).alias("own")
    rows = tokens.groupBy("enc", length_class(F.col("n")).alias("len"), p_bin(F.col("p")).alias("bin"), own).agg(F.count("*").alias("c"), F.sum("same").alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.min("n").alias("n")).collect()
    return decide([r.asDict() for r in rows])


def decide(rows: list[dict]) -> dict[tuple[int, ...], float]:
    words = [r for r in rows if r["enc"] in WORDLIKE]
    coincidence = sum(r["same"] for r in words) / sum(r["pairs"] for r in words) if words else COINCIDENCE
    strata = defaultdict(list)
    for r in rows:
        strata[r["enc"], r["len"]].append(r)

    def passing(enc: int, n: int, level: float) -> float:
        """A word's chance to pass: its chi-squared exceeds the mean by n * (A * coincidence - 1)."""
        a = len(ENCODINGS[enc][1])
        shift = MARGIN * n * (a * coincidence - 1) / math.sqrt(2 * (a - 1)) if enc > 1 else MARGIN * n
        return 0.5 * math.erfc((shift - _normal_quantile(1 - level)) / math.sqrt(2))

    out = {}
    for (enc, length), own in strata.items():
        counts = defaultdict(int)
        for r in own:
            counts[r["bin"]] += r["c"]
        total, seen, cut = sum(counts.values()), 0, 0.0
        for bin_ in sorted(counts, reverse=True):  # from the least p-value
            seen += counts[bin_]
            edge = 10 ** (-bin_ / PER_DECADE)
            if edge * total <= ALPHA * seen:
                cut = max(cut, edge)
        rejects = lambda r: 10 ** (-r["bin"] / PER_DECADE) <= cut  # noqa: B023, E731
        # Whether words can be told at a length doesn't depend on how many tokens there are.
        able = [r for r in own if passing(enc, r["n"], ALPHA) <= ALPHA]
        # The words that are left follow from those rejected: none rejected, none left.
        level = max(cut, ALPHA * sum(r["c"] for r in own if rejects(r)) / total)
        left = 0.0
        for r in filter(rejects, able):
            q = passing(enc, r["n"], level)
            left += r["c"] * q / max(1 - q, 1e-9)
        if able and left <= ALPHA * sum(r["c"] for r in able if not rejects(r)):
            out[(enc, length) if len(able) == len(own) else (enc, length, min(r["n"] for r in able))] = cut
    return out


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12))


def with_random(scanned: DataFrame, cuts: dict[tuple[int, ...], float]) -> DataFrame:
    """scanned with ``_spans``: base spans and those of random tokens."""
    passes = lambda x: F.lit(False)
    if cuts:
        # At most one entry for each stratum.
        entry = lambda key, cut: (F.lit(key[0] * 1000 + key[1]), F.struct(F.lit(float(cut)).alias("cut"), F.lit(key[2] if len(key) > 2 else 0).alias("least")))
        by = F.create_map(*[v for key, cut in sorted(cuts.items()) for v in entry(key, cut)])
        own = lambda x: F.try_element_at(by, x["enc"] * 1000 + length_class(x["n"]))
        passes = lambda x: F.coalesce((10 ** (-p_bin(x["p"]) / F.lit(float(PER_DECADE))) > own(x)["cut"]) & (x["n"] >= own(x)["least"]), F.lit(False))
    more = F.transform(F.filter("_tokens", passes), lambda x: F.struct(*[x[k].alias(k) for k in ("s", "e", "v", "k")]))
    return scanned.withColumn("_spans", F.when(F.size("_tokens") > 0, sp.in_order(F.col("_base"), more)).otherwise(F.col("_base")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "op1")
    out = with_random(found, thresholds(found))
    base = sp.written(F.col("_base"), KINDS)
    return out.select(
        "doc_id",
        *[sp.count_of(F.col("_base"), i).alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(base, 256).alias("base_sha256"),
        sp.written(F.col("_spans"), KINDS).alias("spans"),
        F.filter("_spans", lambda x: x["k"] == 3)["v"].cast("array<string>").alias("random_tokens"),
    )
