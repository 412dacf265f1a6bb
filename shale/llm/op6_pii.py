"""Personal data: fixed patterns, and terms that give a protected entity away. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value of one is a protected
entity. Terms are words of three letters or more, lower-cased. The corpus tells how strongly a term reveals an entity:

* n_et: distinct texts with the entity and the term, anywhere; copies of a text count once, so that copying alone makes no
  term suspicious and hides none,
* n_e: distinct texts with the entity, n_t: distinct texts with the term, N: distinct texts,
* disclosure = log2(n_et * N / (n_e * n_t)) / log2(N / n_e), the share of the entity's information that the term carries.

A term with a disclosure of :data:`GENERALISE` or more, seen in :data:`SUPPORT` texts at least, is generalised at every place
in documents with that entity, and from :data:`REMOVE` on it is removed. All counts cover all documents.

Null texts have no spans and stay null, empty texts stay empty; repeated rows are treated one by one; an empty table
gives an empty result. ``sanitised`` keeps all other columns as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm import spans as sp
from shale.llm.common import count, identified, kept, stored, table, whole_text

KINDS = ("email", "ip", "card", "phone", "term", "term")
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", "")
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
TERM = r"(?<![\p{L}\p{N}_])\p{L}{3,}+(?![\p{N}_])"
#: Texts with both that a disclosing term needs.
SUPPORT = 2
GENERALISE, REMOVE = 0.9, 0.99


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: int) -> Callable[[Column], Column]:
    if kind == 1:
        return lambda x: x["v"].rlike(r"\A(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|\z)){4}")
    if kind == 2:
        return lambda x: F.length(_digits(x["v"])).between(12, 19) & _luhn(_digits(x["v"]))
    if kind == 3:
        return lambda x: F.length(_digits(x["v"])).between(9, 15)
    return lambda x: F.lit(True)


def _value(x: Column) -> Column:
    """The entity behind a span, however it is written."""
    return F.when(x["k"] == 0, F.lower(x["v"])).when(x["k"] == 1, x["v"]).otherwise(_digits(x["v"]))


def _words(t: Column, base: Column) -> Column:
    """The distinct terms outside the base spans, lower-cased."""
    # A span leaves what its ends are to a word beside it: a character of words, or none.
    wordlike = lambda c: c.rlike(r"[\p{L}\p{N}_]").cast("int")
    ends = lambda x: (2 * wordlike(F.substr(x["v"], F.lit(1), F.lit(1))) + wordlike(F.substr(x["v"], F.length(x["v"]), F.lit(1)))).cast("int")
    marks = F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), ends(x).alias("k")))
    masked = sp.redacted(t, marks, F.array(*[F.lit(m) for m in ("  ", " _", "_ ", "__")]))
    return F.array_distinct(F.transform(sp.found(masked, TERM), lambda x: F.lower(x)))


def _places(t: Column, base: Column, kinds: Column) -> Column:
    """The spans of all terms of kinds (a map from term to kind) outside the base spans."""
    terms = F.transform(sp.let(sp.found(t, TERM), lambda own: sp.located(t, own, TERM, 4)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["v"]).alias("v")))
    kind = lambda x: F.try_element_at(kinds, x["v"])
    own = F.transform(F.filter(terms, lambda x: kind(x).isNotNull()), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), kind(x).alias("k")))
    return sp.apart(base, own)


def scan(docs: DataFrame) -> DataFrame:
    """docs (with a column text) and ``_rid`` (unique; docs' own if it has one), ``_base`` (spans), ``_ents``, ``_text_id``, ``_own``.

    ``_own``: the text of rows with spans.
    """
    step = docs.withColumn("_t", whole_text("text"))
    for i, pattern in enumerate(PATTERNS):
        step = step.withColumn(f"_f{i}", sp.found(F.col("_t"), pattern))
    parts = [F.filter(sp.located(F.col("_t"), F.col(f"_f{i}"), p, i), _valid(i)) for i, p in enumerate(PATTERNS)]
    step = step.withColumn("_base", sp.in_order(*parts))
    has = F.size("_base") > 0
    step = step.withColumn("_own", F.when(has, F.col("_t")))
    step = step.withColumn("_text_id", F.when(has, F.xxhash64("_t"))).withColumn("_ents", F.array_distinct(F.transform("_base", lambda x: F.xxhash64(x["k"], _value(x)))))
    return step.withColumn("_mark" if "_rid" in docs.columns else "_rid", F.monotonically_increasing_id()).drop("_t", *[f"_f{i}" for i in range(len(PATTERNS))])


def _classes(members: DataFrame, one: str, name: str, *more: str) -> DataFrame:
    """(one, name, n): equal names for those of members (_text_id, one) that stand in just the same texts, n of them, and agree in more."""
    marks = [F.bit_xor(F.xxhash64("_text_id", F.lit(i))).alias(f"_x{i}") for i in (1, 2)]
    own = members.groupBy(one, *more).agg(F.count("*").alias("n"), *marks)
    return own.select(one, *more, F.xxhash64("n", "_x1", "_x2", *more).alias(name), "n")


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(_text_id, term, k): the terms to treat in each text, and how; found: stored result of scan() on the documents texts, rows without spans apart.

    Entities of just the same texts disclose alike, and so do such terms: they are joined by classes, so that a page of many
    addresses and words doesn't make a row for each two of them.
    """
    text_id = F.xxhash64(whole_text("text"))
    n = count(texts.select(text_id.alias("_text_id")).distinct())
    own = found.where(F.col("_own").isNotNull())
    members = kept(own.select("_text_id", F.explode("_ents").alias("ent")).distinct())
    entities = _classes(members, "ent", "ents").where((F.col("n") >= SUPPORT) & (F.col("n") < n))
    members = kept(members.join(entities, "ent").select("_text_id", "ents", F.col("n").alias("n_e")).distinct())
    judged = own.join(members.select("_text_id").distinct(), "_text_id", "left_semi").select("_text_id", F.explode(_words(F.col("_own"), F.col("_base"))).alias("term")).distinct()
    judged = stored(judged, "op6-terms")
    words = F.array_distinct(F.transform(sp.found(F.lower(whole_text("text")), TERM), lambda x: F.xxhash64(x)))
    # One row for each distinct text; counted before the join: the partial sums are one row for each term and task.
    once = texts.select(text_id.alias("_text_id"), words.alias("_words")).dropDuplicates(["_text_id"])
    all_terms = once.select(F.explode("_words").alias("term_id")).groupBy("term_id").agg(F.count("*").alias("n_t"))
    # A term that discloses is in SUPPORT of the entity's texts at least.
    several = _classes(judged, "term", "terms").where(F.col("n") >= SUPPORT).withColumn("term_id", F.xxhash64("term")).join(all_terms, "term_id")
    terms = kept(several.select("term", F.xxhash64("terms", "n_t").alias("terms"), "n_t"))
    where = kept(judged.join(terms, "term").select("_text_id", "terms", "n_t").distinct())
    joint = members.join(where, "_text_id").groupBy("ents", "n_e", "terms", "n_t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= SUPPORT)
    information = F.log2(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * F.lit(float(n)) / (F.col("n_e").cast("double") * F.col("n_t")))
    kind = F.when(F.col("disclosure") >= REMOVE, F.lit(5)).otherwise(F.lit(4))
    pairs = kept(joint.select("ents", "terms", (pmi / information).alias("disclosure")).where(F.col("disclosure") >= GENERALISE).select("ents", "terms", kind.alias("k")))
    hits = members.join(pairs, "ents").join(where.select("_text_id", "terms"), ["_text_id", "terms"]).groupBy("_text_id", "terms").agg(F.max("k").alias("k"))
    return hits.join(terms.select("terms", "term"), "terms").select("_text_id", "term", "k")


def with_terms(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found with ``_spans``: base spans and disclosing terms, wherever they stand in a document with their entity."""
    own = disclosing(found, texts).groupBy("_text_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "k"))).alias("_kinds"))
    spans = sp.in_order(F.col("_base"), _places(F.col("_own"), F.col("_base"), F.col("_kinds")))
    return found.join(own, "_text_id", "left").withColumn("_spans", F.when(F.col("_kinds").isNull(), F.col("_base")).otherwise(spans)).drop("_kinds")


def sanitised(docs: DataFrame, from_files: bool = False) -> DataFrame:
    """docs with the personal data in text replaced by labels and disclosing terms generalised or removed.

    from_files: see :func:`~shale.llm.common.identified`.
    """
    rows = identified(docs, from_files, "op6")
    # The mark keeps the filter above the patterns: pushed below them, it would look for each one twice.
    found = stored(scan(rows.select("_rid", "text")).where((F.size("_base") > 0) & (F.col("_mark") >= 0)).drop("text", "_mark"), "op6")
    treated = rows.select("_rid", "_row", "text").join(with_terms(found, docs).select("_rid", "_spans"), "_rid", "left")
    text = F.when(F.size("_spans") > 0, sp.redacted(F.col("text"), F.col("_spans"), F.array(*[F.lit(x) for x in LABELS]))).otherwise(F.col("text"))
    return treated.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = stored(scan(docs).drop("text"), "op6")
    base = sp.written(F.col("_base"), KINDS)
    return with_terms(found, docs).select(
        "doc_id",
        *[sp.count_of(F.col("_base"), i).alias(f"n_{KINDS[i]}") for i in range(4)],
        F.sha2(base, 256).alias("base_sha256"),
        sp.written(F.col("_spans"), KINDS).alias("spans"),
    )
