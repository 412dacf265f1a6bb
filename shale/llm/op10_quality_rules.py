"""Quality rules: a threshold table compiled into one projection, without user functions.

Measures of a text (null counts as empty; words are runs of anything but the six ASCII blanks):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (characters of ``#*$%&|<>``),
* ``n_dup_lines``: lines with a word that equal an earlier line,
* ``n_repeat_words``: words inside 3-word windows that occur twice or more, first occurrence included,
* ``n_stop_words``, ``n_alpha_words``, ``n_lines``, ``n_bullet_lines``, ``n_ellipsis_lines``.

A document fails the base rules if it has fewer than 50 words or over half of its words repeat. Otherwise every row
of :data:`RULES` must hold. Ratios with a zero denominator count as 0. An empty table gives an empty result; repeated
rows are judged one by one; all other columns of the input pass through :func:`filter_documents` untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shale.llm.common import packed, table, whole_text

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Frequent function words of the corpus languages, lower case.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be at by this from are or an have not but they which you were his her "
    "de la le et les des en un une du que dans est pour qui sur par au ne se pas plus avec "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es nach wie aus bei "
    "el los las del y una su al lo como con para por no si sus"
).split()

#: (measure, per measure, least, most): least <= measure / per <= most; None: unbounded.
RULES = (
    ("n_words", None, 50, 1_000_000),
    ("word_chars", "n_words", 2.0, 15.0),
    ("n_symbols", "n_words", None, 0.1),
    ("n_stop_words", "n_words", 0.02, None),
    ("n_alpha_words", "n_words", 0.7, None),
    ("n_dup_lines", "n_lines", None, 0.5),
    ("n_bullet_lines", "n_lines", None, 0.9),
    ("n_ellipsis_lines", "n_lines", None, 0.3),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_alpha_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def _repeat_words(words: Column, windows: Column, ordered: Column) -> Column:
    """ordered: (hash, place) of all windows, sorted; equal windows are neighbours there."""
    last = F.size(ordered) - 1

    def twice(x: Column, k: Column) -> Column:
        before = (k > 0) & (ordered[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])
        after = (k < last) & (ordered[F.least(k + 1, last)]["h"] == x["h"])
        return before | after

    places = F.transform(F.filter(ordered, twice), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return F.when(F.size(ordered) == 0, F.lit(0)).otherwise(F.size(F.array_distinct(F.flatten(places))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``_q`` of the :data:`MEASURES`."""
    t = whole_text(text)
    step = docs.withColumn("_qw", F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).withColumn(
        "_ql", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    )
    w, lines, n = F.col("_qw"), F.col("_ql"), F.size("_qw")
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(3)) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    )
    step = step.withColumn("_qh", windows)
    h = F.col("_qh")
    # Texts without a repeated window skip the sort.
    ordered = F.when(F.size(F.array_distinct(h)) == F.size(h), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    )
    step = step.withColumn("_qo", ordered)
    q = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(w, h, F.col("_qo")),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))),
        "n_alpha_words": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
    }
    return step.withColumn("_q", F.struct(*[q[k].cast("long").alias(k) for k in MEASURES])).drop("_qw", "_ql", "_qh", "_qo")


def compile_rules(rules=RULES, at: str = "_q") -> Column:
    """The threshold table as one boolean expression."""
    m = lambda k: F.col(f"{at}.{k}")

    def holds(measure: str, per: str | None, least, most) -> Column:
        value = m(measure).cast("double") if per is None else F.when(m(per) == 0, F.lit(0.0)).otherwise(m(measure) / m(per))
        tests = ([value >= least] if least is not None else []) + ([value <= most] if most is not None else [])
        return reduce(Column.__and__, tests)

    return reduce(Column.__and__, [holds(*r) for r in rules])


def base_failed(at: str = "_q") -> Column:
    n, r = F.col(f"{at}.n_words"), F.col(f"{at}.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with docs' own columns."""
    # The mark keeps the filter above the measures: pushed below them, it would compute each one again wherever it is used.
    judged = measure(packed(docs)).withColumn("_kept", ~base_failed() & compile_rules()).withColumn("_mark", F.monotonically_increasing_id())
    return judged.where(F.col("_kept") & (F.col("_mark") >= 0)).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = base_failed()
    return docs.select(
        "doc_id",
        *[F.col(f"_q.{k}").alias(k) for k in MEASURES],
        failed.alias("base_failed"),
        (~failed & compile_rules()).alias("kept"),
    )


def _sql_rules() -> str:
    out = []
    for name, per, least, most in RULES:
        value = f"{name}::double" if per is None else f"(case when {per} = 0 then 0 else {name} / {per} end)"
        out += [f"{value} >= {least}"] * (least is not None) + [f"{value} <= {most}"] * (most is not None)
    return " and ".join(out)


def measures_sql(source: str) -> str:
    """DuckDB: the measures of the rows (rid, text) of source, with rid unique."""
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    return f"""
    with w as (select rid, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws,
                      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from {source}),
    p as (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3),
    g as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) as c from p),
    r as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from g where c > 1) group by rid)
    select w.rid, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
           coalesce(r.n, 0)::bigint as n_repeat_words, len(list_filter(ws, lambda x: lower(x) in ({stop})))::bigint as n_stop_words,
           len(list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}')))::bigint as n_alpha_words, len(ls)::bigint as n_lines,
           len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*\\x{{2022}}]')))::bigint as n_bullet_lines,
           len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})\\s*$')))::bigint as n_ellipsis_lines
    from w left join r using (rid)"""


FAILED_SQL = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"

ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, text from documents), m as ({measures_sql('d')})
select d.doc_id, {', '.join('m.' + k for k in MEASURES)}, {FAILED_SQL} as base_failed, (not {FAILED_SQL} and {_sql_rules()}) as kept
from d join m using (rid)"""


def kept_sql(source: str) -> str:
    """DuckDB: the rids of source that filter_documents keeps."""
    return f"select rid from ({measures_sql(source)}) where not {FAILED_SQL} and {_sql_rules()}"
