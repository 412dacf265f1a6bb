"""Places of pattern matches, with Column functions alone.

A span is struct<s, e, v, k>: start and end (exclusive) in code points, the text, and the number of its kind. Matches
are leftmost and non-overlapping, as java.util.regex finds them; the pieces between them give their places.

All functions take about linear time in the text and the number of spans: running sums and maxima go block by block (an
aggregate that gathers an array would copy it in each step), and long texts are read in blocks, since a place in a text
is found by walking there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,v:string,k:int>"
NONE = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(NONE)


def found(text: Column, pattern: str | Column) -> Column:
    """All matches, as text."""
    return F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))


#: Elements and code points of a block; spans up to which a text is cut as it is.
BLOCK, TEXT_BLOCK, FEW = 128, 1024, 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each of the ints (one at least), fold over 0 and the elements up to it: those of the blocks before, then those of its own."""
    total = lambda v, first, n, start: F.aggregate(F.slice(v, first + 1, n), start, fold)
    block = lambda i: F.floor(i / BLOCK).cast("int")

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), block(F.size(v) - 1)), lambda k: total(v, k * BLOCK, F.lit(BLOCK), F.lit(0)))
        before = lambda own: F.transform(own, lambda _, k: total(own, F.lit(0), k, F.lit(0)))
        each = lambda done: F.transform(v, lambda _, i: total(v, i - i % BLOCK, i % BLOCK + 1, F.get(done, block(i))))
        return let(let(blocks, before), each)

    return let(values, of)


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def _reach(spans: Column) -> Column:
    """The furthest end of the spans up to each."""
    return running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b))


def located(text: Column, matches: Column, pattern: str | Column, kind: int) -> Column:
    """The spans of matches = found(text, pattern), a column; the pattern matches no empty text."""
    # A match starts behind the pieces before it and the matches between these.
    steps = F.transform(F.split(text, pattern, -1), lambda g, i: F.length(g) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(F.lit(0)))
    span = lambda at, v: F.struct(at.alias("s"), (at + F.length(v)).alias("e"), v.alias("v"), F.lit(kind).alias("k"))
    spans = let(_sums(steps), lambda at: F.transform(matches, lambda v, i: span(F.get(at, i), v)))
    return F.when(F.size(matches) > 0, spans).otherwise(no_spans())


def in_order(*spans: Column) -> Column:
    """All spans by start, then kind."""
    joined = F.concat(*spans)
    keyed = F.transform(joined, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    ordered = F.transform(F.sort_array(keyed), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["k"].alias("k")))
    return F.when(F.size(joined) > 0, ordered).otherwise(no_spans())


def written(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("long")


def apart(base: Column, more: Column) -> Column:
    """The spans of more (in order, none overlapping another) that overlap none of base."""

    def kept(b: Column, m: Column) -> Column:
        # In the order of base starts and of ends in more, a span follows just the base spans that start before its end.
        mark = lambda at, own, e, i: F.struct(at.alias("at"), F.lit(own).alias("own"), e.alias("e"), i.alias("i"))
        ends = F.transform(m, lambda x, i: mark(x["e"], 0, F.lit(0), i))
        marks = F.sort_array(F.concat(ends, F.transform(b, lambda x: mark(x["s"], 1, x["e"], F.lit(-1)))))
        clear = lambda y, reach, j: (y["own"] == 0) & (F.get(reach, j) <= F.get(m, y["i"])["s"])
        own = let(marks, lambda y: let(_reach(y), lambda reach: F.filter(y, lambda x, j: clear(x, reach, j))))
        return F.transform(own, lambda y: F.get(m, y["i"]))

    full = let(base, lambda b: let(more, lambda m: kept(b, m)))
    return F.when((F.size(base) > 0) & (F.size(more) > 0), full).otherwise(more)


def _pieces(text: Column) -> Callable[[Column, Column], Column]:
    """From text's blocks of TEXT_BLOCK code points, what stands from one place up to another."""

    def piece(first: Column, end: Column) -> Column:
        def cut(a: Column, z: Column) -> Column:
            block = lambda k: F.get(text, k)
            within = lambda i: i % TEXT_BLOCK + 1
            one = F.substr(block(a), within(first), end - first)
            inside = F.array_join(F.slice(text, a + 2, F.greatest(z - a - 1, F.lit(0))), "")
            return F.when(a == z, one).otherwise(F.concat(F.substr(block(a), within(first), F.lit(TEXT_BLOCK)), inside, F.substr(block(z), F.lit(1), within(end - 1))))

        at = lambda i: F.floor(i / TEXT_BLOCK).cast("int")
        return F.when(first >= end, F.lit("")).otherwise(let(at(first), lambda a: let(at(end - 1), lambda z: cut(a, z))))

    return piece


def redacted(text: Column, spans: Column, labels: Column) -> Column:
    """text with each span's place taken by the label of its kind (labels: array by kind); spans that overlap share the first one's label."""

    def joined(x: Column, reach: Column, piece: Callable[[Column, Column], Column]) -> Column:
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
        part = lambda y, i: F.when(y["s"] >= before(i), F.concat(piece(before(i), y["s"]), F.get(labels, y["k"]))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(x, part), ""), piece(F.get(reach, F.size(x) - 1), F.length(text)))

    def done(x: Column) -> Column:
        whole = lambda first, end: F.substr(text, first + 1, F.greatest(end - first, F.lit(0)))
        blocks = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % TEXT_BLOCK), F.lit(0))
        few = lambda reach: joined(x, reach, whole)
        many = lambda reach: let(blocks, lambda t: joined(x, reach, _pieces(t)))
        return let(_reach(x), lambda reach: F.when(F.size(x) <= FEW, few(reach)).otherwise(many(reach)))

    return F.when(F.size(spans) > 0, let(spans, done)).otherwise(text)
