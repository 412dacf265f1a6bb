"""Column functions over listing texts. Null or empty input gives null, unless stated."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shale.functions.batches import slices

KST = "Asia/Seoul"
#: Wording that means "no price given". Fixed values.
NO_PRICE = "협의|문의|상담"
#: Price units, tried in this order against the whole text. Fixed values.
UNITS = (("억", 100_000_000), ("만원", 10_000), ("천원", 1_000))


def filled(x: Column) -> Column:
    """Null where x is empty."""
    return F.nullif(x, F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[filled(c) for c in columns])


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """Unicode white space collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s ]+", " "))


def redact(x: Column) -> Column:
    """Credentials in URLs blanked."""
    return F.regexp_replace(x, r"(\w[\w+.-]*://)[^\s/:@]+:[^\s/@]+@", "$1***:***@")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def price_krw(x: Column) -> Column:
    """Whole won: the first number times the unit, cut off; null without a number or where the price is on request."""
    text = clean_text(x)
    number = F.replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.lit(1.0)
    for word, factor in reversed(UNITS):
        unit = F.when(text.contains(word), F.lit(float(factor))).otherwise(unit)
    return F.when(~text.rlike(NO_PRICE), (number * unit).try_cast("bigint"))


def model_key(x: Column) -> Column:
    """Upper case, with only digits, Latin capitals and Hangul left."""
    return F.regexp_replace(F.upper(x), "[^0-9A-Z가-힣]", "")


def nullable_int(x: Column) -> Column:
    """First run of digits, commas removed."""
    return filled(F.regexp_extract(F.replace(x.cast("string"), F.lit(","), F.lit("")), r"(\d+)", 1)).try_cast("int")


def year_month(x: Column) -> Column:
    """yyyymm: the first year of 19xx or 20xx and the first one or two digits after it (default 1); null if that is no month."""
    rest = F.regexp_extract(x, r"(?s)(?:19|20)\d{2}(.*)\z", 1)
    year = filled(F.regexp_extract(x, r"((?:19|20)\d{2})", 1)).cast("int")
    month = F.coalesce(filled(F.regexp_extract(rest, r"(\d{1,2})", 1)).cast("int"), F.lit(1))
    return F.when(month.between(1, 12), year * 100 + month)


def year_month_param(value: str | None) -> int | None:
    """yyyymm of a parameter yyyy-mm; anything else switches the filter off."""
    import re

    found = re.fullmatch(r"((?:19|20)\d{2})-(\d{2})", value or "")
    return int(found[1]) * 100 + int(found[2]) if found and 1 <= int(found[2]) <= 12 else None


HOURS = r"(?i)(\d{1,3}(?:[, ]?\d{3})+|\d{3,6})\s*(?:시간|hr|hrs|hour|hours|h\b)"


def hours(x: Column) -> Column:
    """The first number of operating hours from 100 up."""
    numbers = F.transform(F.regexp_extract_all(x, F.lit(HOURS), F.lit(1)), lambda n: digits(n).try_cast("bigint"))
    return F.get(F.filter(numbers, lambda n: n >= 100), F.lit(0))


def operating_hours(raw_json: Column, description: Column, listing_name: Column, model_name: Column) -> Column:
    """Hours from the details (keys about operation first, in input order), else from the texts.

    Broken JSON is searched as text.
    """
    valid = F.try_parse_json(raw_json).isNotNull()
    entries = F.map_entries(F.from_json(F.get_json_object(raw_json, "$.detail"), "map<string,string>"))
    first = F.filter(entries, lambda e: e["key"].rlike("가동|운행|사용|시간"))
    found = F.filter(F.transform(F.concat(first, entries), lambda e: hours(e["value"])), lambda n: n.isNotNull())
    detail = F.when(valid, F.get(found, F.lit(0))).otherwise(hours(raw_json))
    return F.coalesce(detail, hours(description), hours(listing_name), hours(model_name))


def normalize_phone(x: Column) -> Column:
    """Digits, with the country code 82 turned into 0."""
    d = digits(x)
    return F.when(d.startswith("82") & (F.length(d) >= 11), F.concat(F.lit("0"), F.substr(d, F.lit(3)))).otherwise(d)


def format_phone(x: Column) -> Column:
    """Dashed groups; '-' where there are no digits."""
    d = normalize_phone(F.coalesce(x, F.lit("")))
    part = lambda a, n=None: F.substr(d, F.lit(a), F.lit(n)) if n else F.substr(d, F.lit(a))
    dashed = lambda *sizes: F.concat_ws("-", part(1, sizes[0]), part(sizes[0] + 1, sizes[1]), part(sizes[0] + sizes[1] + 1))
    n = F.length(d)
    return (
        F.when(d.rlike(r"^01\d{9}$"), dashed(3, 4))
        .when(d.rlike(r"^01\d{8}$"), dashed(3, 3))
        .when(d.rlike(r"^0\d{9}$"), dashed(2, 4))
        .when(d.rlike(r"^0\d{8,10}$"), dashed(3, 4))
        .when(n > 0, d)
        .otherwise(F.lit("-"))
    )


PHONE = r"(?:\+?82[-.\s]*)?0?\d{1,2}[-.\s]*\d{3,4}[-.\s]*\d{4}"


def phones(x: Column) -> Column:
    """Distinct phone numbers in order of appearance; [] if there are none."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(PHONE), F.lit(0)), normalize_phone)
    return F.array_distinct(F.filter(found, lambda p: p.rlike(r"^0\d{8,10}$") & ~p.rlike("^0+$")))


def site_date(x: Column, now: Column) -> Column:
    """Wall-clock time in Korea. Texts with an offset are converted; month and day alone are of now's year.

    A day that doesn't exist gives null.
    """
    text = clean_text(x)

    def made(pattern: str, year=lambda y: y, order=(1, 2, 3, 4, 5, 6)) -> Column:
        part = lambda k: F.coalesce(filled(F.regexp_extract(text, pattern, order[k])).cast("int"), F.lit(0)) if order[k] else F.lit(0)
        y = year(part(0))
        return F.when(text.rlike(pattern), F.try_make_timestamp_ntz(y, part(1), part(2), part(3), part(4), part(5).cast("decimal(8,6)")))

    zoned = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*([Zz]|[+-]\d{2}:?\d{2})$"), F.convert_timezone(F.current_timezone(), F.lit(KST), text.try_cast("timestamp").cast("timestamp_ntz")))
    return F.coalesce(
        made(r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?:\.\d+)?)?$"),
        made(r"^(\d{4})\.(\d{1,2})\.(\d{1,2})(?: (\d{1,2}):(\d{1,2}):(\d{1,2}))?$"),
        made(r"^(\d{4})(\d{2})(\d{2})$", order=(1, 2, 3, 0, 0, 0)),
        made(r"^(\d{2})[./-](\d{1,2})[./-](\d{1,2})$", lambda y: y + 2000, (1, 2, 3, 0, 0, 0)),
        made(r"^(\d{1,2})[./-](\d{1,2})$", lambda y: F.year(now), (0, 1, 2, 0, 0, 0)),
        zoned,
    )


#: Names of crawl periods. Fixed values.
MODES = {
    "all": "all 전체 full",
    "1d": "1d 1day latest1day recent1day 최근1일 최1일 1일",
    "5d": "5d 5day 5days latest5days recent5days 최근5일 5일",
    "1m": "1m 1month month 30d 1달 한달 최근1달",
}
DAYS = {"1d": 1, "5d": 5, "1m": 30}


def normalize_mode(mode: str) -> str:
    """The period's short name; an unknown one stays as it is."""
    return next((k for k, names in MODES.items() if mode in names.split()), mode)


def in_period(posted: Column, mode: str, now: Column) -> Column:
    """Posted within the period; all rows without a known period."""
    days = DAYS.get(normalize_mode(mode))
    return F.lit(True) if days is None else F.coalesce(posted >= now - F.expr(f"INTERVAL {days} DAY"), F.lit(False))


def safe_name(x: Column) -> Column:
    """Runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, "[^0-9A-Za-z가-힣._-]+", "_"), "^_+|_+$", "")


def truncated(x: Column, limit: int = 8000) -> Column:
    """Code fences broken up, cut to the limit, with the original length added."""
    t = F.replace(x, F.lit("```"), F.lit("``​`"))
    note = F.concat(F.lit("\n\n... [truncated, original "), F.format_number(F.length(t), 0), F.lit(" chars]"))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substr(t, F.lit(1), F.lit(limit)), note))


def extension(content_type: Column) -> Column:
    low = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(low.contains("json"), "json").when(low.contains("html"), "html").when(low.contains("xml"), "xml").otherwise("txt")


def param_list(names: Column) -> Column:
    return F.when(F.size(names) > 0, F.array_join(F.transform(names, lambda n: F.concat(F.lit("`"), n, F.lit("`"))), ", ")).otherwise("미확인")


def format_price(value: Column, text: Column) -> Column:
    """Thousands separators; 0 and null fall back to the text, then '-'."""
    return F.when(value > 0, F.format_number(value, 0)).otherwise(F.coalesce(filled(text), F.lit("-")))


def excerpt(json: Column, schema: str) -> Column:
    """A JSON object of arrays, two elements of each kept, with the number of all."""
    items = F.from_json(json, schema)
    return F.transform_values(items, lambda k, v: F.struct(F.slice(v, 1, 2).alias("sample"), F.when(F.size(v) > 2, F.size(v)).alias("truncated_count")))


EXCERPT_LIST, EXCERPT_KEYS, EXCERPT_CHARS = 2, 20, 12_000


def _first(v: object) -> object:
    return v[:EXCERPT_LIST] if isinstance(v, list) else v


def _shortened(data: object) -> object:
    if not isinstance(data, dict):
        return _first(data)
    out = {}
    for k, v in data.items():
        out[k] = {n: _first(x) for n, x in list(v.items())[:EXCERPT_KEYS]} if isinstance(v, dict) else _first(v)
        if isinstance(v, list) and len(v) > EXCERPT_LIST:
            out[f"{k}__truncated_count"] = len(v)
    return out


#: Bytes of JSON that are read at a time.
EXCERPT_BYTES = 1 << 20
_EXCERPT = pa.struct([("text", pa.string()), ("language", pa.string())])


def _excerpts(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def one(text: str | None) -> dict[str, str | None]:
        if text is None:
            return {"text": None, "language": None}
        try:
            return {"text": json.dumps(_shortened(json.loads(text)), ensure_ascii=False, indent=2), "language": "json"}
        except (ValueError, RecursionError):
            return {"text": text, "language": "text"}

    for batch in texts:
        for own in slices(batch, EXCERPT_BYTES):
            yield pa.array([one(t) for t in own.to_pylist()], type=_EXCERPT)


def json_excerpt(text: Column) -> Column:
    """struct<text, language>: a JSON text, indented, with two elements of each list and the number of all beside those that were cut.

    Keys keep their order, which Spark's own JSON types don't. Of an object inside the first 20 keys stay, their lists cut to
    two; of a list as a whole two elements stay. A text that is no JSON stays as it is. All are cut to 12,000 characters.
    """
    x = F.arrow_udf(_excerpts, "struct<text:string,language:string>")(text)
    return F.struct(truncated(x["text"], EXCERPT_CHARS).alias("text"), x["language"].alias("language"))


def chunk_name(site: Column, stamp: Column, label: Column) -> Column:
    """Where a chunk of a site's records is written."""
    return F.concat(site, F.lit("/chunks/"), stamp, F.lit("_"), safe_name(label), F.lit(".json"))


def public_config(json: Column) -> Column:
    """Of a database configuration what may be shown: database, host, port; from its part 'mysql' or the whole."""
    part = lambda c: F.coalesce(F.get_json_object(json, f"$.mysql.{c}"), F.get_json_object(json, f"$.{c}"))
    return F.struct(*[part(c).alias(c) for c in ("database", "host", "port")])


def format_hours(value: Column) -> Column:
    return F.when(value != 0, F.concat(F.format_number(value, 0), F.lit("시간"))).otherwise("-")


def format_datetime(value: Column) -> Column:
    """To seconds, with a blank for the T."""
    return F.coalesce(filled(F.substr(F.replace(value.cast("string"), F.lit("T"), F.lit(" ")), F.lit(1), F.lit(19))), F.lit("-"))


#: Display names of task states. Fixed values.
STATES = (("running", "실행중"), ("pending", "대기"), ("done", "완료"))


def status_label(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, label in STATES:
        out = out.when(status == name, F.lit(label))
    return out.otherwise(F.coalesce(filled(status), F.lit("-")))


def epoch_millis(x: Column) -> Column:
    """Milliseconds of a time or its text; null if it is none."""
    return F.unix_millis(x.cast("string").try_cast("timestamp"))
