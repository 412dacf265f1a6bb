"""Hand-made cases of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.functions import urls
from shale.operators import listings as ls
from shale.operators import survey


def values(spark, inputs, f, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_price(spark):
    cases = {"8,500만원": 85_000_000, "1.15억": 114_999_999, "1억 5,000만원": 100_000_000, "5000만": 5000, "300천원": 300_000, "0원": 0, "가격협의 5000만원": None, "": None, ",": None, None: None, "abc": None, "9" * 40: None}
    assert values(spark, cases, tx.price_krw) == list(cases.values())


def test_site_date(spark):
    d = lambda *a: dt.datetime(*a)
    cases = {"2026-5-1": d(2026, 5, 1), "2026.05.01": d(2026, 5, 1), "2026.05.01 10:11": None, "2026.05.01 10:11:12": d(2026, 5, 1, 10, 11, 12), "26-05-01": d(2026, 5, 1), "05-01": d(2026, 5, 1), "20260501": d(2026, 5, 1), "abc": None, "2026-05-01T00:30:00Z": d(2026, 5, 1, 9, 30), "2026-05-01 7:05": d(2026, 5, 1, 7, 5), "2026-13-01": None, "13-40": None, None: None, "": None}
    assert values(spark, cases, lambda x: tx.site_date(x, F.lit("2026-05-02").cast("timestamp_ntz"))) == list(cases.values())


def test_year_month(spark):
    cases = {"2015년 3월": 201503, "2015": 201501, "2015년 36톤": None, "15년": None, None: None, "2015-00": None}
    assert values(spark, cases, tx.year_month) == list(cases.values())
    assert [tx.year_month_param(x) for x in ("2015-03", "2015-13", "2015", "", None)] == [201503, None, None, None, None]


def test_hours(spark):
    cases = {"1,200시간": 1200, "350hrs": 350, "24시간 상담": None, "99시간": None, "50 h 1200 Hours": 1200, None: None}
    assert values(spark, cases, tx.hours) == list(cases.values())
    rows = [('{"detail":{"memo":"900시간","가동시간":"1,500시간"}}', "x"), ("broken 345 hrs", "x"), (None, "777 hours"), ('{"detail":{}}', "none"), ('{"other":1}', "400h")]
    df = spark.createDataFrame(rows, "raw string, d string").select(tx.operating_hours(F.col("raw"), F.col("d"), F.lit(""), F.lit(None).cast("string")).alias("h"))
    assert [r.h for r in df.collect()] == [1500, 345, 777, None, 400]


def test_phones(spark):
    cases = {"010-0000-1234": ["01000001234"], "+82 1000001234": ["01000001234"], "1500-0000": [], "000-0000-0000": [], None: [], "02-123-4567 / 02 123 4567": ["021234567"]}
    assert values(spark, cases, tx.phones) == list(cases.values())
    shown = {"01000001234": "010-0000-1234", "0100001234": "010-000-1234", "0212345678": "02-1234-5678", "05012345678": "050-1234-5678", "": "-", None: "-", "+82 10 0000 1234": "010-0000-1234", "123": "123"}
    assert values(spark, shown, tx.format_phone) == list(shown.values())


def test_texts(spark):
    assert values(spark, [" a b　\n c ", None, ""], tx.clean_text) == ["a b c", "", ""]
    assert values(spark, ["dx 380lc-3", None], tx.model_key) == ["DX380LC3", None]
    assert values(spark, ["http://user:pw@h/x", "mail a:b@c"], tx.redact) == ["http://***:***@h/x", "mail a:b@c"]
    assert values(spark, ["1,234회", "x", None], tx.nullable_int) == [1234, None, None]
    assert values(spark, ["a b/c", "__x__", "가.html"], tx.safe_name) == ["a_b_c", "x", "가.html"]
    assert values(spark, ["abc", "a" * 12, "```"], lambda x: tx.truncated(x, 10)) == ["abc", "a" * 10 + "\n\n... [truncated, original 12 chars]", "``​`"]
    assert [tx.normalize_mode(m) for m in ("전체", "최근5일", "30d", "odd")] == ["all", "5d", "1m", "odd"]


def test_urls(spark):
    assert values(spark, ["https://www.E.com/a?x=1#f", "", "http://h", "http://h?q"], urls.canonical_url_key) == ["//e.com/a?x=1", "", "//h/", "//h/?q"]
    assert values(spark, ["www.a.com; b.com", "a.com , https://c.com", "", None, "a.com；b"], urls.split_urls) == [["https://www.a.com", "http://b.com"], ["http://a.com", "https://c.com"], [], [], ["http://a.com;b"]]
    assert values(spark, ["http://WWW.a.com:80/x", "not a url"], urls.host_key) == ["a.com:80", ""]
    assert values(spark, ["http://www.한글.com/x", "//h/p"], urls.origin_key) == ["http://한글.com", "http://h"]
    assert values(spark, ["http://h/?a=1&b=&a=2&c&d=%EA%B0%80+x&e=%zz", "http://h/"], urls.params) == [{"a": ["1", "2"], "b": [""], "c": [""], "d": ["가 x"], "e": ["%zz"]}, {}]
    base = F.lit("http://h.com/a/b/c.html?q=1")
    refs = {"d.html": "http://h.com/a/b/d.html", "../x": "http://h.com/a/x", "/r": "http://h.com/r", "//o.com/z": "http://o.com/z", "?p=2": "http://h.com/a/b/c.html?p=2", "#f": "http://h.com/a/b/c.html?q=1#f", "https://o/": "https://o/", "./e": "http://h.com/a/b/e", "": "http://h.com/a/b/c.html?q=1"}
    assert values(spark, refs, lambda x: urls.absolute(base, x)) == list(refs.values())


def test_counts(spark):
    cases = {"총 게시물 1,234건": 1234, "총 600001건": None, "검색결과: 77 건": 77, "매물 12대 전체보기 (5)": 12, "총 9건 끝": 9, "none": None}
    assert values(spark, cases, survey.displayed_count) == list(cases.values())
    row = spark.range(1).select(survey.estimated_count(F.lit(None).cast("int"), F.lit(110), F.lit(70)).alias("a"), survey.estimated_count(F.lit(None).cast("int"), F.lit(3), F.lit(90)).alias("b"), survey.estimated_count(F.lit(5), F.lit(3), F.lit(90)).alias("c")).first()
    assert (row.a, row.b, row.c) == (7700, 60, 5)


@pytest.mark.parametrize(("value", "want"), [(None, 1000), ("", 1000), ("0", 1), ("7", 7), ("99999", 5000), ("x", 0), (-3, 1)])
def test_clamp(value, want):
    assert ls.clamp(value) == want
    assert ls.number_param("1,200") == 1200 and ls.number_param("x") is None
    assert ls.Search(q=" ", price_from="1").active() == 1
