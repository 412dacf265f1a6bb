"""Reports by origin: rows of a survey grouped by their site's origin, with its request document and its own data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shale.functions import text as tx
from shale.functions import urls
from shale.operators import survey

LEAST, URLS, NAMES, PHONES = 100, 5, 20, 10


def with_origin(rows: DataFrame, url: str) -> DataFrame:
    """rows with the origin of their URL; '' where there is none."""
    return rows.withColumn("origin", urls.origin_key(F.col(url)))


def with_documents(rows: DataFrame, endpoints: DataFrame, documents: DataFrame) -> DataFrame:
    """rows of the origins with an endpoint (origin, slug, endpoint), and the request document of its slug (slug, ...)."""
    return rows.join(endpoints, "origin").join(documents, "slug")


def with_meta(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """rows with what is known of their origin (origin, ...); origins that nothing is known of are left out."""
    return rows.join(meta, "origin")


def overview(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each origin whose largest count exceeds least: that count, and the first URLs, names and phones by count.

    rows: origin, count, page_url, name, phone, pos (a row's place). Lists are ranked before they are gathered.
    """
    known = rows.where(F.col("origin") != "")
    large = known.groupBy("origin").agg(F.max("count").alias("largest"), F.count("*").alias("rows")).where(F.col("largest") > least)
    order = known.join(large.select("origin"), "origin", "left_semi").withColumn("_by", F.struct((-F.col("count")).alias("c"), "pos"))
    out = large
    for value, most, name in (("page_url", URLS, "urls"), ("name", NAMES, "names"), ("phone", PHONES, "phones")):
        out = out.join(survey.first_values(order, "origin", value, "_by", most).withColumnRenamed("first_values", name), "origin", "left")
    return out.withColumns({n: F.coalesce(n, F.lit("")) for n in ("urls", "names", "phones")})


#: Headings, labels and set sentences of the report. Fixed values.
OVERVIEW, API, REMARKS = "## 개요", "## API 정보", "## 특이사항"
ABOUT = ("사이트명", "Origin", "사이트 내 매물 수", "확인한 대표 매물 URL", "취급장비 정보", "대표자/운영자 정보")
LINKED, TELEPHONES = "연결된 원본 업체", "원본 CSV 대표전화"
NATURE = "- API 성격: JSON API가 아니라 `HTML 목록 엔드포인트`입니다. `requests + BeautifulSoup` 방식으로 목록 HTML을 받아 매물 행과 상세 URL을 파싱하는 구조입니다."
METHOD = "- HTTP 메서드: `GET` 중심. 일부 검색 폼은 `POST`로도 제출되지만, 목록 URL은 쿼리 파라미터 조합으로 재현 가능합니다."
PARAMETERS = (("카테고리/게시판 파라미터", "category"), ("페이지네이션 파라미터", "pagination"), ("검색/필터 파라미터", "search_filter"), ("상세 매물 식별자", "detail_id"))
ENDPOINT, PERIOD, EXAMPLE, NO_REMARKS = "단일 API 엔드포인트", "기간 파라미터", "예시 요청", "- 예외 사항 없음."


def example_url(endpoint: Column, query: Column) -> Column:
    """The endpoint with a query (map<string, array<string>>), encoded, each value on its own."""
    pairs = F.flatten(F.transform(F.map_entries(query), lambda e: F.transform(e["value"], lambda v: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(v)))))
    text = F.array_join(pairs, "&")
    return F.when(F.coalesce(text, F.lit("")) == "", endpoint).otherwise(F.concat(endpoint, F.lit("?"), text))


def report(rows: DataFrame) -> DataFrame:
    """(file, text): a Markdown report of each origin, put together where its row is.

    rows: :func:`overview` with endpoint, the request contract's columns, and what is known of the origin: site_name, display_name,
    equipment, operator_note, period_note, remarks (array<string>), example_query (map; else the contract's current one).
    """
    none = F.array().cast("array<string>")
    names = lambda c: tx.param_list(F.coalesce(F.col(c), none))
    known = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    item = lambda label, *value: F.concat(F.lit(f"- {label}: "), *value)
    mark = lambda *x: F.concat(F.lit("`"), *x, F.lit("`"))
    where = F.when(F.col("urls") == "", F.lit("")).otherwise(mark(F.replace("urls", F.lit(" | "), F.lit("`, `"))))
    of_list = lambda label, c: F.when(F.col(c) != "", item(label, F.replace(c, F.lit(" | "), F.lit(", "))))
    query = known("example_query", known("current_query_params", F.create_map().cast("map<string,array<string>>")))
    remarks = known("remarks", none)
    values = (F.col("display_name"), mark(F.col("origin")), F.concat(F.lit("약 "), mark(F.format_number("largest", 0)), F.lit("건")), where, F.col("equipment"), F.col("operator_note"))
    lines = [
        F.concat(F.lit("# "), "site_name"), F.lit(""), F.lit(OVERVIEW), F.lit(""), *[item(label, F.coalesce(v, F.lit(""))) for label, v in zip(ABOUT, values, strict=True)], of_list(LINKED, "names"), of_list(TELEPHONES, "phones"),
        F.lit(""), F.lit(API), F.lit(""), F.lit(NATURE), item(ENDPOINT, mark(F.col("endpoint"))), F.lit(METHOD), *[item(label, names(f"likely_{role}_params")) for label, role in PARAMETERS],
        item(PERIOD, F.coalesce("period_note", F.lit(""))), item(EXAMPLE, mark(example_url(F.col("endpoint"), query))),
        F.lit(""), F.lit(REMARKS), F.lit(""), F.when(F.size(remarks) > 0, F.array_join(F.transform(remarks, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(NO_REMARKS)),
    ]
    host = F.regexp_replace("origin", "^[a-z]+://", "")
    # concat_ws leaves out the lines of lists that are empty.
    return rows.select(F.concat(tx.safe_name(host), F.lit(".md")).alias("file"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("text"))


def numbered(rows: DataFrame, name: str, text: Column, order: list[Column], most: int, group: str = "page_id") -> DataFrame:
    """(group, section, rank, text): the first rows of each group as lines of a section."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)
    return first.select(group, F.lit(name).alias("section"), F.col("rank").cast("long").alias("rank"), text.alias("text"))


def site_report(lines: DataFrame, sections: list[str], group: str = "page_id") -> DataFrame:
    """(group, text): Markdown of each group's sections, in the order given; lines: of :func:`numbered`, few for each section."""
    at = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    own = lines.groupBy(group, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("body"))
    parts = own.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "section", "body"))).alias("p"))
    return parts.select(group, F.array_join(F.transform("p", lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n\n"), x["body"])), "\n\n").alias("text"))
