"""The report of a site's request profile: nine sections of Markdown, and the same as one JSON document.

Link samples, paths and parameters are ranked and cut before they are gathered, so a page's row holds a few dozen lines of each
section, however many links it has. Forms and scripts are read where the parsed page is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shale import storage
from shale.functions import text as tx
from shale.functions import urls
from shale.operators import html as h
from shale.operators import profile

#: Headings, labels, lines of empty sections and closing notes. Fixed values.
HEAD = ("확인 URL", "매물 수 추정", "응답 형식 판단", "기본 목록 엔드포인트", "현재 Query")
SECTIONS = ("요청 파라미터 요약", "관찰된 파라미터 빈도", "폼 분석", "주요 경로/샘플", "페이지네이션 샘플", "카테고리 샘플", "스크립트/API 단서", "검증 요청 샘플", "크롤링 메모")
ROLES = (("카테고리/게시판", "category"), ("페이지네이션", "pagination"), ("검색/필터", "search_filter"), ("상세 ID", "detail_id"))
UNKNOWN, NO_FIELDS = "미확인", "없음"
EMPTY = {2: "- 링크 query 파라미터가 거의 없거나 path 기반입니다.", 3: "- form 없음", 5: "- 페이지네이션 링크 미검출", 6: "- 카테고리 링크 미검출", 7: "- 명시적인 JSON/API 엔드포인트 미검출"}
EXTERNAL, INLINE = "외부 스크립트 수", "인라인 스크립트 수"
NOTES = (
    "- 우선순위: 목록 URL의 query 파라미터를 조합해 페이지 단위 HTML을 수집한 뒤 상세 링크를 따라가는 방식.",
    "- JSON API로 바로 응답하는 패턴은 현재 확인 페이지 기준 미검출. 스크립트 단서는 대부분 UI/검색 보조 또는 범용 AJAX로 보이며, 실제 매물 목록은 초기 HTML에 포함됩니다.",
    "- 필수 추출 필드 후보: 상세URL, 제목/모델명, 제조사, 연식, 가격, 지역, 판매상/연락처, 등록일, 조회수, 카테고리, 거래상태.",
)
#: Lines that a section shows at most; the document holds as many as the profile does.
SHOWN = {"params": 30, "fields": 30, "paths": 10, "of_path": 3, "pagination": 10, "category": 12, "hints": 25}
DOCUMENT = {"samples": 30, "details": 15, "sources": 40}
NO_LINES = "array<string>"


def _mark(x: Column) -> Column:
    return F.concat(F.lit("`"), x, F.lit("`"))


def _quoted(x: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")


def _spaced(params: Column) -> Column:
    """A map of lists as JSON with a blank after each comma and colon."""
    entry = lambda e: F.concat(_quoted(e["key"]), F.lit(": ["), F.array_join(F.transform(e["value"], _quoted), ", "), F.lit("]"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(params), entry), ", "), F.lit("}"))


def _gathered(rows: DataFrame, group: str, name: str, *columns: str) -> DataFrame:
    """(group, name): the ranked rows of each group as an ordered list; there are few."""
    return rows.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *columns)), lambda a, b: (a["rank"] - b["rank"]).cast("int")), lambda x: F.struct(*[x[c].alias(c) for c in columns])).alias(name))


def _lines(found: Column, section: int, line) -> Column:
    """The lines of a list, or the one that stands for none."""
    own = F.transform(found, line)
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(EMPTY[section]))) if section in EMPTY else own


def _profile(pages: DataFrame, group: str, hosts: list[str] | None, captured: DataFrame | None) -> DataFrame:
    """One row for each page with all that a report is made of."""
    parts = F.struct(*[F.col(f"page.{c}").alias(c) for c in ("title", "og_title", "targets", "forms", "scripts")])
    pages = storage.stored(pages.withColumn("page", parts), "site-report")
    links = storage.kept(profile.on_hosts(profile.links(pages, group), hosts or []))
    shown = ["text", "url", "params"]
    paths = profile.path_frequency(links, group, ["pos"]).select(group, "rank", "path", "count")
    samples = _gathered(profile.path_samples(links.join(paths.select(group, "path"), [group, "path"]), group, ["pos"]).withColumn("_g", F.struct(group, "path")), "_g", "samples", *shown).select(F.col(f"_g.{group}").alias(group), F.col("_g.path").alias("path"), "samples")
    details = profile.path_frequency(links.where(profile.is_detail(profile.names(), F.col("path"))), group, ["pos"], DOCUMENT["details"])
    gathered = [
        _gathered(profile.param_frequency(links, group, ["pos"]), group, "param_frequency", "name", "count"),
        _gathered(paths.join(samples, [group, "path"]), group, "top_paths", "path", "count", "samples"),
        *[_gathered(profile.link_samples(links, group, kind, ["pos"], DOCUMENT["samples"]), group, f"{kind}_link_samples", *shown) for kind in ("category", "pagination")],
        _gathered(details, group, "detail_path_frequency", "path", "count"),
    ]
    wanted = profile.pages_to_sample(links, group, ["pos"])
    if captured is not None:
        body = captured.groupBy("url").agg(F.max(F.struct("status", "content_type", F.octet_length("html").alias("bytes"))).alias("_c"))
        wanted = wanted.join(body, "url", "left").select(group, "rank", "url", "_c.*")
    else:
        wanted = wanted.select(group, "rank", "url", *[F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("content_type", "string"), ("bytes", "long"))])
    gathered.append(_gathered(wanted, group, "page_samples", "url", "status", "content_type", "bytes"))
    out = pages.join(profile.contract(pages, group, hosts), group)
    for part in gathered:
        name = next(c for c in part.columns if c != group)
        out = out.join(part, group, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out


def reports(pages: DataFrame, group: str = "page_id", hosts: list[str] | None = None, captured: DataFrame | None = None) -> DataFrame:
    """(group, text, document): the report of each parsed page (url; name, count_estimate, slug where known), and its JSON.

    hosts: only links to these count. captured: pages (url, html, status, content_type) that stand for the requests by which
    pagination and category links are tried out.
    """
    p, url = F.col("page"), F.col("url")
    has = lambda c: F.col(c).cast("string") if c in pages.columns else F.lit("")
    rows = _profile(pages, group, hosts, captured)
    forms, sources, inline, hints = h.forms(p, url), h.script_sources(p, url), h.inline_scripts(p), h.endpoint_hints(p, url)
    names = lambda role: F.array_join(F.col(f"likely_{role}_params"), ", ")
    head = (url, has("count_estimate"), F.col("response_type"), F.col("base_endpoint"), _spaced(F.col("current_query_params")))
    sample = lambda x: F.concat(F.lit("- "), _mark(x["text"]), F.lit(" -> "), _mark(x["url"]))

    def of_form(f: Column) -> Column:
        fields = F.array_join(F.transform(F.slice(f["fields"], 1, SHOWN["fields"]), lambda x: _mark(x["name"])), ", ")
        first = F.concat(F.lit("- Form "), f["index"].cast("string"), F.lit(": "), _mark(f["method"]), F.lit(" "), _mark(f["action"]))
        return F.concat_ws("\n", first, F.concat(F.lit("  - fields: "), F.when(fields == "", F.lit(NO_FIELDS)).otherwise(fields)), F.when(f["text"] != "", F.concat(F.lit("  - text: "), f["text"])))

    def of_path(x: Column) -> Column:
        first = F.concat(F.lit("- "), _mark(x["path"]), F.lit(": "), x["count"].cast("string"), F.lit(" links"))
        return F.array_join(F.concat(F.array(first), F.transform(F.slice(x["samples"], 1, SHOWN["of_path"]), lambda s: F.concat(F.lit("  "), sample(s)))), "\n")

    tried = lambda x: F.concat(F.lit("- "), *[F.concat(_mark(F.coalesce(x[c].cast("string"), F.lit(""))), F.lit(" ")) for c in ("status", "content_type", "bytes")], F.lit("-> "), _mark(x["url"]))
    count = lambda label, found: F.concat(F.lit(f"- {label}: "), _mark(F.size(found).cast("string")))
    bodies = [
        F.array(*[F.concat(F.lit(f"- {label}: "), _mark(F.when(names(role) == "", F.lit(UNKNOWN)).otherwise(names(role)))) for label, role in ROLES]),
        _lines(F.slice("param_frequency", 1, SHOWN["params"]), 2, lambda x: F.concat(F.lit("- "), _mark(x["name"]), F.lit(": "), x["count"].cast("string"))),
        _lines(forms, 3, of_form),
        _lines(F.slice("top_paths", 1, SHOWN["paths"]), 4, of_path),
        _lines(F.slice("pagination_link_samples", 1, SHOWN["pagination"]), 5, sample),
        _lines(F.slice("category_link_samples", 1, SHOWN["category"]), 6, sample),
        F.concat(F.array(count(EXTERNAL, sources), count(INLINE, inline)), _lines(F.slice(hints, 1, SHOWN["hints"]), 7, lambda x: F.concat(F.lit("- "), _mark(x)))),
        _lines(F.col("page_samples"), 8, tried),
        F.array(*[F.lit(n) for n in NOTES]),
    ]
    lines = [F.array(F.concat(F.lit("# "), has("name")), F.lit("")), F.array(*[F.concat(F.lit(f"- {label}: "), _mark(value)) for label, value in zip(HEAD, head, strict=True)])]
    for title, body in zip(SECTIONS, bodies, strict=True):
        lines += [F.array(F.lit(""), F.lit(f"## {title}"), F.lit("")), body]
    as_map = lambda c, key: F.map_from_entries(F.transform(c, lambda x: F.struct(x[key].alias("key"), x["count"].alias("value"))))
    contract = F.struct(*[F.col(c) for c in ("base_endpoint", "current_query_params", "observed_param_names_ranked", "response_type", *[f"likely_{r}_params" for r in ("pagination", "category", "search_filter", "detail_id")])])
    document = F.to_json(F.struct(
        F.struct(has("slug").alias("slug"), has("name").alias("name"), has("count_estimate").alias("count_estimate")).alias("site"),
        F.struct(url.alias("final_url"), h.title(p).alias("title")).alias("page"), contract.alias("request_contract"), forms.alias("forms"),
        F.struct("top_paths", as_map(F.col("param_frequency"), "name").alias("param_frequency"), "category_link_samples", "pagination_link_samples", as_map(F.col("detail_path_frequency"), "path").alias("detail_path_frequency")).alias("links"),
        F.struct(F.slice(sources, 1, DOCUMENT["sources"]).alias("script_srcs_sample"), hints.alias("inline_endpoint_hints"), F.size(inline).alias("inline_script_count"), F.size(sources).alias("external_script_count")).alias("scripts"),
        F.col("page_samples"),
    ))
    return rows.select(group, F.concat(F.array_join(F.concat(*lines), "\n"), F.lit("\n")).alias("text"), document.alias("document"))


#: The index of all sites: its title, column titles and closing line. Fixed values.
INDEX = ("# 중장비 매물 사이트 API/요청 파라미터 분석", "|순위|사이트|매물수 추정|응답|기본 엔드포인트|파일|", "|---:|---|---:|---|---|---|")


def index_lines(contracts: DataFrame, slug: str, name: str, count: str) -> DataFrame:
    """(rank, line): the index's row of each site, by count."""
    rows = storage.ranked(contracts, [F.desc(count), F.asc(slug)])
    file = lambda kind: F.concat(F.lit("["), F.col(slug), F.lit(f".{kind}]("), F.col(slug), F.lit(f".{kind})"))
    line = F.concat(F.lit("|"), F.col("rank").cast("string"), F.lit("|"), F.col(name), F.lit("|"), F.col(count).cast("string"), F.lit("|"), F.col("response_type"), F.lit("|`"), F.col("base_endpoint"), F.lit("`|"), file("md"), F.lit(" / "), file("json"), F.lit("|"))
    return rows.select("rank", line.alias("line"))
