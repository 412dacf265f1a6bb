"""Site survey: score captured pages, estimate their inventory, pick the best page of a site, rank and summarise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shale import storage
from shale.functions import text as tx
from shale.functions import urls
from shale.operators import html as h

#: Words that speak for and against a listing page. Fixed values.
LISTING_WORDS = (
    "매물", "중고", "판매", "팝니다", "보유", "제품", "장비", "굴삭", "굴착", "지게차", "덤프", "로더", "크레인", "건설기계",
    "product", "products", "goods", "shop", "sale", "sell", "used", "machine", "equipment", "board", "bbs", "sub6", "sub8", "m02",
)
#: Fixed values, as all lists and patterns down to ITEM_LINK.
NEGATIVE_WORDS = (
    "회사소개", "인사말", "오시는길", "공지", "공지사항", "고객센터", "자주하는질문", "묻고답하기", "질문", "자유게시판", "견적", "문의", "로그인",
    "회원", "채용", "개인정보", "약관", "intro", "company", "notice", "contact", "login", "join",
)
NO_INVENTORY = ("질문/자유게시판", "자유게시판", "묻고답하기", "자주하는질문", "고객센터", "공지사항", "구인구직")
INVENTORY_TITLES = ("덤프트럭", "굴삭기", "지게차", "로더", "크레인", "매물", "매매", "제품")
MACHINES = ("만원", "굴삭", "지게", "덤프", "로더", "크레인", "현대", "두산", "볼보")
PRICE = r"(?:(?:[0-9]{2,}(?:,[0-9]{3})*)|(?:[0-9]+억\s*[0-9]*))\s*(?:만원|원)"
YEAR = r"(?:19|20)\d{2}\s*년"
COUNTS = (
    r"총\s*게시물\s*([0-9,]{1,7})\s*건",
    r"검색결과\s*[:：]?\s*([0-9,]{1,7})\s*건",
    r"(?:매물|상품|제품)\s*(?:수|건수)?\s*[:：]?\s*([0-9,]{1,7})\s*(?:건|개|대)",
    r"전체보기\s*\(([0-9,]{1,7})\)",
    r"(?U)총\s*([0-9,]{1,7})\s*(?:건|개|대)\b",
    r"(?U)전체\s*([0-9,]{1,7})\s*(?:건|개|대)\b",
)
API_HINT = r"(?i)(fetch\s*\(|axios\.|XMLHttpRequest|\$\.ajax|/api/|graphql|_next/data|rest_route|wp-json|ajax)"
PAGE_NUMBER = r"(?i)[?&](?:page|paged|p|pageNo|page_no|PB_\d+|board_page)=(\d{1,5})"
ITEM_LINK = r"(?i)(pid=|sub8_1_vvv|wr_id=|idx=|/sell/\d+|view|product|goods|item|no=|seq=|mch-)"
MOST_ITEMS, FULL_PAGE, USUAL_PAGE = 500_000, 80, 20
LINKS_PER_PAGE, PAGES_PER_SITE, LABEL_CHARS = 7, 12, 80


def hits(text: Column, words: tuple[str, ...], weight: int = 1) -> Column:
    """How many of the words stand in text (lower case), times the weight; overlapping words count each."""
    return reduce(Column.__add__, [F.when(text.contains(w.lower()), F.lit(weight)).otherwise(F.lit(0)) for w in words])


def displayed_count(text: Column) -> Column:
    """The total that a page displays: the first pattern with a value up to 500,000 counts."""

    def one(pattern: str) -> Column:
        numbers = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("int"))
        return F.get(F.filter(numbers, lambda n: n.between(0, MOST_ITEMS)), F.lit(0))

    return F.coalesce(*[one(p) for p in COUNTS])


def page_max(links: Column, url: Column) -> Column:
    """The largest page number in the links (array<struct<href>>) of the page at url: a link to its own top has the page's."""
    full = F.transform(links, lambda a: urls.absolute(url, tx.stripped(a["href"])))
    return F.array_max(F.flatten(F.transform(full, lambda x: F.transform(F.regexp_extract_all(x, F.lit(PAGE_NUMBER), F.lit(1)), lambda n: n.cast("int")))))


def visible_count(p: Column, text: Column) -> Column:
    """Items seen on a page: product rows, else distinct item links, else prices, else years."""
    rows = F.size(F.filter(F.transform(p["rows"], lambda r: F.array_join(r["cells"], " ")), lambda t: t.startswith("제품리스트 ") & (t.contains("모델명:") | t.contains("가격"))))
    probe = lambda a: F.concat_ws(" ", a["href"], a["label"])
    machine = lambda t: reduce(Column.__or__, [t.contains(w) for w in MACHINES])
    items = F.filter(p["links"], lambda a: probe(a).rlike(ITEM_LINK) & machine(probe(a)))
    ids = F.transform(items, lambda a: F.coalesce(F.nullif(F.regexp_extract(urls.defragmented(a["href"]), r"((?:pid|wr_id|idx|no|seq)=[0-9A-Za-z_-]+)", 1), F.lit("")), urls.defragmented(a["href"])))
    links = F.size(F.array_distinct(ids))
    prices, years = F.regexp_count(text, F.lit(PRICE)), F.regexp_count(text, F.lit(YEAR))
    return F.when(rows > 0, rows).when(links > 0, links).when(prices > 0, prices).otherwise(years)


def estimated_count(total: Column, last_page: Column, visible: Column) -> Column:
    per_page = F.when(visible <= FULL_PAGE, visible).otherwise(F.lit(USUAL_PAGE))
    return F.when(total.isNotNull(), total).when((last_page > 1) & (visible > 0), last_page * per_page).otherwise(visible)


def listing_like(text: Column, url: Column) -> Column:
    low = F.lower(F.concat_ws(" ", text, url))
    return (hits(low, LISTING_WORDS) >= 2) | text.rlike(PRICE) | text.rlike(YEAR) | url.contains("bo_table") | url.contains("bmode=view")


def no_inventory(title: Column, text: Column, url: Column) -> Column:
    probe = F.lower(F.concat_ws(" ", title, F.substr(text, F.lit(1), F.lit(140)), url))
    return (hits(probe, NO_INVENTORY) > 0) & (hits(title, INVENTORY_TITLES) == 0)


def response_kind(ok: Column, status: Column, content_type: Column, body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    scripted = body.rlike(API_HINT)
    return (
        F.when(F.lower(F.coalesce(content_type, F.lit(""))).contains("json"), "API(JSON 응답)")
        .when((status == "403") & F.lower(body).contains("cloudflare"), "확인불가(Cloudflare 차단)")
        .when(~ok, "확인불가(요청 실패)")
        .when(scripted & (body.contains("__NEXT_DATA__") | body.contains("_next/static")), "HTML+JS/내장데이터")
        .when(scripted, "HTML+API호출 단서")
        .otherwise("HTML 응답")
    )


def page_score(ok: Column, like: Column, count: Column, kind: Column, url: Column) -> Column:
    low = F.lower(url)
    base = F.when(ok, 10.0).otherwise(0.0) + F.when(like, 25.0).otherwise(0.0) + F.least(F.coalesce(count, F.lit(0)), F.lit(200)) / 10
    html = F.when(kind.contains("HTML 응답"), 2.0).otherwise(0.0) - F.when(kind.contains("Cloudflare"), 10.0).otherwise(0.0)
    return base + html + hits(low, LISTING_WORDS, 3) - hits(low, NEGATIVE_WORDS, 4)


def link_score(label: Column, href: Column) -> Column:
    probe = F.lower(F.concat_ws(" ", label, href))
    bonus = lambda test, n: F.when(test, F.lit(n)).otherwise(F.lit(0))
    return (
        hits(probe, LISTING_WORDS, 4) - hits(probe, NEGATIVE_WORDS, 3) + bonus(href.contains("bbs/board.php"), 4) + bonus(href.contains("bo_table"), 3)
        + bonus(href.contains("wr_id"), -8) + bonus(label == "", -2) + bonus(href.rlike(r"(?i)(page|list|product|goods|sell|sale|sub\d+|m\d+)"), 2)
    )


def candidate_links(pages: DataFrame, key: str = "page_id", most: int = LINKS_PER_PAGE) -> DataFrame:
    """The best links of each parsed page to its own host: (key, rank, score, url, label)."""
    links = pages.select(key, "url", F.posexplode("page.links").alias("pos", "a")).select(key, F.col("url").alias("base"), "pos", tx.stripped(F.col("a.href")).alias("href"), F.col("a.label").alias("label"))
    links = links.where((F.col("href") != "") & ~F.col("href").rlike("^(javascript:|mailto:|tel:|#)"))
    links = links.withColumn("full", urls.absolute(F.col("base"), F.col("href"))).where(urls.part(F.col("full"), 1).isin("http", "https") & (urls.host_key(F.col("full")) == urls.host_key(F.col("base"))))
    links = links.withColumn("score", link_score(F.col("label"), F.col("href"))).where("score > 0").withColumn("target", urls.defragmented(F.col("full")))
    first = links.groupBy(key, "target").agg(F.min_by(F.struct("score", "label", "pos"), "pos").alias("x")).select(key, "target", "x.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(key, "rank", "score", F.col("target").alias("url"), F.substr("label", F.lit(1), F.lit(LABEL_CHARS)).alias("label"))


def analyzed(pages: DataFrame) -> DataFrame:
    """Captured pages (url, html; ok, status, content_type where known), parsed and judged."""
    has = lambda c, default: F.coalesce(F.col(c), default) if c in pages.columns else default
    p = h.with_page(pages).withColumns({"_ok": has("ok", F.lit(True)), "_status": has("status", F.lit("200")).cast("string"), "_type": has("content_type", F.lit("text/html")), "text": F.col("page.text"), "title": h.title(F.col("page"))})
    p = p.withColumns({"kind": response_kind(F.col("_ok"), F.col("_status"), F.col("_type"), F.col("html")), "total": displayed_count(F.col("text")), "page_max": page_max(F.col("page.links"), F.col("url")), "_seen": visible_count(F.col("page"), F.col("text")), "off": no_inventory(F.col("title"), F.col("text"), F.col("url"))})
    p = p.withColumns({"visible": F.when(F.col("off"), 0).otherwise(F.col("_seen")), "listing_count": F.when(F.col("off"), 0).otherwise(estimated_count(F.col("total"), F.col("page_max"), F.col("_seen"))).cast("long"), "listing_like": ~F.col("off") & listing_like(F.col("text"), F.col("url"))})
    p = p.withColumn("kind", F.when((F.col("kind") == "HTML+API호출 단서") & F.col("listing_like") & ((F.col("listing_count") > 0) | (F.col("visible") > 0)), "HTML 응답(스크립트 단서 있음)").otherwise(F.col("kind")))
    return p.withColumn("score", page_score(F.col("_ok"), F.col("listing_like"), F.col("listing_count"), F.col("kind"), F.col("url"))).drop("_ok", "_status", "_type", "_seen", "off")


def best_pages(pages: DataFrame, key: str, position: str) -> DataFrame:
    """The page with the highest score of each key; of equals the first."""
    rows = F.struct(*[c for c in pages.columns if c != key])
    return pages.groupBy(key).agg(F.max_by(rows, F.struct("score", -F.col(position))).alias("x")).select(key, "x.*")


ATTEMPTS, ERROR_CHARS = 16, 50


def _captured(pages: DataFrame) -> DataFrame:
    """One page for each canonical URL (key, page_url, html, ok, status, content_type, error): the first by URL."""
    has = lambda c, default: F.coalesce(F.col(c), default) if c in pages.columns else default
    rows = pages.select(
        urls.canonical_url_key(F.col("url")).alias("key"),
        F.struct(has("final_url", F.col("url")).alias("page_url"), "html", has("ok", F.lit(True)).alias("ok"), has("status", F.lit("200")).cast("string").alias("status"), has("content_type", F.lit("text/html")).alias("content_type"), has("error", F.lit("")).alias("error")).alias("x"),
        "url",
    )
    return rows.groupBy("key").agg(F.min_by("x", "url").alias("x")).select("key", "x.*")


def frontier(seeds: DataFrame, captured: DataFrame, rounds: int = 1, most: int = PAGES_PER_SITE) -> DataFrame:
    """(seed_no, place, requested): the pages that a survey looks at, in order: the seeds' URLs, then the best links of what they show.

    seeds: seed_no, pos, url. captured: pages (url, html, and what :func:`analyzed` takes) that stand for fetching. All of a
    seed's own URLs are looked at, and others up to `most` pages in all. Each round expands the pages that the last one has added,
    and ends the search where none is. A page gives :data:`LINKS_PER_PAGE` links at most and a seed `most` pages, before any are
    put together.
    """
    pages = _captured(captured)
    first = seeds.where(F.coalesce("url", F.lit("")) != "").groupBy("seed_no", "url").agg(F.min("pos").alias("_pos"))
    by = Window.partitionBy("seed_no").orderBy("order")
    order = lambda number, parent, rank: F.struct(F.lit(number).alias("round"), parent.cast("long").alias("parent"), rank.cast("long").alias("rank")).alias("order")
    queue = first.select("seed_no", F.col("url").alias("requested"), order(0, F.col("_pos"), F.lit(0)))
    for number in range(1, rounds + 1):
        placed = storage.kept(queue.withColumn("place", F.row_number().over(by)).where((F.col("place") <= most) | (F.col("order.round") == 0)))
        fresh = placed.where((F.col("order.round") == number - 1) & (F.col("place") < most))
        shown = fresh.withColumn("key", urls.canonical_url_key(F.col("requested"))).join(pages, "key").select(F.struct("seed_no", "place").alias("at"), F.col("page_url").alias("url"), "html")
        found = candidate_links(h.with_page(shown), "at").select("at.seed_no", F.col("url").alias("requested"), order(number, F.col("at.place"), F.col("rank")))
        # A URL that is in the queue keeps its place there.
        queue = placed.drop("place").unionByName(found).groupBy("seed_no", "requested").agg(F.min("order").alias("order"))
        if number < rounds and queue.where(F.col("order.round") == number).isEmpty():
            break
    placed = queue.withColumn("place", F.row_number().over(by))
    return placed.where((F.col("place") <= most) | (F.col("order.round") == 0)).select("seed_no", F.col("place").cast("long").alias("place"), "requested")


def surveyed(seeds: DataFrame, captured: DataFrame, rounds: int = 1, most: int = PAGES_PER_SITE) -> DataFrame:
    """The best page of each seed, as :func:`analyzed` judges it, with ``attempted``: what was looked at, in order, with its status.

    A page that isn't captured counts as a failed request.
    """
    queue = frontier(seeds, captured, rounds, most).withColumn("key", urls.canonical_url_key(F.col("requested")))
    rows = storage.stored(queue.join(_captured(captured), "key", "left").drop("key"), "survey")
    tried = F.concat(F.col("requested"), F.lit(" ["), F.coalesce(F.nullif("status", F.lit("")), F.substr("error", F.lit(1), F.lit(ERROR_CHARS)), F.lit("not captured")), F.lit("]"))
    attempts = rows.where(F.col("place") <= ATTEMPTS).groupBy("seed_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", tried.alias("t")))), lambda x: x["t"]).alias("attempted"))
    missing = F.col("page_url").isNull()
    rows = rows.select("seed_no", "place", F.coalesce("page_url", "requested").alias("url"), "html", (~missing & F.coalesce("ok", F.lit(False))).alias("ok"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("content_type", F.lit("")).alias("content_type"))
    return best_pages(analyzed(rows).drop("page", "html", "text"), "seed_no", "place").join(attempts, "seed_no")


def flag(like: Column, count: Column) -> Column:
    return F.when(like & (count > 0), "Y").when(like, "추정").otherwise("N")


def ranked(rows: DataFrame) -> DataFrame:
    """Rank over (count descending, N last, original rows first, name)."""
    return storage.ranked(rows, [F.desc("listing_count"), F.col("flag") == "N", ~F.col("original"), F.asc("name")])


def summary(rows: DataFrame, names: int = 30) -> DataFrame:
    """One row for each (domain, canonical URL): its top row, the number of all and the first names."""
    keys = ["domain", "url_key"]
    keyed = rows.withColumns({"domain": urls.host_key(F.col("url")), "url_key": urls.canonical_url_key(F.col("url"))})
    top = F.struct(F.col("listing_count"), (-F.col("rank")).alias("r"))
    out = keyed.groupBy(*keys).agg(F.max_by(F.struct("name", "url", "listing_count", "flag"), top).alias("x"), F.count("*").alias("linked"))
    # Ranked before they are gathered: a large group keeps its first names only.
    seen = keyed.groupBy(*keys, "name").agg(F.min("rank").alias("r")).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("r"))).where(F.col("n") <= names)
    lists = seen.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), " | ").alias("linked_names"))
    name = F.when(F.col("linked") == 1, F.col("x.name")).otherwise(F.concat(F.col("domain"), F.lit(" 공용매물/플랫폼")))
    out = out.join(lists, keys).select(*keys, name.alias("name"), "x.url", "x.listing_count", "x.flag", "linked", "linked_names")
    return storage.ranked(out, [F.desc("listing_count"), F.asc("flag"), F.asc("domain"), F.asc("url_key")])


def origins_over(rows: DataFrame, origin: str, count: str, least: int = 100) -> DataFrame:
    """Rows of the origins whose largest count exceeds the least."""
    large = rows.groupBy(origin).agg(F.max(count).alias("_m")).where(F.col("_m") > least).select(origin)
    return rows.join(large, origin, "left_semi")


def first_values(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """The first distinct filled values of each key, in order of appearance."""
    seen = rows.where(F.coalesce(F.col(value), F.lit("")) != "").where(F.lower(value) != "nan").groupBy(key, value).agg(F.min(order).alias("_o"))
    kept = seen.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_o", value))).where(F.col("_n") <= most)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]), " | ").alias("first_values"))


def survey_rows(seeds: DataFrame, best: DataFrame, checked: Column) -> DataFrame:
    """One row for each seed (seed_no, name, home, source_url, original, …) with its best page: the survey's columns.

    best: seed_no and the columns of analyzed(), one page for each seed; attempted: array of what was tried.
    """
    url = F.coalesce("url", F.lit(""))
    hint = F.when(F.col("kind").contains("Cloudflare"), "브라우저/쿠키 필요").when(F.col("kind").contains("API") | F.col("kind").contains("JS"), "스크립트/API 엔드포인트 확인 필요").otherwise("requests+BeautifulSoup 가능")
    # The names and hints of this column. Fixed values.
    known = F.filter(F.array(*[F.lit(k) for k in ("bo_table", "page", "cate_cd", "find", "search", "cid", "bmode", "idx", "wr_id")]), lambda k: F.map_contains_key(urls.params(url), k))
    query = urls.part(url, 4)
    fields = F.concat(F.when(query != "", F.array(F.concat(F.lit("query_params="), F.substr(query, F.lit(1), F.lit(120))))).otherwise(F.array().cast("array<string>")), known, F.array(hint))
    attempted = F.array_join(F.slice(F.coalesce("attempted", F.array().cast("array<string>")), 1, 16), " || ") if "attempted" in best.columns else F.lit("")
    count = F.coalesce("listing_count", F.lit(0))
    like = F.coalesce("listing_like", F.lit(False))
    return seeds.join(best, "seed_no", "left").select(
        *[c for c in seeds.columns],
        urls.host_key(url).alias("domain"), url.alias("page_url"), count.alias("listing_count"), "kind", "title", flag(like, count).alias("flag"), "page_max",
        F.col("visible").alias("visible_count"), F.array_join(F.array_distinct(fields), " | ").alias("crawl_fields"), attempted.alias("attempted"), checked.alias("checked"),
    )
