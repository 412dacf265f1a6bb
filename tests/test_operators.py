import datetime as dt

from pyspark.sql import functions as F

from shale import sources, streaming
from shale.functions import text as tx
from shale.functions import urls
from shale.operators import board, dictionary, html, identity, owners, profile, survey
from shale.operators import listings as ls
from shale.operators import tasks as tk
from shale.sources import sinks, store

def now():
    return F.lit("2026-05-02 00:00:00").cast("timestamp_ntz")


def test_dictionary(spark, tmp_path):
    (tmp_path / "model.csv").write_text("﻿AB-12,AB12X, X9 ,ab12\nignored", encoding="utf-8")
    entries = dictionary.from_values(sources.dictionary_line(spark, str(tmp_path / "model.csv")))
    assert {(r.key, r.canonical, r.ord) for r in entries.collect()} == {("AB12", "ab12", 0), ("AB12X", "AB12X", 1), ("X9", "X9", 2)}
    texts = spark.createDataFrame([(0, "zz AB12X 굴"), (1, "AB12"), (2, "X9 extra"), (3, "x-9"), (4, None), (5, ""), (6, "yab12y")], "i int, name string")
    got = {r.i: r.model_norm for r in dictionary.match(texts, "name", entries).collect()}
    assert got == {0: "AB12X", 1: "ab12", 2: None, 3: "X9", 4: None, 5: None, 6: "ab12"}
    both = texts.withColumn("other", F.lit("AB12X"))
    assert {r.i: r.model_norm for r in dictionary.match_first(both, ["name", "other"], entries).collect()}[2] == "AB12X"
    records = spark.createDataFrame([("AB12", "t", "8,500만원")], "model_name string, listing_name string, price string")
    row = ls.enriched(records, entries).first()
    assert (row.model_norm, row.price_krw) == ("ab12", 85_000_000)


def test_merge_keeps_first_and_latest(spark):
    schema = "id long, content_hash string, price string, created_at int, updated_at int"
    current = spark.createDataFrame([(1, "h1", "a", 10, 10), (2, None, "c", 11, 11)], schema)
    batch = spark.createDataFrame([("h1", "b", 1), ("h1", "b2", 2), (None, "d", 3), ("h2", "n", 4)], "content_hash string, price string, seq int")
    got = {(r.id, r.content_hash, r.price, r.created_at, r.updated_at) for r in identity.merge_latest(current, batch, "content_hash", "seq", stamp=F.lit(99)).collect()}
    assert got == {(1, "h1", "b2", 10, 99), (2, None, "c", 11, 11), (None, None, "d", None, None), (None, "h2", "n", None, 99)}
    assert identity.merge_latest(current, batch.limit(0), "content_hash", "seq").count() == 2


def test_hash_is_python_json(spark):
    import hashlib
    import json

    record = {"contact": "c", "detail_url": None, "listing_name": '한"\\<&>', "model_name": "", "origin": "o", "posted_at": "2026-05-01T00:00:00", "posted_date": "2026-05-01", "price": "1만원"}
    want = hashlib.sha256(json.dumps({k: v or "" for k, v in record.items()}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    row = spark.createDataFrame([tuple(record.values())], ", ".join(f"{k} string" for k in record))
    assert row.select(identity.content_hash().alias("h")).first().h == want


def test_enqueue_and_order(spark):
    at = dt.datetime(2026, 1, 1)
    e = lambda task, seq, kind, code=500, wait=60: (task, seq, kind, at, code, "e" * 3000, wait)
    rows = [
        *[e("run-reset", i, k) for i, k in enumerate(["enqueue", "start", "enqueue_reset"])],
        *[e("done-reset", i, k) for i, k in enumerate(["enqueue", "start", "retry", "retry", "start", "done", "enqueue_reset"])],
        *[e("done-keep", i, k) for i, k in enumerate(["enqueue", "done", "enqueue"])],
        *[e("pending-keep", i, k) for i, k in enumerate(["enqueue", "retry", "retry", "enqueue"])],
        *[e("recovered", i, k) for i, k in enumerate(["enqueue", "start", "recover"])],
        *[e("failing", i, k) for i, k in enumerate(["enqueue", "start", "retry"])],
    ]
    events = spark.createDataFrame(rows, "task string, seq int, kind string, at timestamp, code int, error string, wait int")
    got = {r.task: r for r in tk.fold(events, ["task"], ["seq"]).collect()}
    assert {k: (r.status, r.attempts) for k, r in got.items()} == {"run-reset": ("running", 0), "done-reset": ("pending", 0), "done-keep": ("done", 0), "pending-keep": ("pending", 2), "recovered": ("pending", 0), "failing": ("pending", 1)}
    assert got["done-reset"].success_at is None and got["done-keep"].success_at == at
    assert len(got["failing"].last_error) == 2000 and got["failing"].next_run_at == at + dt.timedelta(seconds=60)
    waits = spark.createDataFrame([(400, 0.3), (500, 0.3), (500, 10.0)], "c int, s double").select(tk.back_off(F.col("c"), F.col("s")).alias("w"))
    assert [r.w for r in waits.collect()] == [900, 60, 200]
    states = spark.createDataFrame([(i, s, None, None, None) for i, s in enumerate(["done", "pending", "weird", "running"])], "id int, status string, success_at timestamp, updated_at timestamp, created_at timestamp")
    assert [r.status for r in tk.view(states).collect()] == ["weird", "running", "pending", "done"]
    pages = spark.createDataFrame([("s", i + 1, n) for i, n in enumerate([2, 0, 0, 1, 0, 0, 0, 0, 5])], "site string, page int, found int")
    assert sorted(r.page for r in tk.pages_read(pages, ["site"], "page", "found").collect()) == list(range(1, 8))


def test_fold_in_short_runs(spark):
    """A hot task's transitions, folded in runs of two, three and all at once, give the state of one after the other."""
    import random
    from types import SimpleNamespace

    rng = random.Random(31)
    kinds = ["enqueue", "enqueue_reset", "start", "done", "retry", "recover", "odd"]
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", "c"]), i, rng.choice(kinds[: 2 + i % 6]), (i + 1) * 1_000_000, 400 + i % 9, f"e{i}", 60 + i % 5) for i in range(400)] + [("r", 900 + i, "recover", 1_000_000, 1, "x", 1) for i in range(3)]
    events = spark.createDataFrame(rows, "task string, seq long, kind string, at_us long, code int, error string, wait int").withColumn("at", F.timestamp_micros("at_us"))
    names = [f.split()[0] for f in streaming.TASK_STATE.split(", ")]
    want = {}
    for task, _, kind, at_us, code, error, wait in sorted(rows, key=lambda r: r[1]):
        before = want.get(task, dict.fromkeys(names))
        want[task] = streaming._next(before, SimpleNamespace(kind=kind, at_us=at_us, code=code, error=error, wait=wait))
    micros = lambda c: F.unix_micros(c)
    for run in (2, 3, tk.RUN):
        out = tk.fold(events, ["task"], ["seq"], run).select("task", "status", "attempts", "last_status_code", "last_error", micros("next_run_at"), micros("success_at"), micros("updated_at"))
        assert {r[0]: tuple(r[1:]) for r in out.collect()} == {t: tuple(s[n] for n in names) for t, s in want.items()}, run


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"t{i % 3}", i, k, i * 1_000_000, 500, "err", 60) for i, k in enumerate(["enqueue", "enqueue", "enqueue", "start", "done", "retry", "retry", "start", "enqueue_reset", "recover", "enqueue", "done"])]
    schema = "task string, seq long, kind string, at_us long, code int, error string, wait int"
    events = spark.createDataFrame(rows, schema)
    for i, part in enumerate((events.where("seq < 6"), events.where("seq >= 6"))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.task_states(stream, 10**10).writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.task: (r.status, r.attempts) for r in spark.table("states").orderBy("updated_us").collect()}
    batch = tk.fold(events.withColumn("at", F.timestamp_micros("at_us")), ["task"], ["seq"])
    assert last == {r.task: (r.status, r.attempts) for r in batch.collect()}
    listings = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.merge_each(listings, f"{tmp_path}/store", "task", "seq", f"{tmp_path}/cp", interval=None)
    q.awaitTermination(120)
    assert {(r.task, r.seq) for r in store.read(spark, f"{tmp_path}/store", schema).collect()} == {("t0", 9), ("t1", 10), ("t2", 11)}
    assert streaming.windowed_counts(events.withColumn("at", F.timestamp_micros("at_us")), "at", "kind").count() > 0


LIST_PAGE = """<html><head><title> List  page </title><link rel="canonical" href="http://h.com/x"></head><body>
<a href="/sub8_1_s.html?cate_code=101000">굴삭기</a><a href="/sub8_1_s.html?cate_code=101000">again</a><a href="/sub8_1_s.html?cate_code=xx">bad</a><a href="/l?page=2">2</a>
<form action="/find" method="post"><input name="stx" value="v"><select name="maker"><option value="1">One<option value="2">Two</select><input></form>
<table><tr><th>other</th></tr><tr><td>no</td></tr></table>
<table><tr><th>번호</th><th>모델명</th><th>등록날짜</th></tr>
<tr><td>1</td><td>x</td><td>판매</td><td>현대</td><td>R210</td><td>2015-03</td><td>중고</td><td>서울</td><td>8,500만원</td><td>홍</td><td>26-05-01</td><td>1,234</td><td><a href="sub8_1_vvv.html?pid=77&z=1">go</a></td></tr>
<tr><td><img src="btn16.png"></td><td>x</td><td>판매</td><td>현대</td><td>R1</td><td></td><td></td><td></td><td></td><td></td><td></td><td></td><td><a href="sub8_1_vvv.html?pid=78">go</a></td></tr>
<tr><td>2</td><td>x</td><td>판매</td><td>현대</td><td>R2</td><td></td><td></td><td></td><td></td><td>그린중기</td><td></td><td></td><td><a href="sub8_1_vvv.html?pid=79">go</a></td></tr>
<tr><td>3</td><td>short</td></tr></table>
<script src="/a.js"></script><script>$.ajax('/api/list'); var u = {url: '/ajax/x'};</script><div onclick="location.href='/view/5?wr_id=5'">Row</div></body></html>"""
DETAIL_PAGE = """<table class="shop_table"><tr><td class="al"><strong>Nice one</strong></td><td class="ar">n/a</td><td class="ar">2026.05.01</td></tr>
<tr><th>모델명</th><td>R210-9</td><th>가격</th><td>9,000만원</td></tr><tr><th>가격</th><td></td></tr></table><div class="product_comment">Line 1<br>Line 2 2,500시간</div>"""


def test_board(spark):
    pages = html.with_page(spark.createDataFrame([(1, "http://h.com/list.html", LIST_PAGE), (2, "http://h.com/d.html", DETAIL_PAGE), (3, "http://h.com/e", None)], "page_id long, url string, html string")).cache()
    rows = board.listing_rows(pages, now()).collect()
    assert [(r.pid, r.listing_name, r.price, str(r.posted_date), r.detail_url, r.raw.trade_type) for r in rows] == [("77", "현대 R210", "8,500만원", "2026-05-01", "http://h.com/sub8_1_vvv.html?pid=77", "판매")]
    d = board.details(pages.where("page_id = 2"), now()).first()
    assert (d.detail_title, d.model_name, d.price, str(d.posted_date), d.description) == ("Nice one", "R210-9", "9,000만원", "2026-05-01", "Line 1 Line 2 2,500시간")
    merged = ls.overlaid(spark.createDataFrame(rows), board.details(pages.where("page_id = 2"), now()).withColumn("pid", F.lit("77"))).first()
    assert (merged.model_name, merged.price, merged.listing_name, merged.seller) == ("R210-9", "9,000만원", "현대 Nice one", "홍")
    assert [(r.code, r.name) for r in board.categories(pages).collect()] == [("101000", "굴삭기")]
    assert [r.has_next for r in board.expected_next(pages, F.lit(2)).orderBy("page_id").collect()] == [True, False, False]
    p = pages.where("page_id = 1").first().page
    assert [(f.method, f.action, [(x.name, x.tag, [o.text for o in x.options]) for x in f.fields]) for f in p.forms] == [("POST", "/find", [("stx", "input", []), ("maker", "select", ["One", "Two"])])]
    c = profile.contract(pages).where("page_id = 1").first()
    assert c.response_type == "HTML 목록 + JS/Ajax 단서" and c.likely_pagination_params == ["page"] and c.likely_detail_id_params == ["pid", "wr_id"] and "stx" in c.likely_search_filter_params
    assert pages.where("page_id = 1").select(html.title(F.col("page")).alias("t")).first().t == "List page"
    a = {r.page_id: r for r in survey.analyzed(pages).collect()}
    assert a[1].listing_like and a[1].listing_count > 0 and not a[3].listing_like
    empty = pages.limit(0)
    assert board.listing_rows(empty, now()).count() == profile.contract(empty).count() == 0


def test_pages_against_their_own_url(spark):
    """References are joined with the page's URL before anything is read from them; elements keep their order."""
    body = """<title>
      Foo
     bar
    </title><a href="#top">t</a><a href="">same</a><a href="
/x?pageNo=3 ">x</a><form></form><form action="
 go?y=1 "><input name="b"><select name="a"><option>1</select></form>
    <script></script><script src=" js/a.js "></script><script>var u = {url: '../api/x'}</script>
    <p onclick="window.location='/w?k=1'">w<a href="/n?m=1">n</a></p><a href="/p?k=2">p</a>"""
    pages = html.with_page(spark.createDataFrame([(1, "http://h.com/a/b/c?page=5", body), (2, "http://h.com/x", "<title> </title><meta property='og:title' content='og'>"), (3, "http://h.com/x", "<meta property='og:title' content='og'>")], "page_id int, url string, html string")).cache()
    p, url = F.col("page"), F.col("url")
    rows = pages.select(html.title(p).alias("title"), survey.page_max(p["links"], url).alias("most"), F.transform(html.forms(p, url), lambda f: f["action"]).alias("actions"), html.script_sources(p, url).alias("sources"), html.endpoint_hints(p, url).alias("hints"), F.size(html.inline_scripts(p)).alias("inline")).collect()
    assert [r.title for r in rows] == ["Foo bar", "", "og"]
    assert rows[0].most == 5 and rows[0].actions == ["http://h.com/a/b/c?page=5", "http://h.com/a/b/go?y=1"]
    assert rows[0].sources == ["http://h.com/a/b/js/a.js"] and rows[0].hints == ["http://h.com/a/api/x"] and rows[0].inline == 1
    links = [(r.url, r.text) for r in profile.links(pages).where("page_id = 1").orderBy("pos").collect()]
    assert [u for u, _ in links] == ["http://h.com/a/b/c?page=5#top", "http://h.com/x?pageNo=3", "http://h.com/w?k=1", "http://h.com/n?m=1", "http://h.com/p?k=2"] and links[2][1] == "w n"
    assert profile.contract(pages).where("page_id = 1").first().observed_param_names_ranked == ["b", "a", "k", "page", "pageNo", "m"]
    off = survey.analyzed(spark.createDataFrame([(1, "http://h.com/x", "<title>고객센터</title>총 게시물 9건 <a href='/item/1'>굴삭기</a> fetch('/api/')"), (2, "http://h.com/x", "<title>매물</title>총 게시물 0건 <a href='/item/1'>굴삭기</a><script>fetch('/x')</script>")], "page_id int, url string, html string")).orderBy("page_id").collect()
    assert (off[0].visible, off[0].listing_count, off[0].listing_like) == (0, 0, False)
    assert (off[1].visible, off[1].listing_count, off[1].kind) == (1, 0, "HTML 응답(스크립트 단서 있음)")


def test_absolute(spark):
    from urllib.parse import urljoin

    base = "http://h.com/a/b/c/d?q=1#f"
    hrefs = ["", "x", "./x", "../x", "../../../../../../../x", "/r/../s/./t", "..", ".", "../", "?z=2", "#g", "//o.org/p/../q", "https://e.com/../k", "x/y/?a=../b", "/a//b", "e//f", "javascript:x()", "/.."]
    rows = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", urls.absolute(F.lit(base), F.col("h")).alias("u")).collect()
    assert [(r.h, r.u) for r in rows] == [(h, urljoin(base, h)) for h in hrefs]


def test_decode(spark):
    rows = [("한글".encode("cp949"), None), ("é".encode(), "bogus"), ("é".encode("latin-1"), "latin-1"), (None, None)]
    got = spark.createDataFrame(rows, "b binary, c string").select(html.decode_body("b", "c").alias("t")).collect()
    assert [r.t for r in got] == ["한글", "é", "é", None]


def test_search_edges(spark):
    schema = "id long, posted_at timestamp_ntz, posted_date date, crawled_at timestamp_ntz, price_krw long"
    at = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([(1, at, at.date(), at, 5), (2, at, at.date(), at, None), (3, dt.datetime(2026, 2, 1), at.date(), at, 0), (4, None, None, at, 7)], schema)
    assert [r.id for r in rows.orderBy(*ls.final_order("price_desc")).collect()] == [4, 1, 3, 2]
    assert [r.id for r in rows.orderBy(*ls.final_order("posted_asc")).collect()] == [4, 2, 1, 3]
    assert rows.where(ls.search_filter(ls.Search(date_from="bad", price_from="x"), rows.columns)).count() == 4
    assert rows.where(ls.search_filter(ls.Search(price_to="6"), rows.columns)).count() == 2


def test_owners_are_distinct(spark):
    rows = [(i, "010-0000-1234 010 0000 1234", f"s{i % 5}", "http://www.a.com", dt.datetime(2026, 1, 1 + i)) for i in range(6)]
    base = spark.createDataFrame(rows, "id long, contact string, seller string, origin string, posted_at timestamp_ntz")
    full = base.select(*[F.col(f.name) if f.name in base.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in sources.LISTINGS])
    r = owners.roll_up(full).collect()
    assert [(x.phone, x.listing_count, x.sellers, x.sites, x.latest_posted) for x in r] == [("01000001234", 6, "s0, s4, s3", "a", "2026-01-06 00:00:00")]
    assert owners.roll_up(full, "nobody").count() == 0 and owners.listings_of(full, "+82-10-0000-1234").count() == 6


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name\n1,가\n2,\"x,y\"\n", encoding="utf-8")
    text, typed = sources.csv_text(spark, str(tmp_path / "a.csv")), sources.csv_typed(spark, str(tmp_path / "a.csv"))
    assert text.dtypes == [("id", "string"), ("name", "string")] and dict(typed.dtypes)["id"] == "int"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "site1.json").write_text('{"page":{"status":200}}')
    assert sources.json_documents(spark, str(tmp_path / "j"), "page struct<status:int>").first().slug == "site1"
    assert sources.captured_bodies(spark, str(tmp_path / "j")).first().length == 23
    assert sources.existing(spark, [str(tmp_path / "a.csv"), str(tmp_path / "none")]) == [str(tmp_path / "a.csv")]
    assert sources.tasks_or_empty(spark, "no_such_table").count() == 0
    assert sources.resolve_sites() == sources.resolve_sites(["https://www.4396200.com", "green_heavy"]) == ["green_heavy"]
    spark.conf.set("shale.batch", "7")
    assert sources.Config.from_conf(spark).batch == "7" or sources.Config.from_conf(spark).batch == 7
    sinks.write_csv(text, str(tmp_path / "out"))
    assert sources.csv_text(spark, str(tmp_path / "out")).columns == ["id", "name"]
    sinks.append_log(text.withColumn("u", F.lit("http://a:b@c")), str(tmp_path / "log"))
    sinks.append_log(text.withColumn("u", F.lit("x")), str(tmp_path / "log"))
    logged = spark.read.json(str(tmp_path / "log"))
    assert logged.count() == 4 and logged.where("u = 'http://***:***@c'").count() == 2
    report = sinks.markdown("T", [("S", text, 1)])
    assert report.startswith("# T\n\n## S") and report.count("\n|") == 3
    sinks.capture(spark.createDataFrame([("s1", "text/html", "<p>")], "slug string, content_type string, body string"), str(tmp_path / "cap"))
    assert spark.read.parquet(str(tmp_path / "cap")).first().response_extension == "html"
    shell = spark.range(1).select(sinks.curl(F.lit("POST"), F.lit("http://h/?a='"), F.array(F.lit("A: b")), F.lit("x=1")).alias("c")).first().c
    assert shell == "curl -L \\\n  -X POST \\\n  \"http://h/?a='\" \\\n  -H 'A: b' \\\n  --data 'x=1'"
    import pytest

    with pytest.raises(ValueError):
        sinks.identifier("a; drop")
    with pytest.raises(ValueError):
        sources.resolve_sites(["nope"])


def test_survey_rows_and_summary(spark):
    seeds = spark.createDataFrame([(1, "A", True), (2, "B", False)], "seed_no int, name string, original boolean")
    pages = spark.createDataFrame([(1, "http://h.com/x?page=2", "총 게시물 5건", 1), (1, "http://h.com/y", "", 2)], "seed_no int, url string, html string, pos int")
    best = survey.best_pages(survey.analyzed(pages), "seed_no", "pos").withColumn("attempted", F.array(F.lit("a [200]"), F.lit("b [404]")))
    got = {r.seed_no: r for r in survey.survey_rows(seeds, best, F.lit("2026-05-02")).collect()}
    assert (got[1].listing_count, got[1].crawl_fields, got[1].attempted) == (5, "query_params=page=2 | page | requests+BeautifulSoup 가능", "a [200] || b [404]")
    assert (got[2].listing_count, got[2].flag) == (0, "N")
    s = ls_summary(spark)
    assert (s.records, s.priced, dict(s.queue)) == (2, 1, {"done": 2, "pending": 1})


def ls_summary(spark):
    records = spark.createDataFrame([(1, 5), (2, None)], "id int, price_krw long")
    return tk.run_summary(records, spark.createDataFrame([("done",), ("done",), ("pending",)], "status string")).first()


def test_ranks_are_distributed(spark):
    from shale import storage

    df = spark.range(1000, numPartitions=7).withColumn("v", (F.col("id") * 7919) % 1000)
    got = {r.v: r.rank for r in storage.ranked(df, [F.desc("v")]).collect()}
    assert got == {v: 1000 - v for v in range(1000)}
    assert storage.ranked(df.limit(0), [F.desc("v")]).count() == 0


def test_scratch_leaves_nothing(spark, tmp_path):
    import os
    from concurrent.futures import ThreadPoolExecutor

    from shale import storage

    at = storage.shared_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, n) for d, _, names in os.walk(at) for n in names}
    before = files()

    def one(i):
        with storage.scratch(spark):
            rows = storage.stored(storage.kept(spark.range(i * 10)), "x")
            inner = storage.kept(rows)
            with storage.scratch(spark):
                assert storage.kept(inner).count() == i * 10
            assert inner.count() == rows.count() == i * 10  # the inner scratch has left these alone

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(one, [1, 2, 3]))
    assert files() == before


def test_pages_are_read_in_short_runs(spark, monkeypatch):
    """Where a site stops doesn't depend on the runs of pages that are looked at together."""
    import random

    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]) if s > 5 else f"s{s}", s, p, rng.choice([0, 0, 0, 2, None])) for s in range(9) for p in range(1, rng.randrange(2, 40))]
    want = []
    for site in {(r[0], r[1]) for r in rows}:
        empty = 0
        for r in sorted((r for r in rows if r[:2] == site), key=lambda r: r[2]):
            want.append(r)
            empty = 0 if r[3] else empty + 1
            if empty > 2:
                break
    pages = spark.createDataFrame(rows, "site string, part int, page int, found int")
    for run in (3, 5, 4096):
        monkeypatch.setattr(tk, "PAGES", run)
        assert sorted(map(str, (tuple(r) for r in tk.pages_read(pages, ["site", "part"], "page", "found").collect()))) == sorted(map(str, want))
    assert tk.pages_read(pages, ["site", "part"], "page", "found", max_pages=1).count() == 9 and tk.pages_read(pages.limit(0), ["site", "part"], "page", "found").count() == 0


def test_owners_follow_all_listings(spark):
    n = ls.PRE_LIMIT + 1
    rows = spark.range(n).select("id", F.lit("010-1234-5678").alias("contact"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("posted_at", "crawled_at")], F.lit(None).cast("date").alias("posted_date"))
    assert owners.source_rows(rows).count() == n
    assert owners.source_rows(rows.withColumn("contact", F.lit(" "))).isEmpty()


def test_pages_are_parsed_in_slices(spark, monkeypatch):
    """A batch holds thousands of pages; no more of them than a slice's bytes are in Python at a time, in what it yields as well."""
    import pyarrow as pa

    page_ = "<title>t</title>" + "<a href='/x'>y</a>" * 200
    out = list(html._parse(iter([pa.array([page_, None] * 2000)])))
    assert sum(map(len, out)) == 4000 and max(map(len, out)) <= 2 * html.PARSED_BYTES / len(page_) + 1
    assert {len(p["links"]) for x in out for p in x.to_pylist()} == {200, 0}
    excerpts = list(tx._excerpts(iter([pa.array(['"' + "x" * 13_000 + '"', "no json", None] * 500)])))
    assert sum(map(len, excerpts)) == 1500 and max(x.nbytes for x in excerpts) < 2 * tx.EXCERPT_BYTES
    monkeypatch.setattr(html, "PARSED_BYTES", 100)
    rows = spark.createDataFrame([(i, f"<title>{i}</title><p>" + "z" * (i * 7 % 150), "{}") for i in range(300)] + [(300, None, None)], "i long, h string, j string").coalesce(2)
    got = rows.select("i", html.page(F.col("h"))["title"].alias("t"), tx.json_excerpt(F.col("j"))["language"].alias("l")).collect()
    assert sorted((r.i, r.t, r.l) for r in got) == [(i, str(i) if i < 300 else None, "json" if i < 300 else None) for i in range(301)]


def test_memory_of_a_parse_follows_the_slice(monkeypatch):
    """A batch of sixteen times the pages takes no more of Python's memory than one of a few slices."""
    import tracemalloc

    import pyarrow as pa

    page_ = "<title>t</title>" + "<table><tr><th>k</th><td>v</td></tr></table><a href='/x'>y</a>" * 20
    monkeypatch.setattr(html, "PARSED_BYTES", 1 << 15)

    def peak(n):
        batch = pa.array([page_] * n)
        tracemalloc.start()
        assert sum(map(len, html._parse(iter([batch])))) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(800) < 1.5 * peak(50)


def test_memory_of_a_page_follows_its_length():
    """Elements that are left open don't each keep what comes after them."""
    import tracemalloc

    def peak(n):
        page_ = "<title>t</title>" + "<p>abc " * n + "<a href='/x'>y<b>z"
        tracemalloc.start()
        p = html.parse_page(page_)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert p["links"] == [{"href": "/x", "label": "y z"}] and p["text"] == " ".join(["t", *["abc"] * n, "y", "z"])
        return most

    assert peak(1600) < 3 * peak(800)


def test_cut_entities_are_characters(spark):
    """An entity that lost its semicolon where a title was cut is its character, as HTML has it; what is no entity stays."""
    pages = spark.createDataFrame([(1, "<title>a = &quot</title><h1>a = &quot</h1>"), (2, "<title>b &amp</title>"), (3, "<title>c &quo</title>")], "page_id long, html string")
    rows = html.with_page(pages).select("page_id", html.title(html.F.col("page")).alias("t"), "page.text").collect()
    assert {r.page_id: r.t for r in rows} == {1: 'a = "', 2: "b &", 3: "c &quo"}
    assert {r.page_id: r.text for r in rows}[1] == 'a = " a = "'
