"""The crawl queue as a fold over ordered transitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shale import storage
from shale.operators.listings import TASK_DEFAULT, TASK_MOST, TASK_SITES, both, clamp

COOL_DOWN, LEAST_WAIT, ERROR_CHARS, GRACE = 900, 60, 2000, 2
STATE = "struct<status:string,attempts:int,last_status_code:int,last_error:string,next_run_at:timestamp,success_at:timestamp,updated_at:timestamp>"


def back_off(status_code: Column, sleep: Column) -> Column:
    """Seconds to wait after an error."""
    return F.when(status_code == 400, F.lit(COOL_DOWN)).otherwise(F.greatest(F.lit(LEAST_WAIT), F.floor(20 * sleep))).cast("int")


def transition(state: Column, e: Column) -> Column:
    """The state after event e (kind, at, code, error, wait); kinds: enqueue, enqueue_reset, start, done, retry, recover."""
    old, kind = state["status"], e["kind"]
    queued = kind.isin("enqueue", "enqueue_reset")
    running, reset = F.coalesce(old == "running", F.lit(False)), kind == "enqueue_reset"
    fresh = old.isNull()
    again = reset & ~running
    status = (
        F.when(queued & running, F.lit("running")).when((kind == "enqueue") & F.coalesce(old == "done", F.lit(False)), F.lit("done")).when(queued, F.lit("pending"))
        .when(kind == "start", F.lit("running")).when(kind == "done", F.lit("done")).when(kind == "retry", F.lit("pending")).when((kind == "recover") & running, F.lit("pending")).otherwise(old)
    )
    attempts = F.when(fresh | again, F.lit(0)).when(kind == "retry", state["attempts"] + 1).otherwise(state["attempts"])
    clears = queued | (kind == "done")
    wait = F.timestamp_seconds(F.unix_micros(e["at"]) / 1_000_000 + e["wait"])
    return F.struct(
        status.alias("status"),
        F.when(fresh & (kind == "retry"), F.lit(1)).otherwise(attempts).cast("int").alias("attempts"),
        F.when(clears, F.lit(None)).when(kind == "retry", e["code"]).otherwise(state["last_status_code"]).cast("int").alias("last_status_code"),
        F.when(clears, F.lit(None)).when(kind == "retry", F.substr(e["error"], F.lit(1), F.lit(ERROR_CHARS))).otherwise(state["last_error"]).alias("last_error"),
        F.when(clears, F.lit(None)).when(kind == "retry", wait).otherwise(state["next_run_at"]).cast("timestamp").alias("next_run_at"),
        F.when(kind == "done", e["at"]).when(again, F.lit(None)).otherwise(state["success_at"]).cast("timestamp").alias("success_at"),
        e["at"].alias("updated_at"),
    ).cast(STATE)


#: What a task may have been before a run of transitions: no task, or in one of the three states.
STARTS = (None, "pending", "running", "done")
#: Transitions that one list holds at most; pages that are looked at in one window.
RUN = PAGES = 4096
EFFECT = f"struct<state:{STATE},attempts:boolean,errors:boolean,success:boolean>"


def _effect(x: Column, e: Column) -> Column:
    """The effect x, of earlier transitions, followed by event e. attempts, errors, success: whether these no longer depend on the start."""
    after = transition(x["state"], e)
    queued, running = e["kind"].isin("enqueue", "enqueue_reset"), F.coalesce(x["state"]["status"] == "running", F.lit(False))
    again = (e["kind"] == "enqueue_reset") & ~running
    cleared = queued | e["kind"].isin("done", "retry")
    return F.struct(
        after.alias("state"), (x["attempts"] | again | x["state"]["status"].isNull()).alias("attempts"), (x["errors"] | cleared).alias("errors"), (x["success"] | again | (e["kind"] == "done")).alias("success"),
    ).cast(EFFECT)


def _start(status: str | None) -> Column:
    """The effect of nothing on a task of that status, with no attempts."""
    none = F.lit(None)
    state = F.struct(F.lit(status).alias("status"), F.lit(None if status is None else 0).alias("attempts"), *[none.alias(c) for c in ("last_status_code", "last_error", "next_run_at", "success_at", "updated_at")])
    return F.struct(state.alias("state"), *[F.lit(False).alias(c) for c in ("attempts", "errors", "success")]).cast(EFFECT)


def _applied(x: Column, then: Column) -> Column:
    """Effect x followed by the effects `then` (an array by STARTS)."""
    place = lambda status: F.when(status.isNull(), 0).when(status == "pending", 1).when(status == "running", 2).otherwise(3)

    def joined(e: Column) -> Column:
        old, new = x["state"], e["state"]
        later = lambda flag, c: F.when(e[flag], new[c]).otherwise(old[c]).alias(c)
        attempts = F.when(e["attempts"], new["attempts"]).otherwise(old["attempts"] + new["attempts"])
        state = F.struct(new["status"].alias("status"), attempts.cast("int").alias("attempts"), *[later("errors", c) for c in ("last_status_code", "last_error", "next_run_at")], later("success", "success_at"), F.coalesce(new["updated_at"], old["updated_at"]).alias("updated_at"))
        return F.struct(state.alias("state"), *[(x[c] | e[c]).alias(c) for c in ("attempts", "errors", "success")]).cast(EFFECT)

    return F.get(F.transform(F.array(F.get(then, place(x["state"]["status"]))), joined), F.lit(0))


def fold(events: DataFrame, keys: list[str], order: list[str], run: int = RUN) -> DataFrame:
    """The last state of each key after its events (kind, at, code, error, wait) in order.

    Keys of at most `run` events are folded from one list each. The others are folded in runs: a run of transitions is what it does
    to a task in each of the states that it may have been in. Their events get their place in a distributed sort; runs of `run`
    places are folded first, then runs of these, so no list holds such a key's events, however many there are.
    """
    columns = [F.col(c) for c in (*keys, *order, *[c for c in ("kind", "at", "code", "error", "wait") if c not in order])]
    event = F.struct("kind", "at", "code", "error", "wait")
    large = storage.kept(events.groupBy(*keys).count().where(F.col("count") > run).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    own = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*columns[len(keys) :]).alias("o"), event.alias("_e")))), lambda x: x["_e"])
    some = not large.isEmpty()
    small = (events.join(large, same, "left_anti") if some else events).groupBy(*keys).agg(F.min("at").alias("created_at"), own.alias("_l"))
    small = small.select(*keys, "created_at", F.aggregate("_l", _start(None), _effect)["state"].alias("_s")).select(*keys, "created_at", "_s.*")
    return small.unionByName(_folded_in_runs(events.join(large, same, "left_semi"), keys, columns, event, run)) if some else small


def _folded_in_runs(events: DataFrame, keys: list[str], place: list[Column], event: Column, run: int) -> DataFrame:
    rows = storage.ranked(events, place, "_n").select(*keys, "at", F.col("_n").cast("long").alias("_n"), event.alias("_e"))
    starts = [_start(x) for x in STARTS]
    inner = lambda one: F.transform(F.array_sort(F.collect_list(F.struct("_n", one))), lambda x: x[one])
    rows = rows.groupBy(*keys, F.floor(F.col("_n") / run).alias("_n")).agg(F.min("at").alias("created_at"), inner("_e").alias("_l"))
    rows = rows.select(*keys, "_n", "created_at", F.array(*[F.aggregate("_l", x, _effect) for x in starts]).alias("_x"))
    while True:
        rows = storage.kept(rows)
        if not rows.groupBy(*keys).count().where("count > 1").limit(1).count():
            break
        rows = rows.groupBy(*keys, F.floor(F.col("_n") / run).alias("_n")).agg(F.min("created_at").alias("created_at"), inner("_x").alias("_l"))
        rows = rows.select(*keys, "_n", "created_at", F.array(*[F.aggregate("_l", x, _applied) for x in starts]).alias("_x"))
    return rows.select(*keys, "created_at", F.get("_x", F.lit(0))["state"].alias("_s")).select(*keys, "created_at", "_s.*")


def eligible(tasks: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """Pending tasks that may run now: by priority, then id."""
    ready = (F.col("status") == "pending") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= now))
    return tasks.where(ready).orderBy("priority", "id").limit(limit)


def recovered(tasks: DataFrame, now: Column, age: int | None = None) -> DataFrame:
    """Tasks left running (for longer than age seconds, if given) are pending again."""
    stale = F.col("status") == "running"
    if age is not None:
        stale = stale & (F.col("updated_at") <= now - F.expr(f"INTERVAL {age} SECOND"))
    return tasks.withColumns({"updated_at": F.when(stale, now).otherwise(F.col("updated_at")), "status": F.when(stale, F.lit("pending")).otherwise(F.col("status"))})


def last_crawled() -> Column:
    return F.coalesce("success_at", "updated_at", "created_at")


def task_filter(tasks: DataFrame, q: str = "", status: str = "", site: str = "") -> DataFrame:
    tests = []
    if status:
        tests.append(F.col("status") == status)
    if site:
        tests.append(F.col("site_slug") == site)
    if q.strip():
        found = F.lit(False)
        for c in ("url", "category_name", "last_error", "origin"):
            if c in tasks.columns:
                found = found | F.coalesce(F.col(c), F.lit("")).ilike(f"%{q.strip()}%")
        tests.append(found)
    return tasks.where(both(tests))


def site_name(slug: Column, origin: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for mark, name in TASK_SITES:
        out = out.when(slug == mark, F.lit(name))
    return out.otherwise(F.coalesce(F.nullif(slug, F.lit("")), F.nullif(origin, F.lit("")), F.lit("-")))


def view(tasks: DataFrame, limit=None, **filters) -> DataFrame:
    """Tasks in display order: unknown states, running, pending, done; then the latest, then the highest id."""
    at = F.coalesce(F.array_position(F.array(F.lit("running"), F.lit("pending"), F.lit("done")), F.col("status")), F.lit(0))
    rows = task_filter(tasks, **filters).withColumn("last_crawled_at", last_crawled())
    return rows.withColumn("status_order", at).orderBy("status_order", F.desc_nulls_last("last_crawled_at"), F.desc("id")).limit(clamp(limit, TASK_DEFAULT, TASK_MOST))


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count("*").alias("total"), F.max(last_crawled()).alias("latest"))


def counts_by(tasks: DataFrame, *keys: str) -> DataFrame:
    return tasks.groupBy(*keys).agg(F.count("*").alias("count"), F.max(last_crawled()).alias("latest"))


def status_pivot(tasks: DataFrame, by: str, states: tuple[str, ...] = ("running", "pending", "done")) -> DataFrame:
    return tasks.groupBy(by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in states])


def pages_read(pages: DataFrame, keys: list[str], page: str, found: str, grace: int = GRACE, max_pages: int | None = None) -> DataFrame:
    """The list pages that are read: up to the page after `grace` pages in a row without a record of the period.

    found: records of the period on a page. Whether a site stops at a page depends on the grace + 1 pages up to it only. So the
    pages get their places in one distributed sort, and are looked at in runs of places that overlap by the grace: no window
    holds a site's pages, however many it has.
    """
    rows = storage.kept(storage.ranked(pages.select(*keys, F.col(page).alias("_page"), (F.col(found) > 0).alias("_found")), [*[F.col(k) for k in keys], F.col("_page")], "_n"))
    run = max(PAGES, grace + 1)
    own = F.floor(F.col("_n") / run)
    both = F.when(F.pmod(F.col("_n"), F.lit(run)) >= run - grace, F.array(own, own + 1)).otherwise(F.array(own))
    # The place before a site's first page belongs to another site: a run is looked at for each site in it.
    last = Window.partitionBy(*keys, "_run").orderBy("_n").rowsBetween(-grace, 0)
    ends = rows.withColumns({"_own": own, "_run": F.explode(both)})
    ends = ends.withColumns({"_pages": F.count("*").over(last), "_any": F.max(F.coalesce("_found", F.lit(False))).over(last)})
    stops = ends.where((F.col("_run") == F.col("_own")) & (F.col("_pages") == grace + 1) & ~F.col("_any")).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_page").alias("_stop"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    out = pages.join(stops, same, "left").where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))).select(*pages.columns)
    return out.where(F.col(page) <= max_pages) if max_pages else out


def with_category(tasks: DataFrame) -> DataFrame:
    """category_code and category_name: the column before the metadata; broken metadata counts as none."""
    valid = F.when(F.try_parse_json("metadata_json").isNotNull(), F.col("metadata_json"))
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.get_json_object(valid, f"$.{c}"), F.lit(""))
    return tasks.withColumns({c: own(c) for c in ("category_code", "category_name")})


def run_summary(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: records, those with a price, and queue counts by state."""
    counts = tasks.agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("queue")) if "n" in tasks.columns else tasks.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("queue"))
    return records.agg(F.count("*").alias("records"), F.count("price_krw").alias("priced")).join(F.broadcast(counts))
