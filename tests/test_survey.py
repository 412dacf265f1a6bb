"""The survey's frontier against a queue that is walked page by page."""

import random

from pyspark.sql import functions as F

from shale.operators import survey


def walked(seeds, pages, rounds, most=12):
    """seeds: ordered URLs; pages: url -> [(score, link)] in page order."""
    queue = list(dict.fromkeys(seeds))
    own = len(queue)
    begin = 0
    for _ in range(rounds):
        end = len(queue)
        found = [x for u in queue[begin:end] for _, _, x in sorted([(-n, i, x) for i, (n, x) in enumerate(pages.get(u, [])) if n > 0])[:7]]
        queue = list(dict.fromkeys([*queue, *found]))
        queue = queue[: max(own, most)]
        begin = end
    return queue


#: Labels and the scores that they give to '/x' links. 'list' in the path adds two.
LABELS = {"매물": 4, "중고 장비": 8, "회사소개": -3, "": -2, "text": 0, "goods used": 8}


def test_frontier_is_the_walk(spark):
    rng = random.Random(5)
    seeds, rows, want = [], [], {}
    for site in range(12):
        host = f"http://s{site}.example.com"
        pages = {}
        for p in range(30):
            links = [(rng.choice(list(LABELS)), f"/{'list' if rng.random() < 0.7 else 'x'}/{rng.randrange(34)}") for _ in range(rng.randrange(12))]
            score = lambda label, href: LABELS[label] + (2 if "list" in href else 0)
            best, scored = set(), []
            for label, href in links:  # a link counts where it first has a score
                n = score(label, href)
                if n > 0 and href not in best:
                    best.add(href)
                    scored.append((n, host + href))
            for kind in ("list", "x"):
                pages[f"{host}/{kind}/{p}"] = scored
                rows.append((f"{host}/{kind}/{p}", "".join(f'<a href="{h}">{label}</a>' for label, h in links)))
        own = [f"{host}/list/{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 3, 11, 12, 14]))] + ["", f"{host}/list/1"]
        seeds += [(site, i, u) for i, u in enumerate(own)] + [(site, 99, None)]
        for rounds in (1, 3):
            want[site, rounds] = walked([u for u in own if u], pages, rounds)
    captured = spark.createDataFrame(rows, "url string, html string")
    frame = spark.createDataFrame(seeds, "seed_no int, pos int, url string")
    for rounds in (1, 3):
        got = {}
        for r in survey.frontier(frame, captured, rounds).orderBy("seed_no", "place").collect():
            got.setdefault(r.seed_no, []).append(r.requested)
        assert got == {s: q for (s, n), q in want.items() if n == rounds}
    assert survey.frontier(frame.limit(0), captured).count() == 0
    assert survey.surveyed(frame, captured.limit(0)).where(F.col("attempted")[0].endswith("[not captured]")).count() == 12
