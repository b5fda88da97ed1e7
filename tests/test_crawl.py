"""The crawl queue against a sequential replay that knows all pages and sorts a list."""

import random

import pytest

from brandloom.functions import url as U
from brandloom.operators import crawl

R = random.Random(8)


def _priority(url):
    path = "/" + url.split("?")[0].split("/", 3)[-1] if url.count("/") > 2 else "/"
    return 0 if any(path.lower().rstrip("/") == p.rstrip("/") or path.lower().startswith(p.rstrip("/") + "/") and p != "/" for p in U.PRIORITY_PATHS) else 1


def _brute(start, pages, denied, seeds, limit, depth, same):
    queue, queued, visited, log, kept = [], {start}, set(), [], 0

    def add(urls, d):
        for u in urls:
            if u not in visited and u not in queued:
                queue.append((u, d))
                queued.add(u)
        queue.sort(key=lambda x: _priority(x[0]))  # stable

    def one(u, d):
        nonlocal kept
        visited.add(u)
        if denied(u):
            return "blocked"
        if u not in pages:
            return "failed"
        final, links = pages[u]
        if not same(final):
            return "off site"
        if final != u and final in visited:
            return "known"
        visited.add(final)
        kept += 1
        if d < depth:
            add([x for x in links if same(x)], d + 1)
        return "visited"

    log.append((start, 0, one(start, 0)))
    add(seeds, 1)
    while queue and kept < limit:
        u, d = queue.pop(0)
        if u not in visited:
            log.append((u, d, one(u, d)))
    return log


@pytest.mark.parametrize(("limit", "depth"), [(25, 2), (4, 2), (9, 1), (9, 3)])
def test_visits_equal_a_replay(spark, limit, depth):
    starts, corpus, seeds, rules, want = [], [], [], [], {}
    for n in range(12):
        site = f"s{n}.org"
        full = lambda p: f"https://{site}{p}"  # noqa: B023, E731
        paths = ["/", *[f"/{R.choice(['about', 'blog', 'p', 'q', 'press'])}/{k}" for k in range(R.randrange(3, 90))]]
        urls = list(map(full, paths))
        somewhere = [*urls, full("/gone"), full("/contact"), full("/p/x"), "https://else.org/a", f"https://www.{site}/blog/w"]
        pages = {u: (R.choice(urls) if R.random() < 0.15 else f"https://else.org/{u[-2:]}" if R.random() < 0.2 else u, [R.choice(somewhere) for _ in range(R.choice([0, 2, 9, 40]))]) for u in urls if R.random() < 0.93 or u == urls[0]}
        pages[urls[0]] = (urls[0] if n % 4 else urls[-1], pages[urls[0]][1])
        own = [(site, p, a) for p, a in [("/p/1", False), ("/p/12", True), ("/*7$", False), ("/", n != 5)]]
        put = [full(p) for p in R.sample(["/about", "/contact", "/blog", "/p/3", "/q/4", "/none"], 4)]
        corpus += [(u, f, links) for u, (f, links) in pages.items()]
        starts.append((site, urls[0]))
        seeds += [(site, k, u) for k, u in enumerate(put)]
        rules += own

        def denied(u, own=own):
            path = "/" + u.split("/", 3)[3]
            fits = [(len(p), a) for _, p, a in own if (path.endswith("7") if p == "/*7$" else path.startswith(p))]
            return bool(fits) and not max(fits)[1]

        same = lambda u: u.split("/")[2].removeprefix("www.") == site  # noqa: B023, E731
        want[site] = _brute(urls[0], pages, denied, put, limit, depth, same)
    got = {}
    frames = [spark.createDataFrame(*x) for x in ((starts, "site string, url string"), (corpus, "url string, final_url string, links array<string>"), (rules, "site string, path string, allow boolean"), (seeds, "site string, ord int, url string"))]
    rows = crawl.visits(frames[0], frames[1], frames[2], frames[3], depth, limit).orderBy("site", "ord").collect()
    for r in rows:
        got.setdefault(r.site, []).append((r.url, r.depth, r.outcome))
    assert got == want
    assert limit < 25 or {"visited", "blocked", "failed", "known", "off site"} <= {o for log in got.values() for *_, o in log}


def test_nothing_to_crawl(spark):
    starts = spark.createDataFrame([("a.org", "https://a.org/"), ("b.org", "b.org")], "site string, url string")
    corpus = spark.createDataFrame([("https://b.org/", None)], "url string, links array<string>")
    assert [(r.site, r.outcome) for r in crawl.visits(starts, corpus).orderBy("site").collect()] == [("a.org", "failed"), ("b.org", "visited")]
    assert crawl.crawl(starts.limit(0), corpus).count() == 0
