"""Robots rules, sitemaps and the crawl frontier, for all sites at once."""

from __future__ import annotations

import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import url as U
from ..functions.udf import arrow
from ..session import cut

# Bounds of a crawl.
MAX_RULES, MAX_SITEMAPS, MAX_DELAY = 2_000, 20, 10.0
MAX_DEPTH, MAX_PAGES, SITEMAP_URLS, GAP_MS = 2, 25, 50, 250


def parse_robots(files: DataFrame, agent: str = "brandloom") -> tuple[DataFrame, DataFrame]:
    """files(site, url, body) -> rules(site, path, allow, delay), sitemaps(site, ord, url).

    Lines become rows; a group starts at a User-agent line that does not follow another one (sitemap lines between do not end the run).
    Groups that name the agent apply, else those for '*'.
    """
    lines = files.select("site", "url", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.withColumn("line", bare).filter(F.instr("line", ":") > 0)
    name = F.lower(F.trim(F.substring_index("line", ":", 1)))
    lines = lines.select("site", "url", "n", name.alias("name"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    sitemaps = lines.filter("name = 'sitemap'")
    rules = lines.filter("name <> 'sitemap'")
    by = Window.partitionBy("site").orderBy("n")
    starts = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(by), F.lit("")) != "user-agent")
    rules = rules.withColumn("grp", F.sum(starts.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("grp > 0")
    product = F.regexp_extract(F.lower("value"), r"^([^\s/(]*)", 1)
    agents = rules.filter("name = 'user-agent'").groupBy("site", "grp").agg(F.max((product == agent).cast("int")).alias("ours"), F.max((F.col("value") == "*").cast("int")).alias("star"))
    agents = agents.withColumn("any_ours", F.max("ours").over(Window.partitionBy("site")))
    chosen = agents.filter((F.col("ours") == 1) | (F.col("any_ours") == 0) & (F.col("star") == 1)).select("site", "grp")
    mine = rules.join(chosen, ["site", "grp"])
    nth = F.row_number().over(Window.partitionBy("site", "grp").orderBy("n"))
    paths = mine.filter("name in ('allow', 'disallow') and value <> ''").withColumn("_n", nth).filter(F.col("_n") <= MAX_RULES)
    wait = F.col("value").try_cast("double")
    last = mine.filter((F.col("name") == "crawl-delay") & (wait >= 0)).groupBy("site", "grp").agg(F.max_by(F.least(wait, F.lit(MAX_DELAY)), "n").alias("d"))
    delays = last.groupBy("site").agg(F.max("d").alias("delay"))
    out = paths.select("site", F.col("value").alias("path"), (F.col("name") == "allow").alias("allow")).join(delays, "site", "full_outer")
    found = sitemaps.withColumn("sitemap", _resolve("value", "url")).filter(U.same_site("sitemap", "url"))
    first = found.groupBy("site", "sitemap").agg(F.min("n").alias("n"))
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("n"))).filter(F.col("ord") <= MAX_SITEMAPS)
    return out, ranked.select("site", "ord", F.col("sitemap").alias("url"))


@arrow("string")
def _resolve(value: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([U.canonical(v, b) for v, b in zip(value, base)], dtype=object)


def pattern_regex(pattern: Column) -> Column:
    """Robots path pattern as a regular expression: '*' for anything, a final '$' for the end, else a prefix."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([\\.^$|?+(){}\[\]])", r"\\$1"), r"\*+", ".*")
    return F.concat(F.lit("^"), escaped, F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def matches_pattern(pattern: Column, path: Column) -> Column:
    return F.regexp_like(path, pattern_regex(pattern))


def allowed_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(site, path, ...) + allowed: the longest matching rule decides, allow on ties; no rule allows.

    A site's rules (robots files are bounded) are one array, the deciding ones first, tried within the row of each path.
    """
    rule = F.struct((-F.length("path")).alias("order"), (~F.col("allow")).alias("denies"), pattern_regex(F.col("path")).alias("rx"))
    per_site = rules.filter("path is not null").groupBy("site").agg(F.sort_array(F.collect_list(rule)).alias("_rules"))
    slashed = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))
    fits = F.filter("_rules", lambda r: F.regexp_like(slashed, r["rx"]))
    return urls.join(per_site, "site", "left").withColumn("allowed", F.coalesce(~F.get(fits, F.lit(0))["denies"], F.lit(True))).drop("_rules")


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """sitemaps(site, ord, base_url, body) -> site, ord, url: <loc> entries of the same site, two sitemaps and fifty urls a site."""
    two = sitemaps.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("ord"))).filter("_n <= 2")
    rows = two.select("site", "base_url", "_n", F.posexplode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))).alias("k", "raw"))
    rows = rows.withColumn("url", F.trim(F.regexp_replace("raw", "&amp;", "&"))).filter(F.col("url").rlike("(?i)^https?://") & U.same_site("url", "base_url"))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("_n", "k"))).filter(F.col("ord") <= SITEMAP_URLS).select("site", "ord", "url")


def priority_urls(sites: DataFrame) -> DataFrame:
    """sites(site, base_url) -> site, ord, url: the fixed paths worth a visit."""
    paths = F.array(*[F.lit(p) for p in U.PRIORITY_PATHS])
    rows = sites.select("site", "base_url", F.posexplode(paths).alias("ord", "path"))
    return rows.select("site", (F.col("ord") + 1).alias("ord"), F.concat(U.base_domain("base_url"), "path").alias("url"))


def next_level(links: DataFrame, seen: DataFrame, taken: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """links(site, seq, url) not in seen(site, url): first of each url, priority paths first, up to what is left of `limit` per site."""
    new = links.groupBy("site", "url").agg(F.min("seq").alias("seq")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
    ranked = new.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy(F.when(U.is_priority_path(U.path("url")), 0).otherwise(1), "seq")))
    left = F.lit(limit) - F.coalesce("n_taken", F.lit(0))
    return ranked.join(taken, "site", "left").filter(F.col("_n") <= left).select("site", "url", F.col("_n").alias("ord"))


VISIT = "site string, ord int, depth int, url string, outcome string"


def _facts(wanted: DataFrame, corpus: DataFrame, rules: DataFrame | None) -> DataFrame:
    """wanted(site, url) + links, final_url (null: no such page), allowed, class (0: worth a visit first)."""
    found = wanted.join(corpus, "url", "left").withColumn("path", U.path("url"))
    found = found.withColumn("allowed", F.lit(True)) if rules is None else allowed_urls(found, rules)
    return found.withColumn("class", F.when(U.is_priority_path(F.col("path")), 0).otherwise(1)).drop("path")


def _pushes(pages: DataFrame, origins: DataFrame) -> DataFrame:
    """The links that a page would push: site, src, k, url; those of the site, the first of each url."""
    read = pages.filter("allowed and final_url is not null").join(origins, "site").filter(U.same_site("final_url", "origin"))
    rows = read.select("site", "origin", F.col("url").alias("src"), F.posexplode("links").alias("k", "link")).withColumn("url", U.normalise_url("link")).filter(U.same_site("url", "origin"))
    return rows.groupBy("site", "src", "url").agg(F.min("k").alias("k"))


def _replay(limit: int, depth: int):
    """One site's crawl: a queue that is sorted again, priority paths first, after every page's links are pushed; robots rules and the page itself are looked at on pop."""

    def run(key, nodes, edges):
        facts = {u: (f, a, c, same) for u, f, a, c, same in zip(*(nodes.column(x).to_pylist() for x in ("url", "final_url", "allowed", "class", "same")))}
        start = next((u for u, first in zip(nodes.column("url").to_pylist(), nodes.column("first").to_pylist()) if first), None)
        pushed: dict = {}
        for src, _, url in sorted(zip(*(edges.column(x).to_pylist() for x in ("src", "k", "url"))), key=lambda e: (e[0] or "", e[1])):
            pushed.setdefault(src or "", []).append(url)
        queue, known, done, kept, out = [], set(), set(), 0, []

        def push(urls, level):
            for url in urls:
                if url not in known and url not in done:
                    known.add(url)
                    heapq.heappush(queue, (facts[url][2], len(known), url, level))

        def visit(url, level):
            final, allowed, _, same = facts[url]
            done.add(url)
            if not allowed or final is None:
                return "blocked" if not allowed else "failed"
            if not same:
                return "off site"
            if final != url and final in done:
                return "known"
            done.add(final)
            if level < depth:
                push(pushed.get(url, ()), level + 1)
            return "visited"

        turns = [(start, 0)] if start is not None else []
        while turns or queue:
            if kept >= limit:
                break
            url, level = turns.pop() if turns else heapq.heappop(queue)[2:]
            if level and url in done:
                continue
            known.add(url)
            outcome = visit(url, level)
            kept += outcome == "visited"
            out.append((key[0].as_py(), len(out) + 1, level, url, outcome))
            if not level:
                push(pushed.get("", ()), 1)
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.table({f.split()[0]: pa.array(c, t) for f, c, t in zip(VISIT.split(", "), columns, kinds)})

    return run


def visits(starts: DataFrame, corpus: DataFrame, rules: DataFrame | None = None, seeds: DataFrame | None = None, depth: int = MAX_DEPTH, limit: int = MAX_PAGES) -> DataFrame:
    """starts(site, url) over corpus(url, links array, optional final_url) -> VISIT: every url that a crawler with one worker takes from its queue, in order.

    The start page comes first, its links and then `seeds(site, ord, url)` are pushed at depth 1, and so on until `limit` pages are kept. An outcome is visited, blocked (robots), failed (no such page),
    known (a redirect to a page that is there) or off site. A site's replay gets the facts of urls within reach, not the site: pages of depth 1 open in the order of their push, priority paths among themselves and the others among themselves, and at
    most `limit` are kept besides as many that were known, so of each kind the links of the first 2 * limit + 1 pages can matter, and no others are read.
    """
    pages = corpus.select(U.normalise_url("url").alias("url"), F.coalesce(U.normalise_url("final_url"), U.normalise_url("url")).alias("final_url") if "final_url" in corpus.columns else U.normalise_url("url").alias("final_url"), "links")
    first = cut(_facts(starts.select("site", U.normalise_url("url").alias("url")), pages, rules))
    origins = first.select("site", F.coalesce(F.when(F.col("allowed"), F.col("final_url")), F.col("url")).alias("origin"))
    edges = _pushes(first, origins)
    if seeds is not None:
        edges = edges.unionByName(seeds.select("site", F.lit(None).cast("string").alias("src"), U.normalise_url("url").alias("url"), F.col("ord").cast("int").alias("k")))
    edges = level = cut(edges)
    known = first.withColumn("first", F.lit(True))
    for d in range(1, depth + 1):
        new = level.groupBy("site", "url").agg(F.min(F.struct(F.col("src").isNull().alias("late"), F.col("k"))).alias("at")).join(known.select("site", "url"), ["site", "url"], "left_anti")
        facts = _facts(new, pages if d < depth else pages.drop("links"), rules)
        if d < depth:
            facts = cut(facts)
            kind = ["site", "class"]
            opens = facts.filter("allowed and final_url is not null").join(origins, "site").filter(U.same_site("final_url", "origin")).drop("origin")
            opens = opens.withColumn("_new", (F.row_number().over(Window.partitionBy(*kind, "final_url").orderBy("at", "url")) == 1).cast("int"))
            before = Window.partitionBy(*kind).orderBy("at", "url").rowsBetween(Window.unboundedPreceding, -1)
            opens = opens.withColumn("_before", F.coalesce(F.sum("_new").over(before), F.lit(0)))
            level = cut(_pushes(opens.filter(F.col("_before") <= 2 * limit) if d == 1 else opens, origins))
            edges = edges.unionByName(level)
        known = known.select("site", "url", "final_url", "allowed", "class", "first").unionByName(facts.select("site", "url", "final_url", "allowed", "class", F.lit(False).alias("first")))
    nodes = known.join(origins, "site").withColumn("same", U.same_site("final_url", "origin")).select("site", "url", "final_url", "allowed", "class", "same", "first")
    return nodes.groupBy("site").cogroup(edges.select(F.col("site").alias("edge_site"), "src", "k", "url").groupBy("edge_site")).applyInArrow(_replay(limit, depth), VISIT)


def crawl(starts: DataFrame, corpus: DataFrame, rules: DataFrame | None = None, seeds: DataFrame | None = None, depth: int = MAX_DEPTH, limit: int = MAX_PAGES) -> DataFrame:
    """The pages that `visits` keeps: site, depth, ord, url."""
    return visits(starts, corpus, rules, seeds, depth, limit).filter("outcome = 'visited'").select("site", "depth", "ord", "url")


def start_slots(requests: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """requests(site, seq, arrive_ms) + start_ms, at least `gap_ms` apart in order of seq.

    slot_i = max(arrive_i, slot_(i-1) + gap) unrolls to i * gap + the running maximum of arrive_j - j * gap.
    """
    by = Window.partitionBy("site").orderBy("seq")
    i = F.row_number().over(by)
    rows = requests.withColumn("_i", i)
    best = F.max(F.col("arrive_ms") - F.col("_i") * gap_ms).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_ms", F.col("_i") * gap_ms + best).drop("_i")


def progress(done: Column, found: Column) -> Column:
    """Percent of a crawl: 5 to 45."""
    share = F.least(F.lit(1.0), done / F.least(F.lit(MAX_PAGES), F.greatest(found, F.lit(1))))
    return F.floor(5 + 40 * share + 0.5).cast("int")
