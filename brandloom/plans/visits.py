"""Queries over crawls: every page as a page of its top-level domain's one site, with links by its number."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import crawl
from ..sources.tables import table
from .catalog import query
from .fixtures import values

#: For all sites: robots rules, and links of the n-th page as (factor, add): to page (n * factor + add) of the site, which may be none.
_RULES = [("/page/2", False), ("/page/21", True), ("/*9$", False), ("/press/7", False)]
_LINKS = [(3, 1), (3, 2), (7, 5), (1, 1), (2, 40), (0, 0)]
_SEEDS = [4, 5, 1_000_000, 17]
#: Every eleventh page redirects to the one before; every sixth is one of three that are worth a visit first.
_URL = "'https://' || site || CASE WHEN n = 0 THEN '/' WHEN n % 6 = 1 THEN '/press/' || n WHEN n % 6 = 4 THEN '/Blog/' || n WHEN n % 18 = 3 THEN '/careers/' || n ELSE '/page/' || n END"


@query(f"""WITH RECURSIVE p AS (SELECT regexp_extract(lower(url), '^https?://[^/?#]*?([^./?#]+\\.[a-z]+)([:/?#]|$)', 1) AS site, page_id FROM pages),
r AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS n FROM p), s AS (SELECT site, count(*) AS size FROM p GROUP BY site),
rule(pattern, allow) AS (VALUES {values(_RULES)}),
x AS (SELECT r.site, n, a * n + b AS m, k FROM r, (VALUES {', '.join(f'({k}, {a}, {b})' for k, (a, b) in enumerate(_LINKS))}) AS l(k, a, b)),
e AS (SELECT site, n, m, min(k) AS k FROM x GROUP BY site, n, m UNION ALL SELECT site, 0, m, 100 + k FROM s, (VALUES {', '.join(f'({k}, {m})' for k, m in enumerate(_SEEDS))}) AS t(k, m)),
d AS (SELECT DISTINCT site, m AS n FROM e UNION SELECT site, 0 FROM s),
u AS (SELECT site, n, {_URL} AS url FROM d),
v AS (SELECT u.site, u.n, url, regexp_extract(url, '^https://[^/]*(.*)$', 1) AS path, u.n < size AS there, CASE WHEN u.n % 11 = 10 THEN u.n - 1 ELSE u.n END AS final FROM u JOIN s USING (site)),
w AS (SELECT v.*, coalesce((SELECT arg_max(allow, len(pattern) * 2 + CAST(allow AS INT)) FROM rule WHERE CASE WHEN pattern LIKE '%$' THEN path LIKE '%9' ELSE starts_with(path, pattern) END), true) AS allowed,
  CASE WHEN n = 0 OR n % 6 IN (1, 4) OR n % 18 = 3 THEN 0 ELSE 1 END AS class FROM v),
a AS (SELECT e.site, e.n, list({{'class': w.class, 'seq': e.k, 'm': e.m}} ORDER BY e.k) AS links FROM e JOIN w ON w.site = e.site AND w.n = e.m GROUP BY e.site, e.n),
step AS (SELECT site, 0 AS ord, [{{'class': 0, 'seq': 0, 'm': 0::BIGINT, 'depth': 0}}] AS queue, [0::BIGINT] AS known, []::BIGINT[] AS done, 0 AS kept, NULL::BIGINT AS n, 0 AS depth, NULL::VARCHAR AS outcome FROM s
  UNION ALL
  SELECT site, CASE WHEN outcome IS NULL THEN ord ELSE ord + 1 END, list_sort(list_concat(queue[2:], list_transform(new, lambda z: {{'class': z.class, 'seq': ord * 1000 + z.seq + 1, 'm': z.m, 'depth': depth + 1}}))), list_concat(known, list_transform(new, lambda z: z.m)),
    CASE WHEN outcome = 'visited' THEN list_concat(done, [n, final]) ELSE list_append(done, n) END, kept + CAST(coalesce(outcome = 'visited', false) AS INT), n, depth, outcome
  FROM (SELECT q.site, q.ord, queue, known, done, kept, queue[1].depth AS depth, w.n, final,
      CASE WHEN queue[1].depth > 0 AND list_contains(done, w.n) THEN NULL WHEN NOT allowed THEN 'blocked' WHEN NOT there THEN 'failed' WHEN final <> w.n AND list_contains(done, final) THEN 'known' ELSE 'visited' END AS outcome,
      CASE WHEN queue[1].depth >= 2 OR NOT allowed OR NOT there OR final <> w.n AND list_contains(done, final) OR queue[1].depth > 0 AND list_contains(done, w.n) THEN []
        ELSE list_filter(coalesce(links, []), lambda z: NOT list_contains(known, z.m) AND NOT list_contains(done, z.m)) END AS new
    FROM step q JOIN w ON w.site = q.site AND w.n = queue[1].m LEFT JOIN a ON a.site = w.site AND a.n = w.n WHERE len(queue) > 0 AND kept < 25))
SELECT step.site, CAST(ord AS INT) AS ord, CAST(depth AS INT) AS depth, url, outcome FROM step JOIN w ON w.site = step.site AND w.n = step.n WHERE outcome IS NOT NULL""")
def crawl_visits(spark, d):
    """Every url that a crawl of each site takes from its queue, and what became of it."""
    site = F.regexp_extract(F.lower("url"), r"^https?://[^/?#]*?([^./?#]+\.[a-z]+)([:/?#]|$)", 1)
    ranked = table(spark, d, "pages").select(site.alias("site"), "page_id").withColumn("n", (F.row_number().over(Window.partitionBy("site").orderBy("page_id")) - 1).cast("long"))

    def address(n) -> F.Column:
        path = F.when(n == 0, "/").when(n % 6 == 1, F.concat(F.lit("/press/"), n)).when(n % 6 == 4, F.concat(F.lit("/Blog/"), n)).when(n % 18 == 3, F.concat(F.lit("/careers/"), n)).otherwise(F.concat(F.lit("/page/"), n))
        return F.concat(F.lit("https://"), "site", path)

    n = F.col("n")
    corpus = ranked.select(address(n).alias("url"), address(F.when(n % 11 == 10, n - 1).otherwise(n)).alias("final_url"), F.array(*[address(n * a + b) for a, b in _LINKS]).alias("links"))
    sites = ranked.select("site").distinct()
    starts = sites.select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"))
    seeds = sites.select("site", F.posexplode(F.array(*[F.lit(m).cast("long") for m in _SEEDS])).alias("ord", "n")).select("site", "ord", address(F.col("n")).alias("url"))
    rules = sites.select("site", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in _RULES])).alias("r")).select("site", "r.path", "r.allow")
    return crawl.visits(starts, corpus, rules, seeds)
