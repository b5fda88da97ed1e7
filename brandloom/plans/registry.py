"""Queries by name, and the SQL that gives the same rows.

Inputs that the driver's tables lack (palettes, rules, logs) are derived from their rows; both sides derive them alike.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import color as C, fonts as N, geo as G, text as T, unicode as UN, url as U
from ..operators import colors, consistency, contact, crawl, exports, identity, marketing, merge, pages as P, seo
from ..session import cut, drop_folder, shared_dir, write_down
from ..sources.tables import table
from ..streaming import state
from ..streaming.progress import SECTIONS
from . import fixtures as X
from .analysis import analyse, section_status
from .catalog import ORACLES, QUERIES, query  # noqa: F401

# Pages -------------------------------------------------------------------------------------------------------------

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_PATH = "CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END"
_BARE = f"CASE WHEN regexp_replace(lower({_PATH}), '/$', '') = '' THEN '/' ELSE regexp_replace(lower({_PATH}), '/$', '') END"
_PRIORITY = "(" + " OR ".join([f"b IN ({', '.join(repr(p) for p in U.PRIORITY_PATHS)})", *[f"starts_with(b, '{p}/')" for p in U.PRIORITY_PATHS]]) + ")"
_VOTES = ", ".join(f"count(*) FILTER (contains(title, '{s}'))" for s in seo.SEPARATORS)


@query(f"""
WITH r AS (SELECT {_SITE} AS site, {_TITLE} AS title, len(regexp_extract_all(html, '(?i)<h1[ >]')) AS h1 FROM pages),
g AS (SELECT site, count(*) AS n_pages, count(*) FILTER (title <> '') AS n_titles, [{_VOTES}] AS votes,
             avg(len(title)) FILTER (title <> '') AS mean, count(*) FILTER (h1 = 0) AS missing_h1, count(*) FILTER (h1 > 1) AS multiple_h1 FROM r GROUP BY site),
v AS (SELECT *, list_max(votes) AS most FROM g),
s AS (SELECT *, CASE WHEN most = 0 THEN '|' ELSE ['|', '-', '–', ':', '•', '—'][list_position(votes, most)] END AS separator,
             n_titles > 0 AND most >= n_titles * 0.6 AS is_consistent, CAST(coalesce(floor(mean + 0.5), 0) AS INT) AS avg_length FROM v)
SELECT site, n_pages, separator, is_consistent, avg_length, missing_h1, multiple_h1,
       greatest(0, least(10, 10 - 2 * CAST(missing_h1 > 0 AS INT) - CAST(NOT is_consistent AND n_pages > 1 AS INT) - CAST(avg_length > 70 AS INT) - CAST(multiple_h1 > 0 AS INT))) AS score
FROM s""")
def site_audit(spark, d):
    return seo.site_audit(table(spark, d, "pages"))


@query(f"""SELECT {_SITE} AS site, lower({_TITLE}) AS title_key, count(*) AS n_pages FROM pages WHERE {_TITLE} <> '' GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_titles(spark, d):
    return seo.duplicate_titles(table(spark, d, "pages"))


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, {_BARE} AS b FROM pages), q AS (SELECT page_id, site, CASE WHEN {_PRIORITY} THEN 0 ELSE 1 END AS priority FROM p)
SELECT page_id, site, priority, row_number() OVER (PARTITION BY site ORDER BY priority, page_id) AS crawl_ord FROM q""")
def crawl_order(spark, d):
    return seo.ordered_pages(table(spark, d, "pages"))


@query(f"""WITH l AS (SELECT page_id, {_SITE} AS site, url, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)"', 1)) AS href FROM pages),
n AS (SELECT page_id, site, 'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)), ':(80|443)$', '') AS origin, regexp_extract(href, '^([^?#]*)', 1) AS p, regexp_extract(href, '(\\?[^#]*)', 1) AS q FROM l)
SELECT DISTINCT page_id, site, origin || CASE WHEN len(p) > 1 AND p LIKE '%/' THEN p[:-2] ELSE p END || q AS link FROM n""")
def page_links(spark, d):
    """Links of the parsed pages that stay on their site."""
    parsed = P.parse_pages(table(spark, d, "pages").select("url", "html", F.col("page_id").cast("int").alias("page_ord")))
    return parsed.select(F.col("page_ord").cast("long").alias("page_id"), "site", F.explode("links").alias("link")).distinct()


_NORMAL = """'https://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), ':(80|443)$', '') ||
CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' WHEN len(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) > 1
THEN regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/$', '') ELSE '/' END || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)"""


@query(f"SELECT page_id, {_NORMAL} AS normalised, {_SITE} AS site, {_PATH} AS path FROM pages")
def normalised_urls(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalise_url("url").alias("normalised"), U.site("url").alias("site"), U.path("url").alias("path"))


@query(f"SELECT page_id, {_SITE} AS site, url FROM pages WHERE regexp_matches(url, '(?i)/lp/|/landing|/campaign|/promo|/offer|/special|/free-|utm_')")
def campaign_pages(spark, d):
    return table(spark, d, "pages").filter(U.is_campaign("url")).select("page_id", U.site("url").alias("site"), "url")


@query(f"SELECT DISTINCT {_SITE} AS site, regexp_replace(split_part({_SITE}, '.', 1), '[^a-z0-9]', '', 'g') AS token FROM pages")
def brand_tokens(spark, d):
    return table(spark, d, "pages").select(U.site("url").alias("site"), U.brand_token("url").alias("token")).distinct()


@query(r"""WITH t AS (SELECT c_custkey, c_name || ' (' || c_mktsegment || ') tel. ' || CASE WHEN c_custkey % 3 = 0 THEN '+1 ' ELSE '' END || CAST(200 + c_custkey % 700 AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '-555-' ELSE '.555.' END || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS text FROM customer),
p AS (SELECT c_custkey, unnest(list_concat(regexp_extract_all(text, '\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}'), regexp_extract_all(text, '\+?[0-9]{1,4}[-.\s]?[0-9]{2,4}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{3,4}'))) AS raw FROM t)
SELECT DISTINCT c_custkey, trim(raw) AS phone FROM p WHERE len(regexp_replace(raw, '\D', '', 'g')) BETWEEN 10 AND 15""")
def contact_phones(spark, d):
    """Phones in a line of text for every customer."""
    key = F.col("c_custkey")
    number = F.concat(F.when(key % 3 == 0, "+1 ").otherwise(""), (200 + key % 700).cast("string"), F.when(key % 2 == 0, "-555-").otherwise(".555."), F.lpad((key % 10000).cast("string"), 4, "0"))
    text = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") tel. "), number)
    return table(spark, d, "customer").select("c_custkey", F.explode(G.phones(text)).alias("phone"))


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, {_PATH} AS path FROM pages),
r(pattern, allow) AS (VALUES {X.values(X.ROBOTS)}),
e AS (SELECT pattern, allow, '^' || regexp_replace(regexp_replace(regexp_replace(pattern, '\\$$', ''), '([\\\\.^$|?+(){{}}\\[\\]])', '\\\\\\1', 'g'), '\\*+', '.*', 'g') || CASE WHEN pattern LIKE '%$' THEN '$' ELSE '' END AS rx FROM r),
h AS (SELECT page_id, arg_max(allow, len(pattern) * 2 + CAST(allow AS INT)) AS allowed FROM p, e WHERE regexp_matches(path, rx) GROUP BY page_id)
SELECT p.page_id, p.site, p.path, coalesce(allowed, true) AS allowed FROM p LEFT JOIN h USING (page_id)""")
def robots_allowed(spark, d):
    urls = table(spark, d, "pages").select("page_id", U.site("url").alias("site"), U.path("url").alias("path"))
    # the same rules for each site
    per_site = urls.select("site").distinct().select("site", F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in X.ROBOTS])).alias("r")).select("site", "r.path", "r.allow")
    return crawl.allowed_urls(urls, per_site).select("page_id", "site", "path", "allowed")


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, {_NORMAL} AS url, {_BARE} AS b FROM pages),
n AS (SELECT site, url, min(page_id) AS seq, min(b) AS b FROM p GROUP BY site, url), s AS (SELECT site, url FROM p WHERE page_id % 5 = 0),
f AS (SELECT site, url, seq, b FROM n ANTI JOIN s USING (site, url)),
r AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN {_PRIORITY} THEN 0 ELSE 1 END, seq) AS ord FROM f), t AS (SELECT site, count(DISTINCT url) AS n FROM s GROUP BY site)
SELECT site, url, ord FROM r LEFT JOIN t USING (site) WHERE ord <= 25 - coalesce(n, 0)""")
def crawl_frontier(spark, d):
    rows = table(spark, d, "pages").select(U.site("url").alias("site"), F.col("page_id").alias("seq"), U.normalise_url("url").alias("url"))
    seen = rows.filter("seq % 5 = 0").select("site", "url").distinct()  # the pages visited so far
    return crawl.next_level(rows, seen, seen.groupBy("site").agg(F.count("*").alias("n_taken")))


def _decoded(text: str) -> str:
    """SQL that resolves the character references that the pages have."""
    return f"regexp_replace(replace(replace(replace({text}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"


_UNSEEN = "regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"
_VISIBLE = f"trim(regexp_replace({_decoded(f"regexp_replace({_UNSEEN}, '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'))"
_INSIDE = lambda tag: f"trim({_decoded(f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)")})"
#: pg: pages in order, with their parsed texts; hm: each site's home page, or its first page.
_PAGES = f"""pg AS (SELECT {_SITE} AS site, row_number() OVER (PARTITION BY {_SITE} ORDER BY page_id) AS page_ord, page_id, url, html, {_PATH} AS path, {_INSIDE('title')} AS title, {_INSIDE('footer')} AS footer, {_INSIDE('h1')} AS h1,
  CAST(len(regexp_extract_all(html, '<h[123][ >]')) AS INT) AS n_headings, len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, {_VISIBLE} AS visible FROM pages),
hm AS (SELECT site, arg_min({{'url': url, 'title': title, 'h1': h1}}, CASE WHEN path = '/' THEN 0 ELSE 1000000 END + page_ord) AS home FROM pg GROUP BY site)"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return P.parse_pages(table(spark, d, "pages"), "page_id")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The parsed pages as a table, for reports that read them several times."""
    return write_down(_parsed(spark, d))


@query(f"""WITH {_PAGES}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pg), n AS (SELECT page_id, count(DISTINCT href) AS n FROM l GROUP BY page_id)
SELECT site, CAST(page_ord AS INT) AS page_ord, url, title, n_headings, CAST(coalesce(n, 0) AS INT) AS n_links, CAST(len(regexp_extract_all(html, '<a href="[^"]*">[^<]')) AS INT) AS n_nav, CAST(len(visible) AS INT) AS n_text, footer FROM pg LEFT JOIN n USING (page_id)""")
def parsed_pages(spark, d):
    p = _parsed(spark, d)
    return p.select("site", "page_ord", "url", "title", F.size("headings").alias("n_headings"), F.size("links").alias("n_links"), F.size("nav_labels").alias("n_nav"), F.length("visible_text").alias("n_text"), "footer")


@query(f"WITH {_PAGES} SELECT site, CAST(page_ord AS INT) AS page_ord, visible AS text FROM pg")
def page_texts(spark, d):
    return _parsed(spark, d).select("site", "page_ord", F.col("visible_text").alias("text"))


_TITLE_VOTES = ", ".join(f"count(*) FILTER (title <> '' AND contains(title, '{x}'))" for x in seo.SEPARATORS)

@query(f"""WITH {_PAGES}, t AS (SELECT site, count(*) AS n, count(*) FILTER (title <> '') AS n_titles, [{_TITLE_VOTES}] AS votes, CAST(floor(avg(len(title)) FILTER (title <> '') + 0.5) AS INT) AS avg_length, arg_min(title, page_ord) FILTER (title <> '') AS first_title,
  count(*) FILTER (n_h1 = 0) AS missing, count(*) FILTER (n_h1 > 1) AS multiple, bool_or(contains(html, 'rel="canonical"')) AS canonical, bool_or(regexp_matches(visible, '{G.SEO_ADDRESS}') OR regexp_matches(visible, '{G.SEO_PHONE}')) AS local FROM pg GROUP BY site),
u AS (SELECT *, list_max(votes) AS most, ['|', '-', '–', ':', '•', '—'][list_position(votes, list_max(votes))] AS mark FROM t),
v AS (SELECT *, coalesce(n_titles > 0 AND most >= n_titles * 0.6, false) AS consistent, string_split(first_title, mark) AS parts FROM u),
w AS (SELECT *, CASE WHEN consistent AND most > 0 AND len(parts) >= 2 THEN trim(parts[-1]) END AS last FROM v),
b AS (SELECT w.site, count(*) FILTER (contains(title, last)) AS n_last FROM w JOIN pg ON w.site = pg.site AND title <> '' GROUP BY w.site),
x AS (SELECT *, list_filter([CASE WHEN consistent THEN 'Page titles are consistent' END, CASE WHEN avg_length BETWEEN 50 AND 60 THEN 'Good title length' END, CASE WHEN missing = 0 AND multiple = 0 THEN 'All pages have exactly one H1' END, CASE WHEN canonical THEN 'Canonical tags are in place' END], lambda e: e IS NOT NULL) AS wins,
  list_filter([CASE WHEN NOT consistent AND n > 1 THEN 'Page titles are inconsistent' END, CASE WHEN avg_length > 70 THEN 'Titles may be too long' END, n || CASE WHEN n > 1 THEN ' pages' ELSE ' page' END || ' missing meta descriptions',
  CASE WHEN missing > 0 THEN missing || CASE WHEN missing > 1 THEN ' pages' ELSE ' page' END || ' missing H1 headline' END, CASE WHEN multiple > 0 THEN multiple || CASE WHEN multiple > 1 THEN ' pages have' ELSE ' page has' END || ' multiple H1s' END,
  CASE WHEN local THEN 'Missing LocalBusiness schema' END, 'No social sharing image'], lambda e: e IS NOT NULL) AS found FROM w LEFT JOIN b USING (site)),
y AS (SELECT *, list_concat(found, list_slice([{', '.join(repr(x) for x in seo.DEFAULTS)}], 1, greatest(0, 3 - len(wins) - len(found)))) AS issues FROM x)
SELECT site, CAST(greatest(0, least(10, 10 - len(found) - 1 - CAST(missing > 0 AS INT))) AS INT) AS score, CAST(greatest(30, least(95, 60 + 5 * len(wins) - 3 * len(issues))) AS INT) AS confidence, array_to_string(wins, '; ') AS wins, array_to_string(issues, '; ') AS issues,
  CASE WHEN n_last >= n_titles * 0.5 AND last <> '' THEN '[Page Name] ' || mark || ' ' || last ELSE 'Varies' END AS title_pattern, canonical AS has_canonical, coalesce(nullif(home.title, ''), 'No title found') AS search_title, home.url AS search_url FROM y JOIN hm USING (site)""")
def seo_report(spark, d):
    headlines = lambda c: F.array_join(F.transform(c, lambda x: x["headline"]), "; ").alias(c)
    return seo.seo_report(_stored(spark, d)).select("site", "score", "confidence", headlines("wins"), headlines("issues"), "title_pattern", "has_canonical", F.col("search_preview.title").alias("search_title"), F.col("search_preview.url").alias("search_url"))


@query()
def geo_report(spark, d):
    return contact.geo_report(_stored(spark, d))


@query(f"""WITH {_PAGES}, c AS (SELECT *, regexp_matches(url, '{G.LOCATION_URL}') AS place, CASE WHEN regexp_matches(url, '{G.LOCATION_PAGE}') THEN visible ELSE footer END AS text FROM pg),
r AS (SELECT site, unnest(list_concat({', '.join(f"regexp_extract_all(text, '{x}')" for x in G.PHONES)})) AS raw FROM c),
q AS (SELECT site, count(DISTINCT trim(raw)) AS n FROM r WHERE len(regexp_replace(raw, '\\D', '', 'g')) BETWEEN 10 AND 15 GROUP BY site)
SELECT site, CAST(coalesce(any_value(n), 0) AS INT) AS n_phones, bool_or(regexp_matches(html, '{G.MAPS}')) AS has_maps, coalesce(string_agg(url, ' ' ORDER BY page_ord) FILTER (place), '') AS location_pages,
  bool_or(regexp_matches(lower(html), '{'|'.join(G.MANY_LOCATIONS)}')) OR bool_or(regexp_matches(url, '(?i)/locations?/?$|/store-locator|/stores/?$|/find-us|/find-a-location')) AS is_multi_location FROM c LEFT JOIN q USING (site) GROUP BY site""")
def location_signals(spark, d):
    return contact.geo_report(_stored(spark, d)).select("site", F.size("phones").alias("n_phones"), "has_maps", F.array_join("location_pages", " ").alias("location_pages"), "is_multi_location")


def _first_matches(name: str, section: int, kind: str, patterns: tuple, confidence: int, fold: str) -> str:
    """SQL for the first match of each pattern on each page, then the first of each text of a site."""
    rules = ", ".join(f"({k}, '(?i){x}')" for k, x in enumerate(patterns))
    return f"""{name} AS (SELECT site, {section} AS section, page_ord, pos, '{kind}' AS type, content, url, {confidence} AS confidence, 'extracted' AS source FROM (
  SELECT *, row_number() OVER (PARTITION BY site, {fold} ORDER BY page_ord, pos) AS k FROM (SELECT site, page_ord, url, pos, regexp_extract(visible, rx, 0) AS content FROM pg, (VALUES {rules}) AS r(pos, rx)) WHERE content <> '') WHERE k = 1)"""


_KINDS = ", ".join((_first_matches("nl", 2, "email_capture", marketing.NEWSLETTER, 85, "content"), _first_matches("mg", 3, "lead_magnet", marketing.MAGNET, 80, "lower(content)"), _first_matches("tr", 5, "trust_badge", marketing.TRUST, 80, "lower(content)")))
_SPOKEN = " OR ".join(f"regexp_matches(html, '{x}')" for x in marketing.TESTIMONIAL)


@query(f"""WITH {_PAGES}, {_KINDS},
tm AS (SELECT site, 4 AS section, page_ord, 0 AS pos, 'testimonial' AS type, 'Testimonials section detected' AS content, url, 75 AS confidence, 'inferred' AS source FROM pg WHERE {_SPOKEN}),
cp AS (SELECT site, 7 AS section, page_ord, 0 AS pos, 'campaign_page' AS type, CASE WHEN title <> '' THEN title ELSE url END AS content, url, 85 AS confidence, 'extracted' AS source FROM pg WHERE regexp_matches(url, '(?i)/lp/|/landing|/campaign|/promo|/offer|/special|/free-|utm_')),
al AS (SELECT * FROM nl UNION ALL SELECT * FROM mg UNION ALL SELECT * FROM tm UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM cp)
SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY section, page_ord, pos) AS INT) AS ord, type, content, url, CAST(confidence AS INT) AS confidence, source FROM al""")
def marketing_elements(spark, d):
    return marketing.marketing_elements(_stored(spark, d))


@query(f"""WITH {_PAGES}, n AS (SELECT site, split_part(regexp_replace(site, '^www\\.', ''), '.', 1) AS label, list_filter(list_transform(regexp_split_to_array(home.title, '\\s+[|–—·•:-]\\s+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM hm),
m AS (SELECT *, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS flat FROM n),
f AS (SELECT *, list_filter(parts, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g') <> '' AND (regexp_replace(lower(x), '[^a-z0-9]', '', 'g') = flat OR contains(regexp_replace(lower(x), '[^a-z0-9]', '', 'g'), flat) AND len(x) <= 30))[1] AS named FROM m)
SELECT site, coalesce(CASE WHEN len(named) <= 60 THEN regexp_replace(named, '\\s+', ' ', 'g') END, nullif(array_to_string(list_transform(list_filter(regexp_split_to_array(label, '[-_]'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' '), ''), site) AS brand_name FROM f""")
def brand_names(spark, d):
    return identity.brand_names(_parsed(spark, d))


_MESSAGE = """w AS (SELECT site, home, list_filter(regexp_split_to_array(lower(home.h1), '\\s+'), lambda x: len(x) > 4) AS words FROM hm),
o AS (SELECT pg.site, count(*) AS n_checked, count(*) FILTER (len(list_filter(words, lambda x: contains(lower(h1) || ' ' || lower(title), x))) > 0 AND len(list_filter(words, lambda x: contains(lower(h1) || ' ' || lower(title), x))) >= len(words) * 0.3) AS n_hit FROM pg JOIN w ON pg.site = w.site AND pg.url <> home.url GROUP BY pg.site)"""


@query(f"""WITH {_PAGES}, {_MESSAGE},
t AS (SELECT site, CASE WHEN contains(title, ' | ') THEN '|' WHEN contains(title, ' - ') THEN '-' WHEN contains(title, ' — ') THEN '—' END AS mark, * EXCLUDE (site) FROM pg),
g AS (SELECT site, count(*) AS n, count(*) FILTER (title <> '') AS n_titles, count(DISTINCT mark) AS marks, avg(CAST(h1 <> '' AS INT)) AS h1_share, count(*) FILTER (h1 <> '') AS n_h1, count(DISTINCT h1) FILTER (h1 <> '') AS n_own FROM t GROUP BY site),
r AS (SELECT g.*, 15 - CASE WHEN n_titles > 1 AND marks > 1 THEN 3 ELSE 0 END - CASE WHEN h1_share < 0.8 THEN 3 ELSE 0 END - CASE WHEN n_h1 > n_own + 1 THEN 2 ELSE 0 END AS seo,
  CASE WHEN len(home.h1) > 10 AND len(words) > 0 AND coalesce(n_checked, 0) > 0 THEN floor(15 * n_hit / n_checked + 0.5) END AS message FROM g JOIN w USING (site) LEFT JOIN o USING (site))
SELECT site, CAST(n AS INT) AS n_pages, CASE WHEN n >= 2 THEN CAST(seo AS INT) END AS seo, CASE WHEN n >= 2 THEN CAST(message AS INT) END AS message,
  CASE WHEN n >= 2 THEN CAST(floor((seo + coalesce(message, 0)) / (15 + CASE WHEN message IS NULL THEN 0 ELSE 15 END) * 100.0 + 0.5) AS INT) END AS score FROM r""")
def consistency_scores(spark, d):
    """Scores of the two dimensions that pages without colours, fonts and tone have."""
    parts = analyse(table(spark, d, "pages").withColumnRenamed("page_id", "page_ord"))
    return parts["consistency"].select("site", "n_pages", F.col("seo.score").alias("seo"), F.col("message.score").alias("message"), "score")


_ALWAYS = ("pages", "logo", "seo", "geo", "brand_name", "summary", "consistency", "tone")


@query(f"""WITH m AS ({ORACLES['marketing_elements']}), n AS (SELECT site, count(*) AS n FROM m GROUP BY site), s AS (SELECT DISTINCT {_SITE} AS site FROM pages), c AS (SELECT {_SITE} AS site, count(*) AS n FROM pages GROUP BY 1)
SELECT s.site, section, CASE WHEN kept OR section = 'marketing' AND n.n > 0 THEN 'done' ELSE 'empty' END AS status, CASE WHEN section = 'pages' THEN c.n WHEN section = 'marketing' THEN coalesce(n.n, 0) ELSE CAST(kept AS BIGINT) END AS n_rows
FROM s JOIN c ON s.site = c.site LEFT JOIN n ON s.site = n.site, (VALUES {', '.join(f"('{x}', {str(x in _ALWAYS).lower()})" for x in SECTIONS)}) AS t(section, kept)""")
def analysis_status(spark, d):
    """What became of each section of each site's report; every section is written by itself."""
    folder = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    rows = cut(section_status(analyse(table(spark, d, "pages").withColumnRenamed("page_id", "page_ord")), folder))
    drop_folder(spark, folder)
    return rows.select("site", "section", "status", "n_rows")


@query()
def consistency_reports(spark, d):
    parts = analyse(table(spark, d, "pages").withColumnRenamed("page_id", "page_ord"))
    return parts["consistency"].select("site", "n_pages", "score", "grade", "issues", "insufficient")


@query(f"WITH {_PAGES} SELECT DISTINCT site, CAST(NULL AS VARCHAR) AS logo_url, CAST(NULL AS VARCHAR) AS favicon_url, 0 AS confidence, 'inferred' AS source FROM pg WHERE NOT regexp_matches(html, '(?i)<(img|svg|link)[ >]')")
def missing_logos(spark, d):
    """Sites without any image, drawing or icon: no logo may be made up for them."""
    return identity.logos(_stored(spark, d)).filter("confidence = 0")


@query()
def logos(spark, d):
    return identity.logos(_stored(spark, d))


# Colours -----------------------------------------------------------------------------------------------------------

_HEX = "'#' || substr(md5(p_brand || p_name), 1, 6)"
_CH = lambda h, i: f"CAST(('0x' || substr({h}, {2 + 2 * i}, 2)) AS INT)"
_LIN = lambda h, i, knee: f"CASE WHEN {_CH(h, i)} / 255.0 <= {knee} THEN {_CH(h, i)} / 255.0 / 12.92::DOUBLE ELSE pow(({_CH(h, i)} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
_LUM = lambda h: f"(0.2126::DOUBLE * ({_LIN(h, 0, 0.03928)}) + 0.7152::DOUBLE * ({_LIN(h, 1, 0.03928)}) + 0.0722::DOUBLE * ({_LIN(h, 2, 0.03928)}))"
_CON = lambda a, b: f"((greatest({_LUM(a)}, {_LUM(b)}) + 0.05::DOUBLE) / (least({_LUM(a)}, {_LUM(b)}) + 0.05::DOUBLE))"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_brand", F.concat(F.lit("#"), F.substring(F.md5(F.concat("p_brand", "p_name").cast("binary")), 1, 6)).alias("hex"))


@query(f"WITH c AS (SELECT p_partkey, {_HEX} AS hex FROM part) SELECT p_partkey, hex, {_CH('hex', 0)} AS r, {_CH('hex', 1)} AS g, {_CH('hex', 2)} AS b FROM c")
def hex_channels(spark, d):
    return _parts(spark, d).select("p_partkey", "hex", *[C.channel("hex", i).alias(n) for i, n in enumerate("rgb")])


@query(f"""WITH c AS (SELECT p_partkey, {_HEX} AS hex FROM part)
SELECT p_partkey, round({_LUM('hex')}, 6) AS luminance, round({_CON('hex', "'#ffffff'")}, 4) AS on_white,
       CASE WHEN {_CON("'#ffffff'", 'hex')} >= {_CON("'#0f172a'", 'hex')} THEN '#ffffff' ELSE '#0f172a' END AS readable FROM c""")
def contrast(spark, d):
    rows = _parts(spark, d)
    return rows.select("p_partkey", F.round(C.luminance("hex"), 6).alias("luminance"), F.round(C.contrast_ratio("hex", F.lit("#ffffff")), 4).alias("on_white"), C.readable_text_on("hex").alias("readable"))


_MIX = lambda i: f"lpad(to_hex(CAST(floor({_CH('hex', i)} + ({_CH('t', i)} - {_CH('hex', i)}) * s / 20.0::DOUBLE + 0.5) AS INT)), 2, '0')"


@query(f"""WITH c AS (SELECT p_partkey, {_HEX} AS hex FROM part), t AS (SELECT *, '#0f172a' AS t FROM c),
m AS (SELECT p_partkey, hex, s, lower('#' || {_MIX(0)} || {_MIX(1)} || {_MIX(2)}) AS mixed FROM t, range(0, 21) AS r(s)),
f AS (SELECT p_partkey, min(s) AS s FROM m WHERE {_CON('mixed', "'#ffffff'")} >= 4.5 GROUP BY p_partkey)
SELECT p_partkey, mixed AS safe FROM m JOIN f USING (p_partkey, s)""")
def safe_foreground(spark, d):
    return _parts(spark, d).select("p_partkey", C.ensure_contrast("hex", F.lit("#ffffff")).alias("safe"))


_OKL = f"""k AS (SELECT *, {_LIN('hex', 0, 0.04045)} AS lr, {_LIN('hex', 1, 0.04045)} AS lg, {_LIN('hex', 2, 0.04045)} AS lb FROM c),
q AS (SELECT *, cbrt(0.4122214708::DOUBLE * lr + 0.5363325363::DOUBLE * lg + 0.0514459929::DOUBLE * lb) AS l3, cbrt(0.2119034982::DOUBLE * lr + 0.6806995451::DOUBLE * lg + 0.1073969566::DOUBLE * lb) AS m3,
             cbrt(0.0883024619::DOUBLE * lr + 0.2817188376::DOUBLE * lg + 0.6299787005::DOUBLE * lb) AS s3 FROM k),
o AS (SELECT *, 0.2104542553::DOUBLE * l3 + 0.793617785::DOUBLE * m3 - 0.0040720468::DOUBLE * s3 AS okl,
             sqrt(pow(1.9779984951::DOUBLE * l3 - 2.428592205::DOUBLE * m3 + 0.4505937099::DOUBLE * s3, 2) + pow(0.0259040371::DOUBLE * l3 + 0.7827717662::DOUBLE * m3 - 0.808675766::DOUBLE * s3, 2)) AS okc FROM q)"""


@query(f"""WITH c AS (SELECT p_partkey, {_HEX} AS hex FROM part), {_OKL}
SELECT p_partkey, round(okl, 5) AS lightness, round(okc, 5) AS chroma, okc < 0.05 OR okl > 0.97 OR okl < 0.12 OR (okl < 0.3 AND okc < 0.08) AS neutral FROM o""")
def neutral_colours(spark, d):
    ok = C.oklch("hex")
    return _parts(spark, d).select("p_partkey", F.round(ok["l"], 5).alias("lightness"), F.round(ok["c"], 5).alias("chroma"), C.is_neutral(ok).alias("neutral"))


_F = lambda t: f"CASE WHEN {t} > pow(6 / 29.0::DOUBLE, 3) THEN pow({t}, 1 / 3.0::DOUBLE) ELSE {t} * (pow(29 / 6.0::DOUBLE, 2) / 3) + 4 / 29.0::DOUBLE END"
_LAB = f"""k AS (SELECT *, {_LIN('hex', 0, 0.04045)} AS lr, {_LIN('hex', 1, 0.04045)} AS lg, {_LIN('hex', 2, 0.04045)} AS lb FROM c),
xyz AS (SELECT *, (0.4123907993::DOUBLE * lr + 0.3575843394::DOUBLE * lg + 0.1804807884::DOUBLE * lb) / 0.9504559271::DOUBLE AS x, 0.2126390059::DOUBLE * lr + 0.7151686788::DOUBLE * lg + 0.0721923154::DOUBLE * lb AS y,
               (0.0193308187::DOUBLE * lr + 0.1191947798::DOUBLE * lg + 0.9505321522::DOUBLE * lb) / 1.0890577508::DOUBLE AS z FROM k),
fx AS (SELECT *, {_F('x')} AS f1, {_F('y')} AS f2, {_F('z')} AS f3 FROM xyz),
lab AS (SELECT *, 116 * f2 - 16 AS l, 500 * (f1 - f2) AS a, 200 * (f2 - f3) AS b FROM fx)"""


@query(f"WITH c AS (SELECT p_partkey, {_HEX} AS hex FROM part), {_LAB} SELECT p_partkey, round(l, 4) AS l, round(a, 4) AS a, round(b, 4) AS b FROM lab")
def lab_values(spark, d):
    rows = _parts(spark, d).withColumn("x", C.lab("hex"))
    return rows.select("p_partkey", *[F.round(f"x.{n}", 4).alias(n) for n in "lab"])


_HUE = lambda a, b: f"CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
_DELTA = f"""e1 AS (SELECT *, sqrt(a * a + b * b) AS c1, sqrt(ta * ta + tb * tb) AS c2 FROM pairs),
e2 AS (SELECT *, 0.5::DOUBLE * (1 - sqrt(pow((c1 + c2) / 2, 7) / (pow((c1 + c2) / 2, 7) + pow(25.0::DOUBLE, 7)))) AS g FROM e1),
e3 AS (SELECT *, a * (1 + g) AS a1, ta * (1 + g) AS a2 FROM e2), e4 AS (SELECT *, sqrt(a1 * a1 + b * b) AS d1, sqrt(a2 * a2 + tb * tb) AS d2, {_HUE('a1', 'b')} AS h1, {_HUE('a2', 'tb')} AS h2 FROM e3),
e5 AS (SELECT *, CASE WHEN d1 * d2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 > h1 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
              CASE WHEN d1 * d2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM e4),
e6 AS (SELECT *, (l + tl) / 2 AS ml, (d1 + d2) / 2 AS mc, 2 * sqrt(d1 * d2) * sin(radians(dh / 2)) AS dhh,
              1 - 0.17::DOUBLE * cos(radians(mh - 30)) + 0.24::DOUBLE * cos(radians(2 * mh)) + 0.32::DOUBLE * cos(radians(3 * mh + 6)) - 0.2::DOUBLE * cos(radians(4 * mh - 63)) AS t FROM e5),
e7 AS (SELECT *, (tl - l) / (1 + 0.015::DOUBLE * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))) AS x, (d2 - d1) / (1 + 0.045::DOUBLE * mc) AS y, dhh / (1 + 0.015::DOUBLE * mc * t) AS z,
              -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0::DOUBLE, 7))) AS tw FROM e6)"""


@query(f"""WITH c AS (SELECT p_partkey, {_HEX} AS hex FROM part), {_LAB}, pairs AS (SELECT p.p_partkey, p.l, p.a, p.b, q.l AS tl, q.a AS ta, q.b AS tb FROM lab p JOIN lab q ON q.p_partkey = p.p_partkey + 1), {_DELTA}
SELECT p_partkey, round(sqrt(greatest(0, x * x + y * y + z * z + tw * y * z)), 3) AS delta_e FROM e7""")
def colour_differences(spark, d):
    rows = _parts(spark, d).select("p_partkey", C.lab("hex").alias("p"))
    following = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p").alias("q"))
    return rows.join(following, "p_partkey").select("p_partkey", F.round(C.ciede2000(F.col("p"), F.col("q")), 3).alias("delta_e"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    """Line items as declarations: a part's colour, used as its type says, as often as its quantity."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("site"), F.concat(F.lit("#"), F.substring(F.md5(F.col("p_type").cast("binary")), 1, 3)).alias("short"), F.col("p_size"))
    rows = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("p_size") % 3 == 0, "background").when(F.col("p_size") % 3 == 1, "text").otherwise("border")
    return rows.select("site", C.normalise_hex("short").alias("hex"), kind.alias("kind"), (F.col("p_size") % 5 == 0).alias("branded"), (F.col("l_quantity") * F.when(kind == "border", 0.4).otherwise(1.0)).alias("weight"))


_SIGNALS = """u AS (SELECT p_brand AS site, '#' || regexp_replace(substr(md5(p_type), 1, 3), '(.)', '\\1\\1', 'g') AS hex, p_size % 3 AS k, p_size % 5 = 0 AS branded, l_quantity * CASE WHEN p_size % 3 = 2 THEN 0.4::DOUBLE ELSE 1 END AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT site, hex, sum(weight) AS weight, sum(CASE WHEN branded THEN weight ELSE 0 END) AS brand_weight, sum(CASE WHEN k = 0 THEN weight ELSE 0 END) AS bg_weight, sum(CASE WHEN k = 1 THEN weight ELSE 0 END) AS text_weight FROM u GROUP BY site, hex)"""


def _signals(spark: SparkSession, d: str) -> DataFrame:
    w = lambda test: F.sum(F.when(test, F.col("weight")).otherwise(0.0))
    return _uses(spark, d).groupBy("site", "hex").agg(F.sum("weight").alias("weight"), w(F.col("branded")).alias("brand_weight"), w(F.col("kind") == "background").alias("bg_weight"), w(F.col("kind") == "text").alias("text_weight"))


@query(f"WITH {_SIGNALS} SELECT site, hex, round(weight, 3) AS weight, round(brand_weight, 3) AS brand_weight, round(bg_weight, 3) AS bg_weight, round(text_weight, 3) AS text_weight FROM g")
def colour_signals(spark, d):
    return _signals(spark, d).select("site", "hex", *[F.round(c, 3).alias(c) for c in ("weight", "brand_weight", "bg_weight", "text_weight")])


@query(f"""WITH {_SIGNALS}, t AS (SELECT *, sum(weight) OVER (PARTITION BY site) AS total FROM g)
SELECT site, hex, round(40 * brand_weight / weight + 20 * log2(1 + weight), 4) AS css_score, CAST(floor(least(95, 30 + 60 * sqrt(least(1, weight / total / 0.3::DOUBLE))) + 0.5) AS INT) AS confidence FROM t WHERE weight > 0""")
def colour_scores(spark, d):
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("site"))
    none = F.lit(None).cast("string")
    rows = _signals(spark, d).filter("weight > 0").withColumn("share", share)
    return rows.select("site", "hex", F.round(C.css_score(F.col("weight"), F.col("brand_weight"), none), 4).alias("css_score"), C.confidence(F.lit(0.0), F.col("share"), F.lit(False), F.lit(True)).alias("confidence"))


@query(f"""WITH {_SIGNALS}, c AS (SELECT * FROM g), {_OKL},
n AS (SELECT *, okc < 0.05 OR okl > 0.97 OR okl < 0.12 OR (okl < 0.3 AND okc < 0.08) AS neutral, CASE WHEN weight > 0 THEN 40 * brand_weight / weight ELSE 0 END + 20 * log2(1 + weight) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY site, neutral ORDER BY CASE WHEN neutral THEN 0 ELSE round(score, 6) END DESC, round(weight, 6) DESC, hex) AS k FROM n),
a AS (SELECT *, CASE WHEN neutral THEN CASE WHEN bg_weight > 2 * text_weight THEN 'background' WHEN text_weight > 2 * bg_weight THEN 'text' WHEN okl >= 0.6 THEN 'background' ELSE 'text' END
      WHEN k = 1 THEN 'primary' WHEN k = 2 THEN 'secondary' WHEN k <= 5 THEN 'accent' ELSE 'other' END AS role FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY site, neutral, role ORDER BY k) AS of_role FROM a),
z AS (SELECT site, hex, role, row_number() OVER (PARTITION BY site ORDER BY neutral, k) AS rank FROM f WHERE CASE WHEN neutral THEN of_role <= 2 ELSE k <= 7 END)
SELECT site, rank, hex, role FROM z WHERE rank <= 10""")
def ranked_palette(spark, d):
    """Ranks and roles, every colour its own cluster."""
    rows = _signals(spark, d).select("site", "hex", *[F.round(c, 6).alias(c) for c in ("weight", "brand_weight", "bg_weight", "text_weight")])
    empty = F.array().cast("array<struct<at:struct<page_ord:int,css_ord:int,pos:int>,hint:string,n:bigint>>")
    evidence = F.array().cast("array<struct<at:int,url:string,snippet:string,context:string>>")
    alone = rows.withColumns({"area": F.lit(0.0), "has_areas": F.lit(False), "leader": F.col("hex"), "_rank": F.lit(1), "hints": empty, "variable": F.lit(None).cast("string"), "evidence": evidence})
    return colors.rank_palette(alone).select("site", F.col("rank").cast("long").alias("rank"), "hex", "role")


@query()
def clustered_palette(spark, d):
    """Near colours merged first: an order-dependent fold, checked against brute force in the tests."""
    rows = _signals(spark, d)
    empty = F.array().cast("array<struct<at:struct<page_ord:int,css_ord:int,pos:int>,hint:string,n:bigint>>")
    evidence = F.array().cast("array<struct<at:int,url:string,snippet:string,context:string>>")
    plain = rows.withColumns({"area": F.lit(0.0), "has_areas": F.lit(False), "hints": empty, "variable": F.lit(None).cast("string"), "evidence": evidence})
    return colors.rank_palette(colors.cluster(plain)).select("site", "rank", "hex", "role", "confidence")


_ROLE = ("primary", "secondary", "accent", "background", "text", "other", "accent")
#: Every part as a colour of its brand's palette; every eleventh size gives a name that is no hex colour.
_PALETTE = f"""palette AS (SELECT p_brand AS site, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS rank, CASE WHEN p_size % 11 = 0 THEN p_name WHEN p_size % 2 = 0 THEN upper({_HEX}) ELSE {_HEX} END AS hex,
  [{', '.join(repr(r) for r in _ROLE)}][p_size % 7 + 1] AS role, CASE WHEN p_size % 5 = 0 THEN 'verified' ELSE 'extracted' END AS source, p_size + 40 AS confidence FROM part)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumns({"site": F.col("p_brand"), "rank": F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))})


def _nth(values: tuple, k) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), k.cast("int") + 1)


def _palette(spark: SparkSession, d: str) -> DataFrame:
    hex_ = F.concat(F.lit("#"), F.substring(F.md5(F.concat("p_brand", "p_name").cast("binary")), 1, 6))
    size = F.col("p_size")
    shown = F.when(size % 11 == 0, F.col("p_name")).when(size % 2 == 0, F.upper(hex_)).otherwise(hex_)
    return _ranked(spark, d).select("site", "rank", shown.alias("hex"), _nth(_ROLE, size % 7).alias("role"), F.when(size % 5 == 0, "verified").otherwise("extracted").alias("source"), (size + 40).alias("confidence"))


_FONT_ROLE = ("primary", "heading", "button", "accent", "secondary")
#: Every part as a font of its brand; some names need quoting, some have no name, some are served by Google.
_FONTS = f"""fonts AS (SELECT p_brand AS site, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS rank,
  CASE WHEN p_size % 13 = 0 THEN ' ' WHEN p_size % 6 = 0 THEN p_name || ' O''Sans' WHEN p_size % 6 = 1 THEN p_name || chr(92) || ' Mono' WHEN p_size % 3 = 0 THEN p_name || ' Serif' ELSE p_name END AS name,
  [{', '.join(repr(r) for r in _FONT_ROLE)}][p_size % 5 + 1] AS role, CASE WHEN p_size % 4 = 0 THEN 'https://fonts.googleapis.com/css2' END AS google_url, p_size FROM part)"""


def _fonts(spark: SparkSession, d: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    named = F.when(size % 13 == 0, " ").when(size % 6 == 0, F.concat(name, F.lit(" O'Sans"))).when(size % 6 == 1, F.concat(name, F.lit("\\ Mono"))).when(size % 3 == 0, F.concat(name, F.lit(" Serif"))).otherwise(name)
    weights = F.when(size % 8 == 0, F.array(*[F.lit(w) for w in ("700", "400", "400", "bold")])).when(size % 8 == 4, F.array().cast("array<string>"))
    return _ranked(spark, d).select(
        "site", "rank", named.alias("name"), _nth(_FONT_ROLE, size % 5).alias("role"), F.when(size % 4 == 0, "https://fonts.googleapis.com/css2").alias("google_url"),
        weights.alias("variants"), F.lit("extracted").alias("source"), (size + 40).alias("confidence"),
    )


@query(f"""WITH {_PALETTE} SELECT site, rank, hex, role || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS key FROM (SELECT *, row_number() OVER (PARTITION BY site, role ORDER BY rank) AS n FROM palette WHERE regexp_matches(hex, '(?i)^#[0-9a-f]{{6}}$'))""")
def role_keys(spark, d):
    return exports.role_keys(exports.valid_colors(_palette(spark, d))).select("site", "rank", "hex", "key")


@query(f"""WITH {_PALETTE}, v AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY rank) AS n FROM palette WHERE regexp_matches(hex, '(?i)^#[0-9a-f]{{6}}$'))
SELECT site, 'https://coolors.co/' || string_agg(lower(hex[2:]), '-' ORDER BY rank) AS url FROM v WHERE n <= 5 GROUP BY site""")
def coolors_links(spark, d):
    return exports.coolors_url(_palette(spark, d))


@query(f"""WITH {_PALETTE}, v AS (SELECT *, row_number() OVER (PARTITION BY site, role ORDER BY rank) AS n FROM palette WHERE regexp_matches(hex, '(?i)^#[0-9a-f]{{6}}$'))
SELECT site, '// tailwind.config.js
module.exports = {{
  theme: {{
    extend: {{
      colors: {{
' || string_agg('        ''' || role || CASE WHEN n > 1 THEN '-' || n ELSE '' END || ''': ''' || lower(hex) || ''',', chr(10) ORDER BY rank) || '
      }},
    }},
  }},
}}' AS config FROM v GROUP BY site""")
def tailwind_configs(spark, d):
    return exports.tailwind_config(_palette(spark, d))


_GENERIC = "CASE WHEN regexp_matches(lower(nm), 'mono|code|courier|consol') THEN 'monospace' WHEN contains(lower(nm), 'sans') THEN 'sans-serif' WHEN regexp_matches(lower(nm), 'serif|georgia|times|garamond|playfair|merriweather|baskerville|caslon|didot|bodoni') THEN 'serif' ELSE 'sans-serif' END"


@query(f"""WITH {_PALETTE}, {_FONTS}, v AS (SELECT *, row_number() OVER (PARTITION BY site, role ORDER BY rank) AS n FROM palette WHERE regexp_matches(hex, '(?i)^#[0-9a-f]{{6}}$')),
c AS (SELECT site, string_agg('  --color-' || role || CASE WHEN n > 1 THEN '-' || n ELSE '' END || ': ' || lower(hex) || ';', chr(10) ORDER BY rank) AS c FROM v GROUP BY site),
w AS (SELECT *, trim(name) AS nm, row_number() OVER (PARTITION BY site, role ORDER BY rank) AS n FROM fonts WHERE trim(name) <> ''),
f AS (SELECT site, string_agg('  --font-' || role || CASE WHEN n > 1 THEN '-' || n ELSE '' END || ': ' || chr(39) || replace(replace(nm, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39) || ', ' || {_GENERIC} || ';', chr(10) ORDER BY rank) AS f FROM w GROUP BY site)
SELECT coalesce(c.site, f.site) AS site, concat_ws(chr(10), ':root {{', c, '', f, '}}') AS css FROM c FULL JOIN f ON c.site = f.site""")
def css_exports(spark, d):
    return exports.css_variables_export(_palette(spark, d), _fonts(spark, d))


@query()
def design_tokens(spark, d):
    names = _ranked(spark, d).select("site", F.col("site").alias("brand_name")).distinct()
    return exports.design_tokens(_palette(spark, d), _fonts(spark, d), names)


@query(f"""WITH {_FONTS}, o AS (SELECT *, trim(name) AS nm, row_number() OVER (PARTITION BY site, lower(trim(name)) ORDER BY rank) AS k FROM fonts WHERE google_url IS NOT NULL AND trim(name) <> ''),
f AS (SELECT site, rank, replace(replace(replace(nm, ' ', '+'), chr(39), '%27'), chr(92), '%5C') || ':wght@' || CASE WHEN p_size % 8 = 0 THEN '400;700' ELSE '400;600;700' END AS f FROM o WHERE k = 1),
g AS (SELECT site, string_agg(f, '|' ORDER BY rank) AS a, string_agg('family=' || f, '&' ORDER BY rank) AS b FROM f GROUP BY site)
SELECT DISTINCT site, coalesce('https://fonts.google.com/share?selection.family=' || a, '') AS share_url, coalesce('@import url(' || chr(39) || 'https://fonts.googleapis.com/css2?' || b || '&display=swap' || chr(39) || ');', '/* No Google Fonts detected */') AS css_import FROM fonts LEFT JOIN g USING (site)""")
def google_font_links(spark, d):
    return exports.google_fonts(_fonts(spark, d))


@query(f"""WITH {_PALETTE}, v AS (SELECT * FROM palette), p AS (SELECT site, coalesce(arg_min(hex, rank) FILTER (role = 'primary'), arg_min(hex, rank)) AS h FROM v GROUP BY site),
q AS (SELECT site, CASE WHEN regexp_matches(h, '(?i)^#[0-9a-f]{{6}}$') THEN lower(h) ELSE '#4338ca' END AS main FROM p),
s AS (SELECT v.site, q.main, coalesce(arg_min(hex, rank) FILTER (role = 'secondary'), arg_min(hex, rank) FILTER (lower(hex) <> q.main AND role NOT IN ('background', 'text'))) AS h FROM v JOIN q ON v.site = q.site GROUP BY v.site, q.main)
SELECT site, main AS "primary", CASE WHEN regexp_matches(h, '(?i)^#[0-9a-f]{{6}}$') THEN lower(h) ELSE '#1e293b' END AS secondary FROM s""")
def brand_pairs(spark, d):
    return colors.brand_pair(_palette(spark, d))


# Fonts and edits ------------------------------------------------------------------------------------------------------


_NAMED = ("{} LT Std", "{}-mono", "'{}'", "{} Icons", "{}", "Open {} Sans", "{}_serif", "Arial", "Georgia", '"Courier New"')
_NAMES_SQL = "names AS (SELECT DISTINCT CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN replace('{n.replace(chr(39), chr(39) * 2)}', '{{}}', p_name)" for k, n in enumerate(_NAMED)) + " END AS name FROM part)"


@query(f"""WITH {_NAMES_SQL}
SELECT name, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[-_\\s]+', '', 'g'), '[''"]', '', 'g'), 'ltstd|std', '', 'g')) AS key,
       lower(trim(replace(replace(name, '"', ''), '''', ''))) IN ({', '.join(repr(f) for f in N.SYSTEM_FONTS)}) AS system, regexp_matches(lower(name), '{'|'.join(N.ICON_FONTS)}') AS icon,
       CASE WHEN regexp_matches(lower(name), 'mono|code|courier|consol') THEN 'monospace' WHEN contains(lower(name), 'sans') THEN 'sans-serif' WHEN regexp_matches(lower(name), 'serif|georgia|times|garamond|playfair|merriweather|baskerville|caslon|didot|bodoni') THEN 'serif' ELSE 'sans-serif' END AS generic
FROM names""")
def font_names(spark, d):
    rows = table(spark, d, "part").select(F.replace(_nth(_NAMED, F.col("p_partkey") % 10), F.lit("{}"), F.col("p_name")).alias("name")).distinct()
    return rows.select("name", N.normalise_key("name").alias("key"), N.is_system_font("name").alias("system"), N.is_icon_font("name").alias("icon"), N.generic_family("name").alias("generic"))


#: Letters of a part's name that are written otherwise, and what they fall apart into.
_WRITTEN = (("e", "\u00e9", "e\u0301"), ("fi", "\ufb01", "fi"), ("o", "\u1ed9", "o\u0323\u0302"), ("t", "\uff34", "T"), ("2", "\u00bd", "1\u20442"), ("u", "\u0308", "\u0308"))
_APART = functools.reduce(lambda x, w: f"replace({x}, '{w[0]}', '{w[2]}')", _WRITTEN, "p_name || ' fi 2 ' || p_type")


@query(f"""WITH n AS (SELECT p_partkey, {_APART} AS apart FROM part), s AS (SELECT p_partkey, apart, regexp_replace(regexp_replace(apart, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS bare FROM n)
SELECT p_partkey, coalesce(nullif(lower(bare)[:60], ''), 'brand') AS slug, coalesce(nullif(bare[:60], ''), 'brand') AS file_name, regexp_replace(lower(regexp_replace(apart, '[\u0300-\u036f]', '', 'g')), '[^a-z0-9]', '', 'g') AS key FROM s""")
def file_slugs(spark, d):
    """File names and comparison keys of names with accents, ligatures and signs."""
    name = F.concat("p_name", F.lit(" fi 2 "), "p_type")
    for plain, written, _ in _WRITTEN:
        name = F.replace(name, F.lit(plain), F.lit(written))
    # decomposed once for the three of them
    rows = table(spark, d, "part").select("p_partkey", UN.nfkd(name).alias("name"))
    return rows.select("p_partkey", UN.file_slug(F.col("name"), decomposed=True).alias("slug"), UN.file_slug(F.col("name"), lower=False, decomposed=True).alias("file_name"), N.eval_key("name", decomposed=True).alias("key"))


@query(f"""WITH {_PALETTE}, e AS (SELECT DISTINCT site, lower(hex) AS h, ascii(substr(lower(hex), 3, 1)) % 4 AS k FROM palette)
SELECT p.site AS report, p.rank AS ord, CASE WHEN k = 0 THEN '#101010' ELSE p.hex END AS hex, CASE WHEN k = 1 THEN 'text' ELSE p.role END AS role, coalesce(k IN (0, 1), false) AS user_edited FROM palette p JOIN e ON p.site = e.site AND lower(p.hex) = e.h WHERE k <> 2""")
def edited_colours(spark, d):
    """A brand's colours edited by their second digit: recoloured, given another role, hidden, left as they are."""
    own = _palette(spark, d).select(F.col("site").alias("report"), F.col("rank").alias("ord"), "hex", "role")
    k = F.ascii(F.substring(F.lower("hex"), 3, 1)) % 4
    edits = own.select("report", F.lower("hex").alias("hex"), F.when(k == 0, "#101010").alias("new_hex"), F.when(k == 1, "text").alias("new_role"), (k == 2).alias("hidden")).distinct()
    return merge.apply_color_edits(own, edits).drop("rgb")




# State, over events ---------------------------------------------------------------------------------------------------

_NOW = "TIMESTAMP '{}'"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("key"))


_ADMIT = """r AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS day FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY day, key ORDER BY ts, id) AS rk FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, id) AS rd FROM k WHERE rk <= 3),
a AS (SELECT k.id, k.key, k.day, g.id IS NOT NULL AS admitted FROM k LEFT JOIN g ON k.id = g.id AND g.rd <= 50)"""


@query(f"WITH {_ADMIT} SELECT id, key, strftime(day, '%Y-%m-%d') AS day, admitted FROM a")
def quota_admission(spark, d):
    return state.admit(_requests(spark, d)).select("id", "key", F.col("day").cast("string").alias("day"), "admitted")


@query(f"WITH {_ADMIT} SELECT key, strftime(day, '%Y-%m-%d') AS day, CAST(sum(CAST(admitted AS BIGINT)) AS BIGINT) AS used, CAST(greatest(0, 3 - sum(CAST(admitted AS BIGINT))) AS BIGINT) AS remaining, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS resets_on FROM a GROUP BY key, day")
def quota_usage(spark, d):
    return state.usage(state.admit(_requests(spark, d))).withColumns({c: F.col(c).cast("string") for c in ("day", "resets_on")})


_SIGN = "CASE WHEN event_type = 'view' THEN -1 ELSE 1 END"


@query(f"""WITH c AS (SELECT CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS day, event_id AS seq, {_SIGN} AS delta FROM events),
r AS (SELECT *, sum(delta) OVER (PARTITION BY key, day ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT key, strftime(day, '%Y-%m-%d') AS day, CAST(sum(delta) - least(0, min(run)) AS BIGINT) AS used FROM r GROUP BY key, day""")
def quota_refunds(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", -1).otherwise(1).alias("delta"))
    return state.after_refunds(rows).withColumn("day", F.col("day").cast("string"))


@query("WITH m AS (SELECT max(CAST(ts AS DATE)) AS today FROM events), c AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS day FROM events) SELECT key, strftime(day, '%Y-%m-%d') AS day FROM c, m WHERE day >= today - 7")
def quota_counters(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.to_date("ts").alias("day")).distinct()
    today = rows.agg(F.max("day")).first()[0]
    return state.kept_counters(rows, F.lit(today)).withColumn("day", F.col("day").cast("string"))


_JOBS = """j AS (SELECT user_id AS job, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS last_ts FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)"""


@query(f"WITH {_JOBS} SELECT job, status, last_ts FROM j")
def job_states(spark, d):
    return state.current_jobs(table(spark, d, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("status")))


@query(f"WITH {_JOBS} SELECT job, CASE WHEN floor(epoch(now)) - floor(epoch(last_ts)) >= 90 AND status NOT IN ('completed', 'failed') THEN 'failed' ELSE status END AS status, floor(epoch(now)) - floor(epoch(last_ts)) >= 90 AND status NOT IN ('completed', 'failed') AS reaped FROM j, n")
def stale_jobs(spark, d):
    events = table(spark, d, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return state.reap(job_states(spark, d), now).select("job", "status", "reaped")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Orders as reports: a customer's orders are reports of one site."""
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "crawling").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site"), status.alias("status"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey")).alias("source_report"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), F.col("o_orderdate").alias("heartbeat_at"), (F.col("o_orderkey") % 3 == 0).alias("is_public"), F.lit("{}").alias("data"))


_REPORTS = """r AS (SELECT o_orderkey AS id, o_custkey AS site, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'crawling' ELSE 'failed' END AS status, o_orderkey % 7 = 0 AS cloned, o_orderdate AS created_at, o_orderkey % 3 = 0 AS is_public FROM orders), n AS (SELECT max(o_orderdate) AS now FROM orders)"""


def _now(spark: SparkSession, d: str):
    return F.lit(table(spark, d, "orders").agg(F.max("o_orderdate")).first()[0])


@query(f"WITH {_REPORTS}, f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, id DESC) AS k FROM r, n WHERE status = 'completed' AND NOT cloned AND created_at + INTERVAL 400 DAY > now) SELECT site, id, created_at FROM f WHERE k = 1")
def cached_reports(spark, d):
    return state.cached_reports(_reports(spark, d), _now(spark, d)).select("site", "id", "created_at")


@query(f"WITH {_REPORTS}, f AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY created_at DESC, id DESC) AS k FROM r, n WHERE status NOT IN ('completed', 'failed') AND id % 200 < 90) SELECT site, id FROM f WHERE k = 1")
def live_jobs(spark, d):
    """Jobs last heard of up to 199 seconds ago."""
    now = _now(spark, d)
    beats = _reports(spark, d).withColumn("heartbeat_at", F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - F.col("id") % 200 * 1_000_000))
    return state.in_flight(beats, now).select("site", "id")


@query(f"WITH {_REPORTS} SELECT is_public, count(*) AS n_kept FROM r, n WHERE epoch(now) - epoch(created_at) <= CASE WHEN is_public THEN 180 ELSE 30 END * 86400 GROUP BY is_public")
def retention(spark, d):
    return state.retained(_reports(spark, d), _now(spark, d)).groupBy("is_public").agg(F.count("*").alias("n_kept"))


@query("SELECT user_id AS report, count(*) AS n_views FROM events WHERE event_type <> 'click' GROUP BY user_id")
def view_counts(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("report"), F.when(F.col("event_type") == "click", "Mozilla/5.0 (compatible; SomeBot/1.0)").otherwise("Mozilla/5.0").alias("user_agent"))
    return state.view_counts(rows)


@query("SELECT user_id AS report, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 AS granted FROM events")
def regeneration_claims(spark, d):
    return state.regenerations(table(spark, d, "events").select(F.col("user_id").alias("report"), F.col("event_id").alias("seq")))


@query("""WITH a AS (SELECT user_id AS site, event_id AS seq, CAST(epoch_us(ts) // 1000 AS BIGINT) AS arrive_ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT site, seq, arrive_ms, CAST(i * 250 + max(arrive_ms - i * 250) OVER (PARTITION BY site ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_ms FROM a""")
def request_slots(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("site"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("arrive_ms"))
    return crawl.start_slots(rows)


@query("WITH v AS (SELECT event_id, CAST(floor(value) AS INT) % 30 AS done, CAST(floor(value) AS INT) % 40 + 1 AS found FROM events) SELECT event_id, CAST(floor(5 + 40 * least(1, done / CAST(least(25, greatest(found, 1)) AS DOUBLE)) + 0.5) AS INT) AS percent FROM v")
def crawl_progress(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.floor("value").cast("int") % 30).alias("done"), (F.floor("value").cast("int") % 40 + 1).alias("found"))
    return rows.select("event_id", crawl.progress(F.col("done"), F.col("found")).alias("percent"))


from . import derived, details, marked, records, rendered, streams, structured_data, visits, wide_colours  # noqa: E402, F401  (they register their queries)
