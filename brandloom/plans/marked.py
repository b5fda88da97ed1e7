"""Queries over pages whose heads and bodies carry what the given markup lacks: meta tags, buttons, images and a logo, written in from the parts' rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import url as U
from ..operators import contact, identity, marketing, pages as P
from ..session import write_down
from ..sources.tables import table
from .catalog import query

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
_HEAD = (
    '<meta name="description" content=" <name> &amp; <brand> "><meta name="keywords" content="<kind>, , <name> "><meta property="og:title" content="<name>"><meta property="og:image" content="/img/<size>.png">'
    '<meta property="og:" content="x"><meta property="og:title" content="<kind>"><meta name="twitter:site" content="@<kind>"><meta name="twitter:card" content=""><meta name="Application-Name" content="<brand>">'
    '<link rel="stylesheet" href="/css/<size>.css"><link rel="stylesheet" href="https://cdn.example.com/a.css"><link rel="alternate stylesheet" href="/x.css"><link rel="icon" href="/fav.png" sizes="32x32">'
)
_BODY = (
    '<header><a href="/"><img class="logo" src="/logo.svg" alt="<token>"></a></header><button>Get started with <name></button><a class="btn" href="/b"> Contact us </a><input type="submit" value="Subscribe"><div role="button"></div>'
    '<span class="cta">Plain</span><img src="/clients/<size>.jpg"><img src="/p/x.jpg" alt="Partner <brand>"><img alt="none">'
)


def _dressed(spark: SparkSession, d: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The given pages with heads and bodies filled in, parsed to all columns or to those that are named."""
    pages, parts = table(spark, d, "pages"), table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = pages.join(parts, pages["page_id"] % 100 == parts["p_partkey"])
    head, body = F.lit(_HEAD), F.lit(_BODY)
    for name, value in (("name", F.col("p_name")), ("brand", F.col("p_brand")), ("kind", F.col("p_type")), ("size", F.col("p_size").cast("string")), ("token", U.brand_token("url"))):
        head, body = (F.replace(x, F.lit(f"<{name}>"), value) for x in (head, body))
    html = F.replace(F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>"))), F.lit("<footer"), F.concat(body, F.lit("<footer")))
    return P.parse_pages(rows.select("url", html.alias("html"), F.col("page_id").cast("int").alias("page_ord")), columns=columns)


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The dressed pages as a table, for reports that read them several times."""
    return write_down(_dressed(spark, d))


_P = f"p AS (SELECT page_id, {_SITE} AS site, url, regexp_replace(split_part({_SITE}, '.', 1), '[^a-z0-9]', '', 'g') AS token, p_name AS name, p_brand AS brand, p_type AS kind, p_size AS size, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) IN ('', '/') AS home FROM pages JOIN part ON page_id % 100 = p_partkey)"


@query(f"""WITH {_P} SELECT page_id, name || ' & ' || brand AS description, kind || ',' || name AS keywords, 'image=/img/' || size || '.png,title=' || kind AS og, 'site=@' || kind AS twitter, brand AS app_name, '/logo.svg /clients/' || size || '.jpg /p/x.jpg' AS images,
  token || '||Partner ' || brand AS alts, '/css/' || size || '.css /a.css' AS sheets, 'p{{margin:0}}' AS inline_css, 'Get started with ' || name || '|Contact us|Subscribe|Plain' AS buttons, 'icon:/fav.png:32x32' AS icons FROM p""")
def page_meta(spark, d):
    """What heads, images and buttons of each page say."""
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    path = lambda u: F.regexp_replace(u, "^https?://[^/]+", "")
    return _dressed(spark, d).select(
        F.col("page_ord").cast("long").alias("page_id"), "description", F.array_join("keywords", ",").alias("keywords"), pairs("og").alias("og"), pairs("twitter").alias("twitter"), "app_name",
        F.array_join(F.transform("images", lambda i: path(i["src"])), " ").alias("images"), F.array_join(F.transform("images", lambda i: i["alt"]), "|").alias("alts"),
        F.array_join(F.transform("css_urls", path), " ").alias("sheets"), F.array_join("inline_css", "|").alias("inline_css"), F.array_join("cta_buttons", "|").alias("buttons"),
        F.array_join(F.transform(F.filter("icons", lambda i: i["rel"] == "icon"), lambda i: F.concat_ws(":", i["rel"], i["href"], i["sizes"])), " ").alias("icons"),
    )


_BUTTONS = f"""b AS (SELECT site, page_id, url, pos, content FROM (SELECT site, page_id, url, unnest(['Get started with ' || name, 'Contact us', 'Subscribe', 'Plain']) AS content, unnest([0, 1, 2, 3]) AS pos FROM p))"""


@query(f"""WITH {_P}, {_BUTTONS}, c AS (SELECT * FROM b WHERE pos < 3 QUALIFY row_number() OVER (PARTITION BY site, lower(content) ORDER BY page_id, pos) = 1),
i AS (SELECT site, page_id, url, unnest([coalesce(nullif(token, ''), 'Client logo'), 'Client logo', 'Partner ' || brand]) AS content, unnest([0, 1, 2]) AS pos FROM p),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id, pos) <= 10)
SELECT site, 'cta' AS type, content, url, 90 AS confidence, 'extracted' AS source FROM c UNION ALL SELECT site, 'client_logo', content, url, 70, 'inferred' FROM l""")
def marketing_buttons(spark, d):
    """Calls to action and client logos of sites."""
    rows = marketing.marketing_elements(_stored(spark, d)).filter("type in ('cta', 'client_logo')")
    return rows.select("site", "type", "content", "url", "confidence", "source")


@query(f"""WITH {_P}, {_BUTTONS}, f AS (SELECT site, content, min((page_id, pos)) AS place FROM b WHERE len(content) BETWEEN 3 AND 49 GROUP BY site, content),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY place) AS k FROM f) SELECT site, string_agg(content, '|' ORDER BY k) AS patterns FROM r WHERE k <= 20 GROUP BY site""")
def cta_patterns(spark, d):
    """Distinct texts of each site's buttons, twenty at most."""
    return marketing.cta_patterns(_dressed(spark, d, ("cta_buttons",))).select("site", F.array_join("patterns", "|").alias("patterns"))


_NOT = "flag|country|locale|language|avatar|profile|arrow|chevron|caret|close|menu|hamburger|search|sprite|badge|award|payment|visa|mastercard|paypal|app-?store|google-?play|rating|star|cart|user"


@query(f"""WITH {_P}, k AS (SELECT site, page_id, home, 'https://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) || '/logo.svg' AS link, token FROM p),
s AS (SELECT *, 80 + 40 + 40 + 10 + CASE WHEN len(token) >= 3 THEN 50 ELSE 0 END - CASE WHEN regexp_matches(lower(link) || ' ' || token, '{_NOT}') THEN 120 ELSE 0 END AS base FROM k),
g AS (SELECT site, link, max(base) AS base, count(*) AS n, bool_or(home) AS home, min(page_id) AS place FROM s GROUP BY site, link),
t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY base + least(20, (n - 1) * 5) + CASE WHEN home THEN 15 ELSE 0 END DESC, place) AS r FROM g)
SELECT site, CASE WHEN base >= 60 THEN link END AS logo_url, CAST(NULL AS VARCHAR) AS favicon_url, CASE WHEN base >= 60 THEN 85 ELSE 40 END AS confidence, 'extracted' AS source FROM t WHERE r = 1 AND base >= 60""")
def header_logos(spark, d):
    """Logos that stand in a header, link home and are named after their site."""
    return identity.logos(_stored(spark, d)).filter("confidence = 85").select("site", "logo_url", "favicon_url", "confidence", "source")


@query(f"""WITH {_P}, h AS (SELECT site, arg_min(brand, (NOT home, page_id)) AS name, arg_min(name || ' & ' || brand, page_id) AS description FROM p GROUP BY site) SELECT site, name, description, 50 AS confidence, 'extracted' AS source FROM h""")
def site_summaries(spark, d):
    """Names and descriptions of sites from their pages' heads."""
    parsed = _stored(spark, d)
    return identity.summaries(parsed, identity.brand_names(parsed))


@query(f"""WITH {_P}, t AS (SELECT site, page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&[a-z]+;', ' ', 'g'), '\\s+', ' ', 'g') AS h1 FROM (SELECT page_id, {_SITE} AS site, html FROM pages)),
c AS (SELECT site, count(DISTINCT h1) FILTER (h1 <> '') AS n_hero, count(*) AS n FROM t GROUP BY site), b AS (SELECT site, count(DISTINCT name) + 3 AS n_buttons FROM p GROUP BY site)
SELECT c.site, CAST(least(10, n_hero) AS INT) AS n_hero, CAST(least(15, n_buttons) AS INT) AS n_ctas, CAST(least(10, n) AS INT) AS n_urls FROM c JOIN b ON c.site = b.site""")
def analysis_copy(spark, d):
    """How much copy of each site an analysis of its tone would read."""
    rows = identity.copy_for_analysis(_dressed(spark, d, identity.COPY))
    return rows.select("site", F.size("hero").alias("n_hero"), F.size("ctas").alias("n_ctas"), F.size("urls").alias("n_urls"))


_STREET_OF = "(100 + page_id % 7) || ' ' || CASE page_id % 3 WHEN 0 THEN 'Main' WHEN 1 THEN 'Lake' ELSE 'Elm' END || CASE WHEN page_id % 2 = 0 THEN ' Street' ELSE ' St' END"


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site FROM pages), c AS (SELECT site, regexp_replace(lower({_STREET_OF}), ' street$', ' st') AS key, {_STREET_OF} || CASE WHEN page_id % 4 = 1 THEN ' #' || (page_id % 9 + 1) ELSE '' END || ', Orlando FL, ' || (32800 + page_id % 7) AS address, 1 AS pass, page_id FROM p
  UNION ALL SELECT site, '9 lake dr', '9 Lake Drive, Tampa FL, 33601', 0, page_id FROM p WHERE page_id % 5 = 0),
k AS (SELECT site, CASE WHEN contains(address, '#') THEN key || ' ' || regexp_extract(address, '#(\\d+)', 1) ELSE key END AS key, address, pass, page_id FROM c),
b AS (SELECT site, key, arg_min(address, (-len(address), pass, page_id)) AS address, min((pass, page_id)) AS place FROM k GROUP BY site, key),
l AS (SELECT site, bool_or(page_id % 5 = 0) AS local FROM p GROUP BY site)
SELECT b.site, string_agg(address, '; ' ORDER BY place) AS addresses, any_value(local) AS has_local_schema, CAST(55 + 15 * CAST(any_value(local) AS INT) AS INT) AS confidence, 'extracted' AS source FROM b JOIN l ON b.site = l.site GROUP BY b.site""")
def site_addresses(spark, d):
    """Addresses in footers and structured data of each site, in one form, each street once."""
    rows = table(spark, d, "pages")
    page = F.col("page_id")
    unit = F.when(page % 4 == 1, F.concat(F.lit(" Suite "), (page % 9 + 1).cast("string"))).otherwise("")
    line = F.concat(F.lit(" Visit us at "), F.expr(_STREET_OF), unit, F.lit(", Orlando, FL "), (32800 + page % 7).cast("string"), F.lit(" any day"))
    schema = '<script type="application/ld+json">{"@type": "Store", "address": {"streetAddress": "9 Lake Drive", "addressLocality": "Tampa", "addressRegion": "FL", "postalCode": "33601"}}</script></head>'
    html = F.regexp_replace("html", "(?s)(<footer[^>]*>).*?(</footer>)", "$1\x00$2")
    html = F.replace(F.replace(html, F.lit("\x00"), line), F.lit("</head>"), F.when(page % 5 == 0, schema).otherwise("</head>"))
    report = contact.geo_report(write_down(P.parse_pages(rows.select("url", html.alias("html"), page.cast("int").alias("page_ord")))))
    return report.select("site", F.array_join("addresses", "; ").alias("addresses"), "has_local_schema", "confidence", "source")
