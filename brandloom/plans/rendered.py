"""Queries over pages as a browser would lay them out: styles of text, and areas of colour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import url as U
from ..operators import areas, cascade, colors, typography
from ..session import cut
from ..sources.tables import table
from .catalog import query

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with the part that styles it."""
    pages = table(spark, d, "pages").select("page_id", U.site("url").alias("site"), F.col("page_id").cast("int").alias("page_ord"), "html")
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return pages.join(parts, pages["page_id"] % 100 == parts["p_partkey"])


#: A page's style sheet, with names and numbers of its part for <...>, and with rules that must lose, or hold only elsewhere.
_SHEET = """:root{--nav:'<brand> Sans', sans-serif}
body{font:italic <base>00 16px/1.5 '<name>', serif}
article>p{font-weight:300} p{font-weight:900;font-family:Never} article p{font-family:"<brand>",serif}
p+p{font-weight:inherit}
nav ul li a{font-family:var(--nav)} nav a{font-family:Never;font-weight:500} a{font-weight:200 !important}
.ad{font-weight:bolder} div.ad.ad{font-family:Advert<odd>} .ad .ad,#none{display:none}
h1:not(.big):first-child{font-family:Display,serif} h1:nth-child(2){font-family:Never} h1:hover,p::first-line{font-family:Never}
@media print{*{font-family:Never !important}} @media (min-width:900px){b{font-family:Bold Face}} @media (max-width:900px){b{font-family:Never}}
"""


def _sheets(pages: DataFrame) -> DataFrame:
    size, css = F.col("p_size"), F.lit(_SHEET)
    for name, value in (("brand", F.col("p_brand")), ("name", F.col("p_name")), ("base", (size % 8 + 1).cast("string")), ("odd", F.when(size % 2 == 1, ",Odd").otherwise(""))):
        css = F.replace(css, F.lit(f"<{name}>"), value)
    return pages.select("site", "page_ord", F.lit(0).alias("css_ord"), css.alias("css"))


_COUNT = lambda tag: f"len(regexp_extract_all(html, '<{tag}[ >]'))"


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, html, p_name, p_brand, (p_size % 8 + 1) * 100 AS base FROM pages JOIN part ON page_id % 100 = p_partkey),
r AS (SELECT page_id, site, 'li' AS tag, p_name AS font, base AS weight, {_COUNT('li')} AS n FROM p
  UNION ALL SELECT page_id, site, 'a', p_brand || ' Sans', 200, {_COUNT('a')} FROM p UNION ALL SELECT page_id, site, 'h1', 'Display', 700, {_COUNT('h1')} FROM p
  UNION ALL SELECT page_id, site, 'div', 'Advert', CASE WHEN base < 350 THEN 400 WHEN base < 550 THEN 700 ELSE 900 END, {_COUNT('div')} FROM p
  UNION ALL SELECT page_id, site, 'p', p_brand, 300, 1 FROM p WHERE {_COUNT('p')} > 0 UNION ALL SELECT page_id, site, 'p', p_brand, base, {_COUNT('p')} - 1 FROM p
  UNION ALL SELECT page_id, site, 'b', 'Bold Face', 700, {_COUNT('b')} FROM p)
SELECT page_id, site, tag, font, CAST(weight AS VARCHAR) AS weight, tag = 'h1' AS is_heading, CAST(sum(n) AS BIGINT) AS n_elements FROM r WHERE n > 0 GROUP BY ALL""")
def text_styles(spark, d):
    """Computed family and weight of every text element, by page."""
    pages = _pages(spark, d)
    rules = cut(cascade.page_rules(_sheets(pages)))
    styles = cascade.text_styles(cut(cascade.page_elements(pages)), rules, cascade.root_variables(rules))
    return styles.groupBy(F.col("page_ord").cast("long").alias("page_id"), "site", "tag", "font", "weight", "is_heading").agg(F.count("*").alias("n_elements"))


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, html, p_name, p_brand, (p_size % 8 + 1) * 100 AS base FROM pages JOIN part ON page_id % 100 = p_partkey),
f AS (SELECT * FROM p QUALIFY page_id = min(page_id) OVER (PARTITION BY site)),
c AS (SELECT *, {_COUNT('li')} AS li, {_COUNT('a')} AS a, {_COUNT('div')} AS d, {_COUNT('p')} AS n_p, {_COUNT('b')} AS b FROM f),
e AS (SELECT site, 1 AS place, p_name AS name, li AS n, 0 AS h, [CAST(base AS VARCHAR)] AS weights FROM c UNION ALL SELECT site, 2, p_brand || ' Sans', a, 0, ['200'] FROM c
  UNION ALL SELECT site, 3, 'Advert', d, 0, [CAST(CASE WHEN base < 350 THEN 400 WHEN base < 550 THEN 700 ELSE 900 END AS VARCHAR)] FROM c UNION ALL SELECT site, 4, p_brand, n_p, 0, CASE WHEN base = 300 OR n_p = 1 THEN ['300'] ELSE ['300', CAST(base AS VARCHAR)] END FROM c
  UNION ALL SELECT site, 5, 'Bold Face', b, 0, ['700'] FROM c UNION ALL SELECT site, 0, 'Display', 0, 1, ['700'] FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, place) AS k FROM e WHERE n + h > 0),
l AS (SELECT site, name, weights, place, CASE WHEN k = 1 THEN 'primary' WHEN h > 0 THEN 'heading' WHEN n > 10 THEN 'primary' ELSE 'secondary' END AS role, CASE WHEN k = 1 OR h > 0 THEN 98 ELSE least(90, 50 + n) END AS confidence, CASE WHEN k = 1 THEN -2 WHEN h > 0 THEN -1 ELSE place END AS ord FROM r)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY list_position(['primary', 'heading', 'button', 'accent', 'secondary'], role), confidence DESC, ord) AS rank, name, role, array_to_string(weights, ',') AS variants, CAST(confidence AS INT) AS confidence FROM l""")
def scanned_fonts(spark, d):
    """Each site's ranked fonts from the computed styles of its first page."""
    pages = cut(_pages(spark, d))
    sheets = _sheets(pages)
    entries = typography.scan_elements(cut(cascade.page_elements(pages)), cut(cascade.page_rules(sheets)), sheets)
    return typography.final_fonts(cut(entries), None).select("site", F.col("rank").cast("long").alias("rank"), "name", "role", F.array_join("variants", ",").alias("variants"), "confidence")


#: Line items as boxes of a page: an order's items lie on page l_orderkey % 40 of their supplier's site.
_TAGS = ("button", "div", "a", "path", "p", "span", "input", "section", "circle", "body", "html")
_STYLES = ("solid", "none", "dashed", "hidden")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(*[F.col(f"l_{c}").alias(c) for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity")])
    o, p, s, n, q = (F.col(c) for c in ("orderkey", "partkey", "suppkey", "linenumber", "quantity"))
    nth = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    rgb = lambda r, g, b: F.concat(F.lit("rgb("), r.cast("string"), F.lit(", "), g.cast("string"), F.lit(", "), b.cast("string"), F.lit(")"))
    shade = lambda k: rgb(k % 4 * 60, k % 3 * 100, k % 2 * 200)
    background = F.when(p % 7 == 0, "rgba(0, 0, 0, 0)").when(p % 7 == 1, "#ABC").when(p % 7 == 2, "rgba(9, 9, 9, 0.4)").when(p % 7 == 3, "hsl(220deg 80% 50%)").otherwise(shade(p))
    side = lambda name, k: F.struct(F.lit(name).alias("side"), (k % 3).cast("double").alias("width"), nth(_STYLES, k).alias("style"), shade(s + k).alias("color"))
    return li.select(
        F.concat(F.lit("s"), (s % 5).cast("string"), F.lit(".org")).alias("site"), (o % 40).cast("int").alias("page_ord"), F.lit("u").alias("page_url"), (o * 8 + n).cast("int").alias("el"),
        ((p * 37 % 110 - 10) * 20).cast("double").alias("left"), (s * 91 % 3000 - 500).cast("double").alias("top"), (q * 20 - 20).cast("double").alias("width"), (n * 64).cast("double").alias("height"),
        nth(_TAGS, p).alias("tag"), F.when(s % 9 == 0, "button").alias("role"), F.when(s % 2 == 0, "SUBMIT").otherwise("text").alias("input_type"), (o % 13 == 0).alias("hidden"), (o % 3 == 0).alias("brand_slot"),
        background.alias("background"), shade(n).alias("color"), shade(o).alias("fill"), F.when(s % 4 > 0, (s % 4 * 8).cast("double")).alias("font_size"), (p % 6 * 16).cast("int").alias("text_len"),
        F.array(side("top", p), side("right", o), side("bottom", n), side("left", s)).alias("borders"),
    )


_SHADE = lambda k: f"'#' || lower(lpad(to_hex({k} % 4 * 60), 2, '0') || lpad(to_hex({k} % 3 * 100), 2, '0') || lpad(to_hex({k} % 2 * 200), 2, '0'))"
_BOXES = f"""b AS (SELECT 's' || (s % 5) || '.org' AS site, CAST(o % 40 AS INT) AS page_ord, o * 8 + n AS el, (p * 37 % 110 - 10) * 20.0::DOUBLE AS x, (s * 91 % 3000 - 500)::DOUBLE AS y, q * 20 - 20 AS w, n * 64.0::DOUBLE AS h,
  [{', '.join(repr(t) for t in _TAGS)}][p % {len(_TAGS)} + 1] AS tag, s, o, n, p, CASE p % 7 WHEN 0 THEN NULL WHEN 1 THEN '#aabbcc' WHEN 2 THEN NULL WHEN 3 THEN '#195ee6' ELSE {_SHADE('p')} END AS bg FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber::BIGINT AS n, l_quantity AS q FROM lineitem)),
r AS (SELECT *, row_number() OVER (PARTITION BY site, page_ord ORDER BY el) AS nth FROM b WHERE tag NOT IN ('html', 'body')),
c AS (SELECT *, least(1920, x + w) - greatest(0, x) AS cw, least(2160, y + h) - greatest(0, y) AS ch FROM r WHERE nth <= 4000 AND w > 0 AND o % 13 <> 0),
k AS (SELECT *, cw * ch AS clipped, cw * ch / (w * h) AS shown, CASE WHEN s % 4 > 0 THEN s % 4 * 8 ELSE 16 END AS fs FROM c WHERE cw > 0 AND ch > 0),
a AS (SELECT site, page_ord, {_SHADE('o')} AS hex, clipped * CASE WHEN o % 3 = 0 THEN 2 ELSE 0.15::DOUBLE END AS px FROM k WHERE tag IN ('path', 'circle')
  UNION ALL SELECT site, page_ord, bg, clipped * CASE WHEN tag = 'button' OR s % 9 = 0 OR tag = 'input' AND s % 2 = 0 OR tag = 'a' AND p % 7 <> 0 THEN 4 ELSE 1 END FROM k WHERE tag NOT IN ('path', 'circle')
  UNION ALL SELECT site, page_ord, {_SHADE('n')}, least(p % 6 * 16 * fs * fs * 0.5::DOUBLE * shown, clipped) FROM k WHERE tag NOT IN ('path', 'circle')
  {' '.join(f"UNION ALL SELECT site, page_ord, {_SHADE(f'(s + {c})')}, {edge} * ({c} % 3) FROM k WHERE tag NOT IN ('path', 'circle') AND {c} % 4 IN (0, 2)" for c, edge in (('p', 'cw'), ('o', 'ch'), ('n', 'cw'), ('s', 'ch')))}
  UNION ALL SELECT site, page_ord, coalesce(arg_min(bg, el) FILTER (tag = 'body' AND el = eb), arg_min(bg, el) FILTER (tag = 'html' AND el = eh)), 1920.0::DOUBLE * 2160
    FROM (SELECT *, min(el) FILTER (tag = 'body') OVER w AS eb, min(el) FILTER (tag = 'html') OVER w AS eh FROM b WINDOW w AS (PARTITION BY site, page_ord)) WHERE tag IN ('body', 'html') GROUP BY site, page_ord),
area AS (SELECT site, page_ord, hex, CAST(floor(sum(px) + 0.5) AS BIGINT) AS px FROM a WHERE hex IS NOT NULL AND px > 0 GROUP BY site, page_ord, hex)"""


@query(f"WITH {_BOXES} SELECT site, page_ord, hex, px FROM area WHERE px > 0")
def painted_areas(spark, d):
    """Pixels of each colour on the first two screens of each page."""
    return areas.painted_areas(_boxes(spark, d)).select("site", "page_ord", "hex", "px")


@query(f"WITH {_BOXES}, t AS (SELECT site, hex, CAST(sum(px) AS DOUBLE) AS area FROM area WHERE hex NOT IN ('#0000ee', '#551a8b', '#ee0000') GROUP BY site, hex) SELECT site, hex, area, area > 0 AS has_areas FROM t")
def area_signals(spark, d):
    """Colour signals of sites by painted area alone: areas joined to no declarations."""
    none = colors.colour_uses(spark.createDataFrame([], "site string, page_ord int, page_url string, css_ord int, pos int, selector string, property string, value string"), spark.createDataFrame([], "site string, variables map<string,string>"))
    return colors.signals(none, areas.painted_areas(_boxes(spark, d))).select("site", "hex", "area", "has_areas")
