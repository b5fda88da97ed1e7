"""Queries over single rules: names, colours, slugs, robots files, sitemaps, style attributes, validation; inputs derived from rows of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import color as C, fonts as N, text as T, url as U
from ..operators import crawl, pages as P
from ..sources.tables import table
from .catalog import query

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
_SITES = f"s AS (SELECT {_SITE} AS site, min(page_id) AS k FROM pages GROUP BY 1), z AS (SELECT site, p_size AS size FROM s JOIN part ON k % 100 = p_partkey)"


def _sites(spark, d):
    """site and the size of the part that its first page's number names."""
    first = table(spark, d, "pages").groupBy(U.site("url").alias("site")).agg(F.min("page_id").alias("k"))
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("size"))
    return first.join(parts, first["k"] % 100 == parts["p_partkey"]).select("site", "size")


def _put(text: str, size: Column) -> Column:
    return F.replace(F.lit(text), F.lit("<n>"), size)


_WRITTEN = "CASE p_partkey % 6 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') WHEN 2 THEN initcap(p_name) || ' LT' WHEN 3 THEN '\"' || upper(replace(p_name, ' ', '-')) || '\"' WHEN 4 THEN p_name ELSE p_name || '-' || p_size END"
_TITLE = lambda c, at: f"array_to_string(list_transform(regexp_split_to_array({c}, '{at}'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query(f"""WITH w AS (SELECT p_partkey, {_WRITTEN.replace("initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')")} AS name FROM part), c AS (SELECT p_partkey, name, trim(replace(replace(name, '"', ''), chr(39), '')) AS c FROM w)
SELECT p_partkey, name, CASE WHEN regexp_matches(c, '[A-Z]') AND regexp_matches(c, '[a-z]') THEN c WHEN regexp_matches(c, '^[A-Z\\s-]+$') THEN {_TITLE('c', '[\\s-]+')} WHEN contains(c, '-') AND NOT regexp_matches(c, '[A-Z]') THEN {_TITLE('c', '-')} ELSE c END AS label FROM c""")
def font_labels(spark, d):
    """Font names as they are shown."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_WRITTEN).alias("name"))
    return rows.select("p_partkey", "name", N.clean_name("name").alias("label"))


_RAW = "CASE p_partkey % 7 WHEN 0 THEN '#' || upper(substr(md5(p_name), 1, 3)) WHEN 1 THEN substr(md5(p_name), 1, 6) WHEN 2 THEN ' #' || substr(md5(p_name), 1, 6) || ' ' WHEN 3 THEN '#' || substr(md5(p_name), 1, 5) WHEN 4 THEN 'red' WHEN 5 THEN '##' || substr(md5(p_name), 1, 6) END"


@query(f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part), d AS (SELECT *, lower(regexp_replace(trim(raw), '^#', '')) AS x FROM r),
h AS (SELECT p_partkey, raw, CASE WHEN regexp_matches(x, '^[0-9a-f]{{6}}$') THEN '#' || x WHEN regexp_matches(x, '^[0-9a-f]{{3}}$') THEN '#' || x[1] || x[1] || x[2] || x[2] || x[3] || x[3] END AS hex FROM d)
SELECT p_partkey, raw, hex, coalesce(hex, '#123456') AS safe, hex IS NOT NULL AS valid FROM h""")
def hex_forms(spark, d):
    """Colours as third parties write them."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_RAW.replace("md5(p_name)", "md5(cast(p_name as binary))")).alias("raw"))
    hex_ = C.normalise_hex("raw")
    return rows.select("p_partkey", "raw", hex_.alias("hex"), C.safe_hex("raw", "#123456").alias("safe"), hex_.isNotNull().alias("valid"))


_DOMAIN = "'Shop ' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.IO' WHEN 2 THEN '--.example.com' ELSE ' & the very long name of it all.org' END"


@query(f"""WITH d AS (SELECT o_orderkey, {_DOMAIN} AS domain, o_orderdate FROM orders), b AS (SELECT *, regexp_replace(domain, '\\.[a-zA-Z]{{2,}}$', '') AS base FROM d),
s AS (SELECT *, lower(regexp_replace(regexp_replace(base, '[^a-zA-Z0-9]+', '-', 'g'), '^-|-$', '', 'g'))[:40] AS part FROM b)
SELECT o_orderkey, CASE WHEN part = '' THEN 'brand' ELSE part END || '-' || strftime(o_orderdate, '%Y-%m') || '-' || lower(to_hex(o_orderkey)) AS slug FROM s""")
def report_slugs(spark, d):
    """Names of reports."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", T.slug(F.expr(_DOMAIN), F.col("o_orderdate"), F.lower(F.hex("o_orderkey"))).alias("slug"))


@query(f"""WITH s AS (SELECT DISTINCT {_SITE} AS site FROM pages) SELECT site, CAST(ord AS INT) AS ord, 'https://' || site || path AS url FROM s, (VALUES {', '.join(f"({k + 1}, '{p}')" for k, p in enumerate(U.PRIORITY_PATHS))}) AS t(ord, path)""")
def priority_pages(spark, d):
    """Addresses worth a visit of each site."""
    sites = table(spark, d, "pages").select(U.site("url").alias("site")).distinct()
    return crawl.priority_urls(sites.select("site", F.concat(F.lit("https://"), "site", F.lit("/x?y")).alias("base_url")))


#: A robots file with <n> for a number: other robots' group, the one for all, and in every third file a group of our own.
_ROBOTS = "# all\r\nUSER-AGENT: OtherBot\nDisallow: /\n\nUser-agent: *\nuser-agent: Third\nDisallow: /p<n>  # not this\nAllow: /p<n>/open\nDisallow:\nCrawl-delay: <n>\nnonsense\nSitemap: /maps/<n>.xml\nSitemap: https://elsewhere.example/s.xml\n"
_OWN = "User-agent: Brandloom/1.0\rDisallow: /own\rDisallow: /p\r"


def _robots(spark, d):
    size = F.col("size")
    body = F.concat(_put(_ROBOTS, size), F.when(size.cast("int") % 3 == 0, F.lit(_OWN)).otherwise(F.lit("")))
    return _sites(spark, d).select("site", F.concat(F.lit("https://"), "site", F.lit("/robots.txt")).alias("url"), body.alias("body"))


@query(f"""WITH {_SITES} SELECT site, '/p' || size AS path, false AS allow, CAST(least(10, size) AS DOUBLE) AS delay FROM z WHERE size % 3 <> 0 UNION ALL SELECT site, '/p' || size || '/open', true, CAST(least(10, size) AS DOUBLE) FROM z WHERE size % 3 <> 0
UNION ALL SELECT site, '/own', false, NULL FROM z WHERE size % 3 = 0 UNION ALL SELECT site, '/p', false, NULL FROM z WHERE size % 3 = 0""")
def robots_rules(spark, d):
    """Rules of each site's robots file that hold for us."""
    return crawl.parse_robots(_robots(spark, d))[0].select("site", "path", "allow", "delay")


@query(f"WITH {_SITES} SELECT site, 1 AS ord, 'https://' || site || '/maps/' || size || '.xml' AS url FROM z")
def robots_sitemaps(spark, d):
    """Sitemaps that each site's robots file names, of the site itself."""
    return crawl.parse_robots(_robots(spark, d))[1]


@query(f"""WITH p AS (SELECT {_SITE} AS site, page_id FROM pages), k AS (SELECT site, page_id, row_number() OVER (PARTITION BY site ORDER BY page_id) AS n FROM p)
SELECT site, CAST(n AS INT) AS ord, 'https://' || site || '/at?id=' || page_id || '&x=1' AS url FROM k WHERE n <= 50""")
def sitemap_pages(spark, d):
    """Addresses from each site's sitemap, fifty at most."""
    rows = table(spark, d, "pages").select(U.site("url").alias("site"), "page_id")
    loc = F.concat(F.lit("<url><loc> https://"), "site", F.lit("/at?id="), F.col("page_id").cast("string"), F.lit("&amp;x=1\n</loc></url><loc>https://other.example/</loc><loc>ftp://x/</loc>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("loc")))), lambda x: x["loc"]), "")
    maps = rows.groupBy("site").agg(body.alias("body")).select("site", F.lit(1).alias("ord"), F.concat(F.lit("https://"), "site", F.lit("/")).alias("base_url"), "body")
    return crawl.sitemap_urls(maps)


@query(f"""WITH p AS (SELECT page_id, p_size FROM pages JOIN part ON page_id % 100 = p_partkey) SELECT page_id, 0 AS pos, 'color' AS property, '#' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS value FROM p
UNION ALL SELECT page_id, 1, 'font-family', '"A ' || p_size || '"' FROM p UNION ALL SELECT page_id, 3, '--w', p_size || 'px' FROM p""")
def inline_styles(spark, d):
    """Declarations in style attributes."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    pages = table(spark, d, "pages").join(parts, F.col("page_id") % 100 == F.col("p_partkey"))
    tag = F.concat(F.lit("<i data-style=\"x:y\" STYLE = \"COLOR: #"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" ;font-family:&quot;A "), F.col("p_size").cast("string"), F.lit("&quot;;nonsense;--w:"), F.col("p_size").cast("string"), F.lit("px\">x</i>"))
    rows = pages.select(U.site("url").alias("site"), F.col("page_id").cast("int").alias("page_ord"), "url", F.concat("html", tag).alias("html"))
    return P.inline_style_declarations(rows).select(F.col("page_ord").cast("long").alias("page_id"), "pos", "property", "value")


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, CAST(page_id % 5 AS INT) AS k FROM pages), o AS (SELECT site, page_id, unnest(['a' || k, 'b', 'a' || k]) AS css, unnest([0, 1, 2]) AS css_ord FROM p)
SELECT site, page_id, css_ord, css FROM o QUALIFY row_number() OVER (PARTITION BY site, css ORDER BY page_id, css_ord) = 1""")
def stylesheet_sets(spark, d):
    """Each site's style sheets once, inline ones and fetched ones."""
    pages = table(spark, d, "pages").select(U.site("url").alias("site"), F.col("page_id").cast("int").alias("page_ord"), "url", (F.col("page_id") % 5).cast("string").alias("k"))
    first = F.concat(F.lit("https://css.example/"), "k")
    parsed = pages.select("site", "page_ord", "url", F.array(F.concat(F.lit("a"), "k"), F.lit("b")).alias("inline_css"), F.array(first, F.lit("https://css.example/none")).alias("css_urls"))
    fetched = pages.select(first.alias("url"), F.concat(F.lit("a"), "k").alias("css")).distinct()
    return P.distinct_stylesheets(P.page_stylesheets(parsed, fetched)).select("site", F.col("page_ord").cast("long").alias("page_id"), "css_ord", "css")


_OCTETS = ((10, 100, 127, 169, 172, 192, 198, 203, 8, 224, 0, 1), (0, 16, 31, 32, 51, 64, 88, 100, 127, 128, 168, 254, 18, 19, 20), (0, 2, 99, 100, 113, 5))


@query(f"""WITH c AS (SELECT c_custkey AS k, {', '.join(f'{list(o)}[c_custkey // {n} % {len(o)} + 1] AS {x}' for x, o, n in zip('abc', _OCTETS, (8, 96, 7)))} FROM customer),
u AS (SELECT *, k % 8 AS kind, a || '.' || b || '.' || c || '.' || k % 256 AS ip FROM c),
p AS (SELECT *, NOT (a IN (0, 10, 127) OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND (b = 168 OR b = 0 AND c IN (0, 2) OR b = 88 AND c = 99) OR a = 198 AND (b IN (18, 19) OR b = 51 AND c = 100) OR a = 203 AND b = 0 AND c = 113) AS public FROM u)
SELECT k AS c_custkey, CASE kind WHEN 0 THEN 'https://' || ip || '/a' WHEN 1 THEN 'Shop' || k || '.example.com/x/' WHEN 2 THEN 'http://shop.local:8080' WHEN 3 THEN 'ftp://a.org/' || k WHEN 4 THEN 'https://user:pw@a.org/' || k WHEN 5 THEN 'printer' || k || '.local' WHEN 6 THEN 'intranet' || k ELSE '  ' END AS url,
  CASE kind WHEN 0 THEN CASE WHEN NOT public THEN 'Private IP addresses are not allowed' END WHEN 1 THEN NULL WHEN 2 THEN 'Only ports 80 and 443 are allowed' WHEN 3 THEN 'Only HTTP and HTTPS URLs are allowed' WHEN 4 THEN 'URLs with credentials are not allowed' WHEN 7 THEN 'URL is required' ELSE 'Internal hostnames are not allowed' END AS error,
  CASE WHEN kind = 0 AND public THEN 'https://' || ip || '/a' WHEN kind = 1 THEN 'https://shop' || k || '.example.com/x' END AS normalised FROM p""")
def url_checks(spark, d):
    """Which addresses may be crawled, and why others may not."""
    k = F.col("c_custkey")
    octets = [F.element_at(F.array(*[F.lit(v) for v in o]), (F.floor(k / n) % len(o) + 1).cast("int")).cast("string") for o, n in zip(_OCTETS, (8, 96, 7))]
    name = k.cast("string")
    forms = (
        F.concat(F.lit("https://"), F.concat_ws(".", *octets, (k % 256).cast("string")), F.lit("/a")), F.concat(F.lit("Shop"), name, F.lit(".example.com/x/")), F.lit("http://shop.local:8080"), F.concat(F.lit("ftp://a.org/"), name),
        F.concat(F.lit("https://user:pw@a.org/"), name), F.concat(F.lit("printer"), name, F.lit(".local")), F.concat(F.lit("intranet"), name), F.lit("  "),
    )
    url = F.element_at(F.array(*forms), (k % 8 + 1).cast("int"))
    return U.validate_urls(table(spark, d, "customer").select("c_custkey", url.alias("url"))).select("c_custkey", "url", "error", "normalised")
