"""Queries whose inputs (style sheets, links, fonts, addresses, scores) Spark derives from rows of the given tables; the SQL derives them alike."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import color as C, fonts as N, geo as G, url as U
from ..operators import colors, consistency, contact, evaluation, merge, pages as P, typography
from ..session import cut, drop_folder, shared_dir
from ..sources.points import ReportTable
from ..sources.tables import table
from .catalog import query
from .fixtures import PROPERTIES

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


def _nth(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _styled_pages(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    pages = table(spark, d, "pages").select("page_id", "url", "html", U.site("url").alias("site"))
    return pages.join(parts, pages["page_id"] % 100 == parts["p_partkey"])


# Colours of style sheets ----------------------------------------------------------------------------------------------


@query(f"""WITH props AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p) ELSE p END AS property FROM (SELECT p_partkey, p_size, {_listed(PROPERTIES)}[p_partkey % {len(PROPERTIES)} + 1] AS p FROM part))
SELECT p_partkey, property, CASE WHEN starts_with(p, '--') THEN 'definition' WHEN p = 'color' THEN 'text' WHEN p IN ('background', 'background-color', 'background-image') THEN 'background'
WHEN regexp_matches(p, '^border(-color|-(top|right|bottom|left|block|inline)(-(start|end))?(-color)?)?$') THEN 'border' WHEN p IN ('outline', 'outline-color') THEN 'outline' WHEN p = 'caret-color' THEN 'caret'
WHEN p = 'accent-color' THEN 'accent-control' WHEN p IN ('fill', 'stroke') THEN p WHEN p IN ('text-decoration', 'text-decoration-color', 'column-rule-color', 'column-rule') THEN 'decoration'
WHEN p IN ('box-shadow', 'text-shadow') THEN 'shadow' END AS kind FROM (SELECT p_partkey, property, lower(trim(property)) AS p FROM props)""")
def property_kinds(spark, d):
    """How each property that a part's sheet sets uses colour."""
    name = _nth(tuple(PROPERTIES), F.col("p_partkey"))
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper(name)).otherwise(name).alias("property"))
    return rows.select("p_partkey", "property", C.classify_property("property").alias("kind"))


#: Colours far apart from each other, so that each is a cluster of its own; two neutral ones.
_CHROMATIC = ("#e11d48", "#2563eb", "#16a34a", "#f59e0b", "#9333ea", "#0891b2")
_INK, _PAPER = "#374151", "#f9fafb"
_SHEET = ".btn{background-color:<a>} .card{background:<b>} p{color:" + _INK + "} body{background:" + _PAPER + "}"


@query(f"""WITH s AS (SELECT DISTINCT {_SITE} AS site, {_listed(_CHROMATIC)}[p_size % 6 + 1] AS a, {_listed(_CHROMATIC)}[p_size // 6 % 6 + 1] AS b FROM pages JOIN part ON page_id % 100 = p_partkey),
u AS (SELECT site, a AS hex, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS brand, 1.0::DOUBLE AS bg, 0.0::DOUBLE AS ink, false AS neutral FROM s UNION ALL SELECT site, b, 1, 0, 1, 0, false FROM s UNION ALL SELECT site, '{_INK}', 1, 0, 0, 1, true FROM s UNION ALL SELECT site, '{_PAPER}', 1, 0, 1, 0, true FROM s),
g AS (SELECT site, hex, neutral, sum(weight) AS weight, sum(brand) AS brand, sum(bg) AS bg, sum(ink) AS ink FROM u GROUP BY ALL),
r AS (SELECT *, sum(weight) OVER (PARTITION BY site) AS total, row_number() OVER (PARTITION BY site, neutral ORDER BY CASE WHEN neutral THEN 0 ELSE round(40 * brand / weight + 20 * log2(1 + weight), 6) END DESC, round(weight, 6) DESC, hex) AS k FROM g)
SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY neutral, k) AS INT) AS rank, hex, CASE WHEN neutral THEN CASE WHEN ink > bg THEN 'text' ELSE 'background' END WHEN k = 1 THEN 'primary' WHEN k = 2 THEN 'secondary' WHEN k <= 5 THEN 'accent' ELSE 'other' END AS role,
  CAST(floor(least(95, 30 + 60 * sqrt(least(1, weight / total / 0.3::DOUBLE))) + 0.5) AS INT) AS confidence FROM r""")
def site_palettes(spark, d):
    """Each site's palette from the style sheets of its pages."""
    pages = _styled_pages(spark, d)
    size = F.col("p_size")
    css = F.replace(F.replace(F.lit(_SHEET), F.lit("<a>"), _nth(_CHROMATIC, size)), F.lit("<b>"), _nth(_CHROMATIC, F.floor(size / 6)))
    own = pages.select("site", F.col("page_id").cast("int").alias("page_ord"), "url", "html", css.alias("css"))
    sheets = own.select("site", "page_ord", F.col("url").alias("page_url"), F.lit(0).alias("css_ord"), "css")
    return colors.extract_colors(own.drop("css"), sheets).select("site", "rank", "hex", "role", "confidence")


# Fonts ------------------------------------------------------------------------------------------------------------------

_FACES = ("Red Widget", "RedWidget", "Red Widget Mono", "Work", "Lora Text", "Work Sans", "Karla", "Lora_Text", "Sora", "Figtree", "Inter Tight", "Inter", "Bitter")
_PLACES = ("primary", "heading", "button", "accent", "secondary")


@query(f"""WITH e AS (SELECT p_brand AS site, p_partkey AS ord, {_listed(_FACES)}[p_partkey * 7 % {len(_FACES)} + 1] AS name, {_listed(_PLACES)}[p_size % 5 + 1] AS role, p_size + 40 AS confidence FROM part), k AS (SELECT *, regexp_replace(lower(name), '[-_\\s]+', '', 'g') AS key FROM e),
m AS (SELECT site, key, arg_min(name, -confidence * 10000000 + ord) AS name, arg_min(role, -confidence * 10000000 + ord) AS role, max(confidence) AS confidence, min(ord) AS ord FROM k GROUP BY site, key),
r AS (SELECT *, CASE WHEN regexp_matches(name, '(?i)(^|[\\s-])(mono|monospace|code|consolas|courier|menlo|monaco)([\\s-]|$)|mono$') AND role IN ('primary', 'heading') THEN 'accent' ELSE role END AS final_role FROM m)
SELECT * FROM (SELECT site, row_number() OVER (PARTITION BY site ORDER BY list_position(['primary', 'heading', 'button', 'accent', 'secondary'], final_role), confidence DESC, ord) AS rank, name, final_role AS role, CAST(confidence AS INT) AS confidence FROM r) WHERE rank <= 10""")
def ranked_fonts(spark, d):
    """Each brand's fonts: one per key, code fonts demoted, ranked, ten at most."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("ord"), _nth(_FACES, F.col("p_partkey") * 7).alias("name"), _nth(_PLACES, F.col("p_size")).alias("role"), (F.col("p_size") + 40).cast("int").alias("confidence"))
    rows = rows.withColumns({"variants": F.array(F.lit("400")), "google_url": F.lit(None).cast("string"), "context": F.lit("")})
    return typography.final_fonts(rows).select("site", F.col("rank").cast("long").alias("rank"), "name", "role", "confidence")


_URL = """CASE p_partkey % 4 WHEN 0 THEN 'css2?family=' || replace(p_name, ' ', '+') || ':wght@' || (p_size % 9 + 1) * 100 || ';' || '700&family=Arial&family=' || p_type || '&display=swap' WHEN 1 THEN 'css?family=' || replace(p_name, ' ', '+') || ':bold,' || (p_size % 9 + 1) * 100 || '|' || p_type
  WHEN 2 THEN 'css2?family=' || replace(p_name, ' ', '+') || ':ital,wght@0,400;1,' || (p_size % 9 + 1) * 100 ELSE 'css?family=Georgia|' || p_type || ':regular' END"""


@query(f"""WITH u AS (SELECT p_partkey, 'https://fonts.googleapis.com/' || {_URL} AS url FROM part), f AS (SELECT p_partkey, unnest(regexp_extract_all(url, 'family=([^&]+)', 1)) AS p FROM u), s AS (SELECT p_partkey, unnest(string_split(p, '|')) AS f FROM f),
w AS (SELECT p_partkey, trim(replace(split_part(f, ':', 1), '+', ' ')) AS name, CASE WHEN regexp_extract(split_part(f, ':', 2), 'wght@([\\d;,]+)', 1) <> '' THEN regexp_extract(split_part(f, ':', 2), 'wght@([\\d;,]+)', 1) ELSE split_part(f, ':', 2) END AS spec FROM s)
SELECT p_partkey, name, coalesce(nullif(array_to_string(list_filter(regexp_split_to_array(spec, '[;,]'), lambda x: regexp_matches(x, '^\\d+$')), ','), ''), '400') AS weights FROM w WHERE lower(name) NOT IN ({', '.join(repr(f) for f in N.SYSTEM_FONTS)})""")
def google_font_urls(spark, d):
    """Families and weights of addresses of both styles."""
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://fonts.googleapis.com/"), F.expr(_URL)).alias("url"))
    return rows.select("p_partkey", F.explode(N.google_families("url")).alias("f")).select("p_partkey", "f.name", F.array_join("f.weights", ",").alias("weights"))


# Contact ----------------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT page_id, {_SITE} AS site, url, regexp_replace(split_part({_SITE}, '.', 1), '[^a-z0-9]', '', 'g') AS token, p_size FROM pages JOIN part ON page_id % 100 = p_partkey),
l AS (SELECT site, page_id, url, token, 0 AS pos, 'instagram' AS platform, token || '_co' AS handle, 'https://instagram.com/' || token || '_co' AS link FROM p WHERE page_id % 2 = 0
  UNION ALL SELECT site, page_id, url, token, 1, 'instagram', 'friends' || page_id % 3, 'https://www.instagram.com/friends' || page_id % 3 FROM p
  UNION ALL SELECT site, page_id, url, token, 3, 'twitter', 'Acct' || p_size % 4, 'https://x.com/acct' || p_size % 4 FROM p WHERE page_id % 3 = 0 UNION ALL SELECT site, page_id, url, token, 5, 'linkedin', 'firm-' || p_size % 2, 'https://linkedin.com/company/firm-' || p_size % 2 FROM p),
k AS (SELECT site, any_value(token) AS token, platform, lower(handle) AS key, arg_min(handle, (page_id, pos)) AS handle, arg_min(link, (page_id, pos)) AS url, min((page_id, pos)) AS place, count(DISTINCT url) AS n FROM l GROUP BY site, platform, lower(handle)),
s AS (SELECT *, n * 10 + CASE WHEN len(token) >= 3 AND (contains(regexp_replace(key, '[^a-z0-9]', '', 'g'), token) OR contains(token, regexp_replace(key, '[^a-z0-9]', '', 'g'))) THEN 25 ELSE 0 END AS score FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY site, platform ORDER BY score DESC, place) AS r FROM s)
SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY list_position(['linkedin', 'twitter', 'instagram'], platform)) AS INT) AS rank, platform, url, CASE WHEN platform = 'linkedin' THEN handle ELSE '@' || handle END AS handle, 85 AS confidence, CAST(n AS INT) AS n_pages, CAST(score AS INT) AS score FROM b WHERE r = 1""")
def social_profiles(spark, d):
    """Each site's official profiles, from links in the footers of its pages."""
    pages = _styled_pages(spark, d)
    token, page, size = U.brand_token("url"), F.col("page_id"), F.col("p_size").cast("string")
    link = lambda *parts: F.concat(F.lit('<a href="'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('">x</a>'))
    added = F.concat(
        F.when(page % 2 == 0, link("https://instagram.com/", token, "_co")).otherwise(link("/own")), link("http://www.instagram.com/friends", (page % 3).cast("string"), "?hl=en"), link("https://twitter.com/intent/tweet?x=1"),
        F.when(page % 3 == 0, link("https://x.com/Acct", (F.col("p_size") % 4).cast("string"))).otherwise(link("https://www.linkedin.com/in/someone")), link("https://notlinkedin.org/company/none"),
        link("https://linkedin.com/company/firm-", (size.cast("int") % 2).cast("string"), "?from=footer"),
    )
    # the page's own links come first: only the added ones name a platform
    html = F.replace("html", F.lit("</footer>"), F.concat(added, F.lit("</footer>")))
    parsed = P.parse_pages(pages.select("url", html.alias("html"), page.cast("int").alias("page_ord")))
    return contact.social_links(contact.page_social_links(parsed))


@query(r"""WITH t AS (SELECT page_id, 'tel. ' || CASE WHEN page_id % 3 = 0 THEN '+1 ' ELSE '' END || (200 + page_id % 700) || CASE WHEN page_id % 2 = 0 THEN '-555-' ELSE '.555.' END || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0') || ' fax 12-34' AS text FROM pages),
p AS (SELECT page_id, unnest(list_concat(regexp_extract_all(text, '\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}'), regexp_extract_all(text, '\+?[0-9]{1,4}[-.\s]?[0-9]{2,4}[-.\s]?[0-9]{3,4}[-.\s]?[0-9]{3,4}'))) AS raw FROM t)
SELECT DISTINCT page_id, trim(raw) AS phone FROM p WHERE len(regexp_replace(raw, '\D', '', 'g')) BETWEEN 10 AND 15""")
def footer_phones(spark, d):
    """Phones in the footers of parsed pages, to which each page's number is added."""
    key = F.col("page_id")
    number = F.concat(F.lit(" tel. "), F.when(key % 3 == 0, "+1 ").otherwise(""), (200 + key % 700).cast("string"), F.when(key % 2 == 0, "-555-").otherwise(".555."), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit(" fax 12-34"))
    html = F.regexp_replace("html", "(?s)(<footer[^>]*>).*?(</footer>)", "$1\x00$2")
    pages = table(spark, d, "pages").select("url", F.replace(html, F.lit("\x00"), number).alias("html"), key.cast("int").alias("page_ord"))
    return P.parse_pages(pages).select(F.col("page_ord").cast("long").alias("page_id"), F.explode(G.phones(F.col("footer"))).alias("phone"))


_STREET = "(c_custkey % 40 + 1) || CASE c_custkey % 3 WHEN 0 THEN ' Main' WHEN 1 THEN ' Lake' ELSE ' Elm' END || CASE WHEN c_custkey % 7 < 3 THEN ' Street' WHEN c_custkey % 7 = 3 THEN ' St' WHEN c_custkey % 7 = 4 THEN ' Drive' ELSE ' Dr' END || ', Reno' || CASE WHEN c_custkey % 5 < 2 THEN ' NV' ELSE '' END || CASE WHEN c_custkey % 4 = 1 THEN ', ' || (89000 + c_custkey % 900) ELSE '' END"


@query(f"""WITH a AS (SELECT c_nationkey AS site, c_custkey AS ord, {_STREET} AS address FROM customer), k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(split_part(address, ',', 1)), '\\bstreet\\b', 'st'), '\\bdrive\\b', 'dr'), '[^a-z0-9 ]', '', 'g') AS key FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY CAST(NOT regexp_matches(address, '\\d{{5}}') AS INT), -len(address), ord) AS n, min(ord) OVER (PARTITION BY site, key) AS first_at FROM k)
SELECT site, trim(key) AS key, address, first_at AS "at" FROM r WHERE n = 1""")
def distinct_addresses(spark, d):
    """The fullest address of each street, of customers by nation."""
    return contact.dedupe_addresses(table(spark, d, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_custkey").alias("at"), F.expr(_STREET).alias("address")))


# Merges and scores --------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT p_brand AS site, p_type AS platform, min(p_partkey) AS ord, 'https://own/' || min(p_partkey) AS url, 'extracted' AS source, 85 + count(*) % 10 AS confidence FROM part WHERE p_size % 3 > 0 GROUP BY p_brand, p_type),
t AS (SELECT p_brand AS site, p_type AS platform, min(p_partkey) AS ord, 'https://third/' || min(p_partkey) AS url, CASE WHEN min(p_partkey) % 2 = 0 THEN 'verified' ELSE 'third_party' END AS source, CASE WHEN min(p_partkey) % 2 = 0 THEN 100 ELSE 70 END AS confidence FROM part WHERE p_size % 5 = 0 GROUP BY p_brand, p_type),
b AS (SELECT coalesce(e.site, t.site) AS site, coalesce(e.ord, t.ord + 1000000) AS place, coalesce(t.platform, e.platform) AS platform, coalesce(t.url, e.url) AS url, coalesce(t.source, e.source) AS source, coalesce(t.confidence, e.confidence) AS confidence FROM e FULL JOIN t ON e.site = t.site AND e.platform = t.platform)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY CAST(source <> 'verified' AS INT), confidence DESC, place) AS ord, platform, url, source, CAST(confidence AS INT) AS confidence FROM b""")
def merged_links(spark, d):
    """Found links of each brand merged with a third party's, one for each kind of part."""
    parts = table(spark, d, "part")
    first = F.min("p_partkey")

    def side(rows: DataFrame, start: str, source: Column, confidence: Column) -> DataFrame:
        return rows.groupBy(F.col("p_brand").alias("site"), F.col("p_type").alias("platform")).agg(first.alias("ord"), F.concat(F.lit(start), first.cast("string")).alias("url"), source.alias("source"), confidence.cast("int").alias("confidence"))

    own = side(parts.filter("p_size % 3 > 0"), "https://own/", F.lit("extracted"), 85 + F.count("*") % 10)
    third = side(parts.filter("p_size % 5 = 0"), "https://third/", F.when(first % 2 == 0, "verified").otherwise("third_party"), F.when(first % 2 == 0, 100).otherwise(70))
    return merge.merge_keyed(own, third, "platform").withColumn("ord", F.col("ord").cast("long"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Third-party records of brands: their smallest parts' types as colours, every second brand claimed."""
    rows = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("k"))
    colour = F.struct(F.concat(F.lit("#"), F.substring(F.md5("p_type"), 1, 6)).alias("hex"), _nth(("brand", "dark", "accent", "light"), F.col("k")).alias("type"), F.lit(50).alias("brightness"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", colour.alias("c")))), lambda x: x["c"]).alias("colors")
    named = rows.groupBy("p_brand").agg(listed, (F.min("k") % 2 == 0).alias("claimed"))
    return named.select(F.col("p_brand").alias("domain"), "claimed", "colors")


@query()
def merged_colours(spark, d):
    """A brand's palette merged with a third party's: a fold by order, checked against cases in the tests."""
    hex_ = F.concat(F.lit("#"), F.substring(F.md5(F.concat("p_brand", "p_name").cast("binary")), 1, 6))
    roles = ("primary", "secondary", "accent", "background", "text", "other", "accent")
    named = table(spark, d, "part").groupBy(F.col("p_brand").alias("site"), hex_.alias("hex")).agg(F.min("p_partkey").cast("int").alias("ord"), F.min("p_size").alias("p_size"))
    # a palette has ten colours at most
    best = named.withColumn("n", F.expr("row_number() over (partition by site order by ord)")).filter("n <= 10")
    own = best.select("site", "ord", "hex", _nth(roles, F.col("p_size")).alias("role"), (F.col("p_size") + 40).cast("int").alias("confidence"), F.lit("extracted").alias("source"), F.lit(0.1).alias("area_share"))
    return merge.merge_colors(own, merge.record_colors(_records(spark, d)))


_DIMS = tuple(consistency.MAXIMA)
_SCORED = {x: f"CASE WHEN (c_custkey + {k}) % {k + 4} > 0 THEN c_custkey * {2 * k + 3} % {m + 1} END" for k, (x, m) in enumerate(consistency.MAXIMA.items())}


@query(f"""WITH b AS (SELECT c_custkey AS site, c_custkey % 6 AS n_pages, {', '.join(f'{v} AS {x}' for x, v in _SCORED.items())} FROM customer),
t AS (SELECT *, {' + '.join(f'coalesce({x}, 0)' for x in _DIMS)} AS earned, {' + '.join(f'CASE WHEN {x} IS NULL THEN 0 ELSE {m} END' for x, m in consistency.MAXIMA.items())} AS possible, {' + '.join(f'CAST({x} IS NOT NULL AS INT)' for x in _DIMS)} AS n FROM b),
s AS (SELECT *, CASE WHEN possible > 0 THEN CAST(floor(earned / possible * 100.0 + 0.5) AS INT) END AS score FROM t)
SELECT site, score, CASE WHEN n_pages >= 3 AND n >= 3 THEN CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' WHEN score IS NOT NULL THEN 'F' END END AS grade FROM s""")
def graded_sites(spark, d):
    """Scores and grades of breakdowns, some of whose dimensions lack data; a customer is a site."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), (F.col("c_custkey") % 6).cast("int").alias("n_pages"), *[F.expr(v).cast("int").alias(x) for x, v in _SCORED.items()])
    as_struct = lambda x, m: F.struct(F.col(x).alias("score"), F.lit(m).alias("max"), F.when(F.col(x).isNotNull(), "scored").otherwise("insufficient_data").alias("status"), F.lit(None).cast("string").alias("reason")).alias(x)
    return consistency.summarise(rows.select("site", "n_pages", *[as_struct(x, m) for x, m in consistency.MAXIMA.items()])).select("site", "score", "grade")


@query("""WITH s AS (SELECT o_orderkey % 5 > 0 AS evaluated, o_custkey % 4 > 0 AS color_hit, o_orderkey % 7 > 0 AS font_hit, o_custkey % 9 > 0 AS logo_hit FROM orders),
t AS (SELECT count(*) AS n_evaluated, count(*) FILTER (color_hit) AS color_hits, count(*) FILTER (font_hit) AS font_hits, count(*) FILTER (logo_hit) AS logo_hits FROM s WHERE evaluated)
SELECT *, (color_hits + font_hits + logo_hits) / (n_evaluated * 3.0::DOUBLE) AS total, (color_hits + font_hits + logo_hits) / (n_evaluated * 3.0::DOUBLE) >= 0.75 AS passed FROM t""")
def evaluation_totals(spark, d):
    """Totals over every order as an evaluated brand."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return evaluation.totals(table(spark, d, "orders").select(o.cast("string").alias("site"), (o % 5 > 0).alias("evaluated"), (c % 4 > 0).alias("color_hit"), (o % 7 > 0).alias("font_hit"), (c % 9 > 0).alias("logo_hit")))


@query("""SELECT o_orderkey AS id, 'order-' || strftime(o_orderdate, '%Y-%m') || '-' || o_orderkey AS slug, o_totalprice AS price FROM orders JOIN customer ON o_orderkey = c_custkey""")
def report_reads(spark, d):
    """Orders as reports in a table for point reads, from which those with customers' numbers are read by id."""
    folder = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    store = ReportTable(spark, folder)
    slug = F.concat_ws("-", F.lit("order"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderkey").cast("string"))
    store.write(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), slug.alias("slug"), F.col("o_totalprice").alias("price")))
    found = cut(store.of_ids(table(spark, d, "customer").select(F.col("c_custkey").alias("id"))))
    drop_folder(spark, folder)
    return found.select("id", "slug", "price")


_PATH = "CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END"
_BRANDED = f"""p AS (SELECT page_id, {_SITE} AS site, url, {_PATH} AS path, p_size FROM pages JOIN part ON page_id % 100 = p_partkey),
f AS (SELECT site, arg_min({_listed(_CHROMATIC)}[p_size % 6 + 1], page_id) AS brand FROM p GROUP BY site)"""


@query(f"""WITH {_BRANDED}, c AS (SELECT p.site, url, CASE page_id % 3 WHEN 0 THEN brand WHEN 1 THEN {_listed(_CHROMATIC)}[p_size // 2 % 6 + 1] END AS hex, brand, CASE page_id % 4 WHEN 0 THEN 'sora' WHEN 1 THEN 'karla' WHEN 2 THEN 'bitter' END AS font, path FROM p JOIN f ON p.site = f.site),
g AS (SELECT site, count(DISTINCT url) FILTER (hex IS NOT NULL) AS n, count(DISTINCT url) FILTER (hex = brand) AS w, count(DISTINCT url) FILTER (font IS NOT NULL) AS m, count(DISTINCT url) FILTER (font = 'sora') AS v,
  list_sort(list(DISTINCT 'Page ' || path || ' uses non-brand font: bitter') FILTER (font = 'bitter')) AS stray FROM c GROUP BY site)
SELECT site, CASE WHEN n > 0 THEN CAST(floor(25 * w / n + 0.5) AS INT) END AS color, CASE WHEN n = 0 THEN 'no color usage was found on the crawled pages' END AS color_reason, CASE WHEN n > 0 AND w / n < 0.8::DOUBLE THEN 'Only ' || CAST(floor(100 * w / n + 0.5) AS INT) || '% of pages use brand colors' ELSE '' END AS color_issues,
  CASE WHEN m > 0 THEN CAST(floor(20 * v / m + 0.5) AS INT) END AS typography, CASE WHEN m = 0 THEN 'no font declarations were found on the crawled pages' END AS typography_reason,
  CASE WHEN m > 0 THEN concat_ws('; ', nullif(array_to_string(coalesce(stray, [])[:10], '; '), ''), CASE WHEN v / m < 0.9::DOUBLE THEN 'Font consistency at ' || CAST(floor(100 * v / m + 0.5) AS INT) || '%' END) ELSE '' END AS typography_issues FROM g""")
def consistency_dimensions(spark, d):
    """How consistent each site's colours and fonts are with its brand's."""
    pages = _styled_pages(spark, d)
    page, size = F.col("page_id"), F.col("p_size")
    brand = pages.groupBy("site").agg(F.min_by(_nth(_CHROMATIC, size), "page_id").alias("hex")).withColumn("rank", F.lit(1)).withColumn("role", F.lit("primary"))
    rows = pages.join(brand.select("site", "hex"), "site")
    colour = F.when(page % 3 == 0, F.col("hex")).when(page % 3 == 1, _nth(_CHROMATIC, F.floor(size / 2)))
    font = F.when(page % 4 == 0, "Sora").when(page % 4 == 1, "'Karla', serif").when(page % 4 == 2, "Bitter !important")
    css = F.concat(F.lit("p{margin:0}"), F.coalesce(F.concat(F.lit(".x{border-color:"), colour, F.lit("}")), F.lit("")), F.coalesce(F.concat(F.lit("p{font-family:"), font, F.lit("}")), F.lit("")))
    own = rows.select("site", page.cast("int").alias("page_ord"), "url", "html", css.alias("css"))
    sheets = own.select("site", "page_ord", F.col("url").alias("page_url"), F.lit(0).alias("css_ord"), "css")
    sites = own.groupBy("site").agg(F.count("*").alias("n_pages"))
    fonts = brand.select("site", F.explode(F.array(F.struct(F.lit(1).alias("rank"), F.lit("primary").alias("role"), F.lit("Sora").alias("name")), F.struct(F.lit(2).alias("rank"), F.lit("secondary").alias("role"), F.lit("Karla").alias("name")))).alias("f")).select("site", "f.*")
    c = consistency.color_score(sites, consistency.page_colours(own, sheets), brand)
    t = consistency.typography_score(sites, consistency.page_fonts(sheets), fonts)
    joined = c.join(t, "site")
    return joined.select("site", F.col("color.score").alias("color"), F.col("color.reason").alias("color_reason"), F.array_join("color_issues", "; ").alias("color_issues"), F.col("typography.score").alias("typography"), F.col("typography.reason").alias("typography_reason"), F.array_join("typography_issues", "; ").alias("typography_issues"))


@query("""WITH p AS (SELECT p_brand AS site, p_partkey AS ord, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_size FROM part), r AS (SELECT * FROM p WHERE k <= 3),
g AS (SELECT site, count(*) AS n, count(DISTINCT ord) FILTER (k < 4) AS checked, arg_min(p_size, k) AS size, list(p_size % 2 = 0 ORDER BY k) AS casual, arg_max(k, k) AS last FROM r GROUP BY site),
s AS (SELECT *, len(list_filter(casual, lambda c: c = (size % 3 = 0))) / n AS share FROM g)
SELECT site, CASE WHEN size % 5 <> 0 AND n >= 2 THEN CAST(floor(25 * share + 0.5) AS INT) END AS tone, CASE WHEN size % 5 = 0 THEN 'no tone of voice could be determined' WHEN n < 2 THEN 'needs at least two of the home, about and blog pages to compare tone' END AS reason,
  CASE WHEN size % 5 <> 0 AND n >= 2 AND share < 0.8 AND last = 3 THEN 'Blog/news section may have different tone than main site' ELSE '' END AS issues FROM s""")
def tone_dimensions(spark, d):
    """How each brand's home, about and blog pages keep to its tone; its first three parts are these pages."""
    rank = F.expr("row_number() over (partition by p_brand order by p_partkey)")
    p = table(spark, d, "part").withColumn("k", rank)
    where = F.when(F.col("k") == 1, "/").when(F.col("k") == 2, "/company").when(F.col("k") == 3, "/News/1").otherwise("/x")
    casual = F.when(F.col("p_size") % 2 == 0, "Go!").otherwise("Go")
    pages = p.select(F.col("p_brand").alias("site"), F.col("p_partkey").cast("int").alias("page_ord"), F.concat(F.lit("https://b.org"), where).alias("url"), F.array(F.lit("Read"), casual).alias("cta_buttons"))
    first = p.filter("k = 1")
    voice = F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 0, F.array(F.lit("Playful"))).otherwise(F.array(F.lit("Simple")))
    rows = consistency.tone_score(pages, first.select(F.col("p_brand").alias("site"), voice.alias("traits")))
    return rows.select("site", F.col("tone.score").alias("tone"), F.col("tone.reason").alias("reason"), F.array_join("tone_issues", "; ").alias("issues"))
