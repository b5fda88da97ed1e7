"""Queries over reports, edits, views and third-party records, derived from orders, customers and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as T, url as U
from ..operators import exports, identity, merge, typography
from ..sources.tables import table
from ..streaming import state
from .catalog import query
from .marked import _BUTTONS, _P, _dressed

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


def _nth(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


@query("""SELECT o_orderkey AS id, o_custkey % 5 = 2 AS is_owner, CASE WHEN o_custkey % 5 = 2 THEN 'e' || o_orderkey END AS edits, o_orderstatus AS status FROM orders WHERE o_custkey % 5 = 2
UNION ALL SELECT o_orderkey, false, NULL, 'completed' FROM orders WHERE o_custkey % 5 <> 2 AND o_orderkey % 3 = 0 AND o_orderstatus = 'F'""")
def report_views(spark, d):
    """What the holder of a token sees of reports: their own with edits, of others the public, finished ones."""
    o = table(spark, d, "orders")
    own = F.col("o_custkey") % 5
    status = F.when(own == 2, F.col("o_orderstatus")).when(F.col("o_orderstatus") == "F", "completed").otherwise("crawling")
    rows = o.select(F.col("o_orderkey").alias("id"), F.sha2(F.concat(F.lit("token"), own.cast("string")).cast("binary"), 256).alias("owner_token_hash"), (F.col("o_orderkey") % 3 == 0).alias("is_public"), status.alias("status"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("edits"))
    return merge.view_of(rows, F.lit("token2")).select("id", "is_owner", "edits", "status")


@query("""WITH n AS (SELECT max(o_orderdate) AS now FROM orders), r AS (SELECT o_custkey AS site, o_orderkey AS id, o_orderdate AS made FROM orders, n WHERE o_orderstatus = 'F' AND o_orderkey % 7 <> 0 AND o_orderdate + INTERVAL 400 DAY > now),
k AS (SELECT site, arg_max(id, (made, id)) AS id, max(made) AS made FROM r GROUP BY site) SELECT l_orderkey * 10 + l_linenumber AS request, site, id AS source_report, 'd' || id AS data FROM lineitem JOIN k ON l_suppkey = site""")
def cloned_reports(spark, d):
    """Copies of cached reports for those who ask again; a line item asks for the customer with its supplier's number."""
    o = table(spark, d, "orders")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("crawling")
    reports = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("site"), status.alias("status"), F.when(F.col("o_orderkey") % 7 == 0, F.lit(1)).alias("source_report"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("expires_at"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("data"))
    asked = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request"), F.col("l_suppkey").alias("site"))
    return state.clones(state.cached_reports(reports, now), asked).select("request", "site", "source_report", "data")


@query("""WITH l AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type) || ' x ' || p_brand, ' ') AS words FROM part)
SELECT p_partkey, array_to_string(list_transform(words[:3], lambda w: w[:4]), '|') AS clamped, array_to_string(words, ' ')[:9] AS head, array_to_string(words, ' ') AS collapsed FROM l""")
def clamped_texts(spark, d):
    """Lists and texts cut to what a model may return, and white space made one."""
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("x"), "p_brand"), " ")
    joined = F.array_join(words, " ")
    loose = F.concat(F.lit("\n\t "), F.replace(joined, F.lit(" "), F.lit("  \r\n ")), F.lit("  "))
    return table(spark, d, "part").select("p_partkey", F.array_join(T.clamp_list(words, 3, 4), "|").alias("clamped"), T.clamp_text(joined, 9).alias("head"), T.collapse(loose).alias("collapsed"))


@query("""SELECT p_partkey, CASE WHEN p_size % 11 >= 8 THEN 'Good' WHEN p_size % 11 >= 5 THEN 'Needs work' ELSE 'Poor' END AS rating, ['Verified', 'Third party', 'Extracted', 'Inferred', 'Not found'][p_partkey % 5 + 1] AS label,
CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B' WHEN p_size * 2 >= 70 THEN 'C' WHEN p_size * 2 >= 60 THEN 'D' ELSE 'F' END AS grade, CASE WHEN p_size >= 40 THEN 'high' WHEN p_size >= 30 THEN 'middle' ELSE 'low' END AS bar FROM part""")
def text_labels(spark, d):
    """Scores and sources in words."""
    size = F.col("p_size")
    source = _nth(("verified", "third_party", "extracted", "inferred", "else"), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", T.seo_rating(size % 11).alias("rating"), T.source_label(source).alias("label"), T.grade(size * 2).alias("grade"), T.bar_level(size / 50).alias("bar"))


@query("""WITH f AS (SELECT p_brand AS report, p_partkey AS ord, p_name || ' ' || p_size AS name, CASE WHEN p_size % 2 = 0 THEN 'https://g' END AS google_url FROM part), e AS (SELECT DISTINCT report, name, len(name) % 4 AS k FROM f)
SELECT f.report, ord, CASE WHEN k = 1 THEN upper(f.name) ELSE f.name END AS name, CASE WHEN k <> 1 THEN google_url END AS google_url, k = 1 AS user_edited FROM f JOIN e ON f.report = e.report AND f.name = e.name WHERE k <> 2""")
def edited_fonts(spark, d):
    """A brand's fonts, some renamed, some hidden, by the length of their names."""
    own = table(spark, d, "part").select(F.col("p_brand").alias("report"), F.col("p_partkey").alias("ord"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), F.when(F.col("p_size") % 2 == 0, "https://g").alias("google_url"))
    k = F.length("name") % 4
    edits = own.select("report", "name", F.when(k == 1, F.upper("name")).alias("new_name"), (k == 2).alias("hidden")).distinct()
    return merge.apply_font_edits(own, edits)


@query("SELECT c_custkey AS report, CASE WHEN c_custkey % 4 = 0 THEN 'New ' || c_custkey ELSE c_name END AS brand_name FROM customer")
def edited_names(spark, d):
    """Names of reports; blank edits change nothing."""
    c = table(spark, d, "customer")
    new = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("  New "), F.col("c_custkey").cast("string"), F.lit(" "))).otherwise("  ")
    return merge.apply_name_edit(c.select(F.col("c_custkey").alias("report"), F.col("c_name").alias("brand_name")), c.filter("c_custkey % 3 > 0 or c_custkey % 4 = 0").select(F.col("c_custkey").alias("report"), new.alias("new_brand")))


_ROLES = ("primary", "accent", "text")


@query("""WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part),
g AS (SELECT p_brand AS site, sum(p_size) % 100 AS score, count(*) AS n,
  string_agg('| ' || ['primary', 'accent', 'text'][k % 3 + 1] || ' | #' || upper(substr(md5(p_name), 1, 6)) || ' | rgb(' || ('0x' || substr(md5(p_name), 1, 2))::INT || ', ' || ('0x' || substr(md5(p_name), 3, 2))::INT || ', ' || ('0x' || substr(md5(p_name), 5, 2))::INT || ') |', chr(10) ORDER BY k) FILTER (k <= 6) AS colors,
  string_agg('- **' || ['primary', 'accent', 'text'][k % 3 + 1] || ':** ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' (400, ' || p_size * 10 || ')' ELSE '' END, chr(10) ORDER BY k) FILTER (k <= 4) AS fonts FROM p GROUP BY p_brand)
SELECT site, concat_ws(chr(10), '# ' || site || ' Brand Guideline', '', '**Domain:** ' || site, '**Generated:** 2024-05-06', CASE WHEN score >= 50 THEN '**Brand Health Score:** B (' || score || '/100)' ELSE '**Brand Health Score:** Not enough data for a grade' END, '', '## Brand Summary', 'About ' || site, '',
  '## Color Palette', '', '| Role | Hex | RGB |', '|------|-----|-----|', colors, '', '## Typography', '', fonts, '', '## Tone & Voice', '', '**Traits:** Simple, Playful', '', CASE WHEN n % 2 = 0 THEN concat_ws(chr(10), '## Brand Channels', '', '- **twitter:** https://x.com/' || n, '') END, '---', '*Analyzed ' || n || ' pages*') AS markdown FROM g""")
def markdown_reports(spark, d):
    """Reports of brands as Markdown."""
    p = table(spark, d, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    role = _nth(_ROLES, F.col("k"))
    colour = F.struct("k", F.struct(role.alias("role"), F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6)).alias("hex")).alias("v"))
    variants = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("400"), (F.col("p_size") * 10).cast("string"))).otherwise(F.array().cast("array<string>"))
    font = F.struct("k", F.struct(role.alias("role"), F.col("p_name").alias("name"), variants.alias("variants")).alias("v"))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda s: s["v"])
    g = p.groupBy(F.col("p_brand").alias("site")).agg(listed(colour).alias("colors"), listed(font).alias("fonts"), (F.sum("p_size") % 100).alias("score"), F.count("*").alias("n_pages"))
    links = F.when(F.col("n_pages") % 2 == 0, F.array(F.struct(F.lit("twitter").alias("platform"), F.concat(F.lit("https://x.com/"), F.col("n_pages").cast("string")).alias("url")))).otherwise(F.array().cast("array<struct<platform:string,url:string>>"))
    rows = g.select("site", F.col("site").alias("brand_name"), F.to_timestamp(F.lit("2024-05-06 07:08:09")).alias("generated_at"), F.when(F.col("score") >= 50, "B").alias("grade"), "score", F.concat(F.lit("About "), "site").alias("description"), "colors", "fonts", F.array(F.lit("Simple"), F.lit("Playful")).alias("traits"), links.alias("links"), "n_pages")
    return exports.markdown_report(rows)


@query(f"""WITH {_P}, {_BUTTONS}, h AS (SELECT {_SITE} AS site, page_id, trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) AS h1 FROM pages), d AS (SELECT site, h1, min(page_id) AS place FROM h WHERE h1 <> '' GROUP BY site, h1),
a AS (SELECT site, list(h1 ORDER BY place) AS all_h1 FROM d GROUP BY site), f AS (SELECT site, content, min((page_id, pos)) AS place FROM b GROUP BY site, content), c AS (SELECT site, list(content ORDER BY place)[:15] AS ctas FROM f GROUP BY site),
t AS (SELECT c.site, coalesce(all_h1, []) AS all_h1, ctas, lower(array_to_string(list_concat(coalesce(all_h1, [])[:20], ctas), ' ')) AS text FROM c LEFT JOIN a ON a.site = c.site)
SELECT site, concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in identity.TONES)}) AS traits, CAST(least(90, 35 + 2 * (least(10, len(all_h1)) + least(20, len(all_h1)) + len(ctas))) AS INT) AS inferred_confidence FROM t""")
def site_tones(spark, d):
    """Traits of each site's voice by the words of its headlines and buttons."""
    return identity.tones(identity.copy_for_analysis(_dressed(spark, d, identity.COPY))).select("site", F.array_join("traits", ",").alias("traits"), "inferred_confidence")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A third party's record for every supplier."""
    k, name = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    link = lambda kind, url: F.struct(F.lit(kind).alias("name"), url.alias("url"))
    font = lambda n, kind, weights: F.struct(n.alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("string").alias("originId"), weights.alias("weights"))
    form = lambda src, kind: F.struct(src.alias("src"), F.lit(None).cast("string").alias("background"), F.lit(kind).alias("format"), F.lit(1).alias("size"))
    logo = F.struct(F.when(k % 2 == 0, "logo").otherwise("symbol").alias("type"), F.lit("dark").alias("theme"), F.array(form(F.concat(F.lit("https://c/"), name, F.lit(".png")), "png"), form(F.concat(F.when(k % 3 == 0, "http").otherwise("https"), F.lit("://c/"), name, F.lit(".svg")), "svg")).alias("formats"))
    return table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), F.concat(F.lit("s"), name, F.lit(".org")).alias("domain"), F.when(k % 5 > 0, k % 5 == 1).alias("claimed"), F.when(k % 4 > 0, F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("Short "), name))).alias("description"),
        F.when(k % 3 > 0, F.concat(F.lit("Long "), name)).alias("longDescription"), F.array(link("Twitter", F.concat(F.lit("https://x.com/"), name)), link("crunchbase", F.lit("https://c.com")), link("youtube", F.lit("http://y.com")), link("linkedin", F.concat(F.lit("https://l.com/"), name))).alias("links"),
        F.array(logo).alias("logos"), F.array(font(F.concat(F.lit(" A"), name), "other", F.array(F.lit(400), F.lit(700))), font(F.lit(" "), "title", F.array(F.lit(1))), font(F.lit("B"), "title", F.lit(None).cast("array<int>")), font(F.lit("C"), "body", F.array().cast("array<int>")), font(F.lit("D"), "x", F.array(F.lit(300)))).alias("fonts"),
    )


_STANDING = "CASE WHEN s_suppkey % 5 = 1 THEN 'verified' ELSE 'third_party' END AS source, CASE WHEN s_suppkey % 5 = 1 THEN 100 ELSE 70 END AS confidence"


@query(f"""SELECT 's' || s_suppkey || '.org' AS site, 1 AS ord, 'twitter' AS platform, 'https://x.com/' || s_suppkey AS url, {_STANDING} FROM supplier UNION ALL SELECT 's' || s_suppkey || '.org', 4, 'linkedin', 'https://l.com/' || s_suppkey, {_STANDING} FROM supplier""")
def record_links(spark, d):
    """Profiles of third-party records: secure links to known platforms."""
    return merge.record_links(_records(spark, d))


@query(f"""SELECT 's' || s_suppkey || '.org' AS site, f.ord, CASE WHEN f.ord = 1 THEN 'A' || s_suppkey ELSE f.name END AS name, f.role, f.variants, {_STANDING} FROM supplier, (VALUES (1, '', 'primary', '400,700'), (2, 'B', 'heading', ''), (3, 'C', 'primary', ''), (4, 'D', 'secondary', '300')) AS f(ord, name, role, variants)""")
def record_fonts(spark, d):
    """Fonts of third-party records."""
    return merge.record_fonts(_records(spark, d)).select("site", "ord", "name", "role", F.array_join("variants", ",").alias("variants"), "source", "confidence")


@query("""SELECT 's' || s_suppkey || '.org' AS site, s_name AS name, CASE WHEN s_suppkey % 4 > 1 THEN 'Short ' || s_suppkey WHEN s_suppkey % 3 > 0 THEN 'Long ' || s_suppkey ELSE '' END AS description,
CASE WHEN s_suppkey % 3 = 0 THEN 'https://c/' || s_suppkey || '.png' ELSE 'https://c/' || s_suppkey || '.svg' END AS logo_url, coalesce(s_suppkey % 5 = 1, false) AS verified FROM supplier""")
def record_facts(spark, d):
    """Names, descriptions and logos of third-party records."""
    return merge.record_facts(_records(spark, d))


@query("""WITH p AS (SELECT p_brand AS site, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_brand IN ('Brand#1', 'Brand#2'))
SELECT string_agg('#' || substr(md5(p_name || p_size), 1, 6), ' ' ORDER BY k) FILTER (site = 'Brand#1' AND k <= 5) AS left_colors, string_agg(p_name, '|' ORDER BY k) FILTER (site = 'Brand#1' AND k <= 3) AS left_fonts,
  string_agg('#' || substr(md5(p_name || p_size), 1, 6), ' ' ORDER BY k) FILTER (site = 'Brand#2' AND k <= 5) AS right_colors, string_agg(p_name, '|' ORDER BY k) FILTER (site = 'Brand#2' AND k <= 3) AS right_fonts FROM p""")
def compared_reports(spark, d):
    """Two brands side by side."""
    p = table(spark, d, "part").withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    colours = p.select(F.col("p_brand").alias("site"), "rank", F.concat(F.lit("#"), F.substring(F.md5(F.concat("p_name", F.col("p_size").cast("string")).cast("binary")), 1, 6)).alias("hex"))
    both = merge.compare_reports(colours, p.select(F.col("p_brand").alias("site"), "rank", F.col("p_name").alias("name")), "Brand#1", "Brand#2")
    side = lambda site, field, mark: F.array_join(F.col(f"`{site}`.{field}"), mark)
    return both.select(side("Brand#1", "hexs", " ").alias("left_colors"), side("Brand#1", "names", "|").alias("left_fonts"), side("Brand#2", "hexs", " ").alias("right_colors"), side("Brand#2", "names", "|").alias("right_fonts"))


@query("""WITH e AS (SELECT p_brand AS site, 'Q ' || p_name AS name, 'heading' AS role, CASE WHEN bool_or(p_size % 2 = 0) THEN 98 ELSE 85 END AS confidence, min(p_partkey) * 10 AS ord FROM part GROUP BY p_brand, p_name
  UNION ALL SELECT p_brand, 'Work', 'primary', 85, min(p_partkey) * 10 + 1 FROM part GROUP BY p_brand UNION ALL SELECT p_brand, 'Tiempos', 'button', 80, min(p_partkey) * 10 + 2 FROM part GROUP BY p_brand)
SELECT * FROM (SELECT site, row_number() OVER (PARTITION BY site ORDER BY list_position(['primary', 'heading', 'button', 'accent', 'secondary'], role), confidence DESC, ord) AS rank, name, role, CAST(confidence AS INT) AS confidence FROM e) WHERE rank <= 10""")
def computed_fonts(spark, d):
    """Each brand's fonts from computed styles of a few elements of its pages; a part is a page."""
    style = lambda family, weight: F.struct(family.alias("family"), F.lit(weight).alias("weight"))
    name, none = F.concat(F.lit("Q "), "p_name"), F.array().cast("array<string>")
    computed = F.create_map(F.lit("h1"), style(F.concat(F.lit("'"), name, F.lit("', serif")), "700"), F.lit("body"), style(F.lit("var(--text, x)"), "400"), F.lit("button"), style(F.lit("Arial"), "600"))
    named = F.transform_values(computed, lambda k, v: F.when(k == "h1", F.struct(name.alias("family"), v["weight"].alias("weight"))).otherwise(v))
    pages = table(spark, d, "part").select(
        F.col("p_brand").alias("site"), F.col("p_partkey").cast("int").alias("page_ord"), F.lit("u").alias("url"), named.alias("computed"), F.array(F.lit("Tiempos")).alias("loaded"), F.when(F.col("p_size") % 2 == 0, F.array(name)).otherwise(none).alias("google"),
        F.create_map(F.lit("--text"), F.lit("Work, sans-serif")).alias("variables"), F.array().cast("array<struct<type:string,url:string,fonts:array<string>>>").alias("sources"),
    )
    return typography.final_fonts(typography.from_computed(pages)).select("site", F.col("rank").cast("long").alias("rank"), "name", "role", "confidence")
