"""SEO findings per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo as G, text as T, url as U

SEPARATORS = ("|", "-", "–", ":", "•", "—")
#: Recommendations that fill up a short list of findings, in order.
DEFAULTS = ("Consider page speed optimization", "Ensure mobile-friendliness", "Review internal linking structure", "Add alt text to images", "Submit XML sitemap")


def titles(pages: DataFrame) -> DataFrame:
    """Per site: separator vote, consistency, brand segment, average length."""
    own = pages.filter("title <> ''")
    votes = [F.sum(F.contains("title", F.lit(s)).cast("int")).alias(f"v{i}") for i, s in enumerate(SEPARATORS)]
    got = own.groupBy("site").agg(F.count("*").alias("n_titles"), F.avg(F.length("title")).alias("mean"), F.min_by("title", "page_ord").alias("first_title"), *votes)
    counts = F.array(*[F.col(f"v{i}") for i in range(len(SEPARATORS))])
    most = F.array_max(counts)
    marks = F.array(*[F.lit(s) for s in SEPARATORS])
    got = got.withColumn("separator", F.when(most == 0, F.lit("|")).otherwise(F.element_at(marks, F.array_position(counts, most).cast("int"))))
    got = got.withColumn("is_consistent", most >= F.col("n_titles") * 0.6).withColumn("avg_length", T.half_up(F.col("mean")).cast("int"))
    parts = F.transform(F.split(F.col("first_title"), F.concat(F.lit("\\Q"), F.col("separator"), F.lit("\\E"))), lambda x: F.trim(x))
    got = got.withColumn("last", F.when(F.col("is_consistent") & (F.size(parts) >= 2), F.element_at(parts, -1)))
    shown = own.join(got.select("site", "last"), "site").groupBy("site").agg(F.sum(F.when(F.contains("title", F.col("last")), 1).otherwise(0)).alias("n_last"))
    got = got.join(shown, "site")
    got = got.withColumn("brand", F.when(F.col("n_last") >= F.col("n_titles") * 0.5, F.col("last")))
    pattern = F.when(F.col("brand").isNotNull() & (F.col("brand") != ""), F.concat_ws(" ", F.lit("[Page Name]"), "separator", "brand")).otherwise("Varies")
    return got.select("site", "n_titles", "separator", "is_consistent", "avg_length", "brand", pattern.alias("pattern"))


def descriptions(pages: DataFrame) -> DataFrame:
    """Per site: share of pages with a description of over ten characters, average length, pages missing one, pages with a repeated one."""
    has = F.length("description") > 10
    key = F.substring(F.trim(F.lower("description")), 1, 80)
    repeated = pages.filter(has).groupBy("site", key.alias("_key")).agg(F.count("*").alias("n")).filter("n > 1").groupBy("site").agg(F.sum("n").alias("n_duplicate"))
    got = pages.groupBy("site").agg(
        F.count("*").alias("n_pages"),
        F.sum(has.cast("int")).alias("n_described"),
        F.avg(F.when(has, F.length("description"))).alias("mean"),
    )
    return got.join(repeated, "site", "left").select(
        "site", "n_pages", (F.col("n_pages") - F.coalesce("n_described", F.lit(0))).alias("n_undescribed"),
        T.half_up(F.col("n_described") / F.col("n_pages") * 100).cast("int").alias("coverage"),
        F.coalesce(T.half_up(F.col("mean")), F.lit(0)).cast("int").alias("avg_description"),
        F.coalesce("n_duplicate", F.lit(0)).alias("n_duplicate"),
    )


def h1_tags(pages: DataFrame) -> DataFrame:
    n = F.size(F.filter("headings", lambda h: h["level"] == 1))
    return pages.groupBy("site").agg(F.sum((n == 0).cast("int")).alias("missing_h1"), F.sum((n > 1).cast("int")).alias("multiple_h1"))


def schema_types(pages: DataFrame) -> DataFrame:
    """site, types: distinct types of structured data, in order of appearance."""
    raw = pages.select("site", "page_ord", F.posexplode("schema_data").alias("pos", "item"))
    name = F.get_json_object("item", "$['@type']")
    many = F.from_json(name, "array<string>")
    listed = raw.select("site", "page_ord", "pos", F.posexplode(F.when(name.startswith("["), many).otherwise(F.array(name))).alias("k", "type")).filter("type is not null")
    first = listed.groupBy("site", "type").agg(F.min(F.struct("page_ord", "pos", "k")).alias("at"))
    return first.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]).alias("types"))


def _finding(test: Column, status: str, kind: str, headline: Column | str) -> Column:
    return F.when(test, F.struct(F.lit(status).alias("status"), F.lit(kind).alias("type"), (F.lit(headline) if isinstance(headline, str) else headline).alias("headline")))


def _plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.when(n > 1, many).otherwise(one))


def seo_report(pages: DataFrame, compat: bool = False) -> DataFrame:
    """Per site: score, confidence, findings in order (wins, then issues), title pattern, previews.

    `compat` looks Open Graph data up under keys with their prefix, where there is none.
    """
    home_first = F.struct((~U.is_home("url")).cast("int"), F.col("page_ord"))
    local = F.col("visible_text").rlike(G.SEO_ADDRESS) | F.col("visible_text").rlike(G.SEO_PHONE)
    base = pages.groupBy("site").agg(
        F.min_by(F.struct("url", "title", "description", "og"), home_first).alias("home"),
        F.max(F.contains("html", F.lit('rel="canonical"')) | F.contains("html", F.lit("rel='canonical'"))).alias("canonical"),
        F.max(local).alias("local"),
    )
    s = base.join(titles(pages), "site", "left").join(descriptions(pages), "site").join(h1_tags(pages), "site").join(schema_types(pages), "site", "left")
    key = "og:image" if compat else "image"
    og = lambda k: F.try_element_at(F.col("home.og"), F.lit(f"og:{k}" if compat else k))
    c = F.col
    types = F.coalesce("types", F.array().cast("array<string>"))
    has_type = lambda *names: T.any_of([F.array_contains(types, n) for n in names])
    consistent, length = F.coalesce("is_consistent", F.lit(False)), F.coalesce("avg_length", F.lit(0))
    one_each = (c("missing_h1") == 0) & (c("multiple_h1") == 0)
    has_image = F.coalesce(og("image") != "", F.lit(False))
    wins = F.array_compact(F.array(
        _finding(consistent, "good", "title", "Page titles are consistent"),
        _finding(length.between(50, 60), "good", "title", "Good title length"),
        _finding(c("coverage") == 100, "good", "description", F.concat(F.lit("All "), c("n_pages").cast("string"), F.lit(" pages have meta descriptions"))),
        _finding(c("avg_description").between(120, 160), "good", "description", "Good description length"),
        _finding(one_each, "good", "h1", "All pages have exactly one H1"),
        _finding(has_type("FAQPage"), "good", "schema", "FAQ pages have rich snippet support"),
        _finding(has_type("LocalBusiness", "Organization"), "good", "schema", "Business info is structured for Google"),
        _finding(has_type("Product", "Offer"), "good", "schema", "Products have rich snippet support"),
        _finding(c("canonical"), "good", "canonical", "Canonical tags are in place"),
        _finding(has_image, "good", "og", "Social sharing image is set"),
    ))
    found = F.array_compact(F.array(
        _finding(~consistent & (c("n_pages") > 1), "warning", "title", "Page titles are inconsistent"),
        _finding(length > 70, "warning", "title", "Titles may be too long"),
        _finding((c("coverage") != 100) & (c("n_undescribed") > 0), "bad", "description", F.concat(_plural(c("n_undescribed"), " page", " pages"), F.lit(" missing meta descriptions"))),
        _finding(c("n_duplicate") > 2, "warning", "description", F.concat(F.lit("Meta descriptions are too similar ("), c("n_duplicate").cast("string"), F.lit(" pages)"))),
        _finding(c("missing_h1") > 0, "bad", "h1", F.concat(_plural(c("missing_h1"), " page", " pages"), F.lit(" missing H1 headline"))),
        _finding(c("multiple_h1") > 0, "warning", "h1", F.concat(_plural(c("multiple_h1"), " page has", " pages have"), F.lit(" multiple H1s"))),
        _finding(~has_type("LocalBusiness", "Organization") & F.coalesce("local", F.lit(False)), "warning", "schema", "Missing LocalBusiness schema"),
        _finding(~has_image, "warning", "og", "No social sharing image"),
    ))
    s = s.withColumn("wins", wins).withColumn("found", found)
    cost = F.aggregate("found", F.lit(0), lambda a, x: a + F.when(x["status"] == "bad", 2).otherwise(1))
    missing = F.greatest(F.lit(0), 3 - F.size("wins") - F.size("found"))
    padding = F.transform(F.slice(F.array(*[F.lit(d) for d in DEFAULTS]), F.lit(1), missing), lambda d: F.struct(F.lit("warning").alias("status"), F.lit("title").alias("type"), d.alias("headline")))
    s = s.withColumn("score", T.clip(10 - cost, 0, 10).cast("int")).withColumn("issues", F.concat("found", padding))
    level = T.clip(60 + 5 * F.size("wins") - 3 * F.size("issues"), 30, 95).cast("int")
    named = F.coalesce(F.when(og("site_name") != "", og("site_name")), U.strip_www(U.host("home.url")), F.lit("Unknown"))
    or_text = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs[:-1]], F.lit(xs[-1]))
    return s.select(
        "site", "score", level.alias("confidence"), "wins", "issues", F.coalesce("pattern", F.lit("")).alias("title_pattern"),
        F.col("canonical").alias("has_canonical"), types.alias("schema_types"),
        F.struct(or_text(c("home.title"), "No title found").alias("title"), c("home.url").alias("url"), or_text(c("home.description"), "No meta description found.").alias("description")).alias("search_preview"),
        F.struct(or_text(og("title"), c("home.title"), "No title").alias("title"), or_text(og("description"), c("home.description"), "No description").alias("description"), F.try_element_at("home.og", F.lit(key)).alias("image"), named.alias("site_name")).alias("social_preview"),
    )


def site_audit(pages: DataFrame) -> DataFrame:
    """Titles and main headings per site by patterns alone: pages(url, html) -> site, n_pages, separator, is_consistent, avg_length, missing_h1, multiple_h1, score."""
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select(U.site("url").alias("site"), title.alias("title"), F.regexp_count("html", F.lit("(?i)<h1[ >]")).alias("h1"))
    votes = [F.sum(F.contains("title", F.lit(s)).cast("int")) for s in SEPARATORS]
    got = rows.groupBy("site").agg(
        F.count("*").alias("n_pages"), F.sum((F.col("title") != "").cast("int")).alias("n_titles"), F.array(*votes).alias("votes"),
        F.avg(F.when(F.col("title") != "", F.length("title"))).alias("mean"), F.sum((F.col("h1") == 0).cast("int")).alias("missing_h1"), F.sum((F.col("h1") > 1).cast("int")).alias("multiple_h1"),
    )
    most = F.array_max("votes")
    got = got.withColumn("separator", F.when(most == 0, F.lit("|")).otherwise(F.element_at(F.array(*[F.lit(s) for s in SEPARATORS]), F.array_position("votes", most).cast("int"))))
    got = got.withColumn("is_consistent", (F.col("n_titles") > 0) & (most >= F.col("n_titles") * 0.6)).withColumn("avg_length", F.coalesce(T.half_up(F.col("mean")), F.lit(0)).cast("int"))
    warnings = (~F.col("is_consistent") & (F.col("n_pages") > 1)).cast("int") + (F.col("avg_length") > 70).cast("int") + (F.col("multiple_h1") > 0).cast("int")
    score = T.clip(10 - 2 * (F.col("missing_h1") > 0).cast("int") - warnings, 0, 10).cast("int")
    return got.select("site", "n_pages", "separator", "is_consistent", "avg_length", "missing_h1", "multiple_h1", score.alias("score"))


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Titles that several pages of a site share."""
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    rows = pages.select(U.site("url").alias("site"), F.lower(title).alias("title_key")).filter("title_key <> ''")
    return rows.groupBy("site", "title_key").agg(F.count("*").alias("n_pages")).filter("n_pages > 1")


def ordered_pages(pages: DataFrame) -> DataFrame:
    """Crawl order within a site: priority paths first, otherwise as found."""
    p = U.path("url")
    rows = pages.select("page_id", U.site("url").alias("site"), F.when(U.is_priority_path(p), 0).otherwise(1).alias("priority"))
    return rows.withColumn("crawl_ord", F.row_number().over(Window.partitionBy("site").orderBy("priority", "page_id")))
