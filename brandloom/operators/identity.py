"""Logo, brand name, tone and summary per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T, url as U

# Fixed values.
NOT_A_LOGO = (
    "(?i)flag|country|locale|language|avatar|profile|arrow|chevron|caret|close|menu|hamburger|search|sprite|badge|award|payment|visa|mastercard|paypal|"
    "app-?store|google-?play|rating|star|cart|user"
)
MIN_MARK, MAX_DRAWING, LARGE_ICON = 60, 40 * 1024, 120
TONES = (
    ("Innovative", "innovative|cutting-edge|revolutionary|future"), ("Trustworthy", "trusted|reliable|secure|safe"), ("Simple", "simple|easy|effortless|streamlined"),
    ("Professional", "professional|enterprise|business"), ("Playful", "fun|exciting|adventure|play"), ("Conversational", "we're|you'll|let's|!"),
)
#: What copy_for_analysis reads of a parsed page.
COPY = ("headings", "description", "cta_buttons")
TITLE_BREAK = r"\s+[|–—·•:-]\s+"


def resolve_logo_url(raw: Column, page_url: Column) -> Column:
    """Absolute https URL of a logo reference; http only from the same site; null for other schemes, credentials and long references."""
    t = F.trim(raw)
    origin = U.base_domain(page_url)
    folder = F.regexp_extract(page_url, r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.rlike("://[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    whole = (
        F.when(t.rlike("(?i)^https?://"), t)
        .when(t.startswith("//"), F.concat(F.regexp_extract(page_url, "^([a-zA-Z]+:)", 1), t))
        .when(t.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .when(t.startswith("/"), F.concat(origin, t))
        .otherwise(F.concat(folder, t))
    )

    def safe(w: Column) -> Column:
        own, page = U.strip_www(U.host(w)), U.strip_www(U.host(page_url))
        related = (own == page) | F.endswith(own, F.concat(F.lit("."), page)) | F.endswith(page, F.concat(F.lit("."), own))
        fine = (t != "") & (F.length(t) <= 2048) & ~w.rlike("^[a-zA-Z]+://[^/?#]*@")
        return F.when(fine & F.lower(w).startswith("https://"), w).when(fine & related, F.regexp_replace(w, "(?i)^http://", "https://"))

    return T.let(U.without_dots(whole), safe)


def _sum(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for test, points in rules:
        total = total + F.when(test, points).otherwise(0)
    return total


def file_score(url: Column) -> Column:
    """How much a file name looks like a logo's."""
    u = F.lower(url)
    logo = u.contains("logo")
    return _sum(
        (logo, 50), (u.contains("brand"), 30), (u.contains("icon"), 10), (u.endswith(".svg"), 30), (u.endswith(".png"), 20), (u.endswith(".webp"), 15),
        (u.rlike(r"logo[^/]*\d{3,}"), 10), (u.contains("2x"), 5), (u.contains("full") | u.contains("large"), 10),
        (u.contains("thumbnail"), -20), (u.contains("favicon") & ~logo, -10), (u.contains("icon-") & ~logo, -10),
    )


def place_score(mark: Column, url: Column, token: Column) -> Column:
    """How likely a mark is the site's logo, by where it stands and what it is called."""
    name = F.lower(mark["name"])
    known = F.length(token) >= 3
    squashed = F.regexp_replace(name, "[^a-z0-9]", "")
    generic = F.trim(name).rlike("^(logo|home|homepage|go home|back to home|main page|brand)$")
    named = (name != "") & known
    return _sum(
        (mark["home_link"], 40), (mark["context"].contains("logo"), 40), (known & F.regexp_replace(mark["context"], "[^a-z0-9 ]", "").contains(token), 30),
        (named & squashed.contains(token), 20), (named & ~squashed.contains(token) & ~generic, -90), (mark["in_chrome"], 10),
        (url.rlike(NOT_A_LOGO) | mark["own"].rlike(NOT_A_LOGO), -120),
    )


def logos(pages: DataFrame) -> DataFrame:
    """site, logo_url, favicon_url, confidence, source: meta tags, else header marks, else a large icon."""
    metas = F.array(
        F.struct(F.lit(0).alias("k"), F.when(F.lower(resolve_logo_url(F.try_element_at("og", F.lit("image")), F.col("url"))).contains("logo"), resolve_logo_url(F.try_element_at("og", F.lit("image")), F.col("url"))).alias("v")),
        F.struct(F.lit(1).alias("k"), resolve_logo_url(F.col("logo_meta"), F.col("url")).alias("v")),
    )
    meta = pages.select("site", "page_ord", F.explode(metas).alias("m")).filter("m.v is not null").groupBy("site").agg(F.min_by("m.v", F.struct("page_ord", "m.k")).alias("meta_url"))

    marks = pages.select("site", "page_ord", "url", F.posexplode("marks").alias("pos", "m")).withColumn("token", U.brand_token("url"))
    drawing = F.col("m.kind") == "svg"
    fit = (F.length("m.src") <= MAX_DRAWING) & F.col("m.src").rlike(r"(?i)<(path|rect|circle|polygon|g|text|use)\b")
    link = F.when(drawing, F.when(fit, F.concat(F.lit("data:image/svg+xml;base64,"), F.base64(F.encode("m.src", "UTF-8"))))).otherwise(resolve_logo_url(F.col("m.src"), F.col("url")))
    marks = marks.withColumn("link", link).filter("link is not null")
    unnamed = (F.col("m.name") == "") | F.col("m.hidden")
    base = F.when(drawing, place_score(F.col("m"), F.lit(""), F.col("token")) + 20 - F.when(unnamed, 15).otherwise(0)).otherwise(file_score(F.col("link")) + place_score(F.col("m"), F.col("link"), F.col("token")))
    marks = marks.withColumn("base", base).filter(~drawing | (F.col("base") >= MIN_MARK))
    place = F.struct("page_ord", (~F.col("m.kind").eqNullSafe("img")).cast("int").alias("d"), "pos")
    first = Window.partitionBy("site", "page_ord", "link").orderBy((F.col("m.kind") != "img").cast("int"), "pos")
    marks = marks.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    summed = marks.groupBy("site", "link").agg(F.max("base").alias("base"), F.count_distinct("page_ord").alias("n"), F.max(U.is_home("url")).alias("home"), F.min(place).alias("at"))
    total = F.col("base") + F.least(F.lit(20), (F.col("n") - 1) * 5) + F.when(F.col("home"), 15).otherwise(0)
    best = summed.groupBy("site").agg(F.min_by(F.struct("link", "base"), F.struct((-total).alias("t"), F.col("at"))).alias("b")).filter(F.col("b.base") >= MIN_MARK)
    header = best.select("site", F.col("b.link").alias("header_url"))

    icons = pages.select("site", "page_ord", "url", F.posexplode("icons").alias("pos", "i")).filter(F.arrays_overlap(F.split("i.rel", r"\s+"), F.array(F.lit("icon"), F.lit("apple-touch-icon"))))
    icons = icons.withColumn("link", resolve_logo_url(F.col("i.href"), F.col("url"))).filter("link is not null")
    sized = lambda c: F.regexp_extract(c, r"(\d+)x\d+", 1)
    size = F.when(sized(F.col("i.sizes")) != "", sized(F.col("i.sizes"))).when(sized(F.col("link")) != "", sized(F.col("link"))).otherwise("16").cast("int")
    icons = icons.withColumn("size", size).groupBy("site", "page_ord").agg(F.min_by(F.struct("link", "size"), F.struct((-F.col("size")).alias("s"), F.col("pos"))).alias("f"))
    icon = icons.groupBy("site").agg(F.min_by("f", "page_ord").alias("f"))

    s = pages.select("site").distinct().join(meta, "site", "left").join(header, "site", "left").join(icon, "site", "left")
    use_icon = F.col("meta_url").isNull() & F.col("header_url").isNull() & F.col("f").isNotNull()
    large = use_icon & (F.col("f.size") >= LARGE_ICON)
    level = F.when(F.col("meta_url").isNotNull(), 90).when(F.col("header_url").isNotNull(), 85).when(large, 50).when(use_icon, 40).otherwise(0)
    return s.select("site", F.coalesce("meta_url", "header_url", F.when(large, F.col("f.link"))).alias("logo_url"), F.when(use_icon, F.col("f.link")).alias("favicon_url"), level.alias("confidence"), F.when(level > 0, "extracted").otherwise("inferred").alias("source"))


def _short(value: Column) -> Column:
    t = T.collapse(value)
    return F.when((t != "") & (F.length(t) <= 60), t)


def brand_names(pages: DataFrame) -> DataFrame:
    """site, brand_name: site name, application name, the title's part that names the host, or the host's first label."""
    home = pages.groupBy("site").agg(F.min_by(F.struct("title", "og", "app_name"), F.struct((~U.is_home("url")).cast("int"), F.col("page_ord"))).alias("h"))
    label = F.split_part(U.strip_www(F.col("site")), F.lit("."), F.lit(1))
    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    parts = F.filter(F.transform(F.split("h.title", TITLE_BREAK), lambda x: F.trim(x)), lambda p: p != "")
    fits = F.filter(parts, lambda p: (squash(p) != "") & ((squash(p) == squash(label)) | squash(p).contains(squash(label)) & (F.length(p) <= 30)))
    words = F.filter(F.split(label, "[-_]"), lambda w: w != "")
    cased = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")
    name = F.coalesce(_short(F.try_element_at("h.og", F.lit("site_name"))), _short(F.col("h.app_name")), _short(F.try_element_at(fits, F.lit(1))), F.when(cased != "", cased), F.col("site"))
    return home.select("site", name.alias("brand_name"))


def copy_for_analysis(pages: DataFrame) -> DataFrame:
    """Per site: hero, about, call-to-action and heading texts, distinct and bounded, and page urls."""
    h1 = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    about = F.col("url").rlike("(?i)about|company|story|mission|values")
    described = F.when(F.col("description") != "", F.array("description")).otherwise(F.array().cast("array<string>"))
    per_page = pages.select(
        "site", "page_ord", "url", F.slice(h1, 1, 3).alias("hero"), F.slice(F.transform("headings", lambda h: h["text"]), 1, 5).alias("headings"),
        F.when(about, F.concat(described, h1)).otherwise(F.array().cast("array<string>")).alias("about"), F.slice("cta_buttons", 1, 5).alias("ctas"),
    )
    rows = per_page.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("page_ord", "url", "hero", "headings", "about", "ctas"))).alias("p"))
    some = lambda c, n: F.slice(F.array_distinct(F.flatten(F.col(f"p.{c}"))), 1, n)
    return rows.select("site", some("hero", 10).alias("hero"), some("about", 10).alias("about"), some("ctas", 15).alias("ctas"), some("headings", 20).alias("headings"), F.slice("p.url", 1, 10).alias("urls"))


def tones(content: DataFrame) -> DataFrame:
    """Tone by keywords, and the confidence a fuller analysis of this copy would have: site, traits, confidence, inferred_confidence."""
    text = F.lower(F.array_join(F.concat("hero", "headings", "ctas"), " "))
    traits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in TONES]))
    amount = F.size("hero") + F.size("about") + F.size("ctas") + F.size("headings")
    return content.select("site", F.slice(traits, 1, 7).alias("traits"), F.lit(25).alias("confidence"), F.least(F.lit(90), 35 + amount * 2).alias("inferred_confidence"))


def summaries(pages: DataFrame, names: DataFrame) -> DataFrame:
    """site, name, description, confidence, source: the first description of the site, or a notice that there is none."""
    first = pages.groupBy("site").agg(F.min_by("description", F.when(F.col("description") != "", F.col("page_ord"))).alias("d"))
    s = names.join(first, "site", "left")
    has = F.coalesce(F.col("d") != "", F.lit(False))
    none = F.concat(F.lit("No description could be found for "), "brand_name", F.lit("."))
    return s.select("site", F.col("brand_name").alias("name"), F.when(has, F.col("d")).otherwise(none).alias("description"), F.when(has, 50).otherwise(10).alias("confidence"), F.when(has, "extracted").otherwise("not_found").alias("source"))
