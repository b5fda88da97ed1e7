"""Marketing elements per site: calls to action, sign-ups, magnets, testimonials, badges, client logos, campaign pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import url as U

# Patterns of each kind, in order.
CTA = (
    r"get\s+started", r"sign\s+up", r"start\s+(free|your|now)", r"try\s+(free|now|it)", r"book\s+(a|demo|call)", r"schedule\s+(a|demo|call)",
    r"request\s+(a|demo|quote)", r"download\s+(now|free|the)", r"learn\s+more", r"see\s+(how|pricing|demo)", r"join\s+(now|us|free)", "subscribe",
    r"contact\s+(us|sales)", r"buy\s+now", r"shop\s+now", r"order\s+now", r"add\s+to\s+cart", r"claim\s+(your|free)",
)
NEWSLETTER = (
    r"sign\s*up\s*(for|to)\s*(?:our\s*)?newsletter", r"subscribe\s*(?:to\s*)?(?:our\s*)?(newsletter|updates|emails)", r"join\s*(?:our\s*)?(mailing\s*list|newsletter)",
    r"get\s*(?:our\s*)?(latest|weekly|monthly)\s*(news|updates)", r"stay\s*(up\s*to\s*date|informed|connected)", r"enter\s*your\s*email", r"email\s*updates",
)
MAGNET = (
    r"free\s+(guide|ebook|download|template|checklist|whitepaper|report|toolkit)", r"download\s+(our|the|your)\s+(free)?", r"get\s+(the|your|our)\s+(?:free\s*)?(guide|ebook|template)",
)
TESTIMONIAL = ('"[^"]{50,}"', r"(?i)what\s+(our\s+)?(customers|clients|users)\s+say", "(?i)testimonials?", "(?i)reviews?", r"(?i)success\s+stor(y|ies)", r"(?i)case\s+stud(y|ies)")
TRUST = (r"trusted\s+by", r"used\s+by", r"as\s+seen\s+(on|in)", r"featured\s+(on|in)", r"powered\s+by", "certified", r"award[\s-]winning", r"iso\s*\d+", r"soc\s*2", "gdpr", "hipaa")
MAX_HTML, MAX_LOGOS, MAX_CTAS = 1 << 20, 10, 20


def page_text(visible: Column, attributes: Column) -> Column:
    return F.concat_ws(" ", visible, attributes)


def _matches(pages: DataFrame, patterns: tuple) -> DataFrame:
    """The first match of each pattern on each page."""
    text = page_text(F.col("visible_text"), F.col("attribute_text"))
    found = F.array(*[F.regexp_extract(text, f"(?i){p}", 0) for p in patterns])
    return pages.select("site", "page_ord", "url", F.posexplode(found).alias("pos", "content")).filter("content <> ''")


def _first(rows: DataFrame, key: Column | str) -> DataFrame:
    """The first row of each key of a site."""
    by = Window.partitionBy("site", key).orderBy("page_ord", "pos")
    return rows.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def _element(rows: DataFrame, section: int, kind: str, confidence: int, source: str = "extracted") -> DataFrame:
    return rows.select("site", F.lit(section).alias("section"), "page_ord", "pos", F.lit(kind).alias("type"), "content", "url", F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def ctas(pages: DataFrame) -> DataFrame:
    buttons = pages.select("site", "page_ord", "url", F.posexplode("cta_buttons").alias("pos", "content"))
    return _first(buttons.filter(F.lower("content").rlike("|".join(CTA))), F.lower("content"))


def client_logos(pages: DataFrame) -> DataFrame:
    """Images named after clients or logos, ten a site."""
    images = pages.select("site", "page_ord", "url", F.posexplode("images").alias("pos", "i"))
    alt, src = F.lower("i.alt"), F.lower("i.src")
    hit = images.filter((alt.rlike("logo|client|partner|customer") | src.rlike("logo|client|partner")) & ~alt.contains("our logo") & ~src.contains("header"))
    hit = hit.withColumn("content", F.when(F.col("i.alt") != "", F.col("i.alt")).otherwise("Client logo"))
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy("page_ord", "pos"))).filter(F.col("_n") <= MAX_LOGOS).drop("_n", "i")


def testimonials(pages: DataFrame) -> DataFrame:
    """One a page: the first pattern that fits."""
    head = F.substring("html", 1, MAX_HTML)
    place = F.coalesce(*[F.when(head.rlike(p), F.lit(i)) for i, p in enumerate(TESTIMONIAL)])
    return pages.select("site", "page_ord", "url", place.alias("pos")).filter("pos is not null").withColumn("content", F.lit("Testimonials section detected"))


def marketing_elements(pages: DataFrame) -> DataFrame:
    """All elements of a site in order of section, page and place: site, ord, type, content, url, confidence, source."""
    campaign = pages.filter(U.is_campaign("url")).select("site", "page_ord", "url", F.lit(0).alias("pos"), F.when(F.col("title") != "", F.col("title")).otherwise(F.col("url")).alias("content"))
    parts = [
        _element(ctas(pages), 1, "cta", 90),
        _element(_first(_matches(pages, NEWSLETTER), "content"), 2, "email_capture", 85),
        _element(_first(_matches(pages, MAGNET), F.lower("content")), 3, "lead_magnet", 80),
        _element(testimonials(pages), 4, "testimonial", 75, "inferred"),
        _element(_first(_matches(pages, TRUST), F.lower("content")), 5, "trust_badge", 80),
        _element(client_logos(pages), 6, "client_logo", 70, "inferred"),
        _element(campaign, 7, "campaign_page", 85),
    ]
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(part)
    numbered = everything.withColumn("ord", F.row_number().over(Window.partitionBy("site").orderBy("section", "page_ord", "pos")))
    return numbered.select("site", "ord", "type", "content", "url", "confidence", "source")


def cta_patterns(pages: DataFrame) -> DataFrame:
    """site, patterns: distinct button texts of 3 to 49 characters, 20 at most, in order."""
    buttons = pages.select("site", "page_ord", F.posexplode("cta_buttons").alias("pos", "content")).filter(F.length("content").between(3, 49))
    first = buttons.groupBy("site", "content").agg(F.min(F.struct("page_ord", "pos")).alias("at"))
    return first.groupBy("site").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"]), 1, MAX_CTAS).alias("patterns"))
