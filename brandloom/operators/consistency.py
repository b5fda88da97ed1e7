"""How consistent a site is: five dimensions over its pages, total and grade."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import color as C, fonts as N, text as T, url as U
from ..functions.css import GENERIC_FAMILIES, Variables, first_font, plain_font
from ..functions.udf import arrow
from ..session import cut
from .colors import _value_colours, near_colours, off_palette, variables_of
from .pages import css_declarations, css_variables, inline_style_declarations

# What each dimension can earn.
MAXIMA = {"color": 25, "typography": 20, "tone": 25, "seo": 15, "message": 15}
MIN_PAGES, MIN_DIMENSIONS, MAX_ISSUES = 3, 3, 10


@arrow("string", once=True)
def _first_font(name: pd.Series, value: pd.Series, variables: pd.Series) -> pd.Series:
    return pd.Series([first_font(n, v, Variables(dict(k) if k is not None else {})) for n, v, k in zip(name, value, variables)], dtype=object)


@arrow("string")
def _plain(name: pd.Series) -> pd.Series:
    return name.map(lambda n: None if n is None else plain_font(n))


def page_colours(pages: DataFrame, sheets: DataFrame, areas: DataFrame | None = None, css: DataFrame | None = None) -> DataFrame:
    """site, page_url, hex: every colour of a page's stylesheets, inline styles and rendered areas; css: the sheets' declarations where they are at hand."""
    css = css_declarations(sheets) if css is None else css
    used = css.unionByName(inline_style_declarations(pages)).filter(C.classify_property("property").isNotNull()).join(css_variables(css), "site", "left")
    rows = used.select("site", "page_url", F.explode(_value_colours("value", variables_of("value"))).alias("hex"))
    return (rows if areas is None else rows.unionByName(areas.select("site", "page_url", F.lower("hex").alias("hex")))).distinct()


def page_fonts(sheets: DataFrame, computed: DataFrame | None = None, css: DataFrame | None = None) -> DataFrame:
    """site, page_url, font: the first own family of every font declaration, and of computed styles(site, page_url, family); css: the sheets' declarations where they are at hand."""
    css = css_declarations(sheets) if css is None else css
    named = css.filter(F.col("property").isin("font", "font-family")).join(css_variables(css), "site", "left")
    rows = named.select("site", "page_url", _first_font("property", "value", variables_of("value")).alias("font"))
    if computed is not None:
        rows = rows.unionByName(computed.select("site", "page_url", _plain(F.split_part("family", F.lit(","), F.lit(1))).alias("font")).filter(~F.col("font").contains("var(") & (F.col("font") != "") & ~F.col("font").isin(*sorted(GENERIC_FAMILIES))))
    return rows.filter("font is not null").distinct()


def _scored(name: str, value: Column, reason: Column | None = None) -> Column:
    top = MAXIMA[name]
    points = T.clip(T.half_up(value), 0, top).cast("int")
    if reason is None:
        reason = F.lit(None).cast("string")
    return F.struct(F.when(reason.isNull(), points).alias("score"), F.lit(top).alias("max"), F.when(reason.isNull(), "scored").otherwise("insufficient_data").alias("status"), reason.alias("reason"))


def _why(*cases: tuple[Column, str]) -> Column:
    out = None
    for test, text in cases:
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def color_score(sites: DataFrame, colours: DataFrame, palette: DataFrame) -> DataFrame:
    """25 times the share of pages with a brand colour, less 5 for more than five other colours."""
    brand = palette.select("site", F.lower("hex").alias("hex"), "role", "rank")
    lead = Window.partitionBy("site", "role").orderBy("rank")
    main = brand.filter(F.col("role").isin("primary", "secondary")).withColumn("_n", F.row_number().over(lead)).filter("_n = 1")
    with_brand = near_colours(colours, main).select("site", "page_url").distinct().groupBy("site").agg(F.count("*").alias("n_with"))
    stray = off_palette(colours.filter(~C.is_neutral(C.oklch("hex"))), brand).groupBy("site").agg(F.count_distinct("hex").alias("n_stray"))
    seen = colours.groupBy("site").agg(F.count_distinct("page_url").alias("n_seen"))
    s = sites.join(main.groupBy("site").agg(F.count("*").alias("n_main")), "site", "left").join(seen, "site", "left").join(with_brand, "site", "left").join(stray, "site", "left").fillna(0, ["n_main", "n_seen", "n_with", "n_stray"])
    share = F.when(F.col("n_seen") > 0, F.col("n_with") / F.col("n_seen")).otherwise(F.lit(0.0))
    why = _why((F.col("n_main") == 0, "no brand colors were extracted"), (F.col("n_seen") == 0, "no color usage was found on the crawled pages"))
    return s.select("site", _scored("color", 25 * share - F.when(F.col("n_stray") > 5, 5).otherwise(0), why).alias("color"), F.when(why.isNull(), F.array_compact(F.array(
        F.when(F.col("n_stray") > 5, F.concat(F.lit("Found "), F.col("n_stray").cast("string"), F.lit(" off-brand colors across pages"))),
        F.when(share < 0.8, F.concat(F.lit("Only "), T.half_up(share * 100).cast("string"), F.lit("% of pages use brand colors"))),
    ))).otherwise(F.array().cast("array<string>")).alias("color_issues"))


def typography_score(sites: DataFrame, fonts: DataFrame, brand_fonts: DataFrame) -> DataFrame:
    """20 times the share of pages that use the primary font."""
    first = F.min_by("name", F.struct((F.col("role") != "primary").cast("int").alias("r"), F.col("rank")))
    main = brand_fonts.groupBy("site").agg(first.alias("main"), F.count("*").alias("n_fonts")).withColumn("main", _plain("main"))
    usage = fonts.join(main.select("site", "main"), "site").groupBy("site").agg(F.count_distinct("page_url").alias("n_seen"), F.count_distinct(F.when(F.col("font") == F.col("main"), F.col("page_url"))).alias("n_with"))
    own = brand_fonts.select("site", _plain("name").alias("font")).distinct()
    stray = fonts.join(own, ["site", "font"], "left_anti").filter(~N.is_system_font("font", N.SCORER_SYSTEM_FONTS)).groupBy("site", "page_url").agg(F.min("font").alias("font"))
    issue = F.concat(F.lit("Page "), F.coalesce(U.path("page_url"), "page_url"), F.lit(" uses non-brand font: "), "font")
    stray = stray.groupBy("site").agg(F.slice(F.array_sort(F.collect_list(issue)), 1, MAX_ISSUES).alias("stray"))
    s = sites.join(main, "site", "left").join(usage, "site", "left").join(stray, "site", "left").fillna(0, ["n_fonts", "n_seen", "n_with"])
    share = F.when(F.col("n_seen") > 0, F.col("n_with") / F.col("n_seen")).otherwise(F.lit(0.0))
    why = _why((F.col("n_fonts") == 0, "no brand fonts were identified"), (F.col("n_seen") == 0, "no font declarations were found on the crawled pages"))
    low = F.when(share < 0.9, F.array(F.concat(F.lit("Font consistency at "), T.half_up(share * 100).cast("string"), F.lit("%")))).otherwise(F.array().cast("array<string>"))
    issues = F.concat(F.coalesce("stray", F.array().cast("array<string>")), low)
    return s.select("site", _scored("typography", 20 * share, why).alias("typography"), F.when(why.isNull(), issues).otherwise(F.array().cast("array<string>")).alias("typography_issues"))


def tone_score(pages: DataFrame, tones: DataFrame) -> DataFrame:
    """25 times the share of the home, about and blog pages whose buttons are as casual as the site's tone."""
    path = F.coalesce(U.path("url"), F.lit(""))
    casual_page = F.exists("cta_buttons", lambda c: c.contains("!") | c.rlike("[\\x{1F300}-\\x{1F9FF}]"))
    rows = pages.select("site", "page_ord", path.alias("path"), casual_page.alias("casual"))
    first = lambda test: F.min(F.when(test, F.struct("page_ord", "casual")))
    picked = rows.groupBy("site").agg(first(F.col("path").isin("/", "")).alias("home"), first(F.col("path").rlike("(?i)about|company|story")).alias("about"), first(F.col("path").rlike("(?i)blog|news|article")).alias("blog"))
    checked = F.array_distinct(F.array_compact(F.array("home", "about", "blog")))
    s = picked.join(tones.select("site", "traits"), "site", "left")
    traits = F.transform(F.coalesce("traits", F.array().cast("array<string>")), F.lower)
    casual = F.arrays_overlap(traits, F.array(F.lit("casual"), F.lit("playful"), F.lit("friendly")))
    share = F.size(F.filter(checked, lambda p: p["casual"] == casual)) / F.greatest(F.size(checked), F.lit(1))
    why = _why((F.size(traits) == 0, "no tone of voice could be determined"), (F.size(checked) < 2, "needs at least two of the home, about and blog pages to compare tone"))
    issue = F.when(why.isNull() & (share < 0.8) & F.col("blog").isNotNull(), F.array(F.lit("Blog/news section may have different tone than main site"))).otherwise(F.array().cast("array<string>"))
    return s.select("site", _scored("tone", 25 * share, why).alias("tone"), issue.alias("tone_issues"))


def seo_score(pages: DataFrame) -> DataFrame:
    """15, less 3 for mixed title separators, 2 for uneven descriptions (mean absolute deviation over 50), 3 for missing and 2 for shared H1s."""
    t = F.col("title")
    mark = F.when(t.contains(" | "), "|").when(t.contains(" - "), "-").when(t.contains(" — "), "—")
    h1 = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    mean = F.avg(F.when(F.col("description") != "", F.length("description"))).over(Window.partitionBy("site"))
    rows = pages.select("site", mark.alias("mark"), (t != "").alias("titled"), F.when(F.col("description") != "", F.abs(F.length("description") - mean)).alias("off"), h1.alias("h1"))
    s = rows.groupBy("site").agg(
        F.count("*").alias("n"), F.sum(F.col("titled").cast("int")).alias("n_titles"), F.count_distinct("mark").alias("marks"), F.count("off").alias("n_desc"), F.avg("off").alias("mad"),
        F.avg((F.size("h1") > 0).cast("int")).alias("h1_share"), F.flatten(F.collect_list("h1")).alias("all_h1"),
    )
    c = F.col
    rules = (
        ((c("n_titles") > 1) & (c("marks") > 1), 3, F.lit("Title tags use inconsistent separators")),
        ((c("n_desc") > 1) & (c("mad") > 50), 2, F.lit("Meta description lengths vary significantly")),
        (c("h1_share") < 0.8, 3, F.concat(F.lit("Only "), T.half_up(c("h1_share") * 100).cast("string"), F.lit("% of pages have H1 tags"))),
        (F.size("all_h1") > F.size(F.array_distinct("all_h1")) + 1, 2, F.lit("Multiple pages share the same H1 heading")),
    )
    points = F.lit(15)
    for test, cost, _ in rules:
        points = points - F.when(F.coalesce(test, F.lit(False)), cost).otherwise(0)
    why = _why((c("n") < 2, "needs at least two pages to compare"))
    issues = F.when(why.isNull(), F.array_compact(F.array(*[F.when(test, text) for test, _, text in rules]))).otherwise(F.array().cast("array<string>"))
    return s.select("site", _scored("seo", points, why).alias("seo"), issues.alias("seo_issues"))


def message_score(pages: DataFrame) -> DataFrame:
    """15 times the share of other pages that repeat a core message of the home page."""
    h1 = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: F.lower(h["text"]))
    phrases = F.concat(h1, F.when(F.col("description") != "", F.array(F.lower("description"))).otherwise(F.array().cast("array<string>")), F.transform("cta_buttons", F.lower))
    rows = pages.select("site", "page_ord", "url", phrases.alias("phrases"), F.lower(F.concat_ws(" ", F.array_join(phrases, " "), "title", "description")).alias("content"))
    home = rows.groupBy("site").agg(F.min_by(F.struct("url", "phrases"), F.struct((~U.is_home("url")).cast("int"), F.col("page_ord"))).alias("h"), F.count("*").alias("n"))
    words = F.transform(F.filter("h.phrases", lambda p: F.length(p) > 10), lambda p: F.filter(F.split(p, r"\s+"), lambda w: F.length(w) > 4))
    home = home.select("site", "n", F.col("h.url").alias("home_url"), F.slice(F.filter(words, lambda w: F.size(w) > 0), 1, 3).alias("messages"))
    others = rows.join(home, "site").filter(F.col("url") != F.col("home_url"))
    hits = lambda w: F.size(F.filter(w, lambda x: F.contains("content", x)))
    hit = F.exists("messages", lambda w: (hits(w) > 0) & (hits(w) >= F.size(w) * 0.3))
    found = others.groupBy("site").agg(F.count("*").alias("n_checked"), F.sum(hit.cast("int")).alias("n_hit"))
    s = home.join(found, "site", "left").fillna(0, ["n_checked", "n_hit"])
    share = F.when(F.col("n_checked") > 0, F.col("n_hit") / F.col("n_checked")).otherwise(F.lit(0.0))
    why = _why((F.col("n") < 2, "needs at least two pages to compare"), (F.size("messages") == 0, "no core message was found on the home page"), (F.col("n_checked") == 0, "no pages besides the home page to compare"))
    issue = F.when(why.isNull() & (share < 0.5), F.array(F.lit("Core messaging not reinforced across pages"))).otherwise(F.array().cast("array<string>"))
    return s.select("site", _scored("message", 15 * share, why).alias("message"), issue.alias("message_issues"))


def summarise(breakdowns: DataFrame) -> DataFrame:
    """breakdowns(site, n_pages, one struct(score, max, status, reason) per dimension) -> score, grade, insufficient."""
    dims = list(MAXIMA)
    is_scored = {d: F.coalesce(F.col(f"{d}.status") == "scored", F.lit(False)) & F.col(f"{d}.score").isNotNull() for d in dims}
    total = lambda f: sum((F.when(is_scored[d], F.col(f"{d}.{f}")).otherwise(0) for d in dims), F.lit(0))
    n_scored = sum((is_scored[d].cast("int") for d in dims), F.lit(0))
    score = F.when(total("max") > 0, T.half_up(total("score") / total("max") * 100).cast("int"))
    graded = (F.col("n_pages") >= MIN_PAGES) & (n_scored >= MIN_DIMENSIONS)
    n = F.col("n_pages").cast("string")
    few_pages = F.when(F.col("n_pages") < MIN_PAGES, F.concat(F.lit("pages: only "), n, F.when(F.col("n_pages") == 1, " page").otherwise(" pages"), F.lit(f" crawled; at least {MIN_PAGES} are needed for a grade")))
    few_dims = F.when(n_scored < MIN_DIMENSIONS, F.concat(F.lit("dimensions: only "), n_scored.cast("string"), F.lit(f" of {len(dims)} could be scored; at least {MIN_DIMENSIONS} are needed for a grade")))
    reasons = [F.when(~is_scored[d], F.concat(F.lit(f"{d}: "), F.coalesce(F.col(f"{d}.reason"), F.lit("not enough data")))) for d in dims]
    return breakdowns.withColumn("score", score).withColumn("grade", F.when(graded, T.grade(F.col("score")))).withColumn("insufficient", F.array_compact(F.array(few_pages, *reasons, few_dims)))


def consistency_report(pages: DataFrame, sheets: DataFrame, palette: DataFrame, fonts: DataFrame, tones: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """Per site: score, grade, the five dimensions, issues (ten), reasons for missing data."""
    sites = pages.groupBy("site").agg(F.count("*").cast("int").alias("n_pages"))
    css = cut(css_declarations(sheets))
    s = sites
    for part in (color_score(sites, page_colours(pages, sheets, areas, css), palette), typography_score(sites, page_fonts(sheets, css=css), fonts), tone_score(pages, tones), seo_score(pages), message_score(pages)):
        s = s.join(part.drop("n_pages"), "site", "left")
    issues = F.slice(F.concat(*[F.coalesce(f"{d}_issues", F.array().cast("array<string>")) for d in MAXIMA]), 1, MAX_ISSUES)
    return summarise(s).select("site", "n_pages", "score", "grade", *MAXIMA, issues.alias("issues"), "insufficient")


def upgrade_stored(raw: Column) -> Column:
    """Consistency data of a stored report in today's shape: plain numbers become scored dimensions, absent ones are 'not recorded'."""
    dims = []
    for d, top in MAXIMA.items():
        text = F.get_json_object(raw, f"$.breakdown.{d}")
        plain = text.rlike(r"^-?\d+(\.\d+)?$")
        own = F.from_json(text, "score int, max int, status string, reason string")
        none = F.struct(F.lit(None).cast("int").alias("score"), F.lit(top).alias("max"), F.lit("insufficient_data").alias("status"), F.lit("not recorded").alias("reason"))
        scored = F.struct(text.try_cast("double").cast("int").alias("score"), F.lit(top).alias("max"), F.lit("scored").alias("status"), F.lit(None).cast("string").alias("reason"))
        dims.append(F.when(plain, scored).when(own["status"].isNotNull(), own).otherwise(none).alias(d))
    letter = F.get_json_object(raw, "$.grade")
    lists = lambda k: F.coalesce(F.from_json(F.get_json_object(raw, f"$.{k}"), "array<string>"), F.array().cast("array<string>"))
    return F.struct(F.get_json_object(raw, "$.score").try_cast("int").alias("score"), F.when(letter.rlike("^[ABCDF]$"), letter).alias("grade"), *dims, lists("issues").alias("issues"), lists("insufficientData").alias("insufficient"), F.coalesce(F.get_json_object(raw, "$.pagesAnalyzed").try_cast("int"), F.lit(0)).alias("n_pages"))
