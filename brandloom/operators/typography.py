"""Fonts per site: a full scan of text elements, else computed styles, else stylesheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fonts as N, text as T
from ..session import cut
from . import cascade

MAX_FONTS = 10
ENTRY = ("site", "ord", "name", "role", "variants", "confidence", "google_url", "context")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def count_elements(elements: DataFrame) -> DataFrame:
    """elements(site, page_ord, el, font, weight, is_heading) -> site, page_ord, font, ord, headings, body, weights: the scan's counts, of the first page that has any.

    Fonts come in the order of their first heading, then of their first other element; weights in the order of their first element.
    """
    first = elements.withColumn("_p", F.min("page_ord").over(Window.partitionBy("site"))).filter("page_ord = _p")
    each = first.groupBy("site", "page_ord", "font", "weight").agg(
        F.sum(F.col("is_heading").cast("int")).alias("headings"), F.sum((~F.col("is_heading")).cast("int")).alias("body"), F.min("el").alias("el"), F.min(F.when(F.col("is_heading"), F.col("el"))).alias("h")
    )
    fonts = each.groupBy("site", "page_ord", "font").agg(
        F.sum("headings").cast("int").alias("headings"), F.sum("body").cast("int").alias("body"), F.transform(F.array_sort(F.collect_list(F.struct("el", "weight"))), lambda x: x["weight"]).alias("weights"),
        F.min("el").alias("el"), F.min("h").alias("h"),
    )
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.col("h").asc_nulls_last(), "el"))
    return fonts.select("site", "page_ord", "font", (place - 1).alias("ord"), "headings", "body", "weights", "el", "h")


def available_fonts(elements: DataFrame, rules: DataFrame, sheets: DataFrame) -> DataFrame:
    """Fonts that a page loads: site, page_ord, ord, name, source, url, weights; Google links, imports, @font-face rules and Adobe kits, each name of a source once."""
    at = ("site", "page_ord")
    hrefs = elements.select(*at, "el", "tag", F.col("attrs")["href"].alias("href"), F.col("attrs")["src"].alias("src"))
    linked = hrefs.filter((F.col("tag") == "link") & F.col("href").contains("fonts.googleapis.com")).select(*at, "el", "href", F.posexplode(N.google_families("href")).alias("i", "f"))
    links = linked.select(*at, F.struct(F.lit(0).alias("kind"), F.col("el").alias("a"), F.col("i").alias("b")).alias("place"), F.col("f.name").alias("name"), F.lit("google").alias("source"), F.col("href").alias("url"), F.col("f.weights").alias("weights"))
    calls = sheets.select(*at, "css_ord", F.posexplode(F.regexp_extract_all("css", F.lit(r"@import[^;]*fonts\.googleapis\.com[^;]*"), F.lit(0))).alias("i", "call"))
    named = F.trim(F.regexp_replace(F.try_url_decode(F.regexp_extract("call", r"family=([^&:'\")]+)", 1)), r"\+", " "))
    imported = calls.select(*at, F.struct(F.lit(1).alias("kind"), F.col("css_ord").alias("a"), F.col("i").alias("b")).alias("place"), named.alias("name"), F.lit("google").alias("source"), F.lit(None).cast("string").alias("url"), F.array(F.lit("400")).alias("weights")).filter("name <> ''")
    said = lambda p: F.try_element_at(F.filter("declared", lambda d: d["property"] == p), F.lit(-1))["value"]
    family = F.trim(F.regexp_replace(F.coalesce(said("font-family"), F.lit("")), "['\"]", ""))
    from_file = N.name_from_path(F.regexp_extract(said("src"), r"""url\(['"]*([^'")]+)['"]*\)""", 1))
    face = F.when((family == "") | N.is_system_font(family), F.coalesce(from_file, family)).otherwise(family)
    faces = rules.filter("faces").select(*at, F.struct(F.lit(2).alias("kind"), F.col("css_ord").alias("a"), F.col("pos").alias("b")).alias("place"), face.alias("name"), F.lit("fontface").alias("source"), F.lit(None).cast("string").alias("url"), F.array(F.coalesce(said("font-weight"), F.lit("400"))).alias("weights")).filter("name <> ''")
    kit_url = F.coalesce(F.when(F.col("tag") == "link", F.col("href")), F.when(F.col("tag") == "script", F.col("src")))
    kits = hrefs.withColumn("kit", kit_url).filter(F.col("kit").contains("use.typekit.net")).groupBy(*at).agg(F.min_by("kit", F.struct((F.col("tag") == "script").alias("late"), F.col("el"))).alias("url"))
    kit_id = F.regexp_extract("url", r"(?i)use\.typekit\.net/([a-z0-9]+)", 1)
    kit_name = F.when(kit_id != "", F.concat(F.lit("Adobe Fonts (Kit: "), kit_id, F.lit(")"))).otherwise("Adobe Fonts (Typekit)")
    adobe = kits.select(*at, F.struct(F.lit(3).alias("kind"), F.lit(0).alias("a"), F.lit(0).alias("b")).alias("place"), kit_name.alias("name"), F.lit("adobe").alias("source"), "url", F.lit(None).cast("array<string>").alias("weights"))
    every = links.unionByName(imported).unionByName(faces).unionByName(adobe).filter(~N.is_icon_font("name"))
    once = every.groupBy(*at, "source", F.lower("name").alias("_key")).agg(
        F.min("place").alias("place"), F.min_by("name", "place").alias("name"), F.min_by("url", "place").alias("url"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "weights"))), lambda x: x["weights"]))).alias("weights")
    )
    ranked = F.row_number().over(Window.partitionBy(*at).orderBy("place"))
    return once.select(*at, (ranked - 1).alias("ord"), "name", "source", "url", F.when(F.size("weights") > 0, F.col("weights")).alias("weights"))


def scan_elements(elements: DataFrame, rules: DataFrame, sheets: DataFrame) -> DataFrame:
    """Font entries of each site from the computed styles of its first page with text; the cascade stands in for a browser.

    elements and rules as cascade.page_elements and cascade.page_rules give them, sheets(site, page_ord, css_ord, css). Confidence is the share of the page's text elements that are seen and say something.
    """
    variables = cascade.root_variables(rules)
    styles = cut(cascade.text_styles(elements, rules, variables))
    counted = styles.filter((F.col("font") != "") & ~N.has_unresolved_var("font") & ~N.is_icon_font("font"))
    counts = cut(count_elements(counted))
    chosen = counts.select("site", "page_ord").distinct()
    most = lambda n, place: F.max_by("font", F.when(F.col(n) > 0, F.struct(F.col(n).alias("n"), (-F.col(place)).alias("place"))))
    # first seen among headings, or among the others
    bodies = counted.filter(~F.col("is_heading")).groupBy("site", "page_ord", "font").agg(F.min("el").alias("b"))
    leads = counts.join(bodies, ["site", "page_ord", "font"], "left").groupBy("site", "page_ord").agg(most("body", "b").alias("primary_body"), most("headings", "h").alias("primary_heading"))
    asked = elements.filter(F.col("tag").isin(*cascade.TEXT_TAGS)).groupBy("site", "page_ord").agg(F.count("*").alias("n_asked"))
    seen = styles.groupBy("site", "page_ord").agg(F.count("*").alias("n_seen"))
    share = F.least(F.lit(100), F.floor(F.col("n_seen") / F.col("n_asked") * 100 + 0.5)).cast("int")
    stats = leads.join(asked, ["site", "page_ord"]).join(seen, ["site", "page_ord"]).join(variables, ["site", "page_ord"], "left").select(
        "site", share.alias("confidence"), "primary_body", "primary_heading", F.coalesce("variables", F.create_map().cast("map<string,string>")).alias("variables")
    )
    available = available_fonts(elements, rules, sheets).join(chosen, ["site", "page_ord"], "left_semi")
    return from_scan(counts.select("site", "font", "ord", "headings", "body", "weights"), available.select("site", "ord", "name", "source", "url", "weights"), stats)


def from_scan(counts: DataFrame, available: DataFrame, stats: DataFrame) -> DataFrame:
    """counts(site, font, ord, headings, body, weights), available(site, ord, name, source, url, weights),
    stats(site, confidence, primary_body, primary_heading, variables map) -> font entries."""
    lists = available.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "source", "url", "weights"))).alias("available"))
    s = stats.join(lists, "site", "left").withColumn("available", F.coalesce("available", F.array().cast("array<struct<ord:int,name:string,source:string,url:string,weights:array<string>>>")))

    def resolved(name: Column) -> Column:
        variable = F.trim(F.regexp_extract(name, r"var\(([^),]+)", 1))
        value = F.try_element_at("variables", variable)
        known = F.when(~N.has_unresolved_var(value), F.trim(F.regexp_replace(F.split_part(value, F.lit(","), F.lit(1)), "['\"]", "")))
        other = F.try_element_at(F.filter("available", lambda a: (a["source"] != "adobe") | ~a["name"].contains("Adobe Fonts")), F.lit(1))["name"]
        return F.when(N.has_unresolved_var(name), F.coalesce(known, other, F.lit(N.UNIDENTIFIED))).otherwise(name)

    s = s.withColumn("body_font", resolved(F.col("primary_body"))).withColumn("heading_font", resolved(F.col("primary_heading")))
    loaded = lambda name: F.exists("available", lambda a: _squeezed(a["name"]) == _squeezed(name))
    usable = lambda name: name.isNotNull() & ~N.is_icon_font(name) & ((name == N.UNIDENTIFIED) | loaded(name) | ~N.is_system_font(name))
    google = lambda name: F.try_element_at(F.filter("available", lambda a: (F.lower(a["name"]) == F.lower(name)) & (a["source"] == "google")), F.lit(1))["url"]
    count = counts.select("site", F.col("font").alias("_font"), "headings", "body", "weights")

    def lead(name: str, original: str, role: str, place: int, extra: int, weight: str) -> DataFrame:
        rows = s.filter(usable(F.col(name))).join(count, (s["site"] == count["site"]) & (F.col(original) == F.col("_font")), "left").drop(count["site"])
        level = F.when(F.col(name) == N.UNIDENTIFIED, 50).otherwise(F.least(F.lit(98), F.col("confidence") + extra))
        return rows.select("site", F.lit(place).alias("ord"), F.col(name).alias("name"), F.lit(role).alias("role"), F.coalesce("weights", F.array(F.lit(weight))).alias("variants"), level.alias("confidence"), google(F.col(name)).alias("google_url"), F.lit(f"Primary {role} font").alias("context"))

    body = lead("body_font", "primary_body", "primary", 0, 10, "400")
    heading = lead("heading_font", "primary_heading", "heading", 1, 5, "700")
    used = counts.join(s.select("site", "available"), "site").filter(usable(F.col("font")))
    role = F.when(F.col("headings") > F.col("body"), "heading").when(F.col("body") > 10, "primary").otherwise("secondary")
    total = F.col("headings") + F.col("body")
    others = used.select("site", (F.col("ord") + 2).alias("ord"), F.col("font").alias("name"), role.alias("role"), F.coalesce("weights", F.array(F.lit("400"))).alias("variants"), F.least(F.lit(90), 50 + total).alias("confidence"), google(F.col("font")).alias("google_url"), F.concat(F.lit("Used in "), total.cast("string"), F.lit(" elements")).alias("context"))
    unused = available.filter(~((F.col("source") == "adobe") & (F.col("name") == "Adobe Fonts (Typekit)"))).select(
        "site", (F.col("ord") + 100_000).alias("ord"), "name", F.lit("secondary").alias("role"), F.coalesce("weights", F.array(F.lit("400"))).alias("variants"), F.lit(70).alias("confidence"),
        F.when(F.col("source") == "google", F.col("url")).alias("google_url"), F.lit("Loaded but not seen in visible text").alias("context"),
    )
    return first_of_each(body.unionByName(heading).unionByName(others).unionByName(unused))


def first_of_each(entries: DataFrame) -> DataFrame:
    """The first entry of each lower-case name of a site."""
    by = Window.partitionBy("site", F.lower("name")).orderBy("ord")
    return entries.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def font_source(name: Column, google: Column, sources: Column) -> Column:
    """Where a font comes from. google array<string>, sources array<struct<type, url, fonts>>."""
    first = lambda kind: F.try_element_at(F.filter(sources, lambda s: s["type"] == kind), F.lit(1))
    key = _squeezed(name)
    return (
        F.when(F.exists(google, lambda g: _squeezed(g) == key), "Google Fonts")
        .when(F.regexp_replace(F.lower(first("google")["url"]), r"\+", "").contains(key), "Google Fonts")
        .when(F.exists(sources, lambda s: s["type"] == "adobe"), "Adobe Fonts")
        .when(F.exists(first("fontface")["fonts"], lambda f: F.lower(f).contains(key)), "Self-hosted")
        .when(N.is_system_font(name), "System font")
        .otherwise("Unknown")
    )


def _places(pages: DataFrame, column: str, kind: str) -> DataFrame:
    """site, place, item: the items of a list of each page; places order them by page, by list where pages share a number, and within the list."""
    rows = pages.select("site", "page_ord", F.coalesce(column, F.array().cast(kind)).alias("v"))
    return rows.select("site", "page_ord", "v", F.posexplode("v").alias("pos", "item")).select("site", F.struct("page_ord", "v", "pos").alias("place"), "item")


def _contained(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """texts(site, text), needles(site, needle) -> site, text, needle: every needle that stands within a text of its site.

    Substrings of the lengths that needles have are looked up by equality, so work grows with texts, not with pairs.
    """
    lengths = needles.groupBy("site").agg(F.collect_set(F.length("needle")).alias("_lengths"))
    spans = texts.distinct().join(lengths, "site").select("site", "text", F.explode("_lengths").alias("_n")).filter(F.col("_n") <= F.length("text"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("_n") + 1), lambda i: F.substr("text", i, F.col("_n"))))
    return spans.select("site", "text", F.explode(parts).alias("needle")).join(needles.distinct(), ["site", "needle"])


def from_computed(pages: DataFrame) -> DataFrame:
    """pages(site, page_ord, url, computed map<role, struct<family, weight>>, loaded, google array<string>, variables map, sources) -> font entries.

    What a site's pages load and list stays rows: each family of a site is resolved once, by joins, and no page carries the lists of its site.
    """
    names = "array<string>"
    loaded = _places(pages, "loaded", names).groupBy("site", F.col("item").alias("name")).agg(F.min("place").alias("place"))
    sources = _places(pages, "sources", "array<struct<type:string,url:string,fonts:array<string>>>")
    no_list, no_sources = F.lit(None).cast(names), F.lit(None).cast("array<struct<type:string,url:string,fonts:array<string>>>")
    spot = lambda late, listed, sources, i: F.struct(F.lit(late).alias("late"), F.col("place.page_ord").alias("page_ord"), listed.alias("a"), sources.alias("b"), F.col("place.pos").alias("pos"), i.alias("i")).alias("place")
    listed = _places(pages, "google", names).select("site", F.col("item").alias("name"), spot(0, F.col("place.v"), no_sources, F.lit(0)))
    parsed = sources.filter("item.type = 'google' and item.url is not null").select("site", "place", F.posexplode(N.google_families("item.url")).alias("i", "f"))
    parsed = parsed.select("site", F.col("f.name").alias("name"), spot(1, no_list, F.col("place.v"), F.col("i")))
    google = cut(listed.unionByName(parsed).groupBy("site", "name").agg(F.min("place").alias("place")))

    # what every site says once
    first = lambda value, test=None: F.min_by(value, "place" if test is None else F.when(test, F.col("place")))
    of_type = lambda kind: F.col("item.type") == kind
    by_source = sources.groupBy("site").agg(
        first("item.url", of_type("google")).alias("google_first"), first("item.fonts", of_type("fontface")).alias("faces"), F.max(of_type("adobe")).alias("adobe"),
    )
    by_load = loaded.groupBy("site").agg(first("name").alias("any_load"), first("name", ~N.is_system_font("name")).alias("own_load"))
    told_of = ("google_first", "faces", "adobe", "any_load", "own_load")
    said = pages.select("site").distinct().unionByName(by_source, True).unionByName(by_load, True).groupBy("site").agg(*[F.first(c, True).alias(c) for c in told_of])

    info = lambda *roles: F.coalesce(*[F.try_element_at("computed", F.lit(r)) for r in roles])
    slots = (("heading", info("h1", "h2", "h3", "hero"), "700", 85), ("body", info("body"), "400", 85), ("button", info("button"), "600", 80), ("nav", info("nav"), "500", 75))
    styled = pages.filter(F.size("computed") > 0).filter("site is not null").select("site", "page_ord", *[data.alias(slot) for slot, data, _, _ in slots])
    families = styled.select("site", F.explode(F.array_compact(F.array(*[slot for slot, *_ in slots]))).alias("info")).select("site", F.col("info.family").alias("family")).distinct()

    # a family's name: its variable's value, a font that its site loads, a font that Google lists, a font of the site's own
    held = pages.select("site", "page_ord", F.map_entries(F.coalesce("variables", F.create_map().cast("map<string,string>"))).alias("v"))
    held = held.select("site", F.struct("page_ord", "v").alias("place"), F.explode("v").alias("e")).groupBy("site", F.col("e.key").alias("_variable")).agg(F.max_by("e.value", "place").alias("_value"))
    head = lambda c: F.trim(F.regexp_replace(F.split_part(c, F.lit(","), F.lit(1)), "['\"]", ""))
    asked = families.withColumn("_variable", F.trim(F.regexp_extract("family", r"var\(([^),]+)", 1))).join(held, ["site", "_variable"], "left").join(said.select("site", "any_load", "own_load"), "site")
    asked = asked.withColumn("name", F.when(N.has_unresolved_var("family") & F.col("_value").isNotNull(), head(F.col("_value"))).otherwise(F.col("family")))
    unknown = N.has_unresolved_var("name") | (F.col("name") == "") | (F.col("name") == "Unknown")
    asked = cut(asked.withColumn("name", F.when(unknown, F.coalesce("any_load", "name")).otherwise(F.col("name"))).select("site", "family", "name", "own_load"))
    needles = google.select("site", F.lower("name").alias("needle"), "name", "place").filter("needle is not null")
    within = _contained(asked.select("site", F.lower("family").alias("text")).filter("text is not null"), needles.select("site", "needle"))
    same = asked.select("site", "family", F.lower("name").alias("needle"))
    hits = asked.select("site", "family", F.lower("family").alias("text")).join(within, ["site", "text"]).select("site", "family", "needle").unionByName(same)
    hits = hits.join(needles, ["site", "needle"]).groupBy("site", "family").agg(first("name").alias("_listed"))
    resolved = asked.join(hits, ["site", "family"], "left").withColumn("name", F.coalesce("_listed", "name"))
    resolved = cut(resolved.select("site", "family", F.when(N.is_system_font("name"), F.col("own_load")).otherwise(F.col("name")).alias("name")))

    rows = styled
    for slot, *_ in slots:
        name = resolved.select(F.col("site").alias("_site"), F.col("family").alias("_family"), F.col("name").alias(f"{slot}_name"))
        rows = rows.join(name, F.col(slot).isNotNull() & (F.col("site") == F.col("_site")) & F.col(f"{slot}.family").eqNullSafe(F.col("_family")), "left").drop("_site", "_family")
    different = lambda a, *others: F.lit(True) if not others else F.coalesce(~F.lower(F.col(a)).isin(*[F.coalesce(F.lower(F.col(o)), F.lit("")) for o in others]), F.lit(True))
    roles = {"heading": "heading", "body": "primary", "button": "button", "nav": "accent"}
    seen: list[str] = []
    entries = []
    for k, (slot, _, weight, _) in enumerate(slots):
        name = F.col(f"{slot}_name")
        role = F.when(F.lower("heading_name") == F.lower("body_name"), "primary").otherwise("heading") if slot == "heading" else F.lit(roles[slot])
        entry = F.struct((F.col("page_ord") * 10 + k).alias("ord"), F.lit(k).alias("slot"), name.alias("name"), role.alias("role"), F.array(F.coalesce(F.col(f"{slot}.weight"), F.lit(weight))).alias("variants"))
        entries.append(F.when(name.isNotNull() & different(f"{slot}_name", *seen), entry))
        seen.append(f"{slot}_name")
    found = cut(first_of_each(rows.select("site", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("site", "e.*")))

    # where the fonts that are left come from
    in_google = google.select("site", _squeezed(F.col("name")).alias("_key")).filter("_key is not null").distinct().withColumn("_listed", F.lit(True))
    urls = sources.filter("item.type = 'google' and item.url is not null").groupBy("site", F.col("item.url").alias("url")).agg(F.min("place").alias("place"))
    put = F.regexp_replace(F.lower("name"), r"\s+", "+")
    linked = _contained(urls.select("site", F.lower("url").alias("text")), found.select("site", put.alias("needle")))
    linked = linked.join(urls.withColumn("text", F.lower("url")), ["site", "text"]).groupBy("site", F.col("needle").alias("_put")).agg(first("url").alias("google_url"))
    told = found.withColumns({"_key": _squeezed(F.col("name")), "_put": put}).join(said.select("site", "google_first", "faces", "adobe"), "site").join(in_google, ["site", "_key"], "left").join(linked, ["site", "_put"], "left")
    origin = (
        F.when(F.col("_listed"), "Google Fonts")
        .when(F.regexp_replace(F.lower("google_first"), r"\+", "").contains(F.col("_key")), "Google Fonts")
        .when(F.col("adobe"), "Adobe Fonts")
        .when(F.exists("faces", lambda f: F.lower(f).contains(F.col("_key"))), "Self-hosted")
        .when(N.is_system_font("name"), "System font")
        .otherwise("Unknown")
    )
    low = F.element_at(F.array(*[F.lit(low) for *_, low in slots]), F.col("slot") + 1)
    leading = F.col("slot") < 2
    told = told.withColumn("_origin", origin)
    level = F.when(F.col("_origin") == "Google Fonts", F.when(leading, 98).otherwise(95)).when(leading & (F.col("_origin") == "Self-hosted"), 90).otherwise(low)
    found = told.select("site", "ord", "name", "role", "variants", level.alias("confidence"), "google_url", F.concat(F.lit("Source: "), "_origin").alias("context"))

    # sites whose styles name nothing: the first two fonts that are listed, else loaded
    left = said.select(F.col("site").alias("_site"), "google_first").join(found.select(F.col("site").alias("_site")).distinct(), "_site", "left_anti")
    own = F.col("site").eqNullSafe(F.col("_site"))
    ranked = lambda rows: rows.select("site", "name", (F.row_number().over(Window.partitionBy("site").orderBy("place")) - 1).alias("ord")).filter("ord < 2")
    spare = ranked(google).join(left, own).select("site", "ord", "name", F.lit(95).alias("confidence"), F.col("google_first").alias("google_url"))
    bare = left.join(google.select("site").distinct(), own, "left_anti").select("_site")
    spare = spare.unionByName(ranked(loaded).join(bare, own).select("site", "ord", "name", F.lit(85).alias("confidence"), F.lit(None).cast("string").alias("google_url")).filter(~N.is_system_font("name")))
    spare = spare.select("site", "ord", "name", F.when(F.col("ord") == 0, "primary").otherwise("heading").alias("role"), F.array(F.lit("400")).alias("variants"), "confidence", "google_url", F.lit("Loaded by the site").alias("context"))
    return found.unionByName(spare)


def from_css(pages: DataFrame, sheets: DataFrame) -> DataFrame:
    """Fonts of Google links, then the first own family of each font-family declaration."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="(https://fonts\.googleapis\.com/css2?\?[^"]+)"'), F.lit(1))
    linked = pages.select("site", "page_ord", F.posexplode(hrefs).alias("k", "href")).select("site", "page_ord", "k", "href", F.posexplode(N.google_families("href")).alias("i", "f"))
    google = linked.select("site", (F.col("page_ord") * 1000 + F.col("k") * 50 + F.col("i")).alias("ord"), F.col("f.name").alias("name"), F.when(F.col("i") == 0, "primary").otherwise("heading").alias("role"), F.col("f.weights").alias("variants"), F.lit(90).alias("confidence"), F.col("href").alias("google_url"), F.lit("Google Fonts link").alias("context"))
    stacks = sheets.select("site", "page_ord", "css_ord", F.posexplode(F.regexp_extract_all("css", F.lit(r"(?i)font-family\s*:\s*([^;}]+)"), F.lit(1))).alias("k", "stack"))
    names = F.filter(F.transform(F.split("stack", ","), lambda f: F.regexp_replace(F.trim(f), "['\"`]", "")), lambda f: (f != "") & ~N.is_system_font(f) & ~N.has_unresolved_var(f))
    own = stacks.withColumn("name", F.try_element_at(names, F.lit(1))).filter("name is not null")
    place = (F.col("page_ord") * 1000 + F.col("css_ord")) * 10_000 + F.col("k") + 1_000_000_000
    declared = own.select("site", place.cast("long").alias("ord"), "name", F.lit("secondary").alias("role"), F.array().cast("array<string>").alias("variants"), F.lit(70).alias("confidence"), F.lit(None).cast("string").alias("google_url"), F.lit("CSS declaration").alias("context"))
    return first_of_each(google.withColumn("ord", F.col("ord").cast("long")).unionByName(declared))


def final_fonts(entries: DataFrame, most: int | None = MAX_FONTS) -> DataFrame:
    """Displayable fonts, one per normalised key (most confident, at the key's first place), code fonts demoted, ranked; `most` a site, all of them where it is None."""
    kept = entries.filter(N.is_displayable("name")).withColumn("key", N.normalise_key("name"))
    merged = kept.groupBy("site", "key").agg(
        F.min_by(F.struct("name", "role", "variants", "confidence", "google_url", "context"), F.struct((-F.col("confidence")).alias("c"), F.col("ord"))).alias("f"), F.min("ord").alias("ord")
    ).select("site", "key", "ord", "f.*")
    demoted = N.is_monospace("name") & F.col("role").isin("primary", "heading")
    merged = merged.withColumn("name", N.clean_name("name")).withColumn("role", F.when(demoted, "accent").otherwise(F.col("role")))
    by = Window.partitionBy("site").orderBy(N.role_rank("role"), F.desc("confidence"), "ord")
    ranked = merged.withColumn("rank", F.row_number().over(by))
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select("site", "rank", "name", "role", "variants", "confidence", "google_url", "context")


def extract_typography(css_fonts: DataFrame, computed: DataFrame | None = None, scanned: DataFrame | None = None) -> DataFrame:
    """Each site's best layer: scan, else computed styles, else CSS."""
    chosen = None
    for layer in (scanned, computed, css_fonts):
        if layer is None:
            continue
        rows = layer.select(*ENTRY[:1], F.col("ord").cast("long").alias("ord"), *ENTRY[2:])
        chosen = rows if chosen is None else chosen.unionByName(rows.join(chosen.filter(N.is_displayable("name")).select("site").distinct(), "site", "left_anti"))
    return final_fonts(chosen)
