"""Locations, phones and social profiles per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import geo as G, social as S, text as T, url as U
from .seo import schema_types


def location_candidates(pages: DataFrame) -> DataFrame:
    """site, kind (phone, address), value, at: every candidate, structured data first, then page by page."""
    scanned = F.when(F.col("url").rlike(G.LOCATION_PAGE), F.col("visible_text")).otherwise(F.col("footer"))
    text = pages.select("site", "page_ord", "url", scanned.alias("text"), "address_blocks")
    part = lambda k: F.get_json_object("item", f"$.address.{k}")
    items = pages.select("site", "page_ord", F.posexplode("schema_data").alias("pos", "item"))
    structured = items.select("site", F.lit(0).alias("pass"), "page_ord", F.lit("address").alias("kind"), "pos", F.concat_ws(", ", *[part(k) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")]).alias("value"))
    found = text.select("site", F.lit(1).alias("pass"), "page_ord", F.lit("phone").alias("kind"), F.posexplode(G.phones(F.col("text"))).alias("pos", "value"))
    found = found.unionByName(text.select("site", F.lit(1).alias("pass"), "page_ord", F.lit("address").alias("kind"), F.posexplode(G.addresses(F.col("text"))).alias("pos", "value")))
    blocks = text.filter(F.col("url").rlike(G.LOCATION_PAGE)).select("site", F.lit(1).alias("pass"), "page_ord", F.lit("address").alias("kind"), F.posexplode("address_blocks").alias("pos", "value")).withColumn("pos", F.col("pos") + (1 << 30))
    everything = structured.filter("value <> ''").unionByName(found).unionByName(blocks)
    return everything.groupBy("site", "kind", "value").agg(F.min(F.struct("pass", "page_ord", "pos")).alias("at"))


def dedupe_addresses(rows: DataFrame) -> DataFrame:
    """rows(site, address, at) -> the fullest address of each street (with ZIP, then longer, then first), at the street's first place."""
    keyed = rows.withColumn("key", G.street_key(F.col("address")))
    best = F.min_by("address", F.struct((~F.col("address").rlike(r"\d{5}")).cast("int"), -F.length("address"), F.col("at")))
    return keyed.groupBy("site", "key").agg(best.alias("address"), F.min("at").alias("at"))


def geo_report(pages: DataFrame) -> DataFrame:
    """Per site: addresses, phones, maps and schema flags, location pages, several locations, confidence."""
    found = location_candidates(pages)
    cleaned = dedupe_addresses(found.filter("kind = 'address'").select("site", "at", G.clean_address(F.col("value")).alias("address")).filter("address is not null"))
    listed = lambda rows, value: rows.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v")))), lambda x: x["v"]).alias(value))
    phones = listed(found.filter("kind = 'phone'").withColumnRenamed("value", "phone"), "phone")
    addresses = listed(cleaned, "address")
    raw = found.filter("kind = 'address'").groupBy("site").agg(F.count("*").alias("n_raw"))
    low = F.lower("html")
    many = T.any_of([low.contains(w) for w in G.MANY_LOCATIONS])
    a_link = F.try_element_at(F.filter("all_hrefs", lambda h: h.rlike("(?i)location|store|find") & ~h.rlike("[\"']")), F.lit(1))
    a_page = F.try_element_at(F.filter("all_hrefs", lambda h: h.rlike("(?i)/locations?") & ~h.rlike("[\"']")), F.lit(1))
    absolute = lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(U.base_domain("url"), F.when(h.startswith("/"), "").otherwise("/"), h))
    first = lambda value, test: F.min_by(value, F.when(test, F.col("page_ord")))
    explicit = F.col("url").rlike(r"(?i)/locations?/?$|/store-locator|/stores/?$|/find-us|/find-a-location") & F.col("url").rlike(G.LOCATION_URL)
    base = pages.groupBy("site").agg(
        F.max(F.col("html").rlike(G.MAPS)).alias("has_maps"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("url").rlike(G.LOCATION_URL), F.struct("page_ord", "url")))), lambda x: x["url"]).alias("location_pages"),
        first(F.col("url"), explicit).alias("explicit_page"), F.max(many).alias("many"), first(absolute(a_link), many).alias("many_page"),
        first(absolute(a_page), a_page.isNotNull()).alias("linked_page"), F.min_by("url", "page_ord").alias("first_url"),
    )
    s = base.join(schema_types(pages), "site", "left").join(phones, "site", "left").join(addresses, "site", "left").join(raw, "site", "left")
    empty = F.array().cast("array<string>")
    s = s.withColumn("phone", F.coalesce("phone", empty)).withColumn("address", F.coalesce("address", empty)).withColumn("local", G.has_local_type(F.coalesce("types", empty)))
    hidden = (F.coalesce("n_raw", F.lit(0)) > 3) & (F.size("address") == 0) & F.col("linked_page").isNotNull()
    s = s.withColumn("several", F.col("explicit_page").isNotNull() | F.col("many") | hidden)
    where = F.when(F.col("explicit_page").isNotNull(), F.col("explicit_page")).when(F.col("many"), F.col("many_page")).when(hidden, F.col("linked_page"))
    host = U.strip_www(U.host("first_url"))
    message = F.when(F.col("several") & (F.size("address") == 0), F.when(where.isNotNull(), F.concat(F.lit("Multiple locations - visit "), host, F.lit("/locations"))).otherwise(F.concat(F.lit("Multiple locations - visit "), host, F.lit(" for addresses"))))
    flag = lambda test, n: F.when(test, n).otherwise(0)
    level = 30 + flag(F.size("phone") > 0, 20) + flag(F.size("address") > 0, 25) + flag(F.col("has_maps"), 10) + flag(F.col("local"), 15) + flag(F.col("several"), 10)
    seen = (F.size("phone") > 0) | (F.size("address") > 0) | F.col("local") | F.col("several")
    return s.select(
        "site", F.col("address").alias("addresses"), F.col("phone").alias("phones"), "has_maps", F.col("local").alias("has_local_schema"), "location_pages",
        F.col("several").alias("is_multi_location"), where.alias("locations_page"), message.alias("message"), F.least(level, F.lit(100)).alias("confidence"), F.when(seen, "extracted").otherwise("not_found").alias("source"),
    )


def social_candidates(links: DataFrame, compat: bool = False) -> DataFrame:
    """links(site, page_ord, pos, page_url, href) + twitter metas (context 'meta', href '@handle') -> profiles that count."""
    anchors = links.filter("context = 'anchor'").withColumn("platform", S.platform(F.col("href"), compat)).filter("platform is not null")
    anchors = anchors.filter(~S.is_ignored(F.col("href")) & S.is_valid(F.col("href"), F.col("platform"))).withColumn("handle", S.handle(F.col("href"), F.col("platform"))).withColumn("link", S.normalise(F.col("href")))
    metas = links.filter("context = 'meta' and href like '@%'").withColumn("platform", F.lit("twitter")).withColumn("handle", F.col("href"))
    metas = metas.withColumn("link", S.normalise(F.concat(F.lit("https://twitter.com/"), F.regexp_replace("href", "@", ""))))
    both = anchors.unionByName(metas).filter(~S.is_technical(F.col("handle")))
    return both.withColumn("key", S.dedupe_key(F.col("platform"), F.col("handle"), F.col("link")))


def social_links(links: DataFrame, compat: bool = False) -> DataFrame:
    """One official profile per platform and site: most pages link to it, its handle resembles the host, or its page says so."""
    rows = social_candidates(links, compat)
    place = F.struct("page_ord", "context", "pos")
    once = rows.groupBy("site", "page_ord", "page_url", "link").agg(F.min_by(F.struct("platform", "handle", "key", "context", "pos"), place).alias("f")).select("site", "page_ord", "page_url", "link", "f.*")
    merged = once.groupBy("site", "platform", "key").agg(
        F.min_by("link", place).alias("url"), F.min_by("handle", place).alias("handle"), F.min(place).alias("at"),
        F.count_distinct("page_url").alias("n_pages"), F.max((F.col("context") == "meta")).alias("from_meta"),
        F.max(F.when(F.col("context") == "meta", 90).otherwise(85)).alias("confidence"),
    )
    token = F.regexp_replace(F.split_part("site", F.lit("."), F.lit(1)), "[^a-z0-9]", "")
    score = F.col("n_pages") * 10 + F.when(S.resembles(token, F.col("handle")), 25).otherwise(0) + F.when(F.col("from_meta"), 30).otherwise(0)
    scored = merged.withColumn("score", score)
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("site", "platform").orderBy(F.desc("score"), "at"))).filter("_n = 1")
    ordered = best.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(S.order_of(F.col("platform")))))
    return ordered.select("site", F.col("rank").cast("int").alias("rank"), "platform", "url", "handle", "confidence", F.col("n_pages").cast("int").alias("n_pages"), F.col("score").cast("int").alias("score"))


def page_social_links(pages: DataFrame) -> DataFrame:
    """The links table of social_links, from parsed pages."""
    anchors = pages.select("site", "page_ord", F.col("url").alias("page_url"), F.posexplode("anchor_hrefs").alias("pos", "href")).withColumn("context", F.lit("anchor"))
    named = F.array_compact(F.array(F.try_element_at("twitter", F.lit("site")), F.try_element_at("twitter", F.lit("creator"))))
    metas = pages.select("site", "page_ord", F.col("url").alias("page_url"), F.posexplode(named).alias("pos", "href")).withColumn("context", F.lit("meta"))
    return anchors.unionByName(metas)
