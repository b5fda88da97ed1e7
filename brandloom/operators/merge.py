"""Third-party brand records, their merge with extracted values, and owners' edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import color as C, url as U

# Fixed values.
ROLE_OF_TYPE = {"brand": "primary", "accent": "accent", "dark": "text", "light": "background"}
PROFILE_NAMES = ("twitter", "instagram", "linkedin", "youtube", "tiktok", "facebook")
STRONG_AREA, DISAGREE, SAME, AREA_RATIO = 0.05, 10.0, 3.0, 1 / 3
RECORD = (
    "name string, domain string, claimed boolean, description string, longDescription string, links array<struct<name:string,url:string>>, "
    "logos array<struct<type:string,theme:string,formats:array<struct<src:string,background:string,format:string,size:int>>>>, "
    "colors array<struct<hex:string,type:string,brightness:int>>, fonts array<struct<name:string,type:string,origin:string,originId:string,weights:array<int>>>, "
    "images array<struct<src:string,type:string>>, qualityScore double"
)


def _standing(records: DataFrame) -> DataFrame:
    claimed = F.coalesce("claimed", F.lit(False))
    return records.select("*", F.when(claimed, "verified").otherwise("third_party").alias("source"), F.when(claimed, 100).otherwise(70).alias("confidence"))


def record_colors(records: DataFrame) -> DataFrame:
    """site, ord, hex, role, source, confidence: valid colours once each, one primary."""
    rows = _standing(records).select(F.col("domain").alias("site"), "source", "confidence", F.posexplode("colors").alias("pos", "c"))
    rows = rows.withColumn("hex", C.normalise_hex("c.hex")).filter("hex is not null")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("site", "hex").orderBy("pos"))).filter("_n = 1")
    roles = F.create_map(*[F.lit(x) for pair in ROLE_OF_TYPE.items() for x in pair])
    rows = rows.withColumn("role", F.coalesce(F.try_element_at(roles, F.col("c.type")), F.lit("other")))
    nth = F.row_number().over(Window.partitionBy("site", "role").orderBy("pos"))
    rows = rows.withColumn("role", F.when((F.col("role") == "primary") & (nth > 1), "secondary").otherwise(F.col("role")))
    return rows.select("site", F.row_number().over(Window.partitionBy("site").orderBy("pos")).alias("ord"), "hex", "role", "source", "confidence")


def record_fonts(records: DataFrame) -> DataFrame:
    """site, ord, name, role, variants, source, confidence."""
    rows = _standing(records).select(F.col("domain").alias("site"), "source", "confidence", F.posexplode(F.filter("fonts", lambda f: F.trim(f["name"]) != "")).alias("pos", "f"))
    role = F.when(F.col("f.type").isin("title", "heading"), "heading").when((F.col("f.type") == "body") | (F.col("pos") == 0), "primary").otherwise("secondary")
    weights = F.coalesce(F.transform("f.weights", lambda w: w.cast("string")), F.array().cast("array<string>"))
    return rows.select("site", (F.col("pos") + 1).alias("ord"), F.trim("f.name").alias("name"), role.alias("role"), weights.alias("variants"), "source", "confidence")


def record_links(records: DataFrame) -> DataFrame:
    """site, ord, platform, url, source, confidence: https links to known platforms."""
    rows = _standing(records).select(F.col("domain").alias("site"), "source", "confidence", F.posexplode("links").alias("pos", "l"))
    rows = rows.filter(F.lower("l.name").isin(*PROFILE_NAMES) & U.https_only("l.url").isNotNull())
    return rows.select("site", (F.col("pos") + 1).alias("ord"), F.lower("l.name").alias("platform"), F.col("l.url").alias("url"), "source", "confidence")


def record_facts(records: DataFrame) -> DataFrame:
    """site, name, description, logo_url (SVG, else PNG, else the first format; https only), verified."""
    logo = F.coalesce(F.try_element_at(F.filter("logos", lambda x: x["type"] == "logo"), F.lit(1)), F.try_element_at("logos", F.lit(1)))
    of = lambda kind: U.https_only(F.try_element_at(F.filter(logo["formats"], lambda f: f["format"] == kind), F.lit(1))["src"])
    url = F.coalesce(of("svg"), of("png"), U.https_only(F.try_element_at(logo["formats"], F.lit(1))["src"]))
    text = F.coalesce(F.when(F.col("description") != "", F.col("description")), "longDescription", F.lit(""))
    return records.select(F.col("domain").alias("site"), "name", text.alias("description"), url.alias("logo_url"), F.coalesce("claimed", F.lit(False)).alias("verified"))


def merge_keyed(extracted: DataFrame, third: DataFrame, key: str) -> DataFrame:
    """Same key: the third party's row replaces the extracted one at its place; order: verified, then confidence, then place."""
    value = [c for c in extracted.columns if c not in ("site", "ord", "key")]
    side = lambda df, name: df.select("site", F.col(key).alias("_key"), F.col("ord").alias(f"_{name}_ord"), F.struct(*value).alias(f"_{name}"))
    last = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("site", key).orderBy(F.desc("ord")))).filter("_n = 1").drop("_n")
    both = side(last(extracted), "e").join(side(last(third), "t"), ["site", "_key"], "full_outer")
    rows = both.select("site", F.coalesce("_e_ord", F.col("_t_ord") + 1_000_000).alias("_place"), F.coalesce("_t", "_e").alias("v")).select("site", "_place", "v.*")
    by = Window.partitionBy("site").orderBy((F.col("source") != "verified").cast("int"), F.desc("confidence"), "_place")
    return rows.withColumn("ord", F.row_number().over(by)).select("site", "ord", *value)


COLOURS = "site string, ord int, hex string, role string, confidence int, source string, area_share double"


def merge_colors(extracted: DataFrame, third: DataFrame) -> DataFrame:
    """Both palettes of a site as one, at most one primary; each third-party colour takes the first extracted one within CIEDE2000 of 3.

    Order-dependent over one site's at most ten and twenty colours, hence a fold per site.
    """
    columns = ["site", "ord", "hex", "role", "confidence", "source", "area_share"]
    rows = extracted.select(*columns, F.lit(0).alias("side")).unionByName(third.withColumn("area_share", F.lit(None).cast("double")).select(*columns, F.lit(1).alias("side")))
    return rows.groupBy("site").applyInPandas(_merge_site, COLOURS)


def _merge_site(pdf):
    """One site's merge, see merge_colors."""
    rows = pdf.sort_values(["side", "ord"]).to_dict("records")
    for r in rows:
        r["lab"], r["area_share"] = C.lab_of(r["hex"]), None if pd.isna(r["area_share"]) else r["area_share"]
    ours, theirs = [r for r in rows if r["side"] == 0], [r for r in rows if r["side"] == 1]
    gap = lambda a, b: C.delta_e(a["lab"], b["lab"])
    lead = next((r for r in ours if r["role"] == "primary"), None)
    rival = next((r for r in theirs if r["role"] == "primary"), None)
    own_wins = False
    if lead and rival and rival["source"] != "verified":
        share = lead["area_share"] or 0.0
        covered = next((r["area_share"] or 0.0 for r in ours if gap(r, rival) < SAME), 0.0)
        own_wins = share >= STRONG_AREA and gap(lead, rival) >= DISAGREE and covered < share * AREA_RATIO

    def demoted(palette):
        return "accent" if any(r["role"] == "secondary" for r in palette) else "secondary"

    merged = [dict(r) for r in ours]
    for their in theirs:
        new = dict(their)
        if their is rival and own_wins:
            new["role"] = demoted(merged)
        k = next((i for i, r in enumerate(merged) if gap(r, their) < SAME), None)
        if k is not None:
            old = merged.pop(k)
            new["area_share"] = old["area_share"]
            if new["role"] == "other" or own_wins and old["hex"] == lead["hex"]:
                new["role"] = old["role"]
        merged.append(new)
    leads = [r for r in merged if r["role"] == "primary"]
    if own_wins:
        keeper = next((r for r in leads if gap(r, lead) < SAME), None)
    else:
        names = {r["hex"] for r in theirs}
        keeper = next((r for r in leads if r["hex"] in names), leads[0] if leads else None)
    for r in leads:
        if r is not keeper:
            r["role"] = demoted(merged)
    ranked = sorted(enumerate(merged), key=lambda x: (x[1]["role"] != "primary", x[1]["source"] != "verified", -x[1]["confidence"], x[0]))
    out = pd.DataFrame([r for _, r in ranked])
    out["ord"] = range(1, len(out) + 1)
    return out[["site", "ord", "hex", "role", "confidence", "source", "area_share"]]


def apply_color_edits(palette: DataFrame, edits: DataFrame) -> DataFrame:
    """palette(report, ord, hex, role), edits(report, hex, new_hex, new_role, hidden) -> visible colours, edited flags, channels."""
    e = edits.select("report", F.lower("hex").alias("_key"), "new_hex", "new_role", "hidden")
    rows = palette.withColumn("_key", F.lower("hex")).join(e, ["report", "_key"], "left").filter(~F.coalesce("hidden", F.lit(False)))
    edited = F.coalesce("new_hex", "new_role").isNotNull()
    rows = rows.withColumn("user_edited", edited).withColumn("hex", F.coalesce("new_hex", "hex")).withColumn("role", F.coalesce("new_role", "role"))
    return rows.select("report", "ord", "hex", "role", "user_edited", C.hex_to_rgb("hex").alias("rgb"))


def apply_font_edits(fonts: DataFrame, edits: DataFrame) -> DataFrame:
    """fonts(report, ord, name, google_url), edits(report, name, new_name, hidden); a renamed font loses its Google link."""
    e = edits.select("report", "name", "new_name", F.col("hidden").alias("_hidden"))
    rows = fonts.join(e, ["report", "name"], "left").filter(~F.coalesce("_hidden", F.lit(False)))
    renamed = F.col("new_name").isNotNull()
    return rows.select("report", "ord", F.coalesce("new_name", "name").alias("name"), F.when(~renamed, F.col("google_url")).alias("google_url"), renamed.alias("user_edited"))


def apply_name_edit(reports: DataFrame, edits: DataFrame) -> DataFrame:
    """reports(report, brand_name), edits(report, new_brand): a non-blank edit replaces the name."""
    rows = reports.join(edits.select("report", F.trim("new_brand").alias("_b")), "report", "left")
    return rows.select("report", F.coalesce(F.when(F.col("_b") != "", F.col("_b")), "brand_name").alias("brand_name"))


def view_of(reports: DataFrame, token: Column) -> DataFrame:
    """Owners (SHA-256 of the token) see raw data and edits; others the applied data of public, completed reports."""
    own = F.sha2(token.cast("binary"), 256) == F.col("owner_token_hash")
    rows = reports.withColumn("is_owner", F.coalesce(own, F.lit(False))).filter(F.col("is_owner") | F.col("is_public") & (F.col("status") == "completed"))
    return rows.withColumn("edits", F.when(F.col("is_owner"), F.col("edits")))


def compare_reports(palette: DataFrame, fonts: DataFrame, left: str, right: str) -> DataFrame:
    """Two sites side by side: first five colours and three fonts."""
    wanted = F.col("site").isin(left, right)
    listed = lambda df, value, n: df.filter(wanted & (F.col("rank") <= n)).groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias(f"{value}s"))
    rows = listed(palette, "hex", 5).join(listed(fonts, "name", 3), "site", "full_outer")
    return rows.groupBy().pivot("site", [left, right]).agg(F.first(F.struct("hexs", "names")))
