"""Colour palettes: declarations and rendered areas to signals, clusters, ranks and roles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import color as C
from ..functions.css import Variables, colours, parse_colour
from ..functions.udf import arrow
from .pages import css_declarations, css_variables, distinct_stylesheets, inline_style_declarations

MERGE_DELTA, MAX_SIGNALS, MAX_COLOURS, MAX_CHROMATIC, MAX_NEUTRALS, NOISE, MAX_EVIDENCE = 3.0, 400, 10, 7, 2, 0.002, 5
_VAR_NAME = r"var\(\s*(--[\w-]+)"


@arrow("string")
def written_colour(value: pd.Series) -> pd.Series:
    """'#rrggbb' of a colour as style sheets write it, in any space or as a mix; null for what is none or less than half opaque."""
    return pd.Series([parse_colour(v) if v else None for v in value], dtype=object)


@arrow("array<string>")
def _value_colours(value: pd.Series, variables: pd.Series) -> pd.Series:
    resolvers: dict[int, Variables] = {}
    out = []
    for v, known in zip(value, variables):
        key = id(known)
        if key not in resolvers:
            resolvers[key] = Variables(dict(known) if known is not None else {})
        out.append(list(dict.fromkeys(colours(v or "", resolvers[key]))))
    return pd.Series(out, dtype=object)


def variables_of(value: str) -> Column:
    """A site's variables for a declaration that uses any; the others do not carry them to Python."""
    return F.when(F.regexp_replace(value, "(?i)!important", "").contains("var("), F.col("variables"))


def colour_uses(decls: DataFrame, variables: DataFrame) -> DataFrame:
    """Declarations that use colours, one row per colour: kind, hint, brand context, weight, evidence."""
    kinds = decls.withColumn("kind", C.classify_property("property")).filter("kind is not null")
    rows = kinds.join(variables, "site", "left").withColumn("hex", F.explode(_value_colours("value", variables_of("value"))))
    name = F.when(F.col("kind") == "definition", F.col("property")).otherwise(F.regexp_extract("value", _VAR_NAME, 1))
    rows = rows.withColumn("hint", C.role_from_name(name))
    return rows.select(
        "site", "page_ord", "page_url", "css_ord", "pos", "hex", "kind", "hint",
        F.col("selector").rlike(C.BRAND_SELECTOR).alias("branded"),
        C.usage_weight(F.col("kind"), F.col("hint")).alias("weight"),
        F.when(F.col("kind") == "definition", F.col("property")).alias("variable"),
        F.substring(F.concat_ws(": ", "property", "value"), 1, 160).alias("snippet"),
        "selector",
    )


def signals(uses: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """One row per site and colour: weights by use, area, role hints with their counts in order, first variable, evidence."""
    place = F.struct("page_ord", "css_ord", "pos")
    weight = lambda test: F.sum(F.when(test, F.col("weight")).otherwise(0.0))
    hints = uses.filter("hint is not null").groupBy("site", "hex", "hint").agg(F.count("*").alias("n"), F.min(place).alias("at"))
    hints = hints.groupBy("site", "hex").agg(F.collect_list(F.struct("at", "hint", "n")).alias("hints"))
    found = uses.groupBy("site", "hex", "snippet", "page_url").agg(F.min(F.struct("page_ord", "css_ord", "pos", "selector")).alias("at"))
    ranked = Window.partitionBy("site", "hex").orderBy("at")
    found = found.withColumn("_n", F.row_number().over(ranked)).filter(F.col("_n") <= 2 * MAX_EVIDENCE)
    evidence = found.groupBy("site", "hex").agg(F.array_sort(F.collect_list(F.struct("at", F.col("page_url").alias("url"), "snippet", F.col("at.selector").alias("context")))).alias("evidence"))
    css = uses.groupBy("site", "hex").agg(
        F.sum("weight").alias("weight"),
        weight(F.col("branded")).alias("brand_weight"),
        weight(F.col("kind") == "background").alias("bg_weight"),
        weight(F.col("kind") == "text").alias("text_weight"),
        F.min_by("variable", F.when(F.col("variable").isNotNull(), place)).alias("variable"),
    )
    css = css.join(hints, ["site", "hex"], "left").join(evidence, ["site", "hex"], "left")
    if areas is None:
        return css.withColumn("area", F.lit(0.0)).withColumn("has_areas", F.lit(False))
    seen = areas.filter(~F.col("hex").isin(*C.LINK_DEFAULTS)).groupBy("site", "hex").agg(F.sum("px").cast("double").alias("area"))
    both = css.join(seen, ["site", "hex"], "full_outer").fillna(0.0, ["weight", "brand_weight", "bg_weight", "text_weight", "area"])
    return both.withColumn("has_areas", F.max(F.col("area") > 0).over(Window.partitionBy("site")))


def cluster(rows: DataFrame) -> DataFrame:
    """rows + leader: the colour whose cluster each colour joins.

    The strongest MAX_SIGNALS of a site are taken by area, weight and name; each joins the first leader within CIEDE2000 of 3,
    or leads. Order-dependent, so it folds over one site's bounded list.
    """
    strongest = Window.partitionBy("site").orderBy(F.desc("area"), F.desc("weight"), "hex")
    top = rows.withColumn("_rank", F.row_number().over(strongest)).filter(F.col("_rank") <= MAX_SIGNALS)
    lists = top.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("_rank", "hex"))).alias("l"))
    leaders = lists.select("site", F.explode(F.arrays_zip(F.col("l.hex").alias("hex"), _leaders("l.hex").alias("leader"))).alias("x")).select("site", "x.hex", "x.leader")
    return top.join(leaders, ["site", "hex"])


@arrow("array<string>")
def _leaders(lists: pd.Series) -> pd.Series:
    out = []
    for hexes in lists:
        leads: list[tuple[str, tuple]] = []
        names = []
        for h in hexes:
            lab = C.lab_of(h)
            near = next((g for g, x in leads if abs(x[0] - lab[0]) < 6 and C.delta_e(x, lab) < MERGE_DELTA), None)
            if near is None:
                leads.append((h, lab))
            names.append(near or h)
        out.append(names)
    return pd.Series(out, dtype=object)


def _strongest_hint(hints: Column) -> Column:
    """The role hinted at most often, the one met first on ties; hints in order of strength of members, then place."""
    def fold(acc: Column, x: Column) -> Column:
        same = F.filter(acc, lambda a: a["hint"] == x["hint"])
        added = F.transform(acc, lambda a: F.struct(a["hint"].alias("hint"), F.when(a["hint"] == x["hint"], a["n"] + x["n"]).otherwise(a["n"]).alias("n")))
        return F.when(F.size(same) > 0, added).otherwise(F.concat(acc, F.array(F.struct(x["hint"].alias("hint"), x["n"].alias("n")))))

    summed = F.aggregate(hints, F.array().cast("array<struct<hint:string,n:bigint>>"), fold)
    most = F.array_max(F.transform(summed, lambda a: a["n"]))
    return F.try_element_at(F.filter(summed, lambda a: a["n"] == most), F.lit(1))["hint"]


def rank_palette(clustered: DataFrame) -> DataFrame:
    """Clusters to a palette: site, rank, hex, role, confidence, area_share, css_variable, evidence (5 at most)."""
    members = F.array_sort(F.collect_list(F.struct("_rank", F.coalesce("hints", F.array().cast("array<struct<at:struct<page_ord:int,css_ord:int,pos:int>,hint:string,n:bigint>>")).alias("hints"), "variable", "evidence")))
    groups = clustered.groupBy("site", F.col("leader").alias("hex")).agg(
        *[F.sum(c).alias(c) for c in ("weight", "brand_weight", "bg_weight", "text_weight", "area")], members.alias("m"), F.first("has_areas").alias("has_areas")
    )
    whole = Window.partitionBy("site")
    groups = groups.withColumn("hint", _strongest_hint(F.flatten(F.transform("m", lambda m: F.array_sort(m["hints"]))))).withColumn("ok", C.oklch("hex"))
    groups = groups.withColumn("neutral", C.is_neutral(F.col("ok"))).withColumn("score", C.css_score(F.col("weight"), F.col("brand_weight"), F.col("hint")))
    share = lambda part: F.when(F.sum(part).over(whole) > 0, F.col(part) / F.sum(part).over(whole)).otherwise(F.lit(0.0))
    groups = groups.withColumn("area_share", share("area")).withColumn("usage_share", share("weight")).withColumn("total_area", F.sum("area").over(whole))
    loud = F.when(F.col("area_share") < NOISE, F.lit(0.0)).otherwise(F.col("area_share"))
    by_kind = Window.partitionBy("site", "neutral")
    groups = groups.withColumn("k", F.row_number().over(by_kind.orderBy(
        F.when(F.col("neutral") | F.col("has_areas"), loud).otherwise(F.lit(0.0)).desc(), F.when(F.col("neutral"), F.lit(0.0)).otherwise(F.col("score")).desc(), F.desc("weight"), "hex"
    )))
    chromatic_role = F.when(F.col("k") == 1, "primary").when(F.col("hint").isin("secondary", "accent"), F.col("hint")).when(F.col("k") == 2, "secondary").when(F.col("k") <= 5, "accent").otherwise("other")
    neutral_role = F.when(F.col("bg_weight") > 2 * F.col("text_weight"), "background").when(F.col("text_weight") > 2 * F.col("bg_weight"), "text").when(F.col("ok.l") >= 0.6, "background").otherwise("text")
    groups = groups.withColumn("role", F.when(F.col("neutral"), neutral_role).otherwise(chromatic_role))
    groups = groups.withColumn("of_role", F.row_number().over(Window.partitionBy("site", "neutral", "role").orderBy("k")))
    kept = groups.filter(F.when(F.col("neutral"), F.col("of_role") <= MAX_NEUTRALS).otherwise(F.col("k") <= MAX_CHROMATIC))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy("neutral", "k"))).filter(F.col("rank") <= MAX_COLOURS)
    evidence = F.slice(F.flatten(F.transform("m", lambda m: F.coalesce(F.transform(m["evidence"], lambda e: F.struct(e["url"].alias("url"), e["snippet"].alias("snippet"), e["context"].alias("context"))), F.array()))), 1, MAX_EVIDENCE)
    return kept.select(
        "site", "rank", "hex", "role",
        C.confidence(F.col("area_share"), F.col("usage_share"), F.col("area") > 0, F.col("weight") > 0).alias("confidence"),
        F.when(F.col("total_area") > 0, F.floor(F.col("area_share") * 1000 + 0.5) / 1000).alias("area_share"),
        F.try_element_at(F.filter(F.col("m.variable"), lambda v: v.isNotNull()), F.lit(1)).alias("css_variable"),
        evidence.alias("evidence"),
    )


def extract_colors(pages: DataFrame, sheets: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """pages(site, page_ord, url, html), sheets and rendered areas to palettes."""
    all_decls = css_declarations(sheets)
    decls = css_declarations(distinct_stylesheets(sheets)).unionByName(inline_style_declarations(pages))
    return rank_palette(cluster(signals(colour_uses(decls, css_variables(all_decls)), areas)))


def near_colours(left: DataFrame, right: DataFrame, within: float = MERGE_DELTA) -> DataFrame:
    """left(site, hex, ...) rows that have a colour of right(site, hex) of the same site within `within`.

    `right` is a site's brand palette, at most ten rows; lightness within 6 is tested first.
    """
    target = right.select(F.col("site").alias("_site"), F.col("hex").alias("_hex"), C.lab("hex").alias("_lab")).distinct()
    probe = left.withColumn("_own", C.lab("hex"))
    near = (F.abs(F.col("_own.l") - F.col("_lab.l")) < 2 * within) & (C.ciede2000(F.col("_own"), F.col("_lab")) < within)
    return probe.join(target, (F.col("site") == F.col("_site")) & near, "left_semi").drop("_own")


def off_palette(left: DataFrame, right: DataFrame, within: float = MERGE_DELTA) -> DataFrame:
    """left rows without such a colour."""
    target = right.select(F.col("site").alias("_site"), F.col("hex").alias("_hex"), C.lab("hex").alias("_lab")).distinct()
    probe = left.withColumn("_own", C.lab("hex"))
    near = (F.abs(F.col("_own.l") - F.col("_lab.l")) < 2 * within) & (C.ciede2000(F.col("_own"), F.col("_lab")) < within)
    return probe.join(target, (F.col("site") == F.col("_site")) & near, "left_anti").drop("_own")


def brand_pair(palette: DataFrame) -> DataFrame:
    """site, primary, secondary for display, with fallbacks; the stand-in for a missing secondary is the first other colour that is no surface."""
    first = lambda test: F.min_by("hex", F.when(test, F.col("rank")))
    lead = palette.groupBy("site").agg(first(F.col("role") == "primary").alias("p"), F.min_by("hex", "rank").alias("f"))
    lead = lead.select("site", C.safe_hex(F.coalesce("p", "f"), "#4338ca").alias("primary"))
    other = (F.lower("hex") != F.col("primary")) & ~F.col("role").isin("background", "text")
    got = palette.join(lead, "site").groupBy("site", "primary").agg(first(F.col("role") == "secondary").alias("s"), first(other).alias("o"))
    return got.select("site", "primary", C.safe_hex(F.coalesce("s", "o"), "#1e293b").alias("secondary"))
