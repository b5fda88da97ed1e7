"""Reports as CSS, Tailwind, design tokens, font links, Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fonts as N


def role_keys(rows: DataFrame, group: str = "site", order: str = "rank") -> DataFrame:
    """rows + key: 'primary', then 'primary-2', ... in order."""
    n = F.row_number().over(Window.partitionBy(group, "role").orderBy(order))
    return rows.withColumn("key", F.when(n == 1, F.col("role")).otherwise(F.concat_ws("-", "role", n.cast("string"))))


def valid_colors(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("hex").rlike("(?i)^#[0-9a-f]{6}$"))


def css_string(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(F.regexp_replace(text, r"[\u0000-\u001f\u007f]", " "), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def js_string(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), F.regexp_replace(escaped, r"[\u0000-\u001f  ]", " "), F.lit("'"))


def _lines(rows: DataFrame, line: Column, group: str = "site", order: str = "rank", glue: str = "\n") -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["l"]), glue).alias("text"))


def _named_fonts(fonts: DataFrame) -> DataFrame:
    return role_keys(fonts.filter(F.trim("name") != "").withColumn("name", F.trim("name")))


def css_variables_export(colors: DataFrame, fonts: DataFrame) -> DataFrame:
    """site, css: custom properties for colours and fonts."""
    c = _lines(role_keys(valid_colors(colors)), F.concat(F.lit("  --color-"), "key", F.lit(": "), F.lower("hex"), F.lit(";"))).withColumnRenamed("text", "c")
    f = _lines(_named_fonts(fonts), F.concat(F.lit("  --font-"), "key", F.lit(": "), css_string(F.col("name")), F.lit(", "), N.generic_family("name"), F.lit(";"))).withColumnRenamed("text", "f")
    both = c.join(f, "site", "full_outer")
    return both.select("site", F.concat_ws("\n", F.lit(":root {"), "c", F.lit(""), "f", F.lit("}")).alias("css"))


def tailwind_config(colors: DataFrame) -> DataFrame:
    """site, config."""
    body = _lines(role_keys(valid_colors(colors)), F.concat(F.lit("        "), js_string(F.col("key")), F.lit(": '"), F.lower("hex"), F.lit("',")))
    head = "// tailwind.config.js\nmodule.exports = {\n  theme: {\n    extend: {\n      colors: {\n"
    return body.select("site", F.concat(F.lit(head), F.col("text"), F.lit("\n      },\n    },\n  },\n}")).alias("config"))


def coolors_url(colors: DataFrame) -> DataFrame:
    """site, url: the first five valid colours."""
    nth = F.row_number().over(Window.partitionBy("site").orderBy("rank"))
    five = valid_colors(colors).withColumn("_n", nth).filter("_n <= 5")
    return _lines(five, F.lower(F.substring("hex", 2, 6)), glue="-").select("site", F.concat(F.lit("https://coolors.co/"), "text").alias("url"))


def google_fonts(fonts: DataFrame) -> DataFrame:
    """site, share_url, css_import: families served by Google, once each, with three-digit weights."""
    own = fonts.filter((F.coalesce("google_url", F.lit("")) != "") & (F.trim("name") != "")).withColumn("name", F.trim("name"))
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("site", F.lower("name")).orderBy("rank"))).filter("_n = 1")
    weights = F.array_sort(F.array_distinct(F.filter(F.coalesce("variants", F.array().cast("array<string>")), lambda w: w.rlike(r"^\d{3}$"))))
    weights = F.when(F.size(weights) > 0, weights).otherwise(F.array(*[F.lit(w) for w in ("400", "600", "700")]))
    family = F.concat(F.url_encode("name"), F.lit(":wght@"), F.array_join(weights, ";"))
    listed = own.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", family.alias("f")))), lambda x: x["f"]).alias("families"))
    rows = fonts.select("site").distinct().join(listed, "site", "left")
    share = F.concat(F.lit("https://fonts.google.com/share?selection.family="), F.array_join("families", "|"))
    imported = F.concat(F.lit("@import url('https://fonts.googleapis.com/css2?"), F.array_join(F.transform("families", lambda f: F.concat(F.lit("family="), f)), "&"), F.lit("&display=swap');"))
    return rows.select("site", F.coalesce(share, F.lit("")).alias("share_url"), F.coalesce(imported, F.lit("/* No Google Fonts detected */")).alias("css_import"))


def token_name(key: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(key, "[.{}$]", "-"), r"\s+", "-")
    return F.when(name == "", F.lit("token")).otherwise(name)


def design_tokens(colors: DataFrame, fonts: DataFrame, names: DataFrame) -> DataFrame:
    """site, tokens: Design Tokens Community Group JSON; colors and fonts carry source and confidence."""
    brand = names.select("site", F.when(F.trim("brand_name") != "", F.trim("brand_name")).otherwise("Brand").alias("brand"))
    about = lambda kind: F.concat("brand", F.lit(" "), "key", F.lit(f" {kind} ("), "source", F.lit(", "), F.col("confidence").cast("string"), F.lit("% confidence)"))
    entry = lambda kind, value, text: F.struct(token_name(F.col("key")).alias("key"), F.struct(F.lit(kind).alias("$type"), value.alias("$value"), text.alias("$description")).alias("value"))
    ordered = lambda rows, e, name: rows.groupBy("site").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("o"), e.alias("e")))), lambda x: x["e"])).alias(name))
    c = ordered(role_keys(valid_colors(colors)).join(brand, "site"), entry("color", F.lower("hex"), about("color")), "color")
    f = ordered(_named_fonts(fonts).join(brand, "site"), entry("fontFamily", F.array("name", N.generic_family("name")), about("typeface")), "font")
    both = brand.join(c, "site", "left").join(f, "site", "left")
    return both.select("site", F.to_json(F.struct("color", "font"), {"pretty": "true"}).alias("tokens"))


def markdown_report(reports: DataFrame) -> DataFrame:
    """reports(site, brand_name, generated_at, grade, score, description, colors, fonts, traits, links, n_pages) -> site, markdown."""
    health = F.when(F.col("grade").isNotNull(), F.concat(F.lit("**Brand Health Score:** "), "grade", F.lit(" ("), F.col("score").cast("string"), F.lit("/100)"))).otherwise("**Brand Health Score:** Not enough data for a grade")
    rgb = lambda h, i: F.conv(F.substring(h, 2 + 2 * i, 2), 16, 10)
    color_rows = F.transform(F.slice("colors", 1, 6), lambda c: F.concat(F.lit("| "), c["role"], F.lit(" | "), F.upper(c["hex"]), F.lit(" | rgb("), rgb(c["hex"], 0), F.lit(", "), rgb(c["hex"], 1), F.lit(", "), rgb(c["hex"], 2), F.lit(") |")))
    font_rows = F.transform(F.slice("fonts", 1, 4), lambda f: F.concat(F.lit("- **"), f["role"], F.lit(":** "), f["name"], F.when(F.size(f["variants"]) > 0, F.concat(F.lit(" ("), F.array_join(f["variants"], ", "), F.lit(")"))).otherwise("")))
    link_rows = F.transform("links", lambda x: F.concat(F.lit("- **"), x["platform"], F.lit(":** "), x["url"]))
    block = lambda title, rows: F.when(F.size(rows) > 0, F.concat_ws("\n", F.lit(title), F.lit(""), F.array_join(rows, "\n"), F.lit("")))
    table = F.concat(F.array(F.lit("| Role | Hex | RGB |"), F.lit("|------|-----|-----|")), color_rows)
    return reports.select("site", F.concat_ws(
        "\n", F.concat(F.lit("# "), "brand_name", F.lit(" Brand Guideline")), F.lit(""), F.concat(F.lit("**Domain:** "), "site"), F.concat(F.lit("**Generated:** "), F.date_format("generated_at", "yyyy-MM-dd")),
        health, F.lit(""), F.lit("## Brand Summary"), "description", F.lit(""), block("## Color Palette", table), block("## Typography", font_rows),
        F.lit("## Tone & Voice"), F.lit(""), F.concat(F.lit("**Traits:** "), F.array_join("traits", ", ")), F.lit(""), block("## Brand Channels", link_rows),
        F.lit("---"), F.concat(F.lit("*Analyzed "), F.col("n_pages").cast("string"), F.lit(" pages*")),
    ).alias("markdown"))


def json_export(reports: DataFrame) -> DataFrame:
    """site, json: the whole report row."""
    return reports.select("site", F.to_json(F.struct(*reports.columns), {"pretty": "true"}).alias("json"))
