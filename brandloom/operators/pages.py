"""Raw pages and stylesheets to typed tables."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import url as U
from ..functions.css import declarations
from ..functions.html import parse_page
from ..functions.udf import arrow
from ..session import small_batches

_PAIR = "struct<src:string,alt:string>"
PARSED = (
    "title string, description string, keywords array<string>, og map<string,string>, twitter map<string,string>, app_name string, logo_meta string, "
    f"headings array<struct<level:int,text:string>>, links array<string>, images array<{_PAIR}>, css_urls array<string>, inline_css array<string>, "
    "nav_labels array<string>, cta_buttons array<string>, footer string, schema_data array<string>, schema_blocks array<string>, address_blocks array<string>, visible_text string, "
    "attribute_text string, anchor_hrefs array<string>, all_hrefs array<string>, icons array<struct<rel:string,href:string,sizes:string>>, "
    "marks array<struct<kind:string,src:string,context:string,name:string,own:string,home_link:boolean,in_chrome:boolean,hidden:boolean>>, parse_error string"
)


def _parser(columns: Sequence[str] | None):
    """The function that reads markup; of PARSED it sends back what `columns` names, and holds no more of a page while it reads the next."""
    kinds = [c.strip() for c in _top_level(PARSED) if columns is None or c.split()[0] in columns]
    names = [k.split(" ")[0] for k in kinds]

    @arrow(", ".join(kinds), once=True)
    def parse(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = []
        for h, u in zip(html, url):
            page = _page(h, u)
            rows.append([page[n] for n in names])
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(names)})

    return parse


def _page(html: str | None, url: str | None) -> dict:
    """A page's columns; markup that cannot be read gives an empty page that says why, not the end of the job."""
    try:
        return parse_page(html, url) | {"parse_error": None}
    except Exception as failure:  # noqa: BLE001
        return parse_page("", url) | {"parse_error": f"{type(failure).__name__}: {failure}"[:500]}


def _top_level(schema: str) -> list[str]:
    out, depth, current = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(current)
            current = ""
        else:
            current += ch
    return [*out, current]


def with_order(pages: DataFrame, by: Column | str | None = None) -> DataFrame:
    """pages + site, page_ord (by `by`, else url).

    A site's pages are counted and ranked by their keys alone; markup only meets rows of its own key, so no task holds a site's markup.
    """
    named = pages.withColumn("site", U.site("url"))
    if "page_ord" in pages.columns:
        return named
    keyed = named.withColumn("_key", F.col(by) if isinstance(by, str) else by if by is not None else F.col("url"))
    counts = keyed.groupBy(F.col("site").alias("_site"), F.col("_key").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_site").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_site", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = keyed.join(starts, F.col("site").eqNullSafe(F.col("_site")) & F.col("_key").eqNullSafe(F.col("_of")))
    repeated = F.row_number().over(Window.partitionBy("site", "_key").orderBy("_start"))
    return joined.withColumn("page_ord", (F.col("_start") + repeated).cast("int")).drop("_key", "_site", "_of", "_start")


def parse_pages(pages: DataFrame, by: Column | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """pages(url, html, optional page_ord) -> site, page_ord, url, html and the columns of PARSED, or those that `columns` names; the markup is read once."""
    small_batches(pages.sparkSession)
    parsed = with_order(pages, by).select("site", "page_ord", "url", "html", _parser(columns)("html", "url").alias("p"))
    return parsed.select("site", "page_ord", "url", "html", "p.*")


def page_stylesheets(parsed: DataFrame, fetched: DataFrame | None = None, external: int = 10) -> DataFrame:
    """site, page_ord, page_url, css_ord, css: inline sheets, then the first external ones that `fetched(url, css)` has."""
    inline = parsed.select("site", "page_ord", F.col("url").alias("page_url"), F.posexplode("inline_css").alias("css_ord", "css"))
    if fetched is None:
        return inline
    wanted = parsed.select("site", "page_ord", F.col("url").alias("page_url"), F.size("inline_css").alias("_n"), F.posexplode(F.slice("css_urls", 1, external)).alias("_i", "_url"))
    outside = wanted.join(fetched.select(F.col("url").alias("_url"), "css"), "_url").select("site", "page_ord", "page_url", (F.col("_n") + F.col("_i")).alias("css_ord"), "css")
    return inline.unionByName(outside)


def bounded_stylesheets(sheets: DataFrame, count: int = 200, size: int = 1 << 20, total: int = 4 << 20) -> DataFrame:
    """At most `count` sheets a page, each cut to `size`, until their running total would pass `total`."""
    by_page = Window.partitionBy("site", "page_url").orderBy("css_ord")
    cut = sheets.withColumn("css", F.substring("css", 1, size)).withColumn("_n", F.row_number().over(by_page)).filter(F.col("_n") <= count)
    run = cut.withColumn("_sum", F.sum(F.length("css")).over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter(F.col("_sum") <= total).drop("_n", "_sum")


def distinct_stylesheets(sheets: DataFrame) -> DataFrame:
    """Each text of a site once, at the first page and place that has it."""
    first = Window.partitionBy("site", F.sha2(F.col("css").cast("binary"), 256)).orderBy("page_ord", "css_ord")
    return sheets.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


@arrow("array<struct<pos:int,selector:string,property:string,value:string>>")
def _declared(css: pd.Series) -> pd.Series:
    return css.map(lambda text: [{"pos": i, "selector": s, "property": p, "value": v} for i, (s, p, v) in enumerate(declarations(text or ""))])


def css_declarations(sheets: DataFrame) -> DataFrame:
    """site, page_ord, page_url, css_ord, pos, selector, property, value."""
    small_batches(sheets.sparkSession)
    rows = sheets.select("site", "page_ord", "page_url", "css_ord", F.explode(_declared("css")).alias("d"))
    return rows.select("site", "page_ord", "page_url", "css_ord", "d.*")


def inline_style_declarations(pages: DataFrame) -> DataFrame:
    """Declarations in style attributes, with selector [style]; after all stylesheets of the site."""
    pattern = r"""(?i)\sstyle\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    bodies = F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(F.regexp_replace(m, r"""(?is)^\sstyle\s*=\s*["'](.*)["']$""", "$1"), "&quot;", '"'))
    parts = F.flatten(F.transform(bodies, lambda b: F.split(F.regexp_replace(b, "&#39;", "'"), ";")))
    rows = pages.select("site", "page_ord", F.col("url").alias("page_url"), F.posexplode(parts).alias("pos", "part")).filter(F.instr("part", ":") > 1)
    at = F.instr("part", ":")
    return rows.select("site", "page_ord", "page_url", F.lit(1_000_000).alias("css_ord"), "pos", F.lit("[style]").alias("selector"), F.lower(F.trim(F.expr("substring(part, 1, instr(part, ':') - 1)"))).alias("property"), F.trim(F.expr("substring(part, instr(part, ':') + 1)")).alias("value")).filter(at.isNotNull())


def css_variables(decls: DataFrame) -> DataFrame:
    """site, variables: the last value of each custom property, over all sheets in order."""
    own = decls.filter(F.col("property").startswith("--") & (F.length("value") < 200))
    last = own.groupBy("site", "property").agg(F.max_by(F.trim(F.regexp_replace("value", "(?i)!important", "")), F.struct("page_ord", "css_ord", "pos")).alias("value"))
    return last.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("variables"))


def color_areas(pages: DataFrame, keep: int = 500) -> DataFrame:
    """pages(site, page_ord, url, color_areas map) -> site, page_ord, page_url, hex, px: valid keys, positive areas, the largest of each page."""
    rows = pages.filter("color_areas is not null").select("site", "page_ord", F.col("url").alias("page_url"), F.explode("color_areas").alias("hex", "px"))
    rows = rows.filter(F.col("hex").rlike("^#[0-9a-f]{6}$") & (F.col("px") > 0)).withColumn("px", F.round("px").cast("long"))
    largest = Window.partitionBy("site", "page_url").orderBy(F.desc("px"), "hex")
    return rows.withColumn("_n", F.row_number().over(largest)).filter(F.col("_n") <= keep).drop("_n")


def snapshot_sheets(sheets: DataFrame, budget: int) -> DataFrame:
    """distinct sheets of a site, those of each page kept in order while they fit into `budget` characters (a larger one is skipped)."""
    firsts = distinct_stylesheets(sheets)
    grouped = firsts.groupBy("site", "page_url").agg(F.array_sort(F.collect_list(F.struct("css_ord", "css"))).alias("s"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<css_ord:int,css:string>>").alias("kept"))

    def fold(acc: Column, x: Column) -> Column:
        fits = acc["used"] + F.length(x["css"]) <= budget
        return F.when(fits, F.struct((acc["used"] + F.length(x["css"])).alias("used"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    kept = grouped.select("site", "page_url", F.aggregate("s", empty, fold)["kept"].alias("kept"))
    return kept.select("site", "page_url", F.explode("kept").alias("k")).select("site", "page_url", "k.css_ord", "k.css")


def trim_html(html: Column, budget: int) -> Column:
    """The head, and the first `budget` characters from the body on."""
    at = F.regexp_instr(html, F.lit(r"(?i)<body[\s>]"))
    head = F.when(at > 0, F.concat(F.substr(html, F.lit(1), at - 1), F.substr(html, at, F.lit(budget)), F.lit("</body></html>"))).otherwise(F.substring(html, 1, budget))
    return F.when(F.length(html) <= budget, html).otherwise(head)
