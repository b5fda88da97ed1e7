"""What plans must not hold: work that grows faster than the rows, or that is done again for each use."""

import pandas as pd
from pyspark.sql import functions as F

from brandloom.functions import color as C, udf, unicode as N
from brandloom.llm import sampled_segmentation
from brandloom.operators import cascade, colors, pages as P, structured, typography
from brandloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
COMPUTED = "site string, page_ord int, url string, computed map<string,struct<family:string,weight:string>>, loaded array<string>, google array<string>, variables map<string,string>, sources array<struct<type:string,url:string,fonts:array<string>>>"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_page_carries_the_fonts_of_its_site(spark):
    pages = spark.createDataFrame([("mill.example", i, "u", {"body": (f"'Sans {i}', serif", None)}, None, [f"Sans {i}", "Mono"], None, [("google", f"https://fonts.googleapis.com/css?family=Sans+{i}", None)]) for i in range(1, 40)], COMPUTED)
    entries = typography.from_computed(pages)
    assert "collect_list" not in _plan(entries)
    # a stack's font is the first listed one that stands within it, by page and place
    got = {r.name: (r.ord, r.google_url, r.context) for r in entries.collect()}
    assert set(got) == {f"Sans {i}" for i in range(1, 10)} | {f"Sans {i // 10}" for i in range(10, 40)}
    assert got["Sans 1"] == (11, "https://fonts.googleapis.com/css?family=Sans+1", "Source: Google Fonts")


def test_a_colour_is_read_once_for_its_twenty_steps(spark):
    rows = spark.createDataFrame([("#777777",)], "c string")
    assert _plan(rows.select(C.ensure_contrast("c", F.lit("#ffffff")))).count("conv(") <= 60
    assert rows.select(C.ensure_contrast("c", F.lit("#ffffff")).alias("s"), C.ensure_contrast("c", F.lit(None).cast("string")).alias("n")).first()[:] == ("#727273", "#ffffff")


def test_names_are_decomposed_once(spark):
    once = _plan(spark.createDataFrame([("x",)], "t string").select(N.nfkd(F.col("t")))).count("translate(")
    assert _plan(registry.QUERIES["file_slugs"](spark, FOLDER)).count("translate(") <= once


def test_blocks_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([("mill.example", 1, ['{"@type": "Store", "address": {"@type": "PostalAddress"}}', "5"])], "site string, page_ord int, schema_blocks array<string>").mapInArrow(counted, "site string, page_ord int, schema_blocks array<string>")
    assert sorted(r.path for r in structured.schema_nodes(structured.schema_blocks(pages)).collect()) == ["$", "$.address"] and read.value == 1


def test_markup_is_read_once(spark):
    # by a filter of what was read
    pages = P.parse_pages(spark.createDataFrame([("https://mill.example/", "<button>Buy rye</button>")], "url string, html string"))
    buttons = pages.select("site", F.explode("cta_buttons").alias("b"))
    assert buttons.first()[:] == ("mill.example", "Buy rye") and _plan(buttons).count("ArrowEvalPython") == 1
    # and by reports with several parts
    for name in ("seo_report", "logos", "marketing_elements", "location_signals", "geo_report", "site_addresses", "cta_patterns", "header_logos", "marketing_buttons", "site_summaries"):
        assert _plan(registry.QUERIES[name](spark, FOLDER)).count("ArrowEvalPython") <= 1, name


def test_only_what_is_read_of_a_page_leaves_python(spark):
    rows = spark.createDataFrame([("https://mill.example/", "<h1>Rye</h1><button>Buy rye</button>")], "url string, html string")
    pages = P.parse_pages(rows, columns=("headings", "cta_buttons"))
    assert pages.columns == ["site", "page_ord", "url", "html", "headings", "cta_buttons"]
    assert pages.drop("html").first()[:] == P.parse_pages(rows).select("site", "page_ord", "url", "headings", "cta_buttons").first()[:]
    for name in ("site_tones", "analysis_copy", "cta_patterns"):
        made = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toJSON()
        assert "cta_buttons" in made and "visible_text" not in made, name


def test_a_report_reads_style_sheets_once(spark):
    plan = _plan(registry.QUERIES["consistency_scores"](spark, FOLDER))
    # colours, fonts, and the names of brand fonts; not the sheets again for each of them
    assert plan.count("ArrowEvalPython") <= 5


def test_only_declarations_with_variables_carry_them(spark):
    css = [("rye.example", 1, "u", 0, "body{--ink:#112233;--paper:var(--ink);color:var(--paper);background:#445566;font-family:VAR(--ink)} p{font:16px var(--ink)!important}")]
    decls = P.css_declarations(spark.createDataFrame(css, "site string, page_ord int, page_url string, css_ord int, css string"))
    rows = decls.join(P.css_variables(decls), "site").select("value", colors.variables_of("value").alias("v"))
    assert {r.value: r.v is not None for r in rows.collect()} == {"#112233": False, "var(--ink)": True, "var(--paper)": True, "#445566": False, "VAR(--ink)": False, "16px var(--ink)!important": True}
    assert {r.hex for r in colors.colour_uses(decls, P.css_variables(decls)).collect()} == {"#112233", "#445566"}


def test_trees_are_made_of_less_markup_at_a_time(spark):
    @udf.arrow("array<int>", size=cascade.TREE_SIZE)
    def held(html: pd.Series) -> pd.Series:
        return pd.Series([[len(html), int(html.str.len().sum())]] * len(html))

    pages = spark.createDataFrame([("x" * n,) for n in [9_000] * 20 + [90_000, 10]], "html string").coalesce(1)
    got = [tuple(r.h) for r in pages.select(held("html").alias("h")).collect()]
    assert got == [(7, 63_000)] * 14 + [(6, 54_000)] * 6 + [(1, 90_000), (1, 10)]


def test_samples_do_not_depend_on_the_workers_memory(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} and their pieces " * 3) for i in range(40)], "doc_id long, text string")
    drawn = lambda **bounds: sorted((r.doc_id, r.sample, r.ids, round(r.log_prob, 6)) for r in sampled_segmentation.sample_segmentations(docs, tell_copies=True, **bounds).collect())
    assert drawn(arena_nodes=50, batch_chars=200) == drawn()
