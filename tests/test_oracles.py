import os

import pytest

from brandloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = ("pages", "part", "lineitem", "orders", "events", "customer")
CHECKED = (
    "parsed_pages", "page_texts", "seo_report", "location_signals", "marketing_elements", "brand_names", "consistency_scores", "contact_phones",
    "css_exports", "google_font_links", "edited_colours", "font_names", "live_jobs", "robots_allowed",
    "text_styles", "scanned_fonts", "schema_nodes", "page_schemas", "site_schema_types", "crawl_visits", "painted_areas", "area_signals", "robots_cache", "robots_cache_stream", "quota_admission_stream",
    "section_states", "visible_sections", "wide_colours", "file_slugs", "report_reads", "analysis_status", "site_palettes", "ranked_fonts", "social_profiles", "footer_phones", "distinct_addresses",
    "merged_links", "graded_sites", "evaluation_totals", "property_kinds", "google_font_urls", "page_meta", "marketing_buttons", "cta_patterns", "header_logos", "site_summaries", "font_labels", "hex_forms",
    "report_slugs", "priority_pages", "robots_rules", "robots_sitemaps", "sitemap_pages", "inline_styles", "stylesheet_sets", "url_checks",
)


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
def test_queries_give_the_rows_of_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name in CHECKED:
        rel = con.sql(registry.ORACLES[name])
        want = sorted((tuple(map(_plain, row)) for row in rel.fetchall()), key=str)
        got = sorted((tuple(_plain(r[c]) for c in rel.columns) for r in registry.QUERIES[name](spark, FOLDER).collect()), key=str)
        assert got == want and got, name
