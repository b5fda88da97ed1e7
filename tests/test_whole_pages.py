"""Pages are read to their end, however long they are."""

from brandloom.functions.html import parse_page
from brandloom.operators import contact, pages as P, seo
from brandloom.plans import registry

LONG = "plain words of a long page " * 8_000  # 216,000 characters


def test_texts_and_links_are_kept_whole():
    marks = "".join(f'<img src="/{k}.png" alt="a picture of bread">' for k in range(3_000))
    links = "".join(f'<a href="/p{k}">x</a>' for k in range(5_500)) + f'<a href="/{"q" * 3_000}">x</a>' + f'<a href="data:text/plain,{"find" * 1_000}">x</a>'
    shops = ", ".join(f'{{"address": "{k} Quarry Lane"}}' for k in range(250))
    html = f'<body><script type="application/ld+json">{{"@graph": [{shops}]}}</script><p>{LONG}the end</p>{marks}<b title="last">y</b>{links}<footer>{LONG}foot</footer></body>'
    page = parse_page(html, "https://mill.example/")
    assert page["visible_text"].startswith("plain words") and "page the end" in page["visible_text"] and page["visible_text"].endswith("page foot")
    assert page["footer"].endswith("page foot") and page["attribute_text"].endswith("bread last") and len(page["address_blocks"]) == 250
    # a data: URL of that size is content, not an address
    assert len(page["links"]) == len(page["anchor_hrefs"]) == len(page["all_hrefs"]) == 5_501


def test_the_end_of_a_text_is_a_row_of_its_query(spark, tmp_path):
    spark.createDataFrame([(1, "https://mill.example/", f"<body><p>{LONG}the end</p></body>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = registry.QUERIES["page_texts"](spark, str(tmp_path)).first()
    assert row.text == f"{LONG}the end" and registry.QUERIES["parsed_pages"](spark, str(tmp_path)).first().n_text == len(row.text)


def test_locations_are_read_from_whole_texts_and_footers(spark):
    page = f"<body><p>{LONG}The shop is at 27 Quarry Lane, Stowe, VT 05672, open daily; ring 407-555-0123.</p><div class='address'>63 Orchard Terrace Road, Salem, OR, 97301</div></body>"
    rows = [("https://mill.example/contact", page), ("https://rye.example/bread", f"<body><footer>{LONG}Ring 321-555-0199</footer></body>")]
    pages = P.parse_pages(spark.createDataFrame(rows, "url string, html string"))
    found = {r.site: r for r in contact.geo_report(pages).collect()}
    assert found["mill.example"].phones == ["407-555-0123"] and found["rye.example"].phones == ["321-555-0199"]
    # what the text says comes before the blocks, however far in it stands
    assert found["mill.example"].addresses == ["27 Quarry Lane, Stowe VT, 05672", "63 Orchard Terrace Road, Salem OR, 97301"]


def test_seo_reads_whole_texts(spark):
    pages = [("https://mill.example/", f"<title>Mill</title><body><h1>Mill</h1><p>{LONG}Ring 407-555-0123</p></body>"), ("https://rye.example/", f"<title>Rye</title><body><h1>Rye</h1><p>{LONG}</p></body>")]
    report = seo.seo_report(P.parse_pages(spark.createDataFrame(pages, "url string, html string"))).collect()
    assert {r.site: "Missing LocalBusiness schema" in [i.headline for i in r.issues] for r in report} == {"mill.example": True, "rye.example": False}
