from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brandloom.functions import css as _css
from brandloom.operators import colors, consistency, contact, crawl, evaluation, exports, identity, marketing, merge, pages as P, seo, typography
from brandloom.plans import fixtures as X
from brandloom.streaming import state

VISIT = """<!doctype html><title>Find our bakery</title><meta name=twitter:creator content=@larkfield>
<script type='application/ld+json'>[{"@type": ["Thing", "FoodEstablishment"], "address": {"streetAddress": "27 Quarry Lane", "addressLocality": "Stowe", "addressRegion": "VT", "postalCode": "05672"}}, {bad json}]</script>
<script type="application/ld+json">{"@type": "LocalBusiness", "address": {"streetAddress": "63 Orchard Ter", "addressLocality": "Salem", "addressRegion": "OR", "postalCode": "97301"}}</script>
<header><nav><a href=/bread>Bread</a></nav></header><main><h1>Visit us</h1><h2>Today</h2>
<p>The mill shop is at 914 W Harbor Boulevard #12, Duluth, MN 55802, open daily; ring 218.555.0142.</p>
<p>Stay informed about new loaves, or get our free checklist. Award-winning rye since 1988.</p>
<input type=submit value="Order now"><a class="btn" href="/tour">See how we bake</a><a href="//goo.gl/maps/xyz">map</a></main>
<footer>Larkfield, 27 Quarry Lane, Stowe, VT 05672
<a href="https://instagram.com/larkfield.bread/">photos</a> <a href="https://fb.com/larkfield">friends</a> <a href="http://youtube.com/@larkfield">films</a>
<a href="https://twitter.com/intent/tweet?text=rye">tell</a> <a href="https://linkedin.com/in/the-baker">baker</a></footer>"""


@pytest.fixture(scope="module")
def visit_page(spark):
    return P.parse_pages(spark.createDataFrame([("https://larkfield.example/about/contact", VISIT)], "url string, html string")).cache()


def test_locations(spark, visit_page):
    geo = contact.geo_report(visit_page).first()
    assert sorted(geo.addresses) == ["27 Quarry Lane, Stowe VT, 05672", "63 Orchard Ter, Salem OR, 97301", "914 W Harbor Boulevard #12, Duluth MN, 55802"]
    assert "218.555.0142" in geo.phones and geo.has_maps and geo.has_local_schema and geo.source == "extracted"
    assert geo.confidence == min(100, 30 + 20 + 25 + 10 + 15 + (10 if geo.is_multi_location else 0))


def test_profiles_of_a_page(spark, visit_page):
    social = contact.social_links(contact.page_social_links(visit_page)).orderBy("rank").collect()
    assert [(r.platform, r.handle, r.confidence) for r in social] == [("twitter", "@larkfield", 90), ("instagram", "@larkfield.bread", 85), ("youtube", "larkfield", 85), ("facebook", "larkfield", 85)]


def test_marketing(spark, visit_page):
    found = {(r.type, r.content.lower()) for r in marketing.marketing_elements(visit_page).collect()}
    assert found >= {("cta", "order now"), ("cta", "see how we bake"), ("trust_badge", "award-winning")}
    assert {t for t, _ in found} >= {"email_capture", "lead_magnet"}


def test_seo_report(spark, visit_page):
    """Every point that the page lacks costs what the rules say."""
    full = seo.seo_report(visit_page).first()
    plain = seo.seo_report(visit_page.withColumn("schema_data", F.array().cast("array<string>"))).first()
    heads = lambda notes: {n.headline for n in notes}
    gained = heads(full.wins) - heads(plain.wins)
    missed = heads(plain.issues) - heads(full.issues)
    assert gained and missed and plain.score < full.score
    assert any("LocalBusiness" in m for m in missed)


def test_social_fixture(spark):
    rows = contact.social_links(spark.createDataFrame(X.LINKS, "site string, page_ord int, page_url string, pos int, context string, href string")).collect()
    by: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        by.setdefault(r.site, []).append((r.platform, r.handle, r.n_pages))
    # a handle like the host beats one that a page more links to; two forms of one profile count together; sharing and personal links and pages below a profile never count
    assert by == {
        "kiln.studio": [("instagram", "@kilnstudio", 2), ("facebook", "kiln.studio", 2)], "peat.farm": [("twitter", "@peatfarm", 1), ("youtube", "UC77peat", 1)],
        "quay.shop": [("tiktok", "@quay.shop", 1)],
    }


def _palette(spark, css, areas=None, html=""):
    sheets = spark.createDataFrame([("s.com", 1, "https://s.com/", 0, css)], "site string, page_ord int, page_url string, css_ord int, css string")
    pages = spark.createDataFrame([("s.com", 1, "https://s.com/", html)], "site string, page_ord int, url string, html string")
    a = spark.createDataFrame([("s.com", "https://s.com/", h, px) for h, px in areas.items()], "site string, page_url string, hex string, px long") if areas else None
    return colors.extract_colors(pages, sheets, a).orderBy("rank").collect()


def test_what_makes_a_palette(spark):
    got = _palette(spark, "html{--ink:#1b1b1f} main{--lead:oklch(0.6 0.18 40)} .hero a.button{background:var(--lead)} .hero a.button:focus{background:var(--lead)} h2{color:var(--ink)}")
    assert got[0].role == "primary" and got[0].css_variable == "--lead" and {r.hex: r.role for r in got}["#1b1b1f"] == "text"
    # many small rules lead until it is known what covers the page
    rules = "".join(f"ul.tags li.t{k}, ol li.t{k}{{color:#8a1c7c}}" for k in range(24)) + "section.banner{background-color:#00796b} html{background-color:#fefefe;color:#202124}"
    assert _palette(spark, rules)[0].hex == "#8a1c7c"
    seen = _palette(spark, rules, {"#fefefe": 700_000, "#00796b": 250_000, "#202124": 40_000, "#8a1c7c": 1_500})
    roles = {r.hex: r.role for r in seen}
    assert seen[0].hex == "#00796b" and roles == {"#00796b": "primary", "#8a1c7c": roles["#8a1c7c"], "#fefefe": "background", "#202124": "text"} and roles["#8a1c7c"] != "primary"
    assert seen[0].area_share == pytest.approx(250 / 991.5, abs=0.03)


def test_greys_and_near_colours(spark):
    greys = _palette(spark, "p{color:#303030} .card{background:#f0f0f1} .rule{border-color:#c8c8ca}")
    assert greys and all(r.role in ("text", "background") for r in greys)
    near = [r for r in _palette(spark, "b{color:#b3541f} i{color:#b3541e} u{background:#b3541e} s{fill:#b4541e}") if r.role not in ("text", "background")]
    assert len(near) == 1 and near[0].hex == "#b3541e"
    many = _palette(spark, "".join(f"nav .tab-{k}{{background-color:#4b3f72}}" for k in range(20)))
    assert len(many) == 1 and 1 <= len(many[0].evidence) <= 5 and many[0].evidence[0].context == "nav .tab-0"
    assert [r.hex for r in _palette(spark, "", html="<p style='border-left: 3px solid hsl(255 29% 35%)'>")] == [_css.parse_colour("hsl(255 29% 35%)")]
    assert _palette(spark, "") == []


def test_logos(spark):
    pages = [
        ("https://drift.example/", "<nav><a href='https://drift.example/' title='Drift start page'><svg viewBox='0 0 9 9'><circle r='4'/></svg></a> <img src='de.gif' alt='Deutsch'></nav><header><a href='/' aria-label='Drift logo'><svg><rect/></svg></a></header>"),
        ("https://photo.example/", "<header><picture><img src='/team-2019-photo.webp' alt='Our people outdoors'></picture></header>"),
        ("https://touch.example/", "<link rel='apple-touch-icon' sizes='152x152' href='img/icon-152.png'><link rel=icon href=/favicon.ico>"),
        ("https://mill.example/", "<header><a href='/'><img id='site-logo' src='img/mill-logo.png' alt='Mill'></a></header><section class='partners'><img src='/p/granite-logo.png' alt='Granite'></section>"),
    ]
    got = {r.site: r for r in identity.logos(P.parse_pages(spark.createDataFrame(pages, "url string, html string"))).collect()}
    assert got["drift.example"].logo_url.startswith("data:image/svg+xml;base64,")
    assert got["photo.example"].logo_url is None
    assert got["touch.example"].logo_url == "https://touch.example/img/icon-152.png"
    assert got["mill.example"].logo_url == "https://mill.example/img/mill-logo.png"
    assert got["touch.example"].confidence < got["drift.example"].confidence


def test_logo_urls(spark):
    page = F.lit("https://www.mill.example/shop/list?x=1")
    want = {
        "../img/m.png": "https://www.mill.example/img/m.png", "m.png?v=2": "https://www.mill.example/shop/m.png?v=2", "//static.example/m.png": "https://static.example/m.png",
        "http://mill.example/m.png": "https://mill.example/m.png", "http://elsewhere.example/m.png": None, "ftp://mill.example/m.png": None, "blob:abc": None, "https://me:pw@mill.example/m.png": None,
    }
    got = spark.range(1).select(*[identity.resolve_logo_url(F.lit(r), page) for r in want]).first()
    assert dict(zip(want, got)) == want


def test_brand_names(spark):
    pages = [
        ("https://larkfield.example/", "<meta property='og:site_name' content='Larkfield Bakers'><title>Bread | Rye</title>"), ("https://kiln.studio/", "<meta name='application-name' content='Kiln'><title>Pots</title>"),
        ("https://drift.example/", "<title>Drift – boats for rent</title>"), ("https://granite.example/", "<title>Stone cut to size | Granite</title>"), ("https://old-mill.example/", "<title>Flour</title>"),
    ]
    got = {r.site: r.brand_name for r in identity.brand_names(P.parse_pages(spark.createDataFrame(pages, "url string, html string"))).collect()}
    assert got == {"larkfield.example": "Larkfield Bakers", "kiln.studio": "Kiln", "drift.example": "Drift", "granite.example": "Granite", "old-mill.example": "Old Mill"}


def test_typography(spark):
    html = '<link rel="stylesheet" href="https://fonts.googleapis.com/css2?family=Karla:wght@300;500&family=Zilla+Slab:wght@600">'
    pages = spark.createDataFrame([("mill.example", 1, "https://mill.example/", html)], "site string, page_ord int, url string, html string")
    css = "h2{font-family:\"MILL-TEXT\", sans-serif} i.fa{font-family:'Font Awesome 6 Free'} td{font-family:Verdana, Arial} q{font-family:var(--nowhere)}"
    sheets = spark.createDataFrame([("mill.example", 1, "https://mill.example/", 0, css)], "site string, page_ord int, page_url string, css_ord int, css string")
    got = [(r.name, r.role) for r in typography.extract_typography(typography.from_css(pages, sheets)).orderBy("rank").collect()]
    assert got == [("Karla", "primary"), ("Zilla Slab", "heading"), ("Mill Text", "secondary")]
    computed = spark.createDataFrame(
        [("kiln.studio", 2, "u", {"h1": ("var(--head)", "700"), "body": ("Figtree", "400"), "button": ("Helvetica", "500"), "nav": ("Sora", "500")}, ["Tiempos"], ["Sora"], {"--head": "Recoleta, serif"}, [("google", "https://fonts.googleapis.com/css2?family=Sora", [])])],
        "site string, page_ord int, url string, computed map<string,struct<family:string,weight:string>>, loaded array<string>, google array<string>, variables map<string,string>, sources array<struct<type:string,url:string,fonts:array<string>>>",
    )
    got = {r.name: r.role for r in typography.final_fonts(typography.from_computed(computed)).collect()}
    assert got == {"Recoleta": "heading", "Figtree": "primary", "Tiempos": "button", "Sora": "accent"}


def test_robots(spark):
    body = "# for all\r\nUSER-AGENT: otherbot\nDisallow: /\n\nUser-Agent: *\nuser-agent: Third\nDisallow: /private   # keep out\nAllow: /private/open\nDisallow: /same\nAllow: /same\nDisallow: /*.zip$\nDisallow: /m*n\nDisallow: /end$\nCrawl-Delay: 3600\nSitemap: maps/all.xml\nSitemap: https://elsewhere.example/s.xml\n"
    rules, maps = crawl.parse_robots(spark.createDataFrame([("mill.example", "https://mill.example/robots.txt", body)], "site string, url string, body string"))
    assert rules.select("delay").first()[0] == 10 and [r.url for r in maps.collect()] == ["https://mill.example/maps/all.xml"]
    # the longest pattern decides, and an allowing one where two are as long
    expected = {"/private": False, "/private/open/x": True, "/same": True, "/f/b.zip": False, "/f/b.zip?v=1": True, "/m/1/n/2": False, "/m/1": True, "/end": False, "/ending": True, "/": True}
    urls = spark.createDataFrame([("mill.example", p) for p in expected], "site string, path string")
    assert {r.path: r.allowed for r in crawl.allowed_urls(urls, rules).collect()} == expected
    own, _ = crawl.parse_robots(spark.createDataFrame([("mill.example", "https://mill.example/robots.txt", "User-agent: *\nDisallow: /all\nUser-agent: Brandloom/1.0\nDisallow: /own")], "site string, url string, body string"))
    assert [r.path for r in own.collect()] == ["/own"]


def test_crawl(spark):
    links = {"": ["/y", "/contact", "https://other.example/"], "/contact": ["/deep"], "/y": [], "/deep": ["/deeper"], "/deeper": []}
    full = lambda p: p if p.startswith("http") else f"https://mill.example{p or '/'}"
    corpus = spark.createDataFrame([(full(a), [full(b) for b in to]) for a, to in links.items()], "url string, links array<string>")
    starts = spark.createDataFrame([("mill.example", full(""))], "site string, url string")
    got = [(r.depth, r.url) for r in crawl.crawl(starts, corpus).orderBy("depth", "ord").collect()]
    assert got == [(0, full("")), (1, full("/contact")), (1, full("/y")), (2, full("/deep"))]


def test_merge_colors(spark):
    """A found primary stays first if it covers much of the page; a verified record leads all the same; equal colours become one."""
    def run(own, third):
        o = spark.createDataFrame([("s", i, h, r, 80, "extracted", a) for i, (h, r, a) in enumerate(own)], merge.COLOURS)
        t = spark.createDataFrame([("s", i, h, r, c, s, None) for i, (h, r, c, s) in enumerate(third)], merge.COLOURS)
        return merge.merge_colors(o, t.drop("area_share")).orderBy("ord").collect()

    teal, rust, plum = "#00796b", "#b3541e", "#8a1c7c"
    got = run([(teal, "primary", 0.4), (plum, "secondary", 0.02)], [(rust, "primary", 70, "third_party")])
    assert (got[0].hex, got[0].role) == (teal, "primary") and [r.role for r in got].count("primary") == 1 and {r.hex for r in got} == {teal, plum, rust}
    assert run([(teal, "primary", 0.4)], [(rust, "primary", 100, "verified")])[0].hex == rust
    got = run([(teal, "primary", None)], [(rust, "primary", 70, "third_party")])
    assert got[0].hex == rust and (got[1].hex, got[1].role) == (teal, "secondary")
    got = run([("#00796c", "primary", 0.15)], [(teal, "primary", 70, "third_party")])
    assert [(r.hex, r.area_share) for r in got] == [(teal, 0.15)]


def test_exports(spark):
    colours = spark.createDataFrame(X.PALETTE, "site string, rank int, hex string, role string, source string, confidence int")
    fonts = spark.createDataFrame(X.FONTS, "site string, rank int, name string, role string, google_url string, variants array<string>, source string, confidence int")
    css = {r.site: r.css for r in exports.css_variables_export(colours, fonts).collect()}["acme.com"]
    assert "--color-accent-2: #ff5996;" in css and "--color-other-2: #123abc;" in css and "red" not in css
    assert "--font-accent-2: 'O\\'Hare \\\\ Sans', sans-serif;" in css
    links = {r.site: r for r in exports.google_fonts(fonts).collect()}
    assert links["acme.com"].share_url == "https://fonts.google.com/share?selection.family=Inter:wght@400;700|Playfair+Display:wght@400;600;700"
    assert links["bolt.io"].css_import == "/* No Google Fonts detected */"


def test_consistency(spark):
    def site(name, pages):
        return [(f"https://{name}/{p}", f"<title>{t}</title><meta name='description' content='{d}'><h1>{h}</h1>") for p, t, d, h in pages]

    five = [(p, f"{p or 'Home'} | Shop", "A wonderful bakery selling fresh bread every morning", f"Fresh bread for everyone {p}") for p in ("", "about", "blog", "bread", "cake")]
    raw = spark.createDataFrame(site("good.com", five) + site("bare.com", [(p, "", "", "") for p in ("", "x", "y")]) + site("one.com", [("", "", "", "")]), "url string, html string")
    parsed = P.parse_pages(raw).cache()
    sheets = parsed.select("site", "page_ord", F.col("url").alias("page_url"), F.lit(0).alias("css_ord"), F.lit("a{color:#635bff;font-family:Inter}").alias("css")).filter("site = 'good.com'")
    palette = spark.createDataFrame([("good.com", 1, "#635bff", "primary")], "site string, rank int, hex string, role string")
    fonts = spark.createDataFrame([("good.com", 1, "Inter", "primary")], "site string, rank int, name string, role string")
    tones = spark.createDataFrame([("good.com", ["Professional"])], "site string, traits array<string>")
    got = {r.site: r for r in consistency.consistency_report(parsed, sheets, palette, fonts, tones).collect()}
    assert got["good.com"].score >= 90 and got["good.com"].grade == "A" and not got["good.com"].insufficient
    assert got["one.com"].score is None and got["one.com"].grade is None and len(got["one.com"].insufficient) == 7
    assert got["bare.com"].score is not None and got["bare.com"].grade is None


def test_fonts_of_evaluation(spark):
    expected = spark.createDataFrame([("a.com", ["#635bff"], ["Sohne"]), ("b.com", ["#000000"], ["X"])], "site string, colors array<string>, fonts array<string>")
    palette = spark.createDataFrame([("a.com", 1, "#645cff"), ("a.com", 3, "#000000")], "site string, rank int, hex string")
    fonts = spark.createDataFrame([("a.com", 1, "Söhne Var")], "site string, rank int, name string")
    logos = spark.createDataFrame([("a.com", "https://a.com/l.svg")], "site string, logo_url string")
    got = evaluation.totals(evaluation.score_brands(expected, palette, fonts, logos, expected.filter("site = 'a.com'"))).first()
    assert (got.n_evaluated, got.total, got.passed) == (1, 1.0, True)


def test_quotas_equal_a_sequential_replay(spark):
    import random

    rng = random.Random(3)
    rows = [(i, datetime(2024, 1, 1 + rng.randrange(2), rng.randrange(24), rng.randrange(60)), rng.choice("abcdef")) for i in range(300)]
    got = {r.id: r.admitted for r in state.admit(spark.createDataFrame(rows, "id long, ts timestamp, key string"), 3, 10).collect()}
    keys, days, expected = {}, {}, {}
    for i, ts, k in sorted(rows, key=lambda r: (r[1], r[0])):
        d = ts.date()
        expected[i] = keys.get((d, k), 0) < 3 and days.get(d, 0) < 10
        if keys.get((d, k), 0) < 3:
            keys[d, k] = keys.get((d, k), 0) + 1
            if expected[i]:
                days[d] = days.get(d, 0) + 1
    assert got == expected


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, 0, i), "k") for i in range(5)] + [(9, datetime(2024, 1, 9), "z")]
    spark.createDataFrame(rows, "id long, ts timestamp, key string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, key string").parquet(str(tmp_path / "in"))
    q = state.daily_usage_stream(stream).writeStream.outputMode("update").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.attempts) for r in spark.table("daily").collect()} == {("k", 5), ("z", 1)}
    q = state.admit_stream(stream).writeStream.outputMode("append").format("memory").queryName("admitted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("admitted").filter("admitted").collect()) == [0, 1, 2, 9]


def test_empty_tables(spark):
    empty = P.parse_pages(spark.createDataFrame([], "url string, html string"))
    nulls = P.parse_pages(spark.createDataFrame([(None, None), ("https://a.com/", None)], "url string, html string"))
    assert empty.count() == 0 and seo.seo_report(empty).count() == 0
    assert contact.geo_report(nulls.filter("site is not null")).count() == 1


def test_order_of_pages(spark):
    """Pages by url within their sites, repeated ones each with a number of their own, null urls as a site of theirs."""
    urls = ["https://a.org/b", "https://a.org/a", "https://www.a.org/a", "https://b.org/", "https://a.org/b", None, None]
    frame = spark.createDataFrame([(u, f"<title>{k}</title>", k) for k, u in enumerate(urls)], "url string, html string, n int")
    got = sorted(((r.site or "", r.page_ord, r.url or "") for r in P.with_order(frame).collect()))
    assert got == [("", 1, ""), ("", 2, ""), ("a.org", 1, "https://a.org/a"), ("a.org", 2, "https://a.org/b"), ("a.org", 3, "https://a.org/b"), ("a.org", 4, "https://www.a.org/a"), ("b.org", 1, "https://b.org/")]
    assert {r.n: r.page_ord for r in P.with_order(frame.filter("url is not null"), F.col("n") * -1).collect()} == {4: 1, 2: 2, 1: 3, 0: 4, 3: 1}
    assert P.with_order(frame, "n").filter("site = 'a.org'").agg(F.max("page_ord")).first()[0] == 4
