"""Painted areas against a pixel-free replay box by box, and places of brand marks."""

import random
from collections import defaultdict

from brandloom.functions.css import parse_colour
from brandloom.operators import areas, cascade

R = random.Random(2)
COLOURS = ["rgb(1, 2, 3)", "rgba(9, 9, 9, 0.49)", "rgba(9, 9, 9, 50%)", "transparent", "rgba(0, 0, 0, 0)", "oklch(0.62 0.21 259)", "color(srgb 1 0 0)", "#fff", "nonsense", "", None]
TAGS = ["div", "BUTTON", "a", "input", "path", "text", "p", "span", "body", "html", "header"]


def _box(page, el):
    pick = lambda: R.choice(COLOURS)
    return (
        "a.org" if page % 2 else "b.org", page, f"https://p/{page}", el, R.uniform(-300, 2200), R.uniform(-300, 2500), R.choice([0.0, -5.0, R.uniform(1, 900)]) if R.random() < 0.2 else R.uniform(1, 900), R.uniform(0, 600),
        R.choice(TAGS), R.choice([None, "button", "banner"]), R.choice([None, "Submit", "text", "button"]), R.choice([None, False, False, True]), R.choice([None, False, True]), pick(), pick(), pick(),
        R.choice([None, 0.0, 12.5, 40.0]), R.choice([0, 0, 5, 400]), [(s, R.choice([0.0, 1.0, 3.5]), R.choice([None, "solid", "none", "hidden", "dotted"]), pick()) for s in R.sample(["top", "right", "bottom", "left"], R.randrange(5))] or None,
    )


def _brute(boxes, vw, vh, most):
    area = defaultdict(float)

    def add(place, colour, px):
        if px > 0 and colour and (hexa := parse_colour(colour)):
            area[(*place, hexa)] += px

    pages = defaultdict(list)
    for b in boxes:
        pages[b[:3]].append(b)
    for place, own in pages.items():
        own.sort(key=lambda b: b[3])
        grounds = [next((b[13] for b in own if b[8].lower() == t), None) for t in ("body", "html")]
        ground = next((g for g in grounds if g and parse_colour(g)), None)
        add(place, ground, vw * vh * 2)
        for _, _, _, _, x, y, w, h, tag, role, kind, hidden, slot, back, ink, fill, fs, n, borders in [b for b in own if b[8].lower() not in ("body", "html")][:most]:
            cw, ch = min(vw, x + w) - max(0, x), min(2 * vh, y + h) - max(0, y)
            if w <= 0 or h <= 0 or hidden or cw <= 0 or ch <= 0:
                continue
            tag, clipped = tag.lower(), cw * ch
            if tag in ("path", "text"):
                add(place, fill, clipped * (2 if slot else 0.15))
                continue
            act = tag == "button" or role == "button" or tag == "input" and (kind or "").lower() in ("submit", "button") or tag == "a" and back is not None and back not in ("rgba(0, 0, 0, 0)", "transparent")
            add(place, back, clipped * (4 if act else 1))
            if n > 0:
                add(place, ink, min(n * (fs or 16) ** 2 * 0.5 * clipped / (w * h), clipped))
            for side, thick, style, colour in borders or ():
                if thick > 0 and style not in ("none", "hidden"):
                    add(place, colour, (cw if side in ("top", "bottom") else ch) * thick)
    return area


def test_areas_equal_brute_force(spark):
    boxes = [_box(page, el) for page in range(6) for el in R.sample(range(500), 60)]
    for screen, most in (((1920, 1080), 4000), ((800, 600), 25)):
        got = {(r.site, r.page_ord, r.page_url, r.hex): r.px for r in areas.painted_areas(spark.createDataFrame(boxes, areas.BOX), screen, most).collect()}
        want = {k: v for k, v in _brute(boxes, *screen, most).items() if v >= 0.5}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.5001 for k in want) and len(got) > 20


def test_no_boxes(spark):
    assert areas.painted_areas(spark.createDataFrame([], areas.BOX)).count() == 0


def test_brand_slots(spark):
    html = '<body><header><b>x</b></header><a href="/"><i>y</i></a><a href="/z">n</a><div class="site-LOGO x"><svg><path/></svg></div><div role="banner"><p>q</p></div><p class="lo go">n</p></body>'
    elements = cascade.page_elements(spark.createDataFrame([("a.org", 1, html)], "site string, page_ord int, html string")).cache()
    marked = {r.el for r in areas.brand_slots(elements).collect()}
    tags = [(r.tag, r.el in marked) for r in elements.orderBy("el").collect()]
    assert tags == [("body", False), ("header", True), ("b", True), ("a", True), ("i", True), ("a", False), ("div", True), ("svg", True), ("path", True), ("div", True), ("p", True), ("p", False)]


def test_boxes_of_one_number(spark):
    """Where numbers tie at the bound or at the root, the result does not depend on how rows lie."""
    boxes = [("a.org", 1, "u", 1, 0.0, 0.0, 10.0 + k, 10.0, "div", None, None, None, None, f"#0000{k:02x}", None, None, None, 0, None) for k in range(40)]
    boxes += [("a.org", 1, "u", 0, 0.0, 0.0, 1.0, 1.0, "body", None, None, None, None, back, None, None, None, 0, None) for back in ("transparent", "#123456", "nonsense")]
    results = [{(r.hex, r.px) for r in areas.painted_areas(spark.createDataFrame(own, areas.BOX).coalesce(1), (100, 100), 5).collect()} for own in (boxes, boxes[::-1], boxes[20:] + boxes[:20])]
    assert results[0] == results[1] == results[2] and len(results[0]) == 6 and ("#123456", 20_000) in results[0]
