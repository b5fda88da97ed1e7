import colorsys
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brandloom.functions import color as C, css, fonts as N, geo as G, text as T, url as U
from brandloom.functions.html import parse_page

# One colour in every notation, each worked out from the channels 18, 128, 96.
FOREST = [
    "#128060", "#128060ff", "#128060F2", "rgb(18,128,96)", "rgb(18 128 96 / 95%)", "RGB(18 128 96)", "rgba(18, 128, 96, .95)",
    "hsl(162.545deg 75.342% 28.627%)", "hsl(162.545, 75.342%, 28.627%)", "hwb(162.545 7.059% 49.804%)",
]
# Half-transparent, inherited and unknown values are no colours.
NO_COLOURS = ["rgb(18 128 96 / 45%)", "rgba(18,128,96,.2)", "#12806033", "TRANSPARENT", "currentcolor", "unset", "dotted", "", "#12806", "rgb(1,2)"]


@pytest.mark.parametrize("text", FOREST)
def test_notations_of_one_colour(text):
    assert css.parse_colour(text) == "#128060"


@pytest.mark.parametrize("text", NO_COLOURS)
def test_what_is_no_colour(text):
    assert css.parse_colour(text) is None


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 255), st.integers(0, 255), st.integers(0, 255))
def test_channels_round_trip(r, g, b):
    want = f"#{r:02x}{g:02x}{b:02x}"
    assert css.parse_colour(f"rgb({r} {g} {b})") == css.parse_colour(want.upper()) == css.parse_colour(f"color(srgb {r / 255} {g / 255} {b / 255})") == want
    h, light, s = colorsys.rgb_to_hls(r / 255, g / 255, b / 255)
    assert css.parse_colour(f"hsl({h * 360:.6f} {s * 100:.6f}% {light * 100:.6f}%)") == want
    white, black = min(r, g, b) / 255, 1 - max(r, g, b) / 255
    assert css.parse_colour(f"hwb({h * 360:.6f} {white * 100:.6f}% {black * 100:.6f}%)") == want
    digit = f"{r % 16:x}{g % 16:x}{b % 16:x}"
    assert css.parse_colour("#" + digit) == css.parse_colour("#" + digit + "f") == "#" + "".join(c * 2 for c in digit)


def test_named_and_perceptual_colours():
    assert [css.parse_colour(n) for n in ("seagreen", "Crimson", "WHITE")] == ["#2e8b57", "#dc143c", "#ffffff"]
    assert css.parse_colour("oklch(0.7 0.1 30)") == css.parse_colour("oklch(70% 0.1 30deg)") == css.parse_colour(f"oklab(0.7 {0.1 * math.cos(math.radians(30))} {0.1 * math.sin(math.radians(30))})")
    assert css.parse_colour("lab(60% 20 -30)") == css.parse_colour(f"lch(60% {math.hypot(20, 30)} {math.degrees(math.atan2(-30, 20)) % 360})")
    assert css.parse_colour("lab(100% 0 0)") == "#ffffff" and css.parse_colour("oklch(0 0 0)") == "#000000"


def test_colours_of_values():
    assert css.colours("hsl(162.545 75.342% 28.627% / var(--fade))") == ["#128060"]
    assert css.colours("fixed url(tile.svg) repeat-x seagreen") == ["#2e8b57"]
    assert css.colours("conic-gradient(from 10deg, crimson 5%, #128060 40%, crimson)") == ["#dc143c", "#128060", "#dc143c"] or css.colours("conic-gradient(from 10deg, crimson 5%, #128060 40%, crimson)") == ["#dc143c", "#128060"]
    known = css.Variables({"--base": "seagreen", "--loop": "var(--loop, red)", "--gone": "var(--nowhere)"})
    assert css.colours("1px solid var(--base)", known) == ["#2e8b57"]
    assert css.colours("var(--loop)", known) == ["#ff0000"]
    assert css.colours("var(--gone)", known) == []


def test_declarations():
    sheet = "@media x{.a , .b{color:red;background:url(data:a;b)} /* c;{ */ p{--x: '}' }} .z{fill:blue"
    assert list(css.declarations(sheet)) == [(".a , .b", "color", "red"), (".a , .b", "background", "url(data:a;b)"), ("p", "--x", "'}'"), (".z", "fill", "blue")]


def test_markup_in_linear_time():
    import time

    def took(n):
        t = time.perf_counter()
        parse_page("<div><p>" * n, "https://a.com/")
        list(css.declarations("a{b:" * n))
        return time.perf_counter() - t

    small = max(took(2000), 0.02)
    assert took(8000) <= 12 * small


def _one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**24 - 1), st.integers(0, 2**24 - 1))
def test_contrast(spark, a, b):
    """Ratios by the published formula, symmetric, from 1 to 21; whatever is repaired can be read."""

    def luminance(v):
        channels = [((v >> k) & 255) / 255 for k in (16, 8, 0)]
        return sum(w * (c / 12.92 if c <= 0.03928 else ((c + 0.055) / 1.055) ** 2.4) for w, c in zip((0.2126, 0.7152, 0.0722), channels))

    x, y = (F.lit(f"#{v:06x}") for v in (a, b))
    ratio, back, text, safe = _one(spark, C.contrast_ratio(x, y), C.contrast_ratio(y, x), C.readable_text_on(x), C.ensure_contrast(x, F.lit("#ffffff")))
    low, high = sorted((luminance(a), luminance(b)))
    assert ratio == back == pytest.approx((high + 0.05) / (low + 0.05)) and 1 <= ratio <= 21
    other = "#ffffff" if text == "#0f172a" else "#0f172a"
    assert luminance(int(text[1:], 16)) is not None and _one(spark, C.contrast_ratio(x, F.lit(text)) >= C.contrast_ratio(x, F.lit(other)))[0]
    assert _one(spark, C.contrast_ratio(F.lit(safe), F.lit("#ffffff")))[0] >= 4.5 and (safe == f"#{a:06x}") == (_one(spark, C.contrast_ratio(x, F.lit("#ffffff")))[0] >= 4.5)


def test_safe_hex(spark):
    assert _one(spark, C.safe_hex(F.lit("#F0d"), "#000000"), C.safe_hex(F.lit("teal"), "#0a0b0c"), C.safe_hex(F.lit(None).cast("string"), "#0a0b0c")) == ("#ff00dd", "#0a0b0c", "#0a0b0c")


# Published test pairs of the CIEDE2000 formula.
@pytest.mark.parametrize(("p", "q", "expected"), [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425), ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.6940), (23.0331, 14.9730, -42.5619), 2.0373), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
])
def test_ciede2000(spark, p, q, expected):
    as_struct = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, "lab")])
    assert C.delta_e(p, q) == pytest.approx(expected, abs=1e-4)
    assert _one(spark, C.ciede2000(as_struct(p), as_struct(q)))[0] == pytest.approx(expected, abs=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**24 - 1), st.integers(0, 2**24 - 1))
def test_difference_is_a_symmetric_distance(a, b):
    x, y = (C.lab_of(f"#{v:06x}") for v in (a, b))
    assert C.delta_e(x, x) == pytest.approx(0, abs=1e-6)
    assert C.delta_e(x, y) == pytest.approx(C.delta_e(y, x), abs=1e-6)


@pytest.mark.parametrize("bad", ["", "ftp://a.com", "http://user:pw@a.com", "http://a.com:8080", "http://localhost", "http://127.0.0.1", "http://0x7f.1", "http://2130706433", "http://printer", "http://x.local", "http://[::1]/", "http://10.1.2.3"])
def test_blocked_urls(bad):
    assert U.url_error(bad)


@pytest.mark.parametrize("good", ["example.com", "https://Example.com/a", "http://8.8.8.8", "http://a.com:80", "https://[2606:4700::1111]/"])
def test_allowed_urls(good):
    assert U.url_error(good) is None


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("192.168.0.1", False), ("100.64.0.1", False), ("198.18.0.1", False), ("::1", False), ("::ffff:8.8.8.8", True), ("::ffff:10.0.0.1", False), ("2002::1", False), ("64:ff9b::808:808", False), ("2606:4700::1111", True), ("fe80::1%eth0", False), ("1.2.3", False)])
def test_public_addresses(address, public):
    assert U.is_public_address(address) is public


@settings(max_examples=50, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,5}\.com(:80|:443)?(/[a-z.]{1,4}){0,3}/?(\?[a-z]{1,3})?", fullmatch=True))
def test_normalising_twice_changes_nothing(url):
    assert U.normalised(U.normalised(url)) == U.normalised(url)


def test_url_columns(spark):
    got = _one(spark, U.normalise_url(F.lit("HTTP://WWW.A.com:80/x/?q=1#f")), U.site(F.lit("https://www.A.com/x")), U.same_site(F.lit("https://a.com"), F.lit("http://www.a.com")), U.same_site(F.lit("http://a.com:6379"), F.lit("https://a.com")), U.is_priority_path(F.lit("/about/team")), U.is_priority_path(F.lit("/x")))
    assert got == ("https://www.a.com/x?q=1", "a.com", True, False, True, False)


def test_font_columns(spark):
    assert _one(spark, *[N.normalise_key(F.lit(n)) for n in ("bebas-neue", "Bebas Neue", "BebasNeue")]) == ("bebasneue",) * 3
    assert _one(spark, *[N.clean_name(F.lit(n)) for n in ("BRAND-DISPLAY", "open-sans", "'Inter'", "lower")]) == ("Brand Display", "Open Sans", "Inter", "lower")
    assert _one(spark, N.names_match(F.lit("Söhne Var"), F.lit("sohne")), N.names_match(F.lit("Lato"), F.lit("Latin"))) == (True, False)


def test_addresses(spark):
    cases = {
        "27 Quarry Lane, Stowe, VT 05672": "27 Quarry Lane, Stowe VT, 05672",
        "914 W Harbor Blvd #12 Duluth MN 55802": "914 W Harbor Blvd #12, Duluth MN, 55802",
        "914 W Harbor Blvd Suite 12B, Duluth, MN, 55802-1234": "914 W Harbor Blvd #12B, Duluth MN, 55802-1234",
        "63 Orchard TerraceSalem OR97301": "63 Orchard Terrace, Salem OR, 97301",
        "5 St Johns Way, Coeur d'Alene ID 83814": "5 St Johns Way, Coeur d'Alene ID, 83814",
        "  8  Mill   Road ,  Bend   OR  97701 ": "8 Mill Road, Bend OR, 97701",
        "Duluth, MN 55802": None, "27 Quarry Lane": None, "27 Quarry Lane, Stowe": None, "Call us: 27 Quarry Lane, Stowe, VT 05672": None, "": None, "x" * 300: None,
    }
    assert dict(zip(cases, _one(spark, *[G.clean_address(F.lit(r)) for r in cases]))) == cases
    partial = {"Duluth, MN 55802": True, "27 Quarry Lane, Stowe, VT 05672": False, "somewhere": True}
    assert dict(zip(partial, _one(spark, *[G.is_partial(F.lit(r)) for r in partial]))) == partial
    assert _one(spark, *[G.is_valid_address(F.lit(r)) for r in ("27 Quarry Lane", "#aabbccdd", "var(--x)", "1234567890123")]) == (True, False, False, False)
    assert _one(spark, G.phones(F.lit("ring 218.555.0142, or 1234, or 555-12")))[0] == ["218.555.0142"]


def test_text_columns(spark):
    assert _one(spark, T.collapse(F.lit(" a   b\n")), T.client_ip(F.lit("1.1.1.1, 2.2.2.2"), F.lit(None).cast("string")), T.client_ip(F.lit(None).cast("string"), F.lit(" 3.3.3.3 "))) == ("a b", "2.2.2.2", "3.3.3.3")
    assert _one(spark, T.slug(F.lit("My Shop.co"), F.to_timestamp(F.lit("2024-03-05")), F.lit("ab")))[0] == "my-shop-2024-03-ab"


def test_long_and_deep_pages_are_read_whole():
    late = "<style>a{}</style><nav><a href='/x'>Late</a></nav><h2>End</h2><button>Buy</button><footer>Foot</footer><script>var hidden</script>"
    for page in ("<i></i>" * 100_500 + late, "<div>" * 3000 + late, "<nav>" + "<div>" * 3000 + "<a href='/x'>Late</a></nav>" + late):
        got = parse_page(f"<body>{page}</body>", "https://a.com/")
        assert got["headings"] == [{"level": 2, "text": "End"}] and got["cta_buttons"] == ["Buy"] and got["footer"] == "Foot"
        assert got["inline_css"] == ["a{}"] and got["links"] == ["https://a.com/x"] and set(got["nav_labels"]) == {"Late"} and "hidden" not in got["visible_text"]
    assert parse_page("<header>" + "<i></i>" * 100_500 + "<img src='/logo.png'></header>", "https://a.com/")["marks"] == []


def test_batches_are_taken_in_parts(spark):
    """Arrow functions see a bounded part of a batch at a time, and rows keep their order."""
    import pandas as pd
    from pyspark.sql import functions as F

    from brandloom.functions import udf

    @udf.arrow("struct<rows:int,text:string>")
    def seen(text: pd.Series, other: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(text)] * len(text), "text": [f"{t}{o}" for t, o in zip(text, other)]})

    rows = spark.range(0, 3000, 1, 1).select(F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), 10)).alias("t"), "id")
    got = rows.select("t", "id", seen("t", "id").alias("s")).collect()
    assert len(got) == 3000 and max(r.s.rows for r in got) <= udf.PART_ROWS and all(r.s.text == f"{r.t}{r.id}" for r in got)
    long = pd.Series(["x" * udf.PART_SIZE, "y", None, "z" * udf.PART_SIZE, "w"])
    assert [len(p) for p, in udf.parts([long])] == [1, 2, 1, 1] and [len(p) for p, in udf.parts([long[:0]])] == [0]
