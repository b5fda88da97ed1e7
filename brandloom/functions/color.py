"""Colour functions as Column expressions over '#rrggbb' strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .text import let

INK, PAPER = "#0f172a", "#ffffff"

# How strongly each kind of use counts, and which role a word in a variable's name suggests (first match).
USAGE_WEIGHTS = {
    "text": 1.0, "background": 1.0, "fill": 0.8, "stroke": 0.6, "accent-control": 0.6, "border": 0.4, "outline": 0.3,
    "decoration": 0.3, "shadow": 0.2, "caret": 0.2, "definition": 0.25,
}
ROLE_WORDS = (
    ("primary", "primary"), ("brand", "primary"), ("secondary", "secondary"), ("accent", "accent"), ("highlight", "accent"),
    ("cta", "primary"), ("background", "background"), ("surface", "background"), ("foreground", "text"),
)
BRAND_SELECTOR = r"(?i)header|nav|btn|button|cta|(^|[\s>+~,])a($|[\s:.\[#,>])|link|anchor|logo|brand|hero|banner|primary|accent"
LINK_DEFAULTS = ("#0000ee", "#551a8b", "#ee0000")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_hex(raw: Column | str) -> Column:
    """3 or 6 hex digits, '#' optional -> lower-case '#rrggbb'; anything else null."""
    digits = F.lower(F.regexp_replace(F.trim(_col(raw)), "^#", ""))
    return F.when(digits.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), digits)).when(
        digits.rlike("^[0-9a-f]{3}$"), F.concat(F.lit("#"), F.regexp_replace(digits, "(.)", "$1$1"))
    )


def safe_hex(raw: Column | str, fallback: str) -> Column:
    return F.coalesce(normalise_hex(raw), F.lit(fallback))


def channel(hex_: Column | str, i: int) -> Column:
    """Channel i (0 red, 1 green, 2 blue) as 0 to 255."""
    return F.conv(F.substring(_col(hex_), 2 + 2 * i, 2), 16, 10).cast("int")


def hex_to_rgb(hex_: Column | str) -> Column:
    """struct(r, g, b), null unless '#' and six digits."""
    return F.when(_col(hex_).rlike("(?i)^#[0-9a-f]{6}$"), F.struct(*[channel(hex_, i).alias(n) for i, n in enumerate("rgb")]))


def to_hex(*channels: Column) -> Column:
    """Channels rounded half up and clipped to 0..255."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c)) + 0.5).cast("long"))), 2, "0") for c in channels])


def _linear(s: Column, knee: float) -> Column:
    return F.when(s <= knee, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def _channels(hex_: Column) -> Column:
    return F.array(*[channel(hex_, i) for i in range(3)])


def _glow(rgb: Column) -> Column:
    r, g, b = (_linear(rgb[i] / 255, 0.03928) for i in range(3))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luminance(hex_: Column | str) -> Column:
    """WCAG relative luminance; 0 for no colour."""
    return F.coalesce(let(let(normalise_hex(hex_), _channels), _glow), F.lit(0.0))


def _ratio(x: Column, y: Column) -> Column:
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def contrast_ratio(a: Column | str, b: Column | str) -> Column:
    return let(F.array(luminance(a), luminance(b)), lambda v: _ratio(v[0], v[1]))


def readable_text_on(background: Column | str) -> Column:
    return let(luminance(background), lambda y: F.when(_ratio(luminance(F.lit(PAPER)), y) >= _ratio(luminance(F.lit(INK)), y), F.lit(PAPER)).otherwise(F.lit(INK)))


def ensure_contrast(foreground: Column | str, background: Column | str, least: float = 4.5) -> Column:
    """`foreground`, moved toward white or ink in twentieths until it reads on `background`.

    Channels and luminances are bound once; a step is arithmetic on three numbers, and only the colour that is taken is written again.
    """

    def moved(v: Column) -> Column:
        def mixed(step: Column) -> Column:
            return F.transform(F.arrays_zip(v["own"].alias("a"), v["to"].alias("b")), lambda c: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c["a"] + (c["b"] - c["a"]) * step / 20)) + 0.5).cast("int"))

        reached = F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), mixed), lambda m: _ratio(_glow(m), v["back"]) >= least)
        best = let(F.try_element_at(reached, F.lit(1)), lambda m: F.when(m.isNotNull(), to_hex(*[m[i].cast("double") for i in range(3)])))
        return F.when(v["fg"].isNull() | v["bg"].isNull(), v["target"]).when(_ratio(_glow(v["own"]), v["back"]) >= least, v["fg"]).otherwise(F.coalesce(best, v["target"]))

    given = F.struct(normalise_hex(foreground).alias("fg"), normalise_hex(background).alias("bg"), luminance(background).alias("back"), readable_text_on(background).alias("target"))
    return let(let(given, lambda v: F.struct(v["fg"].alias("fg"), v["bg"].alias("bg"), v["back"].alias("back"), v["target"].alias("target"), _channels(v["fg"]).alias("own"), _channels(v["target"]).alias("to"))), moved)


def _linear_rgb(hex_: Column | str) -> tuple[Column, Column, Column]:
    return tuple(_linear(channel(hex_, i) / 255, 0.04045) for i in range(3))


def _cbrt(x: Column) -> Column:
    return F.cbrt(x)


def _linear_struct(hex_: Column | str) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(_linear_rgb(hex_), "rgb")])


def oklch(hex_: Column | str) -> Column:
    """struct(l, c): OKLCH lightness and chroma."""

    def roots(p: Column) -> Column:
        r, g, b = p["r"], p["g"], p["b"]
        return F.struct(
            _cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b).alias("l"),
            _cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b).alias("m"),
            _cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b).alias("s"),
        )

    def polar(p: Column) -> Column:
        l, m, s = p["l"], p["m"], p["s"]  # noqa: E741
        a = 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s
        b = 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s
        return F.struct((0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s).alias("l"), F.sqrt(a * a + b * b).alias("c"))

    return let(let(_linear_struct(hex_), roots), polar)


def is_neutral(ok: Column) -> Column:
    """Whites, greys, blacks and barely tinted darks, from an oklch() struct."""
    return let(ok, lambda o: (o["c"] < 0.05) | (o["l"] > 0.97) | (o["l"] < 0.12) | ((o["l"] < 0.3) & (o["c"] < 0.08)))


def lab(hex_: Column | str) -> Column:
    """struct(l, a, b): CIE Lab under D65."""

    def curve(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.pow(t, F.lit(1 / 3))).otherwise(t * ((29 / 6) ** 2 / 3) + 4 / 29)

    def white(p: Column) -> Column:
        r, g, b = p["r"], p["g"], p["b"]
        return F.struct(
            ((0.4123907993 * r + 0.3575843394 * g + 0.1804807884 * b) / 0.9504559271).alias("x"),
            (0.2126390059 * r + 0.7151686788 * g + 0.0721923154 * b).alias("y"),
            ((0.0193308187 * r + 0.1191947798 * g + 0.9505321522 * b) / 1.0890577508).alias("z"),
        )

    curved = let(let(_linear_struct(hex_), white), lambda p: F.struct(*[curve(p[n]).alias(n) for n in "xyz"]))
    return let(curved, lambda f: F.struct((116 * f["y"] - 16).alias("l"), (500 * (f["x"] - f["y"])).alias("a"), (200 * (f["y"] - f["z"])).alias("b")))


def ciede2000(p: Column, q: Column) -> Column:
    """CIEDE2000 between two lab() structs, all weights 1."""

    def hue(a: Column, b: Column) -> Column:
        return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.degrees(F.atan2(b, a)) + F.when(F.atan2(b, a) < 0, 360).otherwise(0))

    def stretched(v: Column) -> Column:
        mean7 = F.pow((F.sqrt(v["a1"] ** 2 + v["b1"] ** 2) + F.sqrt(v["a2"] ** 2 + v["b2"] ** 2)) / 2, F.lit(7.0))
        g = 1 + 0.5 * (1 - F.sqrt(mean7 / (mean7 + 25.0**7)))
        return F.struct(v["l1"].alias("l1"), v["l2"].alias("l2"), v["b1"].alias("b1"), v["b2"].alias("b2"), (v["a1"] * g).alias("a1"), (v["a2"] * g).alias("a2"))

    def polar(v: Column) -> Column:
        chroma = lambda n: F.sqrt(v[f"a{n}"] ** 2 + v[f"b{n}"] ** 2)
        return F.struct(v["l1"].alias("l1"), v["l2"].alias("l2"), chroma(1).alias("c1"), chroma(2).alias("c2"), hue(v["a1"], v["b1"]).alias("h1"), hue(v["a2"], v["b2"]).alias("h2"))

    def means(v: Column) -> Column:
        h1, h2, grey = v["h1"], v["h2"], v["c1"] * v["c2"] == 0
        turn = F.when(grey, F.lit(0.0)).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360).otherwise(h2 - h1 + 360)
        mean = F.when(grey, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360) / 2).otherwise((h1 + h2 - 360) / 2)
        return F.struct(
            (v["l2"] - v["l1"]).alias("dl"), (v["c2"] - v["c1"]).alias("dc"), (2 * F.sqrt(v["c1"] * v["c2"]) * F.sin(F.radians(turn / 2))).alias("dh"),
            ((v["l1"] + v["l2"]) / 2).alias("l"), ((v["c1"] + v["c2"]) / 2).alias("c"), mean.alias("h"),
        )

    def weighted(v: Column) -> Column:
        cosine = lambda k, shift: F.cos(F.radians(k * v["h"] + shift))
        t = 1 - 0.17 * cosine(1, -30) + 0.24 * cosine(2, 0) + 0.32 * cosine(3, 6) - 0.2 * cosine(4, -63)
        off, c7 = (v["l"] - 50) ** 2, F.pow(v["c"], F.lit(7.0))
        twist = -F.sin(F.radians(60 * F.exp(-(((v["h"] - 275) / 25) ** 2)))) * 2 * F.sqrt(c7 / (c7 + 25.0**7))
        return F.struct(
            (v["dl"] / (1 + 0.015 * off / F.sqrt(20 + off))).alias("x"), (v["dc"] / (1 + 0.045 * v["c"])).alias("y"), (v["dh"] / (1 + 0.015 * v["c"] * t)).alias("z"), twist.alias("w"),
        )

    both = F.struct(*[x[n].alias(f"{n}{i}") for i, x in ((1, p), (2, q)) for n in "lab"])
    for step in (stretched, polar, means, weighted):
        both = let(both, step)
    return let(both, lambda v: F.sqrt(F.greatest(F.lit(0.0), v["x"] ** 2 + v["y"] ** 2 + v["z"] ** 2 + v["w"] * v["y"] * v["z"])))


def classify_property(name: Column | str) -> Column:
    """How a CSS property uses colour, or null."""
    p = F.lower(F.trim(_col(name)))
    return (
        F.when(p.startswith("--"), "definition")
        .when(p == "color", "text")
        .when(p.isin("background", "background-color", "background-image"), "background")
        .when(p.rlike("^border(-color|-(top|right|bottom|left|block|inline)(-(start|end))?(-color)?)?$"), "border")
        .when(p.isin("outline", "outline-color"), "outline")
        .when(p == "caret-color", "caret")
        .when(p == "accent-color", "accent-control")
        .when(p.isin("fill", "stroke"), p)
        .when(p.isin("text-decoration", "text-decoration-color", "column-rule-color", "column-rule"), "decoration")
        .when(p.isin("box-shadow", "text-shadow"), "shadow")
    )


def role_from_name(name: Column | str) -> Column:
    lower, out = F.lower(_col(name)), None
    for word, role in ROLE_WORDS:
        out = F.when(lower.contains(word), role) if out is None else out.when(lower.contains(word), role)
    return out


def usage_weight(kind: Column, hint: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in USAGE_WEIGHTS.items() for x in pair])
    return F.when((kind == "definition") & hint.isNotNull(), F.lit(1.0)).otherwise(F.try_element_at(table, kind))


def css_score(weight: Column, brand_weight: Column, hint: Column) -> Column:
    share = F.when(weight > 0, brand_weight / weight).otherwise(F.lit(0.0))
    bonus = F.when(hint == "primary", 30).when(hint.isin("accent", "secondary"), 12).otherwise(0)
    return share * 40 + bonus + 20 * F.log2(1 + weight)


def confidence(area_share: Column, usage_share: Column, has_area: Column, has_css: Column) -> Column:
    strength = F.greatest(F.least(F.lit(1.0), area_share / 0.25), F.least(F.lit(1.0), usage_share / 0.3))
    both = F.when(has_area & has_css, 5).otherwise(0)
    return F.floor(F.least(F.lit(95.0), 30 + 60 * F.sqrt(strength) + both) + 0.5).cast("int")


# Plain Python twins, for code that folds over one site's few colours inside a task.
def _lin(c: int) -> float:
    s = c / 255
    return s / 12.92 if s <= 0.04045 else ((s + 0.055) / 1.055) ** 2.4


def lab_of(hex_: str) -> tuple[float, float, float]:
    r, g, b = (_lin(int(hex_[i : i + 2], 16)) for i in (1, 3, 5))
    xyz = (
        (0.4123907993 * r + 0.3575843394 * g + 0.1804807884 * b) / 0.9504559271,
        0.2126390059 * r + 0.7151686788 * g + 0.0721923154 * b,
        (0.0193308187 * r + 0.1191947798 * g + 0.9505321522 * b) / 1.0890577508,
    )
    fx, fy, fz = (t ** (1 / 3) if t > (6 / 29) ** 3 else t * ((29 / 6) ** 2 / 3) + 4 / 29 for t in xyz)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def delta_e(p: tuple, q: tuple) -> float:
    """CIEDE2000 of two Lab triples."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    mean7 = ((math.hypot(a1, b1) + math.hypot(a2, b2)) / 2) ** 7
    g = 0.5 * (1 - math.sqrt(mean7 / (mean7 + 25.0**7)))
    a1, a2 = a1 * (1 + g), a2 * (1 + g)
    c1, c2 = math.hypot(a1, b1), math.hypot(a2, b2)
    h1, h2 = (math.degrees(math.atan2(b, a)) % 360 if a or b else 0.0 for a, b in ((a1, b1), (a2, b2)))
    if c1 * c2 == 0:
        dh, mh = 0.0, h1 + h2
    else:
        dh = h2 - h1 if abs(h2 - h1) <= 180 else h2 - h1 - 360 if h2 > h1 else h2 - h1 + 360
        mh = (h1 + h2) / 2 if abs(h1 - h2) <= 180 else (h1 + h2 + 360) / 2 if h1 + h2 < 360 else (h1 + h2 - 360) / 2
    hue = 2 * math.sqrt(c1 * c2) * math.sin(math.radians(dh / 2))
    ml, mc = (l1 + l2) / 2, (c1 + c2) / 2
    cosine = lambda k, s: math.cos(math.radians(k * mh + s))
    t = 1 - 0.17 * cosine(1, -30) + 0.24 * cosine(2, 0) + 0.32 * cosine(3, 6) - 0.2 * cosine(4, -63)
    off = (ml - 50) ** 2
    x = (l2 - l1) / (1 + 0.015 * off / math.sqrt(20 + off))
    y = (c2 - c1) / (1 + 0.045 * mc)
    z = hue / (1 + 0.015 * mc * t)
    twist = -math.sin(math.radians(60 * math.exp(-(((mh - 275) / 25) ** 2)))) * 2 * math.sqrt(mc**7 / (mc**7 + 25.0**7))
    return math.sqrt(max(0.0, x * x + y * y + z * z + twist * y * z))
