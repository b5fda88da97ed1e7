"""CSS: declarations of a stylesheet, colours and fonts of a value. A small state machine, used inside Arrow functions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from .spaces import MIXED, SPACES, mix, to_srgb

_PROPERTY = re.compile(r"(--)?[a-z-][\w-]*$")
_COLOUR_CALL = re.compile(r"(rgba?|hsla?|hwb|lab|lch|oklab|oklch|color)\(", re.I)
_CALL = re.compile(r"([\w-]+)\((.*)\)$", re.S)
_VAR = re.compile(r"var\(\s*(--[\w-]+)\s*(?:,([^()]*(?:\([^()]*\)[^()]*)*))?\)")
_SLASH_ALPHA = re.compile(r"\s*/\s*var\(\s*--[\w-]+\s*(?:,[^()]*)?\)\s*\)")
_COMMA_ALPHA = re.compile(r"(rgba|hsla)\(([^()]*?),\s*var\(\s*--[\w-]+\s*(?:,[^()]*)?\)\s*\)", re.I)
_IMPORTANT = re.compile("!important", re.I)
UNRESOLVED = "__unresolved__"
MAX_SUBSTITUTIONS, MAX_DEPTH, MAX_RESOLVED = 12, 5, 500


def declarations(css: str) -> Iterator[tuple[str, str, str]]:
    """(innermost selector that is no at-rule, property, value) in order; one pass over comments, strings, parentheses and blocks."""
    open_blocks: list[str] = []
    piece: list[str] = []
    parens = 0
    for m in _TOKENS.finditer(css):
        t = m[0]
        if t.startswith("/*"):
            continue
        if t == "(":
            parens += 1
        elif t == ")":
            parens = max(0, parens - 1)
        elif parens == 0 and t in "{};":
            if t == "{":
                open_blocks.append(" ".join("".join(piece).split())[:200])
            else:
                if found := _declaration("".join(piece), open_blocks):
                    yield found
                if t == "}" and open_blocks:
                    open_blocks.pop()
            piece = []
            continue
        piece.append(t)
    if found := _declaration("".join(piece), open_blocks):
        yield found


_TOKENS = re.compile(r"""/\*(?:[^*]|\*(?!/))*(?:\*/|$)|"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?|[(){};]|[^(){};"'/]+|/""", re.S)


def _declaration(text: str, blocks: list[str]) -> tuple[str, str, str] | None:
    name, colon, value = text.strip().partition(":")
    name = name.strip().lower()
    if not blocks or not colon or not _PROPERTY.match(name):
        return None
    selector = next((b for b in reversed(blocks) if not b.startswith("@")), blocks[-1])
    return selector, name, value.strip()


def split_value(value: str) -> list[str]:
    """Tokens at the top level: blanks, commas and slashes divide outside parentheses."""
    out, current, parens = [], [], 0
    for ch in value:
        parens = parens + 1 if ch == "(" else max(0, parens - 1) if ch == ")" else parens
        if parens == 0 and ch in " \t\n,/":
            if current:
                out.append("".join(current))
            current = []
        else:
            current.append(ch)
    return [*out, "".join(current)] if current else out


def without_alpha_variables(value: str) -> str:
    return _COMMA_ALPHA.sub(r"\1(\2)", _SLASH_ALPHA.sub(")", value))


class Variables:
    """Resolves var(--name, fallback) against a site's custom properties; cycles fall back, depth and length are bounded."""

    def __init__(self, known: dict[str, str]):
        self.known, self.done, self.busy = known, {}, set()

    def resolve(self, value: str, depth: int = 0) -> str:
        if depth > MAX_DEPTH:
            return value
        for _ in range(MAX_SUBSTITUTIONS):
            m = _VAR.search(value)
            if not m:
                break
            name, fallback = m[1], m[2]
            if name in self.known and name not in self.busy:
                put = self._named(name, depth + 1)
            elif fallback is not None:
                put = self.resolve(without_alpha_variables(fallback.strip()), depth + 1)
            else:
                put = UNRESOLVED
            value = (value[: m.start()] + put + value[m.end() :])[:MAX_RESOLVED]
        return value

    def _named(self, name: str, depth: int) -> str:
        if name not in self.done:
            self.busy.add(name)
            self.done[name] = self.resolve(without_alpha_variables(self.known[name]), depth)
            self.busy.discard(name)
        return self.done[name]


def colours(value: str, variables: Variables | None = None) -> list[str]:
    """Every colour in a value as '#rrggbb', also inside shorthands and gradients, in order."""
    v = without_alpha_variables(_IMPORTANT.sub("", value))
    if variables:
        v = variables.resolve(v)
    return list(_visit(v, 0))


def _visit(text: str, depth: int) -> Iterator[str]:
    for token in split_value(text):
        if UNRESOLVED in token:
            continue
        if (token.startswith("#") or _COLOUR_CALL.match(token) or token.isascii() and token.isalpha()) and (found := parse_colour(token)):
            yield found
        elif depth < 3 and (call := _CALL.match(token)) and call[1].lower() != "url":
            yield from _visit(call[2], depth + 1)


def _number(text: str, whole: float = 1.0) -> float:
    if text == "none":
        return 0.0
    return float(text[:-1]) / 100 * whole if text.endswith("%") else float(text)


def _angle(text: str) -> float:
    if text == "none":
        return 0.0
    for unit, degrees in (("deg", 1.0), ("grad", 0.9), ("rad", 180 / math.pi), ("turn", 360.0)):
        if text.endswith(unit):
            return float(text[: -len(unit)]) * degrees
    return float(text)


def _hex(rgb) -> str:
    return "#" + "".join(f"{min(255, max(0, math.floor(c * 255 + 0.5))):02x}" for c in rgb)


def _gamma(c: float) -> float:
    a = abs(c)
    return math.copysign(1.055 * a ** (1 / 2.4) - 0.055, c) if a > 0.0031308 else 12.92 * c


def _oklab_rgb(l: float, a: float, b: float) -> tuple:  # noqa: E741
    x, y, z = ((l + p * a + q * b) ** 3 for p, q in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.291485548)))
    linear = (4.0767416621 * x - 3.3077115913 * y + 0.2309699292 * z, -1.2684380046 * x + 2.6097574011 * y - 0.3413193965 * z, -0.0041960863 * x - 0.7034186147 * y + 1.707614701 * z)
    return tuple(map(_gamma, linear))


def _inside(rgb) -> bool:
    return all(-1e-6 <= c <= 1 + 1e-6 for c in rgb)


def _oklch_in_gamut(l: float, c: float, h: float) -> tuple:  # noqa: E741
    """sRGB of an OKLCH colour, chroma reduced until it fits."""
    at = lambda k: _oklab_rgb(l, k * math.cos(math.radians(h)), k * math.sin(math.radians(h)))
    if l >= 1:
        return (1.0, 1.0, 1.0)
    if l <= 0:
        return (0.0, 0.0, 0.0)
    if _inside(at(c)):
        return at(c)
    low, high = 0.0, c
    for _ in range(24):
        mid = (low + high) / 2
        low, high = (mid, high) if _inside(at(mid)) else (low, mid)
    return at(low)


def _fitted(rgb) -> tuple:
    """sRGB of any range, fitted through OKLCH."""
    if _inside(rgb):
        return rgb
    lin = [math.copysign(((abs(c) + 0.055) / 1.055) ** 2.4, c) if abs(c) > 0.04045 else c / 12.92 for c in rgb]
    l, m, s = (math.copysign(abs(v) ** (1 / 3), v) for v in (
        0.4122214708 * lin[0] + 0.5363325363 * lin[1] + 0.0514459929 * lin[2],
        0.2119034982 * lin[0] + 0.6806995451 * lin[1] + 0.1073969566 * lin[2],
        0.0883024619 * lin[0] + 0.2817188376 * lin[1] + 0.6299787005 * lin[2],
    ))
    big = 0.2104542553 * l + 0.793617785 * m - 0.0040720468 * s
    a, b = 1.9779984951 * l - 2.428592205 * m + 0.4505937099 * s, 0.0259040371 * l + 0.7827717662 * m - 0.808675766 * s
    return _oklch_in_gamut(big, math.hypot(a, b), math.degrees(math.atan2(b, a)))


def _lab_rgb(l: float, a: float, b: float) -> tuple:  # noqa: E741
    """sRGB of CIE Lab under D50."""
    fy = (l + 16) / 116
    x, y, z = ((f**3 if f > 6 / 29 else 3 * (6 / 29) ** 2 * (f - 4 / 29)) * w for f, w in ((fy + a / 500, 0.9642956764), (fy, 1.0), (fy - b / 200, 0.8251046025)))
    linear = (
        3.1341359569 * x - 1.6173863321 * y - 0.4906619460 * z,
        -0.9787954765 * x + 1.9162543774 * y + 0.0334427339 * z,
        0.0719553913 * x - 0.2289768264 * y + 1.4053860351 * z,
    )
    return tuple(map(_gamma, linear))


def _hue_parts(h: float) -> tuple:
    """How far red, green and blue stand below the brightest channel of a pure hue, 0 to 1."""
    h = h % 360 / 60
    f = abs(h % 2 - 1)
    return ((0, f, 1), (f, 0, 1), (1, 0, f), (1, f, 0), (f, 1, 0), (0, 1, f))[int(h)]


def parse_colour(text: str) -> str | None:
    """One CSS colour as '#rrggbb'; None for anything else and for colours less than half opaque."""
    v = text.strip().lower()
    if not v or len(v) > 200:
        return None
    if v.startswith("#"):
        d = v[1:]
        if len(d) in (3, 4):
            d = "".join(c * 2 for c in d)
        if len(d) not in (6, 8) or any(c not in "0123456789abcdef" for c in d) or len(d) == 8 and int(d[6:], 16) / 255 < 0.5:
            return None
        return f"#{d[:6]}"
    if v in NAMED:
        return NAMED[v]
    found = _read(v)
    return _hex(found[2](found[0])) if found and found[1] >= 0.5 else None


def _clipped(rgb) -> tuple:
    return tuple(rgb)


def _read(v: str) -> tuple | None:
    """(sRGB values that may lie outside 0 to 1, alpha, how they are brought inside) of a colour in lower case, or None."""
    if v.startswith("#") or v in NAMED:
        d = (NAMED[v] if v in NAMED else v)[1:]
        d = "".join(c * 2 for c in d) if len(d) in (3, 4) else d
        if len(d) not in (6, 8) or any(c not in "0123456789abcdef" for c in d):
            return None
        return tuple(int(d[k : k + 2], 16) / 255 for k in (0, 2, 4)), int(d[6:] or "ff", 16) / 255, _clipped
    if v == "transparent":
        return (0.0, 0.0, 0.0), 0.0, _clipped
    if v.startswith("color-mix(") and v.endswith(")"):
        try:
            return _mixed(v[10:-1])
        except (ValueError, ZeroDivisionError):
            return None
    m = re.match(r"([a-z]+)\(([^()]*)\)$", v)
    if not m:
        return None
    kind, body = m[1], m[2].strip()
    main, _, alpha = body.partition("/")
    args = [a for a in re.split(r"[\s,]+", main.strip()) if a]
    space = args.pop(0) if kind == "color" and args else ""
    if not alpha and len(args) == 4:
        alpha = args.pop()
    try:
        if len(args) != 3:
            return None
        opaque = min(1.0, max(0.0, _number(alpha.strip()))) if alpha else 1.0
        if kind in ("rgb", "rgba"):
            return tuple(_number(a, 255) / 255 for a in args), opaque, _clipped
        if kind in ("hsl", "hsla"):
            return _hsl_rgb(_angle(args[0]), min(1, max(0, float(args[1].rstrip("%")) / 100)), float(args[2].rstrip("%")) / 100), opaque, _clipped
        if kind == "hwb":
            return _hwb_rgb(_angle(args[0]), float(args[1].rstrip("%")) / 100, float(args[2].rstrip("%")) / 100), opaque, _clipped
        if kind == "lab":
            return _lab_rgb(_number(args[0], 100), _number(args[1], 125), _number(args[2], 125)), opaque, _fitted
        if kind == "lch":
            c, h = _number(args[1], 150), math.radians(_angle(args[2]))
            return _lab_rgb(_number(args[0], 100), c * math.cos(h), c * math.sin(h)), opaque, _fitted
        if kind in ("oklab", "oklch"):
            a, b = _number(args[1], 0.4), _number(args[2], 0.4) if kind == "oklab" else _angle(args[2])
            polar = (_number(args[0]), math.hypot(a, b), math.degrees(math.atan2(b, a))) if kind == "oklab" else (_number(args[0]), a, b)
            angle = math.radians(polar[2])
            return _oklab_rgb(polar[0], polar[1] * math.cos(angle), polar[1] * math.sin(angle)), opaque, lambda _: _oklch_in_gamut(*polar)
        if kind == "color" and space in SPACES:
            return to_srgb(space, [_number(a) for a in args]), opaque, _fitted
    except ValueError:
        return None
    return None


def _hsl_rgb(h: float, s: float, l: float) -> tuple:  # noqa: E741
    high = l + s * min(l, 1 - l)
    return tuple(high - (high - l) * 2 * part for part in _hue_parts(h))


def _hwb_rgb(h: float, w: float, b: float) -> tuple:
    if w + b >= 1:
        return (w / (w + b),) * 3
    return tuple((1 - b) - (1 - b) * (1 - w / (1 - b)) * part for part in _hue_parts(h))


#: From a space for mixing back to sRGB, and whether values outside are clipped.
_BACK = {
    "hsl": (_hsl_rgb, _clipped), "hwb": (_hwb_rgb, _clipped), "oklab": (_oklab_rgb, _fitted), "lab": (_lab_rgb, _fitted),
    "oklch": (lambda l, c, h: _oklab_rgb(l, c * math.cos(math.radians(h)), c * math.sin(math.radians(h))), _fitted),
    "lch": (lambda l, c, h: _lab_rgb(l, c * math.cos(math.radians(h)), c * math.sin(math.radians(h))), _fitted),
}


def _mixed(body: str) -> tuple | None:
    """The inside of color-mix(): `in <space> [<way> hue], <colour> [<share>], <colour> [<share>]`."""
    parts, depth, piece = [], 0, ""
    for ch in body:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(piece)
            piece = ""
        else:
            piece += ch
    method, *others = [p.strip() for p in [*parts, piece]]
    words = method.split()
    if len(others) != 2 or len(words) not in (2, 4) or words[0] != "in" or words[1] not in MIXED or len(words) == 4 and (words[3] != "hue" or words[2] not in ("shorter", "longer", "increasing", "decreasing")):
        return None
    colours_, shares = [], []
    for other in others:
        tokens = split_value(other)
        share = [t for t in tokens if t.endswith("%") and "(" not in t]
        rest = [t for t in tokens if t not in share]
        if len(share) > 1 or len(rest) != 1 or (found := _read(rest[0])) is None:
            return None
        colours_.append(found)
        shares.append(float(share[0][:-1]) if share else None)
    if any(s is not None and not 0 <= s <= 100 for s in shares):
        return None
    first = 100 - shares[1] if shares[0] is None and shares[1] is not None else 50.0 if shares[0] is None else shares[0]
    second = 100 - first if shares[1] is None else shares[1]
    values, alpha = mix(words[1], words[2] if len(words) == 4 else "shorter", colours_[0][:2], colours_[1][:2], second / (first + second))
    back, fit = _BACK.get(words[1], (lambda *v: to_srgb(words[1], v), _fitted))
    return back(*values), alpha * min(1.0, (first + second) / 100), fit


# CSS named colours.
NAMED = {
    name: f"#{value}"
    for name, value in (pair.split(":") for pair in """
    aliceblue:f0f8ff antiquewhite:faebd7 aqua:00ffff aquamarine:7fffd4 azure:f0ffff beige:f5f5dc bisque:ffe4c4 black:000000
    blanchedalmond:ffebcd blue:0000ff blueviolet:8a2be2 brown:a52a2a burlywood:deb887 cadetblue:5f9ea0 chartreuse:7fff00 chocolate:d2691e
    coral:ff7f50 cornflowerblue:6495ed cornsilk:fff8dc crimson:dc143c cyan:00ffff darkblue:00008b darkcyan:008b8b darkgoldenrod:b8860b
    darkgray:a9a9a9 darkgreen:006400 darkgrey:a9a9a9 darkkhaki:bdb76b darkmagenta:8b008b darkolivegreen:556b2f darkorange:ff8c00 darkorchid:9932cc
    darkred:8b0000 darksalmon:e9967a darkseagreen:8fbc8f darkslateblue:483d8b darkslategray:2f4f4f darkslategrey:2f4f4f darkturquoise:00ced1
    darkviolet:9400d3 deeppink:ff1493 deepskyblue:00bfff dimgray:696969 dimgrey:696969 dodgerblue:1e90ff firebrick:b22222 floralwhite:fffaf0
    forestgreen:228b22 fuchsia:ff00ff gainsboro:dcdcdc ghostwhite:f8f8ff gold:ffd700 goldenrod:daa520 gray:808080 green:008000 greenyellow:adff2f
    grey:808080 honeydew:f0fff0 hotpink:ff69b4 indianred:cd5c5c indigo:4b0082 ivory:fffff0 khaki:f0e68c lavender:e6e6fa lavenderblush:fff0f5
    lawngreen:7cfc00 lemonchiffon:fffacd lightblue:add8e6 lightcoral:f08080 lightcyan:e0ffff lightgoldenrodyellow:fafad2 lightgray:d3d3d3
    lightgreen:90ee90 lightgrey:d3d3d3 lightpink:ffb6c1 lightsalmon:ffa07a lightseagreen:20b2aa lightskyblue:87cefa lightslategray:778899
    lightslategrey:778899 lightsteelblue:b0c4de lightyellow:ffffe0 lime:00ff00 limegreen:32cd32 linen:faf0e6 magenta:ff00ff maroon:800000
    mediumaquamarine:66cdaa mediumblue:0000cd mediumorchid:ba55d3 mediumpurple:9370db mediumseagreen:3cb371 mediumslateblue:7b68ee
    mediumspringgreen:00fa9a mediumturquoise:48d1cc mediumvioletred:c71585 midnightblue:191970 mintcream:f5fffa mistyrose:ffe4e1 moccasin:ffe4b5
    navajowhite:ffdead navy:000080 oldlace:fdf5e6 olive:808000 olivedrab:6b8e23 orange:ffa500 orangered:ff4500 orchid:da70d6 palegoldenrod:eee8aa
    palegreen:98fb98 paleturquoise:afeeee palevioletred:db7093 papayawhip:ffefd5 peachpuff:ffdab9 peru:cd853f pink:ffc0cb plum:dda0dd
    powderblue:b0e0e6 purple:800080 rebeccapurple:663399 red:ff0000 rosybrown:bc8f8f royalblue:4169e1 saddlebrown:8b4513 salmon:fa8072
    sandybrown:f4a460 seagreen:2e8b57 seashell:fff5ee sienna:a0522d silver:c0c0c0 skyblue:87ceeb slateblue:6a5acd slategray:708090 slategrey:708090
    snow:fffafa springgreen:00ff7f steelblue:4682b4 tan:d2b48c teal:008080 thistle:d8bfd8 tomato:ff6347 turquoise:40e0d0 violet:ee82ee wheat:f5deb3
    white:ffffff whitesmoke:f5f5f5 yellow:ffff00 yellowgreen:9acd32
    """.split())
}

# Families that name no font.
GENERIC_FAMILIES = {
    "inherit", "initial", "unset", "revert", "sans-serif", "serif", "monospace", "cursive", "fantasy", "system-ui", "ui-sans-serif",
    "ui-serif", "ui-monospace", "-apple-system", "blinkmacsystemfont",
}
_SHORTHAND_FAMILY = re.compile(r"\d[\w.%]*(?:\s*/\s*[\w.%]+)?\s+([^\d\s].*)$")


def plain_font(name: str) -> str:
    return " ".join(re.sub("['\"`]", "", name).split()).lower()


def first_font(name: str, value: str, variables: Variables | None = None) -> str | None:
    """The first family of a font or font-family declaration, or None."""
    stack = _IMPORTANT.sub("", value)
    if "var(" in stack:
        stack = variables.resolve(stack) if variables else UNRESOLVED
    if "var(" in stack or UNRESOLVED in stack:
        return None
    if name == "font":
        m = _SHORTHAND_FAMILY.search(stack[:500])
        if not m:
            return None
        stack = m[1]
    family = plain_font(stack.split(",")[0])
    return family if family and family not in GENERIC_FAMILIES else None
