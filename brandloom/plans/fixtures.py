"""Small fixed lists that queries deal out over the rows of the given tables, inputs of tests, and their SQL form."""

from __future__ import annotations


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(_literal, row))})" for row in rows)


ROBOTS = [("/fr/", False), ("/fr/8", True), ("/*1$", False), ("/en/2*", False), ("/en/25", True), ("/de/*?x", False)]

PALETTE = [
    ("acme.com", 1, "#635BFF", "primary", "extracted", 90), ("acme.com", 2, "#00d4ff", "accent", "extracted", 70), ("acme.com", 3, "#ff5996", "accent", "extracted", 60),
    ("acme.com", 4, "#0a2540", "text", "extracted", 80), ("acme.com", 5, "#abc123", "other", "extracted", 40), ("acme.com", 6, "#123abc", "other", "extracted", 40),
    ("acme.com", 7, "red", "other", "extracted", 10), ("bolt.io", 1, "#e11d48", "primary", "verified", 100), ("bolt.io", 2, "#111111", "secondary", "extracted", 75),
    ("bolt.io", 3, "#eeeeee", "background", "extracted", 66), ("grey.org", 1, "#777777", "text", "extracted", 55), ("grey.org", 2, "#fafafa", "background", "extracted", 50),
]

FONTS = [
    ("acme.com", 1, "Inter", "primary", "https://fonts.googleapis.com/css2?family=Inter", ["700", "400", "400", "bold"], "extracted", 90),
    ("acme.com", 2, "Playfair Display", "heading", "https://fonts.googleapis.com/css2?family=Playfair+Display", [], "extracted", 85),
    ("acme.com", 3, "JetBrains Mono", "accent", None, ["400"], "extracted", 70), ("acme.com", 4, "O'Hare \\ Sans", "accent", None, None, "extracted", 60),
    ("bolt.io", 1, "Sohne", "primary", None, ["300"], "verified", 100),
]

PROPERTIES = [
    "color", "background", "Background-Color", "background-image", "border", "border-top", "border-top-color", "border-inline-start-color", "border-radius",
    "outline", "outline-color", "caret-color", "accent-color", "fill", "stroke", "text-decoration", "column-rule", "box-shadow", "text-shadow", "--brand", "margin", " color ",
]

LINKS = [
    *[("kiln.studio", p, f"https://kiln.studio/{p}", 0, "anchor", "https://www.instagram.com/kilnstudio/") for p in (1, 2)],
    *[("kiln.studio", p, f"https://kiln.studio/{p}", 1, "anchor", "https://instagram.com/glazefriends") for p in (1, 2, 3)],
    ("kiln.studio", 2, "https://kiln.studio/2", 2, "anchor", "https://fb.com/kiln.studio"), ("kiln.studio", 3, "https://kiln.studio/3", 3, "anchor", "https://m.facebook.com/kiln.studio?ref=x"),
    ("peat.farm", 1, "https://peat.farm/", 0, "anchor", "https://youtube.com/watch"), ("peat.farm", 1, "https://peat.farm/", 1, "anchor", "https://www.youtube.com/channel/UC77peat"),
    ("peat.farm", 1, "https://peat.farm/", 2, "meta", "@peatfarm"), ("peat.farm", 1, "https://peat.farm/", 3, "anchor", "https://twitter.com/intent/post?text=x"),
    ("lone.dev", 1, "https://lone.dev/", 0, "anchor", "https://www.linkedin.com/in/lonedev"), ("lone.dev", 1, "https://lone.dev/", 1, "anchor", "https://notlinkedin.org/company/lone"),
    ("quay.shop", 1, "https://quay.shop/", 0, "anchor", "https://www.tiktok.com/@quay.shop?lang=de"), ("quay.shop", 1, "https://quay.shop/", 1, "anchor", "https://www.linkedin.com/school/quay/about"),
]
