"""Font names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim
from .unicode import without_marks

# Fixed values.
GENERIC_FALLBACKS = ("serif", "sans-serif", "monospace", "cursive", "fantasy", "inherit", "initial", "unset", "none", "normal", "auto")
SYSTEM_FONTS = (
    "arial", "helvetica", "verdana", "georgia", "times", "times new roman", "courier", "courier new", "system-ui", "-apple-system",
    "blinkmacsystemfont", "segoe ui", "tahoma", "geneva", "lucida grande", "trebuchet ms",
)
SCORER_SYSTEM_FONTS = (
    "arial", "helvetica", "verdana", "georgia", "times", "times new roman", "courier", "courier new", "system-ui", "-apple-system",
    "segoe ui", "roboto", "helvetica neue",
)
ICON_FONTS = (
    "fontawesome", "font awesome", "fa-", "fa solid", "fa brands", "fa regular", "material", "icon", "awb-icons", "revicons", "icomoon",
    "glyphicon", "dashicons", "eleganticons", "feather", "ionicons", "star", "etmodules",
)
MONOSPACE = r"(?i)(^|[\s-])(mono|monospace|code|consolas|courier|menlo|monaco)([\s-]|$)|mono$"
UNIDENTIFIED = "Custom Font (unidentified)"
ROLE_ORDER = ("primary", "heading", "button", "accent", "secondary")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _plain(name: Column | str) -> Column:
    return trim(F.regexp_replace(F.lower(_col(name)), "['\"]", ""))


def is_css_variable(name: Column | str) -> Column:
    t = trim(name)
    return F.coalesce((t == "") | t.startswith("var(") | t.startswith("--") | t.contains("var(--"), F.lit(True))


def is_generic_fallback(name: Column | str) -> Column:
    return F.coalesce((_col(name) == "") | _plain(name).isin(*GENERIC_FALLBACKS), F.lit(True))


def has_unresolved_var(name: Column | str) -> Column:
    return _col(name).contains("var(") | _col(name).startswith("--")


def is_system_font(name: Column | str, fonts: tuple = SYSTEM_FONTS) -> Column:
    return F.coalesce((_col(name) == "") | _plain(name).isin(*fonts), F.lit(True))


def is_icon_font(name: Column | str) -> Column:
    lower = F.lower(_col(name))
    hit = lower.contains(ICON_FONTS[0])
    for part in ICON_FONTS[1:]:
        hit = hit | lower.contains(part)
    return hit


def is_monospace(name: Column | str) -> Column:
    return _col(name).rlike(MONOSPACE)


def is_displayable(name: Column | str) -> Column:
    """A real family: no variable, fallback, icon font or placeholder."""
    return ~is_css_variable(name) & ~is_generic_fallback(name) & ~is_icon_font(name) & (_col(name) != UNIDENTIFIED)


def normalise_key(name: Column | str) -> Column:
    """One key for 'bebas-neue', 'Bebas Neue' and 'BebasNeue'."""
    return trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_col(name)), r"[-_\s]+", ""), "['\"]", ""), "ltstd|std", ""))


def _title_words(name: Column, at: str) -> Column:
    return F.array_join(F.transform(F.split(name, at), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), " ")


def clean_name(name: Column | str) -> Column:
    """Quotes dropped; all capitals and kebab case become title case, mixed case stays."""
    c = trim(F.regexp_replace(_col(name), "['\"]", ""))
    mixed = c.rlike("[A-Z]") & c.rlike("[a-z]")
    return (
        F.when(mixed, c)
        .when(c.rlike(r"^[A-Z\s-]+$"), _title_words(c, r"[\s-]+"))
        .when(c.contains("-") & ~c.rlike("[A-Z]"), _title_words(c, "-"))
        .otherwise(c)
    )


def generic_family(name: Column | str) -> Column:
    lower = F.lower(_col(name))
    return (
        F.when(lower.rlike("mono|code|courier|consol"), "monospace")
        .when(lower.contains("sans"), "sans-serif")
        .when(lower.rlike("serif|georgia|times|garamond|playfair|merriweather|baskerville|caslon|didot|bodoni"), "serif")
        .otherwise("sans-serif")
    )


def role_rank(role: Column | str) -> Column:
    out = None
    for i, r in enumerate(ROLE_ORDER):
        out = F.when(_col(role) == r, i) if out is None else out.when(_col(role) == r, i)
    return out.otherwise(len(ROLE_ORDER))


def google_families(url: Column | str) -> Column:
    """array<struct(name, weights)> of a Google Fonts URL, old and new style; weight 400 where none is given."""
    params = F.regexp_extract_all(_col(url), F.lit("family=([^&]+)"), F.lit(1))
    each = F.flatten(F.transform(params, lambda p: F.split(p, r"\|")))

    def one(f: Column) -> Column:
        spec = F.try_element_at(F.split(f, ":"), F.lit(2))
        axis = F.regexp_extract(spec, r"wght@([\d;,]+)", 1)
        weights = F.filter(F.split(F.when(axis != "", axis).otherwise(F.coalesce(spec, F.lit(""))), "[;,]"), lambda w: w.rlike(r"^\d+$"))
        return F.struct(
            F.trim(F.regexp_replace(F.element_at(F.split(f, ":"), 1), r"\+", " ")).alias("name"),
            F.when(F.size(weights) > 0, weights).otherwise(F.array(F.lit("400"))).alias("weights"),
        )

    return F.filter(F.transform(each, one), lambda f: (f["name"] != "") & ~is_system_font(f["name"]))


def name_from_path(path: Column | str) -> Column:
    """Family name of a font file's path: suffixes of weight, style and hash dropped."""
    stem = F.regexp_extract(_col(path), r"([^/?#]+?)(?:\.(?:woff2?|ttf|otf|eot))(?:[?#].*)?$", 1)
    stem = F.regexp_replace(stem, r"(?i)[-_.]?(regular|bold|italic|medium|light|thin|black|semibold|extrabold|variable|webfont|latin|subset|\d{3}|[0-9a-f]{8,})(?=$|[-_.])", "")
    return F.when(stem != "", trim(F.regexp_replace(stem, "[-_]+", " ")))


def eval_key(name: Column | str, decomposed: bool = False) -> Column:
    """Letters and digits only, decomposed and without accents."""
    return F.regexp_replace(F.lower(without_marks(_col(name), decomposed)), "[^a-z0-9]", "")


def names_match(a: Column, b: Column) -> Column:
    """Equal keys, or one within the other where the shorter has five letters."""
    x, y = eval_key(a), eval_key(b)
    return (x != "") & (y != "") & ((x == y) | (F.least(F.length(x), F.length(y)) >= 5) & (x.contains(y) | y.contains(x)))
