"""Text helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: White space as the web platform counts it; Java's \s lacks the no-break space and its kin.
SPACE = r"[\s\u00a0\ufeff\p{Z}]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(x: Column | str) -> Column:
    return F.regexp_replace(_col(x), f"^{SPACE}+|{SPACE}+$", "")


def collapse(x: Column | str) -> Column:
    return trim(F.regexp_replace(_col(x), f"{SPACE}+", " "))


def clamp_text(x: Column | str, limit: int) -> Column:
    return F.substring(_col(x), 1, limit)


def clamp_list(x: Column | str, items: int, chars: int) -> Column:
    return F.transform(F.slice(_col(x), 1, items), lambda v: F.substring(v, 1, chars))


def half_up(x: Column) -> Column:
    """Nearest integer, halves upward."""
    return F.floor(x + 0.5)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def first_seen(x: Column | str) -> Column:
    """Distinct elements in order of first appearance."""
    return F.array_distinct(_col(x))


def slug(domain: Column | str, when: Column, suffix: Column) -> Column:
    """Name of a report: domain without its last label, month, suffix."""
    base = F.regexp_replace(_col(domain), r"(?i)\.[a-z]{2,}$", "")
    base = F.substring(F.lower(F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9]+", "-"), "^-|-$", "")), 1, 40)
    return F.concat_ws("-", F.when(base == "", F.lit("brand")).otherwise(base), F.date_format(when, "yyyy-MM"), suffix)


def seo_rating(score: Column) -> Column:
    return F.when(score >= 8, "Good").when(score >= 5, "Needs work").otherwise("Poor")


def bar_level(share: Column) -> Column:
    return F.when(share >= 0.8, "high").when(share >= 0.6, "middle").otherwise("low")


def source_label(source: Column | str) -> Column:
    s = _col(source)
    return F.when(s == "verified", "Verified").when(s == "third_party", "Third party").when(s == "extracted", "Extracted").when(s == "inferred", "Inferred").otherwise("Not found")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").when(score.isNotNull(), "F")


def client_ip(forwarded: Column, real_ip: Column, hops: int = 1) -> Column:
    """The hop-th address from the right of X-Forwarded-For, else X-Real-IP, else 'unknown'."""
    parts = F.filter(F.transform(F.split(forwarded, ","), lambda x: F.trim(x)), lambda p: p != "")
    picked = F.when(F.size(parts) >= hops, F.element_at(parts, -hops))
    return F.coalesce(picked, F.when(F.trim(real_ip) != "", F.trim(real_ip)), F.lit("unknown"))
