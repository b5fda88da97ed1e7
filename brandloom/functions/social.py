"""Social profiles: platform, handle and validity of a link, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let

# Fixed values.
PLATFORMS = ("instagram", "twitter", "linkedin", "youtube", "tiktok", "facebook")
ORDER = ("linkedin", "twitter", "instagram", "youtube", "facebook", "tiktok", "other")
IGNORED = ("sharer", "share", "intent", "dialog", "login", "signup", "help", "about", "privacy", "terms", "settings", "widgets", "embed", "oauth", "api")
TECHNICAL = (
    "mapbox", "gl-js", "sdk", "api", "cdn", "webpack", "node", "npm", "yarn", "react", "angular", "vue", "jquery", "bootstrap", "tailwind",
    "font", "icon", "share", "widget", "embed", "plugin", "module", "package", "lib", "dist", "build", "src", "assets", "static", "public",
    "js", "css", "img",
)
_HOST = r"(?i)^(?:https?:)?(?://)?(?:[a-z0-9-]+\.)*"
_PROFILE = {
    "instagram": rf"{_HOST}(?:instagram\.com|instagr\.am)/([^/?\s]+)",
    "twitter": rf"{_HOST}(?:twitter|x)\.com/([^/?\s]+)",
    "linkedin": rf"{_HOST}linkedin\.com/(?:company|school|showcase)/([^/?\s]+)",
    "youtube": rf"{_HOST}youtube\.com/(?:c/|channel/|user/|@)?([^/?\s]+)",
    "tiktok": rf"{_HOST}tiktok\.com/@?([^/?\s]+)",
    "facebook": rf"{_HOST}(?:facebook|fb)\.com/([^/?\s]+)",
}
#: The same without an anchored host: any host that ends in a platform's name counts.
_PROFILE_LOOSE = {k: p.replace(_HOST, "(?i)") for k, p in _PROFILE.items()}
_VALID = {
    "instagram": r"instagram\.com/[a-z0-9_.]{1,30}(/?$|\?)",
    "twitter": r"(?:twitter|x)\.com/[a-z0-9_]{1,15}(/?$|\?)",
    "linkedin": r"linkedin\.com/(?:company|school|showcase)/[a-z0-9-]{1,100}/?",
    "youtube": r"youtube\.com/(?:channel/|@|c/|user/)[a-z0-9_-]+",
    "tiktok": r"tiktok\.com/@[a-z0-9_.]{1,24}",
    "facebook": r"(?:facebook|fb)\.com/[a-z0-9.]{1,50}(/?$|\?)",
}


def _case(value, default=None) -> Column:
    out = None
    for p in PLATFORMS:
        test, result = value(p)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out if default is None else out.otherwise(default)


def platform(url: Column, compat: bool = False) -> Column:
    """First platform whose profile pattern fits. `compat` leaves the host unanchored."""
    patterns = _PROFILE_LOOSE if compat else _PROFILE
    return _case(lambda p: (url.rlike(patterns[p]), F.lit(p)))


def handle(url: Column, name: Column) -> Column:
    def one(p: str):
        found = F.regexp_extract(url, _PROFILE_LOOSE[p], 1)
        found = F.regexp_replace(found, "@", "") if p == "tiktok" else found
        return name == p, F.concat(F.lit("@"), found) if p in ("instagram", "twitter", "tiktok") else found

    return _case(one)


def is_valid(url: Column, name: Column) -> Column:
    return _case(lambda p: (name == p, F.lower(url).rlike(_VALID[p])), F.lit(True))


def is_ignored(url: Column) -> Column:
    return F.lower(url).rlike("/(" + "|".join(IGNORED) + ")")


def is_technical(name: Column) -> Column:
    def test(c: Column) -> Column:
        odd = c.rlike(r"^[a-z]+-[a-z]+-[a-z]+$") | c.rlike(r"^\d+\.\d+") | c.rlike("^[@/]")
        return c.isin(*TECHNICAL) | c.rlike("|".join(TECHNICAL)) & (F.length(c) < 25) | odd

    return F.coalesce((name != "") & let(F.lower(F.regexp_replace(name, "^([^@]*)@", "$1")), test), F.lit(False))


def normalise(url: Column) -> Column:
    """https, no query or fragment, no trailing slash, lower case."""
    u = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    u = F.regexp_replace(F.regexp_replace(u, "^http:", "https:"), r"[?#].*$", "")
    return F.lower(F.regexp_replace(u, "/+$", ""))


def dedupe_key(name: Column, who: Column, url: Column) -> Column:
    return F.when(who.isNotNull() & (who != ""), F.concat_ws(":", name, F.lower(F.regexp_replace(who, "^@", "")))).otherwise(normalise(url))


def resembles(token: Column, who: Column) -> Column:
    h = F.regexp_replace(F.lower(F.coalesce(who, F.lit(""))), "[^a-z0-9]", "")
    return F.coalesce((F.length(token) >= 3) & (h != "") & (h.contains(token) | token.contains(h)), F.lit(False))


def order_of(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in ORDER]), name)
