"""URLs: parts and predicates as Columns; resolution by WHATWG rules as a small Python helper."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .udf import arrow

# Paths worth visiting first.
PRIORITY_PATHS = (
    "/", "/about", "/about-us", "/brand", "/brand-guidelines", "/press", "/media", "/media-kit", "/careers", "/jobs",
    "/contact", "/blog", "/locations", "/location", "/stores", "/store-locator", "/find-us", "/our-locations", "/branches", "/offices",
)
CAMPAIGN = r"(?i)/lp/|/landing|/campaign|/promo|/offer|/special|/free-|utm_"
NEEDS_RENDERING = "(?i)location|store|contact|about"
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback")
BLOCKED_SUFFIXES = (".localhost", ".local", ".internal", ".intranet", ".corp", ".lan", ".home.arpa", ".localdomain")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(_col(url), F.lit("HOST")))


def strip_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def site(url: Column | str) -> Column:
    """Host without 'www.'; what is no URL stands for itself."""
    return F.coalesce(strip_www(host(url)), _col(url))


def port(url: Column | str) -> Column:
    """Explicit port, '' for none or the scheme's own."""
    u = _col(url)
    found = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    own = (found == "443") & F.lower(u).startswith("https:") | (found == "80") & F.lower(u).startswith("http:")
    return F.when(own, F.lit("")).otherwise(found)


def same_site(a: Column | str, b: Column | str) -> Column:
    return F.coalesce((strip_www(host(a)) == strip_www(host(b))) & (port(a) == port(b)), F.lit(False))


def path(url: Column | str) -> Column:
    """Path, '/' where empty, null for what is no URL."""
    p = F.try_parse_url(_col(url), F.lit("PATH"))
    return F.when(p == "", F.lit("/")).otherwise(p)


def base_domain(url: Column | str) -> Column:
    u = _col(url)
    return F.coalesce(F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)), u)


def without_dots(url: Column) -> Column:
    """The URL with the segments `.` and `..` of its path resolved."""
    part = lambda k: F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)([^?#]*)(.*)$", k)
    start = F.array().cast("array<string>")
    step = lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    path = F.array_join(F.aggregate(F.split(part(2), "/"), start, step), "/")
    return F.when(url.rlike(r"^[^?#]*/\.{1,2}(?:[/?#]|$)"), F.concat(part(1), path, part(3))).otherwise(url)


def normalise_url(raw: Column | str) -> Column:
    """https, lower-case host, no default port, no trailing slash, no fragment. Dot segments are left to `canonical`."""
    u = F.trim(_col(raw))
    u = F.when(F.lower(u).rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    rest = F.regexp_replace(u, "(?i)^https?://", "")
    name = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), ":(80|443)$", "")
    where = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    where = F.when(where == "", F.lit("/")).when((F.length(where) > 1) & where.endswith("/"), F.regexp_replace(where, "/$", "")).otherwise(where)
    return F.concat(F.lit("https://"), name, where, F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1))


def is_priority_path(p: Column) -> Column:
    bare = F.regexp_replace(F.lower(p), "/$", "")
    bare = F.when(bare == "", F.lit("/")).otherwise(bare)
    hits = bare.isin(*PRIORITY_PATHS)
    for prefix in PRIORITY_PATHS:
        hits = hits | bare.startswith(f"{prefix}/")
    return hits


def is_campaign(url: Column | str) -> Column:
    return _col(url).rlike(CAMPAIGN)


def is_home(url: Column | str) -> Column:
    return F.coalesce(path(url) == "/", F.lit(False))


def brand_token(url: Column | str) -> Column:
    return F.regexp_replace(F.split_part(strip_www(host(url)), F.lit("."), F.lit(1)), "[^a-z0-9]", "")


def https_only(url: Column | str) -> Column:
    return F.when(_col(url).rlike("(?i)^https://[^/\\s]"), _col(url))


# Helpers for code that runs inside page parsing.
def canonical(url: str, base: str | None = None) -> str | None:
    """Absolute URL as a browser would write it, or None."""
    try:
        u = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        number = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if scheme not in ("http", "https"):
        return None
    if not u.hostname:
        return None
    name = u.hostname if ":" not in u.hostname else f"[{u.hostname}]"
    login = u.netloc.rpartition("@")[0]
    shown = "" if number in (None, 443 if scheme == "https" else 80) else f":{number}"
    parts: list[str] = []
    for step in u.path.split("/")[1:]:
        if step == "..":
            del parts[-1:]
        elif step != ".":
            parts.append(step)
    where = "/" + "/".join(parts)
    if u.path.endswith(("/.", "/..")) and not where.endswith("/"):
        where += "/"
    return f"{scheme}://{login + '@' if login else ''}{name}{shown}{where.replace(' ', '%20')}{'?' + u.query if u.query else ''}{'#' + u.fragment if u.fragment else ''}"


def normalised(url: str) -> str:
    """normalise_url for one string, dot segments resolved."""
    u = url.strip()
    if not u.lower().startswith(("http://", "https://")):
        u = f"https://{u}"
    whole = canonical(u)
    if whole is None:
        return u
    s = urlsplit(whole)
    name = s.netloc.removesuffix(":80").removesuffix(":443")
    where = s.path[:-1] if len(s.path) > 1 and s.path.endswith("/") else s.path
    return f"https://{name}{where}{'?' + s.query if s.query else ''}"


def sites_match(a: str, b: str) -> bool:
    x, y = (urlsplit(canonical(u) or "") for u in (a, b))
    return bool(x.hostname) and x.hostname.removeprefix("www.") == (y.hostname or "").removeprefix("www.") and x.port == y.port


def parse_ip(text: str):
    """Address of a strict dotted quad or IPv6 literal (brackets allowed, no zones), or None."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]"):
        t = t[1:-1]
    if "%" in t:
        return None
    try:
        return ipaddress.ip_address(t)
    except ValueError:
        return None


# IPv4 space that is not plain unicast, besides what the standard library calls non-global.
_SPECIAL_V4 = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "100.64.0.0/10", "192.0.0.0/24", "192.88.99.0/24", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4")]
_SPECIAL_V6 = [ipaddress.ip_network(n) for n in ("64:ff9b::/96", "64:ff9b:1::/48", "2002::/16", "2001::/23", "2001:db8::/32", "3fff::/20")]
_GLOBAL_V6 = ipaddress.ip_network("2000::/3")


def is_public_address(text: str) -> bool:
    ip = parse_ip(text)
    if ip is None:
        return False
    if ip.version == 6:
        if ip.ipv4_mapped:
            return is_public_address(str(ip.ipv4_mapped))
        return ip in _GLOBAL_V6 and not any(ip in n for n in _SPECIAL_V6)
    return ip.is_global and not any(ip in n for n in _SPECIAL_V4)


def _quad(name: str) -> str:
    """IPv4 spellings such as 0x7f.1 or 2130706433 as a dotted quad; other names unchanged."""
    parts = name.rstrip(".").split(".")
    try:
        values = [int(p, 16) if p.lower().startswith("0x") else int(p, 8) if len(p) > 1 and p.startswith("0") else int(p) for p in parts]
    except ValueError:
        return name
    if len(values) > 4 or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
        return name
    number = values[-1] + sum(v << (24 - 8 * i) for i, v in enumerate(values[:-1]))
    return str(ipaddress.IPv4Address(number))


def url_error(raw: str | None) -> str | None:
    """Why a URL may not be crawled, or None."""
    text = (raw or "").strip()
    if not text:
        return "URL is required"
    head = text.split("://")[0]
    explicit = "://" in text and head.replace("+", "").replace("-", "").replace(".", "").isalnum() or (
        ":" in text and text.split(":")[0].isalpha() and not text.split(":", 1)[1][:1].isdigit() and not text.startswith("[")
    )
    full = text if explicit else f"https://{text}"
    try:
        u = urlsplit(full)
        number = u.port
    except ValueError:
        return "Invalid URL format"
    if u.scheme.lower() not in ("http", "https"):
        return "Only HTTP and HTTPS URLs are allowed"
    if not u.hostname or any(c in u.hostname for c in " <>^`{|}"):
        return "Invalid URL format"
    if u.username or u.password:
        return "URLs with credentials are not allowed"
    if number not in (None, 80, 443):
        return "Only ports 80 and 443 are allowed"
    name = _quad(u.hostname)
    if parse_ip(name):
        return None if is_public_address(name) else "Private IP addresses are not allowed"
    bare = name.lower().rstrip(".")
    if not bare:
        return "Invalid URL: missing hostname"
    if bare in BLOCKED_HOSTS or bare.endswith(BLOCKED_SUFFIXES) or "." not in bare:
        return "Internal hostnames are not allowed"
    return None


@arrow("string")
def url_errors(urls: pd.Series) -> pd.Series:
    return urls.map(url_error)


@arrow("string")
def canonical_urls(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else normalised(u))


@arrow("boolean")
def all_public(addresses: pd.Series) -> pd.Series:
    return addresses.map(lambda a: a is not None and len(a) > 0 and all(map(is_public_address, a)))


def validate_urls(df: DataFrame, column: str = "url", resolved: str | None = None) -> DataFrame:
    """df + error, normalised: verdict on each URL of `column`; `resolved` names an array of addresses that must all be public."""
    out = df.withColumn("error", url_errors(column))
    if resolved:
        none = F.coalesce(F.size(resolved), F.lit(0)) <= 0
        bad = F.when(none, "Could not resolve hostname").otherwise("Hostname resolves to a private address")
        out = out.withColumn("error", F.coalesce("error", F.when(~all_public(resolved), bad)))
    return out.withColumn("normalised", F.when(F.col("error").isNull(), canonical_urls(column)))
