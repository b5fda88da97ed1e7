"""One pass over a page's markup: an element table from which every view of the page is read."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from itertools import accumulate

from .url import canonical, normalised, sites_match

#: A data: or javascript: URL longer than this is content, not an address; all else of a page is kept whole.
MAX_INLINE = 2_048
#: Levels of a page's tree.
MAX_TREE = 512
#: Bounds of the search for logos only.
MAX_NODES, MAX_DEPTH = 100_000, 256
MAX_IMAGES, MAX_SVGS, MAX_LINKS, MAX_ANCESTORS = 300, 100, 200, 12
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNSEEN = {"script", "style", "noscript", "iframe", "svg", "path", "template"}
#: An opening tag of the key ends an open one of the set, unless a tag of the stop set stands between.
IMPLIED = {
    "p": ({"p"}, {"table", "td", "button"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    **{b: ({"p"}, {"table", "td", "button"}) for b in ("div", "section", "article", "header", "footer", "nav", "main", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "form", "aside", "figure", "blockquote", "pre", "hr")},
}


class Node:
    __slots__ = ("attrs", "begin", "depth", "end", "in_nav", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, begin: int):
        self.tag, self.attrs, self.parent, self.begin, self.end = tag, attrs, parent, begin, -1
        self.depth = parent.depth + 1 if parent else 0
        self.in_nav = parent is not None and (parent.in_nav or parent.tag in ("nav", "header", "navigation") or parent.attrs.get("role") == "navigation")


class Document(HTMLParser):
    """Elements in document order; an element's text is a slice of the text pieces."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.pieces: list[tuple[str, bool]] = []
        self._open: list[Node] = []
        self._places: dict[str, list[int]] = {}  # of open elements, by tag, so that deep pages take linear time
        self._unseen = 0
        self.feed(html)
        self.close()
        for node in self._open:
            node.end = len(self.pieces)
        self._dense = [0, *accumulate(sum(map(len, t.split())) for t, _ in self.pieces)]

    def _last(self, tags) -> int:
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=-1)

    def _pop_to(self, k: int) -> None:
        for node in reversed(self._open[k:]):
            node.end = len(self.pieces)
            self._places[node.tag].pop()
            self._unseen -= node.tag in UNSEEN
        del self._open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            if (k := self._last(ends)) > self._last(stops - ends):
                self._pop_to(k)
        kept: dict[str, str] = {}
        for name, value in attrs:
            kept.setdefault(name, value or "")
        node = Node(tag, kept, self._open[-1] if self._open else None, len(self.pieces))
        self.nodes.append(node)
        if tag in VOID:
            node.end = node.begin
        else:
            self._places.setdefault(tag, []).append(len(self._open))
            self._open.append(node)
            self._unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open and self._open[-1].tag == tag and self._places.get("svg"):
            self._pop_to(len(self._open) - 1)

    def handle_endtag(self, tag):
        if (k := self._last((tag,))) >= 0:
            self._pop_to(k)

    def parse_marked_section(self, i, report=1):
        """`<![` and what is none of its known words: a comment up to the next bracket, as in browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else -1

    def handle_data(self, data):
        self.pieces.append((data, self._unseen > 0))

    def text(self, node: Node) -> str:
        return "".join(t for t, _ in self.pieces[node.begin : node.end])

    def dense(self, node: Node) -> int:
        """How many characters of the element's text are no white space."""
        return self._dense[node.end] - self._dense[node.begin]

    def seen(self, node: Node) -> str:
        return "".join(t for t, hidden in self.pieces[node.begin : node.end] if not hidden)


def _classes(n: Node) -> list[str]:
    return n.attrs.get("class", "").split()


def _ancestors(n: Node, limit: int = MAX_ANCESTORS):
    """The element itself and at most `limit` elements above it."""
    for _ in range(limit + 1):
        if n is None:
            return
        yield n
        n = n.parent


def _chrome(n: Node) -> bool:
    return n.tag in ("header", "nav") or n.attrs.get("role") == "banner"


def _named_logo(n: Node) -> bool:
    return "logo" in n.attrs.get("class", "").lower() or "logo" in n.attrs.get("id", "").lower()


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def parse_page(html: str | None, url: str | None) -> dict:
    """A page's columns, see PAGE in operators.pages."""
    html, url = html or "", url or ""
    doc = Document(html)
    nodes = doc.nodes
    meta = [n.attrs for n in nodes if n.tag == "meta"]
    named = lambda name: next((m["content"] for m in meta if m.get("name") == name and "content" in m), "")
    hrefs = [(n.tag, h) for n in nodes if (h := n.attrs.get("href")) and (len(h) <= MAX_INLINE or not _INLINE.match(h))]
    links: dict[str, None] = {}
    for tag, href in hrefs:
        if tag == "a" and not href.startswith(("#", "javascript:", "mailto:", "tel:")) and (whole := canonical(href, url)):
            tidy = normalised(whole)
            if sites_match(tidy, url):
                links[tidy] = None

    ctas, attribute_text, structured, written, blocks = [], [], [], [], []
    for n in nodes:
        c = _classes(n)
        if n.tag == "button" or n.attrs.get("role") == "button" or "cta" in c or "btn" in c or n.tag == "a" and "button" in c or n.tag == "input" and n.attrs.get("type") == "submit":
            words = "" if doc.dense(n) >= 100 else doc.text(n).strip() or n.attrs.get("value", "")
            if words and len(words) < 100:
                ctas.append(words)
        if "placeholder" in n.attrs or "aria-label" in n.attrs or "title" in n.attrs or n.tag == "img" and "alt" in n.attrs or n.tag == "button" and "value" in n.attrs or n.tag == "input" and n.attrs.get("type") == "submit" and "value" in n.attrs:
            attribute_text += [n.attrs[k] for k in ("placeholder", "aria-label", "title", "alt", "value") if n.attrs.get(k)]
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json":
            written.append(doc.text(n))
            try:
                parsed = json.loads(doc.text(n))
            except (ValueError, RecursionError):
                continue
            structured += [x for x in (parsed if isinstance(parsed, list) else [parsed]) if x is not None]
        named_place = n.attrs.get("class", "")
        if "address" in named_place or "location" in named_place or "PostalAddress" in n.attrs.get("itemtype", "") or n.attrs.get("itemprop") == "address":
            words = _squeezed(doc.text(n)) if doc.dense(n) < 200 else ""
            if 10 < len(words) < 200 and (_STREETISH.search(words) or _STATE_ZIP.search(words)):
                blocks.append(words)
    for item in structured:
        blocks += _addresses_of(item, 0)

    body = next((n for n in nodes if n.tag == "body"), None)
    visible = doc.seen(body) if body else "".join(t for t, hidden in doc.pieces if not hidden)
    return {
        "title": next((doc.text(n).strip() for n in nodes if n.tag == "title"), ""),
        "description": named("description").strip(),
        "keywords": [k.strip() for k in named("keywords").split(",") if k.strip()],
        "og": {m["property"].replace("og:", "", 1): m["content"] for m in meta if m.get("property", "").startswith("og:") and m.get("content") and m["property"] != "og:"},
        "twitter": {m["name"].replace("twitter:", "", 1): m["content"] for m in meta if m.get("name", "").startswith("twitter:") and m.get("content") and m["name"] != "twitter:"},
        "app_name": next((m["content"] for m in meta if m.get("name", "").lower() == "application-name" and m.get("content")), None),
        "logo_meta": next((m["content"] for m in meta if m.get("name", "").lower() == "logo" and m.get("content")), None),
        "headings": [{"level": int(n.tag[1]), "text": t} for n in nodes if n.tag in ("h1", "h2", "h3") and (t := doc.text(n).strip())],
        "links": list(links),
        "images": [{"src": s, "alt": n.attrs.get("alt", "")} for n in nodes if n.tag == "img" and n.attrs.get("src") and (s := canonical(n.attrs["src"], url))],
        "css_urls": [s for n in nodes if n.tag == "link" and n.attrs.get("rel") == "stylesheet" and n.attrs.get("href") and (s := canonical(n.attrs["href"], url))],
        "inline_css": [t for n in nodes if n.tag == "style" and (t := doc.text(n).strip())],
        "nav_labels": [t for n in nodes if n.tag == "a" and n.in_nav and doc.dense(n) < 50 and (t := doc.text(n).strip()) and len(t) < 50],
        "cta_buttons": ctas,
        "footer": "".join(doc.text(n) for n in nodes if n.tag == "footer").strip(),
        "schema_data": [json.dumps(x, ensure_ascii=False) for x in structured],
        "schema_blocks": written,
        "address_blocks": blocks,
        "visible_text": _squeezed(visible),
        "attribute_text": _squeezed(" ".join(attribute_text)),
        "anchor_hrefs": [h for tag, h in hrefs if tag == "a"],
        "all_hrefs": [h for _, h in hrefs],
        "icons": [{"rel": n.attrs.get("rel", "").lower(), "href": n.attrs.get("href", ""), "sizes": n.attrs.get("sizes", "")} for n in [n for n in nodes if n.tag == "link"][:MAX_LINKS]],
        "marks": _marks(doc, url),
    }


_INLINE = re.compile(r"\s*(?:data|javascript):", re.I)
_STREETISH = re.compile(r"\d+.*(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|way|trail|blvd)", re.I)
_STATE_ZIP = re.compile(r"[A-Z]{2}\s*,?\s*\d{5}")


def _addresses_of(item, depth: int) -> list[str]:
    """Addresses in structured data, through @graph lists."""
    if not isinstance(item, dict) or depth > 5:
        return []
    found, address = [], item.get("address")
    if isinstance(address, str):
        found.append(address)
    elif isinstance(address, dict) and address.get("streetAddress"):
        found.append(", ".join(str(address[k]) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode") if address.get(k)))
    if isinstance(item.get("@graph"), list):
        for x in item["@graph"]:
            found += _addresses_of(x, depth + 1)
    return found


def tree_of(html: str) -> list[dict]:
    """Every element with its place among the others; below MAX_TREE levels elements stand beside each other, as in browsers."""
    doc = Document(html)
    number, above = {}, {}
    out, count, typed, last = [], {}, {}, {}
    for n in doc.nodes:
        up = n.parent
        while up is not None and len(above[up]) >= MAX_TREE - 1:
            up = up.parent
        i = number[n] = len(out)
        above[n] = [number[up], *above[up]] if up is not None else []
        at = number[up] if up is not None else None
        count[at] = count.get(at, 0) + 1
        typed[at, n.tag] = typed.get((at, n.tag), 0) + 1
        out.append({
            "el": i, "parent": at, "prev": last.get(at) if up is not None else None, "above": above[n], "tag": n.tag, "id": n.attrs.get("id") or None, "classes": list(dict.fromkeys(_classes(n))),
            "attrs": n.attrs, "nth": count[at], "nth_typed": typed[at, n.tag], "has_text": doc.dense(n) > 0,
        })
        last[at] = i
    for e in out:
        e["n_nth"], e["n_typed"] = count[e["parent"]], typed[e["parent"], e["tag"]]
    return out


def _marks(doc: Document, url: str) -> list[dict]:
    """Features of each image and inline drawing that may be the site's logo."""
    walked = [n for n in doc.nodes if n.depth <= MAX_DEPTH][:MAX_NODES]
    images = [n for n in walked if n.tag == "img" and n.attrs.get("src")][:MAX_IMAGES]
    drawings = [n for n in walked if n.tag == "svg" and not any(a.tag == "svg" for a in _ancestors(n.parent, MAX_DEPTH))][:MAX_SVGS]
    out = []
    for n in images + drawings:
        above = list(_ancestors(n))
        in_chrome, in_named = any(map(_chrome, above)), any(map(_named_logo, above))
        link = next((a for a in above if a.tag == "a" and "href" in a.attrs), None)
        if not (in_chrome or in_named) or n.tag == "svg" and not in_named and link is None:
            continue
        drawn_title = next((doc.text(x) for x in doc.nodes if n.tag == "svg" and x.tag == "title" and x.parent is n), "")
        name = n.attrs.get("alt") or n.attrs.get("aria-label") or n.attrs.get("title") or drawn_title
        if not name.strip() and link is not None:
            name = link.attrs.get("aria-label") or link.attrs.get("title") or ""
        target = canonical(link.attrs["href"], url) if link is not None else None
        page_host, target_host = ((re.match(r"https?://(?:www\.)?([^/:?#]+)", u or "") or [None, ""])[1] for u in (canonical(url), target))
        home = bool(target) and bool(page_host) and (page_host == target_host or page_host.endswith(f".{target_host}") or target_host.endswith(f".{page_host}")) and re.match(r"https?://[^/]+/?(?:[?#].*)?$", target) is not None
        context = " ".join(a.attrs.get(k, "") for a in above[:4] for k in ("class", "id", "alt", "aria-label", "title")).lower()
        out.append({
            "kind": n.tag,
            "src": n.attrs.get("src", "") if n.tag == "img" else _drawing(doc, n),
            "context": context,
            "name": name.strip(),
            "own": " ".join(n.attrs.get(k, "") for k in ("class", "id", "alt", "aria-label", "src")),
            "home_link": home,
            "in_chrome": in_chrome,
            "hidden": n.attrs.get("aria-hidden") == "true",
        })
    return out


def _drawing(doc: Document, svg: Node) -> str:
    """An inline drawing written again without scripts, styles, handlers and outside references."""
    parts, open_tags = [], []
    start = doc.nodes.index(svg)
    within, left_out = {svg}, {svg} if any(a.tag in ("script", "style", "foreignobject") for a in _ancestors(svg, MAX_DEPTH)) else set()
    for n in doc.nodes[start:]:
        if n is not svg and n.parent not in within:
            break
        within.add(n)
        if n in left_out or n.parent in left_out or n.tag in ("script", "style", "foreignobject"):
            left_out.add(n)
            continue
        while open_tags and open_tags[-1] is not n.parent:
            parts.append(f"</{open_tags.pop().tag}>")
        kept = {k: v for k, v in n.attrs.items() if not k.startswith("on") and not (k in ("href", "xlink:href") and not v.startswith("#"))}
        if n is svg:
            kept.setdefault("xmlns", "http://www.w3.org/2000/svg")
        parts.append(f"<{n.tag}{''.join(f' {k}={json.dumps(v, ensure_ascii=False)}' for k, v in kept.items())}>")
        open_tags.append(n)
    parts += [f"</{n.tag}>" for n in reversed(open_tags)]
    return "".join(parts)
