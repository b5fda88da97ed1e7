"""CSS rules and selectors as plain values: what a stylesheet says, made ready for joins. Used inside Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from .css import _TOKENS

# Pseudo-classes by position: (a, b, from the end, of the same type).
POSITIONS = {
    "first-child": [(0, 1, False, False)], "last-child": [(0, 1, True, False)], "only-child": [(0, 1, False, False), (0, 1, True, False)],
    "first-of-type": [(0, 1, False, True)], "last-of-type": [(0, 1, True, True)], "only-of-type": [(0, 1, False, True), (0, 1, True, True)],
}
NTH = {"nth-child": (False, False), "nth-last-child": (True, False), "nth-of-type": (False, True), "nth-last-of-type": (True, True)}
WEIGHTS = {"normal": "400", "bold": "700"}

_IDENT = r"(?:[\w\u0080-\U0010ffff-]|\\.)+"
_PIECE = re.compile(
    rf"""\s*(?P<comb>[>+~])\s*|(?P<space>\s+)|\#(?P<id>{_IDENT})|\.(?P<cls>{_IDENT})
    |\[\s*(?P<name>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]+))\s*(?P<fold>[iIsS])?\s*)?\]
    |(?P<colon>::?)(?P<pseudo>[\w-]+)(?P<open>\()?|(?P<tag>\*|{_IDENT})""",
    re.X,
)
_AN_B = re.compile(r"(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?$", re.I)
_FONT = re.compile(r"""^(?P<before>.*?)(?P<size>(?:\d*\.?\d+(?:px|r?em|ex|ch|lh|rlh|v[wh]|vmin|vmax|pt|pc|in|cm|mm|q|%)|xx-small|x-small|small|medium|large|x-large|xx-large|xxx-large|larger|smaller|(?:calc|clamp|min|max|var)\([^()]*(?:\([^()]*\)[^()]*)*\))(?:\s*/\s*[^\s,]+)?)\s+(?P<family>[^\d\s/].*)$""", re.I | re.S)


def _split(text: str, mark: str = ",") -> list[str]:
    """Parts at the top level, outside brackets, parentheses and quotes."""
    parts, depth, quote, piece = [], 0, "", []
    for ch in text:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "([":
            depth += 1
        elif ch in ")]":
            depth = max(0, depth - 1)
        elif ch == mark and depth == 0:
            parts.append("".join(piece))
            piece = []
            continue
        piece.append(ch)
    return [*parts, "".join(piece)]


def _plain(ident: str) -> str:
    return re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if m[1] else m[2], ident)


def _compound() -> dict:
    return {"tag": None, "ids": [], "classes": [], "attrs": [], "nth": [], "root": False, "linked": False}


def _closing(text: str, at: int) -> int:
    """Where the parenthesis that opens before `at` closes, or -1."""
    depth = 1
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0:
            return k
    return -1


def _an_b(text: str) -> tuple[int, int] | None:
    t = text.strip().lower()
    if t in ("odd", "even"):
        return 2, int(t == "odd")
    m = _AN_B.match(t)
    if not t or not m:
        return None
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    return a, int(re.sub(r"\s", "", m[2])) if m[2] else 0


def selectors(text: str) -> list[dict]:
    """Each selector of a list as steps from left to right with its specificity; one that can never match a still element is left out.

    :is() and :where() are written out as selectors of their own. States (:hover), pseudo-elements and what is unknown match nothing.
    """
    out = []
    for one in _split(text):
        out += _one(one.strip())
    return out


def _one(text: str) -> list[dict]:
    for m in re.finditer(r":(is|where|matches|-webkit-any)\(", text):
        head = text[: m.start()]
        if head.count("(") > head.count(")"):
            continue  # within :not()
        end = _closing(text, m.end())
        options = [o.strip() for o in _split(text[m.end() : end])] if end > 0 else []
        # options of one compound each; others match nothing here
        inner = [(o, s) for o in options for s in _one(o) if len(s["steps"]) == 1]
        weight = [0, 0, 0] if m[1] == "where" else max((s["spec"] for _, s in inner), default=[0, 0, 0])
        joint = re.search(r"[^\s>+~]*$", head).start()
        out = []
        for o, own in inner:
            # a type goes first in its compound
            put = head[:joint] + (o + head[joint:] if re.match(r"[\w*]", o) else head[joint:] + o) + text[end + 1 :]
            out += [s | {"spec": [x - y + z for x, y, z in zip(s["spec"], own["spec"], weight)]} for s in _one(put)]
        return out
    return [s] if (s := _steps(text)) else []


def _steps(text: str) -> dict | None:
    steps, spec, at, comb, current, any_piece = [], [0, 0, 0], 0, "", _compound() | {"nots": []}, False
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            return None
        at = m.end()
        if m["comb"] or m["space"]:
            if at >= len(text):
                break
            if not any_piece:
                return None
            steps.append({"comb": comb, **current})
            comb, current, any_piece = m["comb"] or " ", _compound() | {"nots": []}, False
            continue
        any_piece = True
        if m["tag"]:
            current["tag"] = None if m["tag"] == "*" else _plain(m["tag"]).lower()
            spec[2] += m["tag"] != "*"
        elif m["id"]:
            current["ids"].append(_plain(m["id"]))
            spec[0] += 1
        elif m["cls"]:
            current["classes"].append(_plain(m["cls"]))
            spec[1] += 1
        elif m["name"]:
            value = next((m[v] for v in ("v1", "v2", "v3") if m[v] is not None), "")
            fold = (m["fold"] or "").lower() == "i"
            current["attrs"].append({"name": m["name"].lower(), "op": m["op"] or "", "value": value.lower() if fold else value, "fold": fold})
            spec[1] += 1
        else:
            name, arg = m["pseudo"].lower(), None
            if m["open"]:
                end = _closing(text, at)
                if end < 0:
                    return None
                arg, at = text[at:end], end + 1
            if m["colon"] == "::":
                return None
            if name in POSITIONS and arg is None:
                current["nth"] += [dict(zip(("a", "b", "last", "typed"), p)) for p in POSITIONS[name]]
            elif name in NTH and arg is not None and (ab := _an_b(arg)):
                current["nth"].append(dict(zip(("a", "b", "last", "typed"), (*ab, *NTH[name]))))
            elif name == "root":
                current["root"] = True
            elif name in ("link", "any-link"):
                current["linked"] = True
            elif name == "not" and arg is not None:
                inner = [_steps(o.strip()) for o in _split(arg)]
                # what can never match is excluded by nothing
                inner = [i for i in inner if i]
                if any(len(i["steps"]) != 1 or i["steps"][0]["nots"] for i in inner):
                    return None
                if inner:
                    current["nots"] += [{k: v for k, v in i["steps"][0].items() if k not in ("comb", "nots")} for i in inner]
                    spec = [x + y for x, y in zip(spec, max(i["spec"] for i in inner))]
                continue
            else:
                return None
            spec[1] += 1
    if not any_piece:
        return None
    return {"steps": [*steps, {"comb": comb, **current}], "spec": spec}


def media_holds(query: str, width: int) -> bool:
    """Whether a list of media queries holds for a screen of this width; what is not about type or width holds."""
    for one in _split(query.lower()):
        if not one.strip():
            return True
        negated = one.strip().startswith("not ")
        holds = re.search(r"\b(print|speech|tty|braille)\b", one) is None
        for edge, size, unit in re.findall(r"(min|max)-(?:device-)?width\s*:\s*([\d.]+)(px|r?em)", one):
            px = float(size) * (16 if unit != "px" else 1)
            holds &= width >= px if edge == "min" else width <= px
        if re.search(r"prefers-color-scheme\s*:\s*dark|prefers-reduced-motion\s*:\s*reduce|prefers-contrast\s*:\s*more|orientation\s*:\s*portrait", one):
            holds = False
        if holds != negated:
            return True
    return False


def longhands(name: str, value: str) -> list[tuple[str, str]]:
    """A declaration's properties: the font shorthand sets family, weight and size; anything else stands for itself."""
    if name != "font":
        return [(name, value)]
    plain = value.strip()
    if plain.lower() in ("inherit", "initial", "unset", "revert"):
        return [(p, plain) for p in ("font-family", "font-weight", "font-size")]
    m = _FONT.match(plain)
    if not m:
        return []
    weight = re.search(r"(?<![\w.])(bold|bolder|lighter|[1-9]\d{0,2}|1000)(?![\w.%])", m["before"], re.I)
    return [("font-family", m["family"].strip()), ("font-weight", weight[1].lower() if weight else "normal"), ("font-size", m["size"].split("/")[0].strip())]


def rules(css: str, width: int) -> Iterator[tuple[str, list[tuple[str, str, bool]]]]:
    """(selector list, [(property, value, important)]) of each rule that holds for a screen of this width, in order.

    Rules of media that do not hold, keyframes and pages are left out; those in other at-rules (supports, layer) hold. @font-face is a rule, too.
    """
    blocks: list[tuple[str, bool]] = []  # header, whether what is inside holds
    found: list[list] = []
    piece: list[str] = []
    parens = 0

    def declare():
        name, colon, value = "".join(piece).strip().partition(":")
        name = name.strip().lower() if not name.strip().startswith("--") else name.strip()
        if colon and found and blocks and blocks[-1][1] and re.match(r"(--)?[a-zA-Z-][\w-]*$", name):
            bare = re.sub(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
            found[-1][1] += [(p, v, bare != value.strip()) for p, v in longhands(name, bare)]

    for m in _TOKENS.finditer(css):
        t = m[0]
        if t.startswith("/*"):
            continue
        parens = parens + 1 if t == "(" else max(0, parens - 1) if t == ")" else parens
        if parens or t not in "{};":
            piece.append(t)
            continue
        if t == "{":
            header = " ".join("".join(piece).split())
            holds = not blocks or blocks[-1][1]
            lower = header.lower()
            if lower.startswith("@media"):
                holds &= media_holds(header[6:], width)
            elif lower.startswith(("@keyframes", "@-webkit-keyframes", "@-moz-keyframes", "@page", "@counter-style", "@property")):
                holds = False
            blocks.append((header, holds))
            if not lower.startswith("@") or lower.startswith("@font-face"):
                found.append([header, []])
        else:
            declare()
            if t == "}" and blocks:
                header, holds = blocks.pop()
                if found and header == found[-1][0] and holds and (not header.startswith("@") or header.lower().startswith("@font-face")):
                    yield found[-1][0], found.pop()[1]
                elif found and header == found[-1][0]:
                    found.pop()
        piece = []
    declare()
    if blocks and found and found[-1][0] == blocks[-1][0] and blocks[-1][1]:
        yield found[-1][0], found.pop()[1]


def imports(css: str) -> list[str]:
    """Addresses of @import rules."""
    return re.findall(r"""@import\s+(?:url\(\s*)?["']?([^"')\s;]+)""", css, re.I)
