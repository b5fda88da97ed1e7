"""Unicode's compatibility decomposition (NFKD) as Column expressions, without Python in the tasks.

The driver takes each code point's decomposition from its own Unicode tables. Code points that become one other are one `translate` over the whole text. Those that become
several are taken one by one, a `translate` for each place in what they become, by length, so that each is a look-up in a dictionary. Then runs of combining marks are
put in the order of their classes. Texts of ASCII alone pass untouched.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, functions as F

from .text import let


@functools.cache
def _tables() -> tuple[dict[str, str], dict[int, dict[str, str]], dict[str, int]]:
    """Code points that become one other; those that become several, by how many; combining classes."""
    single: dict[str, str] = {}
    several: dict[int, dict[str, str]] = {}
    classes: dict[str, int] = {}
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000 or 0x20000 <= point < 0x2F800:
            continue
        c = chr(point)
        if rank := unicodedata.combining(c):
            classes[c] = rank
        if (put := unicodedata.normalize("NFKD", c)) != c:
            if len(put) == 1:
                single[c] = put
            else:
                several.setdefault(len(put), {})[c] = put
    return single, several, classes


def _class_of(points) -> str:
    """A regular expression's character class of code points, neighbours as ranges."""
    spans: list[list[int]] = []
    for p in sorted(map(ord, points)):
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


_ASCII = "[\\x{0}-\\x{7f}]"


def _split_by(points: str) -> tuple[str, str]:
    """A class of hundreds of ranges, and what else lies beyond ASCII; both ask first whether a character is ASCII, since a range is a step for every character."""
    return f"[[^{_ASCII[1:]}&&{points}]", f"[[^{_ASCII[1:]}&&[^{points[1:]}]"


def nfkd(text: Column) -> Column:
    single, several, classes = _tables()
    held = "".join(single)
    plain = F.translate(text, held, "".join(single[c] for c in held))

    def spelled(c: Column) -> Column:
        out = None
        for length, table in sorted(several.items()):
            points = "".join(table)
            put = F.concat(*[F.translate(c, points, "".join(table[p][k] for p in points)) for k in range(length)])
            test = F.translate(c, points, "") == ""
            out = F.when(test, put) if out is None else out.when(test, put)
        return out.otherwise(c)

    # character by character, but only where there is one that becomes several
    points, others = _split_by(_class_of(p for table in several.values() for p in table))
    single_point = lambda p: (F.char_length(p) == 1) & (p > F.lit("\x7f"))
    apart = let(plain, lambda t: F.when(t.rlike(points), F.array_join(F.transform(_extract(t, f"{_ASCII}+|{points}|{others}+"), lambda p: F.when(single_point(p), spelled(p)).otherwise(p)), "")).otherwise(t))

    # marks of lower classes first, those of one class as they come
    marks, unmarked = _split_by(_class_of(classes))
    names = "".join(classes)
    ranks = "".join(chr(0x100 + classes[c]) for c in names)
    ordered = lambda run: F.array_join(F.transform(F.array_sort(F.transform(F.split(run, ""), lambda c, i: F.struct(F.translate(c, names, ranks).alias("rank"), i.alias("i"), c.alias("c")))), lambda s: s["c"]), "")
    sorted_ = let(apart, lambda t: F.when(t.rlike(f"{marks}{{2}}"), F.array_join(F.transform(_extract(t, f"{_ASCII}+|{marks}+|{unmarked}+"), lambda p: F.when((F.char_length(p) > 1) & p.rlike(f"^{marks}"), ordered(p)).otherwise(p)), "")).otherwise(t))
    return F.when(text.rlike("^\\p{ASCII}*$"), text).otherwise(sorted_)


def _extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without_marks(text: Column, decomposed: bool = False) -> Column:
    """NFKD without the combining marks of the first block; a text that is decomposed already is taken as it is."""
    return F.regexp_replace(text if decomposed else nfkd(text), "[\\u0300-\\u036f]", "")


def file_slug(name: Column, lower: bool = True, decomposed: bool = False) -> Column:
    """A name for a file: letters and digits of the decomposed name, others as single hyphens, at most 60 characters; 'brand' where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(name if decomposed else nfkd(name), "[^a-zA-Z0-9]+", "-"), "^-|-$", "")
    cut = F.substring(F.lower(bare) if lower else bare, 1, 60)
    return F.when(cut != "", cut).otherwise("brand")
