"""Structured data against a walk of the parsed JSON in plain Python."""

import json
import random

from brandloom.operators import pages as P, structured

R = random.Random(3)


def _value(depth=0):
    kind = R.random()
    if depth > 4 or kind < 0.3:
        return R.choice([None, True, False, 0, 7, 2.5, "", "text", "é"])
    if kind < 0.55:
        return [_value(depth + 1) for _ in range(R.randrange(4))]
    out = {k: _value(depth + 1) for k in R.sample(["name", "@graph", "department", "a b", "offers"], R.randrange(3))}
    if R.random() < 0.6:
        out["@type"] = R.choice(["Store", "Person", "Hotel", ["Thing", 5, "Place"], [], 9, None, {"x": 1}])
    if R.random() < 0.4:
        out["address"] = R.choice([{"streetAddress": "1 A St", "postalCode": 12345, "addressRegion": 0}, {"addressLocality": ""}, "2 B St", None, {"streetAddress": True, "addressLocality": "Town"}])
    return out


BROKEN = ["", "{", "{'a': 1}", '{"a": 1} {"b": 2}', "[1, 2] x", "1],[2", '{"a": 1}},{"b": 2', "// no\n{}", '{"a": NaN}', "undefined", None]


def _text(v):
    return None if v in (None, "", False) or v == 0 and not isinstance(v, bool) else "true" if v is True else str(v)


def _walk(value, path, top):
    out = []
    if isinstance(value, dict):
        kind = value.get("@type")
        types = [kind] if isinstance(kind, str) else [t for t in kind if isinstance(t, str)] if isinstance(kind, list) else None
        if top or types is not None:
            address = value.get("address")
            parts = [t for p in structured.ADDRESS_PARTS if (t := _text(address.get(p)))] if isinstance(address, dict) else []
            out.append((path, top, None if types is None else tuple(types), ", ".join(parts) or None))
        for k, v in value.items():
            out += _walk(v, f"{path}.{k}", False)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += _walk(v, f"{path}[{i}]", top and path == "$")
    return out


def _page(texts):
    return "<html><body>" + "".join(f'<script type="application/ld+json">{t or ""}</script>' for t in texts) + "</body></html>"


def test_nodes_equal_a_plain_walk(spark):
    pages, want, broken = [], set(), {}
    for n in range(60):
        values = [_value() for _ in range(R.randrange(4))]
        bad = R.sample(BROKEN, R.randrange(3))
        texts = [json.dumps(v, ensure_ascii=R.random() < 0.5, indent=R.choice([None, 2])) for v in values] + bad
        pages.append((f"https://s{n % 4}.org/{n}", _page(texts), n))
        want |= {(n, block, *node) for block, v in enumerate(values) for node in _walk(v, "$", True)}
        broken[n] = (len(texts), len(bad))
    blocks = structured.schema_blocks(P.parse_pages(spark.createDataFrame(pages, "url string, html string, page_ord int"))).cache()
    nodes = structured.schema_nodes(blocks).cache()
    got = {(r.page_ord, r.block, r.path, r.top, None if r.types is None else tuple(r.types), r.address) for r in nodes.collect()}
    assert got == want and len(want) > 60
    for r in structured.page_schemas(blocks, nodes).collect():
        own = sorted((b, p, t, a) for n, b, p, top, t, a in want if n == r.page_ord and top)
        assert (r.n_blocks, r.n_malformed) == broken[r.page_ord]
        assert r.n_nodes == sum(n == r.page_ord and t is not None for n, _, _, _, t, _ in want)
        assert set(r.types) == {x for _, _, t, _ in own for x in t or ()} and sorted(r.addresses) == sorted(a for *_, a in own if a)
        assert r.is_local == any(x in ("Store", "Hotel") for x in r.types)


def test_order_of_types(spark):
    pages = [("https://a.org/2", _page(['[{"@type":"Z"},{"@type":["Y","Z"]}]', '{"@type":"X"}', *['{"@type":"Y"}'] * 10]), 2), ("https://a.org/1", _page(['{"@type":"W"}']), 1)]
    nodes = structured.schema_nodes(structured.schema_blocks(P.parse_pages(spark.createDataFrame(pages, "url string, html string, page_ord int"))))
    assert structured.site_schema_types(nodes).first().types == ["W", "Z", "Y", "X"]


def test_deep_and_empty(spark):
    deep = '{"@type":"Deep","in":' * 60 + '{"@type":"Last"}' + "}" * 60
    pages = spark.createDataFrame([("https://a.org/", _page([deep]), 1), ("https://b.org/", None, 1), ("https://c.org/", "<p>", 1)], "url string, html string, page_ord int")
    blocks = structured.schema_blocks(P.parse_pages(pages))
    nodes = structured.schema_nodes(blocks)
    assert nodes.count() == 61 and structured.schema_nodes(blocks, levels=3).count() == 3
    assert structured.schema_nodes(blocks.limit(0)).count() == 0
