"""Queries over structured data that pages carry, written into their markup from the parts' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import pages as P, structured
from ..session import cut
from ..sources.tables import table
from .catalog import query

_SITE = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
#: Blocks of a page with its part's values for <...>; the third is no JSON in every third size, the fourth where its text goes on after the value.
_BLOCKS = (
    '{"@context": "https://schema.org", "@graph": [{"@type": "Organization", "name": "<name>", "address": {"@type": "PostalAddress", "streetAddress": "<size> Main Street", "addressLocality": "", "postalCode": <zip>}},'
    ' {"@type": ["Store", 7, "LocalBusiness"], "department": [{"@type": "Restaurant"}, {"x": [[{"@type": "Hotel", "name": null}]]}]}]}',
    ' [{"@type": "<kind>", "address": {"streetAddress": "<size> Side Street", "addressRegion": "<brand>"}}, null, {"name": "untyped"}, 5, [{"@type": "Inner"}]]\n',
    '{"@type": "Product", "offers": {"@type": "Offer", "price": <size>.50}<comma>}',
    '{"@type": "Event"} <rest>',
)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose heads hold the blocks, parsed."""
    pages, parts = table(spark, d, "pages"), table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    size = F.col("p_size")
    put = {
        "name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.when(size % 5 == 0, "Hotel").otherwise(F.initcap("p_type")), "size": size.cast("string"), "zip": (10000 + size).cast("string"),
        "comma": F.when(size % 3 == 0, ",").otherwise(""), "rest": F.when(size % 2 == 0, "{}").otherwise(""),
    }
    text = F.lit("".join(f'<script type="application/ld+json">{b}</script>' for b in _BLOCKS))
    for name, value in put.items():
        text = F.replace(text, F.lit(f"<{name}>"), value)
    rows = pages.join(parts, pages["page_id"] % 100 == parts["p_partkey"])
    return P.parse_pages(rows.select("url", F.replace("html", F.lit("</head>"), F.concat(text, F.lit("</head>"))).alias("html"), F.col("page_id").cast("int").alias("page_ord")))


_PARTS = f"""p AS (SELECT page_id, {_SITE} AS site, p_name, p_brand, p_size AS size, CASE WHEN p_size % 5 = 0 THEN 'Hotel' ELSE upper(p_type[1]) || lower(p_type[2:]) END AS kind FROM pages JOIN part ON page_id % 100 = p_partkey)"""


@query(f"""WITH {_PARTS}
SELECT page_id, site, 0 AS block, u.path, u.types, u.address, u.top FROM p, (VALUES ('$', NULL, NULL, true), ('$.@graph[0]', 'Organization', 'o', false), ('$.@graph[0].address', 'PostalAddress', NULL, false), ('$.@graph[1]', 'Store,LocalBusiness', NULL, false), ('$.@graph[1].department[0]', 'Restaurant', NULL, false), ('$.@graph[1].department[1].x[0][0]', 'Hotel', NULL, false)) AS u(path, types, address, top) WHERE u.address IS NULL
UNION ALL SELECT page_id, site, 0, '$.@graph[0]', 'Organization', size || ' Main Street, ' || (10000 + size), false FROM p
UNION ALL SELECT page_id, site, 1, '$[0]', kind, size || ' Side Street, ' || p_brand, true FROM p UNION ALL SELECT page_id, site, 1, '$[2]', NULL, NULL, true FROM p UNION ALL SELECT page_id, site, 1, '$[4][0]', 'Inner', NULL, false FROM p
UNION ALL SELECT page_id, site, 2, '$', 'Product', NULL, true FROM p WHERE size % 3 <> 0 UNION ALL SELECT page_id, site, 2, '$.offers', 'Offer', NULL, false FROM p WHERE size % 3 <> 0
UNION ALL SELECT page_id, site, 3, '$', 'Event', NULL, true FROM p WHERE size % 2 <> 0""")
def schema_nodes(spark, d):
    """Every typed or top object of each page's blocks."""
    nodes = structured.schema_nodes(structured.schema_blocks(_marked(spark, d)))
    return nodes.select(F.col("page_ord").cast("long").alias("page_id"), "site", "block", "path", F.array_join("types", ",").alias("types"), "address", "top")


@query(f"""WITH {_PARTS}
SELECT page_id, site, 4 AS n_blocks, CAST(size % 3 = 0 AS INT) + CAST(size % 2 = 0 AS INT) AS n_malformed, 7 + 2 * CAST(size % 3 <> 0 AS INT) + CAST(size % 2 <> 0 AS INT) AS n_nodes,
  concat_ws(',', kind, CASE WHEN size % 3 <> 0 THEN 'Product' END, CASE WHEN size % 2 <> 0 THEN 'Event' END) AS types, size || ' Side Street, ' || p_brand AS addresses, kind = 'Hotel' AS is_local FROM p""")
def page_schemas(spark, d):
    """What a page's top objects say, and how many of its blocks are no JSON."""
    blocks = cut(structured.schema_blocks(_marked(spark, d)))
    rows = structured.page_schemas(blocks, structured.schema_nodes(blocks))
    return rows.select(F.col("page_ord").cast("long").alias("page_id"), "site", F.col("n_blocks").cast("int").alias("n_blocks"), F.col("n_malformed").cast("int").alias("n_malformed"), F.col("n_nodes").cast("int").alias("n_nodes"), F.array_join("types", ",").alias("types"), F.array_join("addresses", "; ").alias("addresses"), "is_local")


@query(f"""WITH {_PARTS}, t AS (SELECT site, page_id, 0 AS block, kind AS type FROM p UNION ALL SELECT site, page_id, 1, 'Product' FROM p WHERE size % 3 <> 0 UNION ALL SELECT site, page_id, 2, 'Event' FROM p WHERE size % 2 <> 0),
f AS (SELECT site, type, min((page_id, block)) AS place FROM t GROUP BY site, type) SELECT site, string_agg(type, ',' ORDER BY place) AS types FROM f GROUP BY site""")
def site_schema_types(spark, d):
    nodes = structured.schema_nodes(structured.schema_blocks(_marked(spark, d)))
    return structured.site_schema_types(nodes).select("site", F.array_join("types", ",").alias("types"))
