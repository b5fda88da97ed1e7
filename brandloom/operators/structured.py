"""Structured data (JSON-LD) of pages, as VARIANT values walked by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

# Types of places that customers visit; parts of an address in order.
LOCAL_TYPES = (
    "LocalBusiness", "Restaurant", "Store", "MedicalBusiness", "LegalService", "FinancialService", "RealEstateAgent", "AutoDealer", "Hotel",
    "SportsActivityLocation", "EntertainmentBusiness", "FoodEstablishment",
)
ADDRESS_PARTS = ("streetAddress", "addressLocality", "addressRegion", "postalCode")
#: Levels of nesting that are walked; JSON-LD seldom has more than ten.
LEVELS = 100
PAGE = ("site", "page_ord")


def schema_blocks(parsed: DataFrame) -> DataFrame:
    """parsed(site, page_ord, schema_blocks array<string>) -> site, page_ord, block, v: a row for each block; v is null where the text is no JSON.

    As with JSON.parse, nothing may follow the value, and there are no comments, single quotes or NaN. An object that has a key twice is no JSON here.
    """
    rows = parsed.select(*PAGE, F.posexplode("schema_blocks").alias("block", "raw"))
    # VARIANT takes a text's first value and leaves the rest unread; in both of these places nothing but white space can stand after it
    in_list, in_object = F.concat(F.lit("["), "raw", F.lit("]")), F.concat(F.lit('{"x":'), "raw", F.lit("}"))
    alone = F.try_parse_json(in_list).isNotNull() & F.try_parse_json(in_object).isNotNull()
    return rows.select(*PAGE, "block", F.when(alone, F.try_parse_json("raw")).alias("v"))


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _text(v: Column) -> Column:
    """A value as JavaScript would print it; null for what counts as nothing: null, false, 0 and ''."""
    plain = F.try_variant_get(v, "$", "string")
    return F.when(~F.is_variant_null(v) & ~plain.isin("", "0", "false"), plain)


def schema_nodes(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every object of every block that names a type or stands at the top: site, page_ord, block, path, top, types, address, node.

    Levels are opened one after the other by variant_explode, so a block of any width is rows, not one value in a task. `top` marks a block's own object, or the items of
    a block that is a list. types are the texts of @type; address joins the parts that are there.
    """
    # the first level is read twice, for its objects and for what they hold: pages are parsed once for both
    level = cut(blocks.filter("v is not null").select(*PAGE, "block", F.lit("$").alias("path"), F.lit(True).alias("top"), "v"))
    found = None
    for _ in range(levels):
        objects = level.filter(_is(F.col("v"), "OBJECT"))
        kind = F.try_variant_get("v", '$["@type"]', "variant")
        several = F.transform(F.filter(F.try_variant_get(kind, "$", "array<variant>"), lambda t: F.schema_of_variant(t) == "STRING"), lambda t: F.try_variant_get(t, "$", "string"))
        types = F.when(F.schema_of_variant(kind) == "STRING", F.array(F.try_variant_get(kind, "$", "string"))).when(_is(kind, "ARRAY"), several)
        parts = F.array_compact(F.array(*[_text(F.try_variant_get("v", f"$.address.{p}", "variant")) for p in ADDRESS_PARTS]))
        nodes = objects.select(*PAGE, "block", "path", "top", types.alias("types"), F.when(F.size(parts) > 0, F.array_join(parts, ", ")).alias("address"), F.col("v").alias("node")).filter("top or types is not null")
        found = nodes if found is None else found.unionByName(nodes)
        inside = level.withColumnRenamed("path", "_over").withColumnRenamed("top", "_top").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.col("key"))).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        listed = F.col("_top") & (F.col("_over") == "$") & F.col("key").isNull()
        inside = inside.select(*PAGE, "block", F.concat("_over", step).alias("path"), listed.alias("top"), F.col("value").alias("v"))
        level = cut(inside.filter(_is(F.col("v"), "OBJECT") | _is(F.col("v"), "ARRAY")))
        if level.isEmpty():
            break
    return found


def is_local(types: Column) -> Column:
    return F.exists(types, lambda t: t.rlike("|".join(LOCAL_TYPES)))


def page_schemas(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """site, page_ord, n_blocks, n_malformed, n_nodes, types (of top objects, each once, in order), addresses (of top objects), is_local."""
    counts = blocks.groupBy(*PAGE).agg(F.count("*").alias("n_blocks"), F.count_if(F.col("v").isNull()).alias("n_malformed"))
    item = F.coalesce(F.regexp_extract("path", r"^\$\[(\d+)\]$", 1).try_cast("int"), F.lit(0))
    place = F.struct("block", item.alias("item"))
    top = lambda value: F.transform(F.array_sort(F.collect_list(F.when(F.col("top"), F.struct(place.alias("place"), value.alias("value"))))), lambda x: x["value"])
    empty = F.array().cast("array<string>")
    described = nodes.groupBy(*PAGE).agg(
        F.count_if(F.col("types").isNotNull()).alias("n_nodes"),
        F.array_distinct(F.flatten(top(F.coalesce("types", empty)))).alias("types"),
        F.array_compact(top(F.col("address"))).alias("addresses"),
        F.coalesce(F.bool_or(F.col("top") & is_local(F.coalesce("types", empty))), F.lit(False)).alias("is_local"),
    )
    joined = counts.join(described, [*PAGE], "left")
    return joined.select(*PAGE, "n_blocks", "n_malformed", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("types", empty).alias("types"), F.coalesce("addresses", empty).alias("addresses"), F.coalesce("is_local", F.lit(False)).alias("is_local"))


def site_schema_types(nodes: DataFrame) -> DataFrame:
    """site, types: the distinct types of top objects over a site's pages in order."""
    item = F.coalesce(F.regexp_extract("path", r"^\$\[(\d+)\]$", 1).try_cast("int"), F.lit(0))
    each = nodes.filter("top").select("site", F.struct("page_ord", "block", item.alias("item")).alias("place"), F.posexplode("types").alias("k", "type"))
    first = each.groupBy("site", "type").agg(F.min(F.struct("place", "k")).alias("place"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("site").orderBy("place")))
    return ranked.groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "type"))), lambda x: x["type"]).alias("types"))
