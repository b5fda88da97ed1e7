"""Painted areas: how many pixels of each colour the first two screens of a page show, from boxes and their computed styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .colors import written_colour

PAGE = ("site", "page_ord", "page_url")
BORDER = "struct<side:string,width:double,style:string,color:string>"
BOX = (
    "site string, page_ord int, page_url string, el int, left double, top double, width double, height double, tag string, role string, input_type string, hidden boolean, brand_slot boolean, "
    f"background string, color string, fill string, font_size double, text_len int, borders array<{BORDER}>"
)
# Screen, elements looked at, tags that paint their fill, factors of areas.
SCREEN, MAX_ELEMENTS = (1920, 1080), 4000
DRAWN = ("path", "circle", "rect", "ellipse", "polygon", "polyline", "text")
SCREENS, ACTION, BRAND_MARK, DRAWING, LETTER, FONT_SIZE = 2, 4.0, 2.0, 0.15, 0.5, 16.0
CLEAR = ("rgba(0, 0, 0, 0)", "transparent")


def brand_slots(elements: DataFrame) -> DataFrame:
    """site, page_ord, el of elements (as cascade.page_elements gives them) in or below a header, a navigation, a banner, a link home or something called a logo."""
    attrs = F.col("attrs")
    slot = F.col("tag").isin("header", "nav") | (attrs["role"] == "banner") | (F.col("tag") == "a") & (attrs["href"] == "/") | F.lower(attrs["class"]).contains("logo")
    slots = elements.filter(slot).select("site", "page_ord", F.col("el").alias("at"))
    return elements.select("site", "page_ord", "el", F.explode(F.concat("above", F.array("el"))).alias("at")).join(slots, ["site", "page_ord", "at"]).select("site", "page_ord", "el").distinct()


def painted(boxes: DataFrame, screen: tuple[int, int] = SCREEN, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """boxes (BOX) -> site, page_ord, page_url, el, part, color, px: what each box paints within the first two screens.

    A box is cut to the screens; its background counts in full and four times for what one acts on, a drawing's fill twice in a brand's place and little elsewhere, text by its length and
    size as far as it shows and at most the box, borders by length and width. The first `max_elements` boxes of a page's body count; boxes of one number go by their other columns,
    so the result never depends on how rows lie.
    """
    wide, high = float(screen[0]), float(screen[1] * SCREENS)
    rest = [c for c in boxes.columns if c not in (*PAGE, "el")]
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("el", *rest))
    rows = boxes.filter(~F.lower("tag").isin("html", "body")).withColumn("tag", F.lower("tag")).withColumn("_n", nth).filter(F.col("_n") <= max_elements)
    across = F.least(F.lit(wide), F.col("left") + F.col("width")) - F.greatest(F.lit(0.0), F.col("left"))
    down = F.least(F.lit(high), F.col("top") + F.col("height")) - F.greatest(F.lit(0.0), F.col("top"))
    rows = rows.filter("width > 0 and height > 0 and not coalesce(hidden, false)").withColumns({"cw": across, "ch": down}).filter("cw > 0 and ch > 0")
    rows = rows.withColumn("clipped", F.col("cw") * F.col("ch")).withColumn("shown", F.col("clipped") / (F.col("width") * F.col("height")))
    none = F.lit("")
    acted = (F.col("tag") == "button") | (F.coalesce("role", none) == "button") | (F.col("tag") == "input") & F.lower(F.coalesce("input_type", none)).isin("submit", "button") | (F.col("tag") == "a") & F.col("background").isNotNull() & ~F.col("background").isin(*CLEAR)
    size = F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(FONT_SIZE)
    text = F.least(F.col("text_len") * size * size * LETTER * F.col("shown"), F.col("clipped"))

    def paint(part: str, color: Column, px: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), color.alias("color"), px.cast("double").alias("px"))

    edges = F.transform(F.filter("borders", lambda b: (b["width"] > 0) & ~F.coalesce(b["style"], none).isin("none", "hidden")), lambda b: F.struct(F.lit("border").alias("part"), b["color"].alias("color"), (F.when(b["side"].isin("top", "bottom"), F.col("cw")).otherwise(F.col("ch")) * b["width"]).alias("px")))
    own = F.concat(F.array(paint("background", F.col("background"), F.col("clipped") * F.when(acted, ACTION).otherwise(1.0)), paint("text", F.col("color"), F.when(F.col("text_len") > 0, text))), F.coalesce(edges, F.array()))
    drawn = F.array(paint("fill", F.col("fill"), F.col("clipped") * F.when(F.col("brand_slot"), BRAND_MARK).otherwise(DRAWING)))
    parts = F.when(F.col("tag").isin(*DRAWN), drawn).otherwise(own)
    return rows.select(*PAGE, "el", F.explode(parts).alias("p")).select(*PAGE, "el", "p.*").filter(F.col("color").isNotNull() & (F.col("px") > 0))


def painted_areas(boxes: DataFrame, screen: tuple[int, int] = SCREEN, max_elements: int = MAX_ELEMENTS) -> DataFrame:
    """boxes (BOX) -> site, page_ord, page_url, hex, px, as colors.signals takes them: colours at least half opaque, the page's canvas included.

    The canvas is the background of body, else of html, over the whole of the two screens; of several with one number, the greatest that is a colour.
    """
    by_text = painted(boxes, screen, max_elements).groupBy(*PAGE, "color").agg(F.sum("px").alias("px"))
    inside = by_text.select(*PAGE, written_colour("color").alias("hex"), "px")
    ground = lambda tag: F.max_by("hex", F.when(F.lower("tag") == tag, F.struct(-F.col("el"), "hex")))
    roots = boxes.filter(F.lower("tag").isin("html", "body")).select(*PAGE, "el", "tag", written_colour("background").alias("hex"))
    canvas = roots.groupBy(*PAGE).agg(F.coalesce(ground("body"), ground("html")).alias("hex"))
    canvas = canvas.withColumn("px", F.lit(float(screen[0] * screen[1] * SCREENS)))
    every = inside.unionByName(canvas).filter("hex is not null")
    return every.groupBy(*PAGE, "hex").agg(F.floor(F.sum("px") + 0.5).cast("long").alias("px")).filter("px > 0")
