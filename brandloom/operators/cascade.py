"""The CSS cascade over many pages: elements and rules as tables, matched by joins.

Elements know their tag, id, classes, attributes, parent, left neighbour and the elements above them. Rules are indexed by the rarest part of each of
their compounds (an id, else a class, else a tag), so a compound meets only elements of its page that have that part. A selector of several compounds is followed from
left to right: the elements a step reaches are joined to those its next compound fits, by parent, by any element above, by left neighbour or by an earlier
sibling. Winners go by importance, inline style, specificity and order; what an element does not declare comes from the nearest element above that does.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import selectors as S
from ..functions.css import Variables
from ..functions.html import tree_of
from ..functions.udf import arrow
from ..session import cut, small_batches

# The browser's own style sheet, as far as fonts and visibility go.
BOLD_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "b", "strong", "th")
MONOSPACE_TAGS = ("pre", "code", "kbd", "samp")
CONTROL_TAGS, CONTROL_FONT = ("button", "input", "select", "textarea"), "Arial"
HIDDEN_TAGS = ("head", "script", "style", "template", "title", "meta", "link", "base", "noscript", "datalist")
# Elements whose text tells a site's fonts.
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
TEXT_TAGS = ("p", "span", "a", "li", *HEADING_TAGS, "button", "label", "input", "textarea", "div", "td", "th", "blockquote", "figcaption", "strong", "em", "b", "i", "small")
INITIAL_FAMILY, INITIAL_WEIGHT = "serif", "400"
#: Width of the screen for media queries.
WIDTH = 1280

ELEMENT = (
    "el:int,parent:int,prev:int,above:array<int>,tag:string,id:string,classes:array<string>,attrs:map<string,string>,"
    "nth:int,n_nth:int,nth_typed:int,n_typed:int,has_text:boolean,style:array<struct<property:string,value:string,important:boolean>>"
)
_PARTS = "tag:string,ids:array<string>,classes:array<string>,attrs:array<struct<name:string,op:string,value:string,fold:boolean>>,nth:array<struct<a:int,b:int,last:boolean,typed:boolean>>,root:boolean,linked:boolean"
RULE = (
    "pos:int,faces:boolean,declared:array<struct<property:string,value:string,important:boolean>>,"
    f"selectors:array<struct<spec:array<int>,steps:array<struct<comb:string,{_PARTS},nots:array<struct<{_PARTS}>>>>>>"
)
PAGE = ("site", "page_ord")
#: Characters of markup whose elements a worker holds at a time; a single longer page is taken by itself.
TREE_SIZE = 1 << 16


@arrow(f"array<struct<{ELEMENT}>>", size=TREE_SIZE)
def _tree(html: pd.Series) -> pd.Series:
    return html.map(lambda text: [e | {"style": _inline(e["attrs"].get("style", ""))} for e in tree_of(text or "")])


def _inline(style: str) -> list[dict]:
    return [_said(d) for _, declared in S.rules(f"x{{{style}}}", 0) for d in declared] if ":" in style else []


def _said(declaration: tuple) -> dict:
    return dict(zip(("property", "value", "important"), declaration))


def page_elements(pages: DataFrame) -> DataFrame:
    """pages(site, page_ord, html) -> site, page_ord and ELEMENT, a row for each element in document order."""
    small_batches(pages.sparkSession)
    return pages.select(*PAGE, F.explode(_tree("html")).alias("e")).select(*PAGE, "e.*")


def page_rules(sheets: DataFrame, width: int = WIDTH) -> DataFrame:
    """sheets(site, page_ord, css_ord, css) -> site, page_ord, css_ord and RULE, a row for each rule that holds on a screen of this width; faces: an @font-face rule."""

    @arrow(f"array<struct<{RULE}>>")
    def parse(css: pd.Series) -> pd.Series:
        return css.map(lambda text: [{"pos": k, "faces": s.startswith("@"), "declared": [_said(d) for d in declared], "selectors": [] if s.startswith("@") else S.selectors(s)} for k, (s, declared) in enumerate(S.rules(text or "", width))])

    small_batches(sheets.sparkSession)
    return sheets.select(*PAGE, "css_ord", F.explode(parse("css")).alias("r")).select(*PAGE, "css_ord", "r.*")


def _fits(c: str) -> str:
    """SQL: the compound `c` fits the element's own columns; unknown positions and attributes do not fit."""
    told = "if(a.fold, lower(attrs[a.name]), attrs[a.name])"
    attribute = f"""CASE a.op WHEN '' THEN true WHEN '=' THEN {told} = a.value WHEN '~=' THEN a.value <> '' AND array_contains(split({told}, '\\\\s+'), a.value)
      WHEN '|=' THEN {told} = a.value OR startswith({told}, a.value || '-') WHEN '^=' THEN a.value <> '' AND startswith({told}, a.value)
      WHEN '$=' THEN a.value <> '' AND endswith({told}, a.value) WHEN '*=' THEN a.value <> '' AND contains({told}, a.value) ELSE false END"""
    index = "if(p.typed, if(p.last, n_typed - nth_typed + 1, nth_typed), if(p.last, n_nth - nth + 1, nth))"
    return f"""(({c}.tag IS NULL OR {c}.tag = tag) AND forall({c}.ids, x -> coalesce(x = id, false)) AND forall({c}.classes, x -> array_contains(classes, x))
      AND forall({c}.attrs, a -> attrs[a.name] IS NOT NULL AND {attribute})
      AND forall({c}.nth, p -> if(p.a = 0, {index} = p.b, ({index} - p.b) % p.a = 0 AND ({index} - p.b) div p.a >= 0))
      AND (NOT {c}.root OR parent IS NULL) AND (NOT {c}.linked OR tag IN ('a', 'area') AND attrs['href'] IS NOT NULL))"""


def matched_rules(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """Which elements each rule applies to: site, page_ord, css_ord, pos, el, spec (the most specific selector of the rule that matches)."""
    rule = [*PAGE, "css_ord", "pos", "k"]
    steps = rules.select(*PAGE, "css_ord", "pos", F.posexplode("selectors").alias("k", "s"))
    steps = steps.select(*rule, "s.spec", F.size("s.steps").alias("n"), F.expr("transform(s.steps, (x, j) -> get(s.steps, j + 1).comb)").alias("_next"), F.posexplode("s.steps").alias("step", "c"))
    key = F.when(F.size("c.ids") > 0, F.concat(F.lit("#"), F.col("c.ids")[0])).when(F.size("c.classes") > 0, F.concat(F.lit("."), F.col("c.classes")[0])).otherwise(F.coalesce("c.tag", F.lit("*")))
    steps = steps.withColumn("key", key).withColumn("next", F.get("_next", F.col("step"))).drop("_next")
    own = F.array_distinct(F.concat(F.array(F.lit("*"), F.col("tag")), F.when(F.col("id").isNotNull(), F.array(F.concat(F.lit("#"), F.col("id")))).otherwise(F.array()), F.transform("classes", lambda x: F.concat(F.lit("."), x))))
    met = elements.withColumn("key", F.explode(own)).join(steps, [*PAGE, "key"])
    met = met.filter(F.expr(f"{_fits('c')} AND forall(c.nots, o -> NOT {_fits('o')})"))
    met = cut(met.select(*rule, "el", "parent", "prev", "above", "spec", "n", "step", F.col("c.comb").alias("comb"), "next"))

    longest = met.agg(F.max("n")).first()[0] or 0
    reached = met.filter("step = 0").select(*rule, "el", "parent", "spec", "n", "step", "next")
    done = reached.filter("n = 1")
    for step in range(1, longest):
        # earlier siblings are known by their parent and the first of them, others by themselves
        plain = reached.filter("n > 1 and next <> '~'").select(*rule, F.col("el").alias("link"), F.lit(-1).alias("least"))
        elder = reached.filter("n > 1 and next = '~' and parent is not null").groupBy(*rule, (-F.col("parent") - 1).alias("link")).agg(F.min("el").alias("least"))
        links = F.when(F.col("comb") == ">", F.array("parent")).when(F.col("comb") == "+", F.array("prev")).when(F.col("comb") == "~", F.array(-F.col("parent") - 1)).otherwise(F.col("above"))
        here = met.filter(F.col("step") == step).withColumn("link", F.explode(links)).filter("link is not null")
        here = here.join(plain.unionByName(elder), [*rule, "link"]).filter("least < el")
        reached = here.groupBy(*rule, "el", "parent", "spec", "n", "step", "next").agg(F.count("*").alias("_ways")).drop("_ways")
        done = done.unionByName(reached.filter(F.col("n") == step + 1))
    return done.groupBy(*PAGE, "css_ord", "pos", "el").agg(F.max("spec").alias("spec"))


def declared_values(elements: DataFrame, rules: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """site, page_ord, el, property, value: the winning declaration of each element that has one, inherit and the like included."""
    wanted = rules.withColumn("declared", F.filter("declared", lambda d: d["property"].isin(*properties))).filter("not faces and size(declared) > 0 and size(selectors) > 0")
    wanted = cut(wanted)
    matched = matched_rules(elements, wanted)
    said = wanted.select(*PAGE, "css_ord", "pos", F.posexplode("declared").alias("at", "d"))
    order = F.struct(F.col("d.important").alias("important"), F.col("inline"), F.col("spec"), F.col("css_ord"), F.col("pos"), F.col("at"))
    from_rules = matched.join(said, [*PAGE, "css_ord", "pos"]).withColumn("inline", F.lit(False)).select(*PAGE, "el", "d", order.alias("order"))
    inline = elements.filter(F.size("style") > 0).select(*PAGE, "el", F.posexplode("style").alias("at", "d")).filter(F.col("d.property").isin(*properties))
    inline = inline.withColumns({"inline": F.lit(True), "spec": F.array(F.lit(0), F.lit(0), F.lit(0)), "css_ord": F.lit(0), "pos": F.lit(0)}).select(*PAGE, "el", "d", order.alias("order"))
    best = from_rules.unionByName(inline).groupBy(*PAGE, "el", F.col("d.property").alias("property")).agg(F.max_by("d.value", "order").alias("value"))
    own = [(F.col("tag").isin(*BOLD_TAGS), "font-weight", "bold"), (F.col("tag").isin(*MONOSPACE_TAGS), "font-family", "monospace"), (F.col("tag").isin(*CONTROL_TAGS), "font-family", CONTROL_FONT),
           (F.col("tag").isin(*CONTROL_TAGS), "font-weight", INITIAL_WEIGHT), (F.col("tag").isin(*HIDDEN_TAGS) | F.col("attrs")["hidden"].isNotNull(), "display", "none")]
    base = elements.select(*PAGE, "el", F.explode(F.array_compact(F.array(*[F.when(test & F.lit(p in properties), F.struct(F.lit(p).alias("property"), F.lit(v).alias("value"))) for test, p, v in own]))).alias("b")).select(*PAGE, "el", "b.property", F.col("b.value").alias("_base"))
    # an author's `revert` falls back to the browser's sheet
    joined = best.join(base, [*PAGE, "el", "property"], "full_outer")
    return joined.select(*PAGE, "el", "property", F.when(F.col("value").isNull() | (F.lower("value") == "revert"), F.coalesce("_base", "value")).otherwise(F.col("value")).alias("value"))


def inherited_values(elements: DataFrame, declared: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """site, page_ord, el + a column `values` per property: what an element and those above it declare, outermost first.

    elements(site, page_ord, el, above): those wanted. Values that mean the parent's are left out, so the last one is what holds.
    """
    passed = ~F.lower("value").isin("inherit", "unset", "revert", "revert-layer")
    own = declared.filter(F.col("property").isin(*properties) & passed).withColumnRenamed("el", "at")
    chain = elements.select(*PAGE, "el", F.posexplode(F.concat(F.reverse("above"), F.array("el"))).alias("depth", "at"))
    found = chain.join(own, [*PAGE, "at"])
    gathered = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("property") == p, F.struct("depth", "value")))), lambda x: x["value"]).alias(p)
    lists = found.groupBy(*PAGE, "el").agg(*[gathered(p) for p in properties])
    empty = F.array().cast("array<string>")
    return elements.select(*PAGE, "el").join(lists, [*PAGE, "el"], "left").select(*PAGE, "el", *[F.coalesce(F.col(f"`{p}`"), empty).alias(p) for p in properties])


def computed_weight(values: Column) -> Column:
    """A font weight from what stands above and here: words to numbers, bolder and lighter from the weight so far."""
    def step(now: Column, value: Column) -> Column:
        v = F.lower(F.trim(value))
        bolder = F.when(now < 350, 400).when(now < 550, 700).otherwise(F.greatest(now, F.lit(900)))
        lighter = F.when(now < 100, now).when(now < 550, 100).when(now < 750, 400).otherwise(700)
        number = v.try_cast("double").cast("int")
        return F.when(v.isin("normal", "initial"), 400).when(v == "bold", 700).when(v == "bolder", bolder).when(v == "lighter", lighter).otherwise(F.coalesce(F.when((number >= 1) & (number <= 1000), number), now))

    return F.aggregate(values, F.lit(int(INITIAL_WEIGHT)), step)


@arrow("string")
def _substituted(value: pd.Series, variables: pd.Series) -> pd.Series:
    return pd.Series([Variables(dict(v or ())).resolve(s) if s is not None else None for s, v in zip(value, variables)], dtype=object)


def root_variables(rules: DataFrame) -> DataFrame:
    """site, page_ord, variables: the last value of each custom property that a rule for :root, html or body sets, over a page's sheets in order."""
    plain = "exists(selectors, s -> size(s.steps) = 1 AND size(s.steps[0].classes) = 0 AND size(s.steps[0].ids) = 0 AND (s.steps[0].root OR s.steps[0].tag IN ('html', 'body')))"
    rows = rules.filter(F.expr(plain)).select(*PAGE, "css_ord", "pos", F.posexplode("declared").alias("at", "d")).filter(F.startswith(F.col("d.property"), F.lit("--")))
    last = rows.groupBy(*PAGE, F.col("d.property").alias("property")).agg(F.max_by("d.value", F.struct("css_ord", "pos", "at")).alias("value"))
    return last.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("variables"))


def first_family(stack: Column) -> Column:
    return F.trim(F.regexp_replace(F.split_part(stack, F.lit(","), F.lit(1)), "['\"]", ""))


def text_styles(elements: DataFrame, rules: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Computed family and weight of each visible text element: site, page_ord, el, tag, font, weight, is_heading.

    variables(site, page_ord, variables map) holds the custom properties for var(); a name that stays unresolved stays in `font` as it is.
    """
    asked = elements.filter(F.col("tag").isin(*TEXT_TAGS) & F.col("has_text")).select(*PAGE, "el", "above", "tag")
    properties = ("font-family", "font-weight", "display", "visibility", "opacity")
    declared = cut(declared_values(elements, rules, properties))
    held = inherited_values(asked, declared, ("font-family", "font-weight", "visibility"))
    off = declared.filter("property = 'display' and lower(value) = 'none'").select(*PAGE, F.col("el").alias("at"))
    clear = declared.filter("property = 'opacity' and (try_cast(value as double) = 0 or value = '0%')").select(*PAGE, "el")
    gone = asked.select(*PAGE, "el", F.explode(F.concat("above", F.array("el"))).alias("at")).join(off, [*PAGE, "at"]).select(*PAGE, "el").unionByName(clear).distinct()
    rows = asked.join(held, [*PAGE, "el"]).join(gone, [*PAGE, "el"], "left_anti")
    rows = rows.filter(~F.lower(F.coalesce(F.try_element_at("visibility", F.lit(-1)), F.lit("visible"))).isin("hidden", "collapse"))
    stack = F.coalesce(F.try_element_at(F.col("`font-family`"), F.lit(-1)), F.lit(INITIAL_FAMILY))
    rows = rows.select(*PAGE, "el", "tag", F.when(F.lower(stack) == "initial", INITIAL_FAMILY).otherwise(stack).alias("stack"), computed_weight(F.col("`font-weight`")).cast("string").alias("weight"))
    if variables is not None:
        stacks = rows.filter("stack like '%var(%'").select(*PAGE, "stack").distinct().join(variables, [*PAGE], "left")
        resolved = stacks.select(*PAGE, "stack", _substituted("stack", F.coalesce("variables", F.create_map().cast("map<string,string>"))).alias("_put"))
        resolved = resolved.withColumn("_put", F.when(~F.col("_put").contains("__unresolved__"), F.col("_put")))
        rows = rows.join(resolved, [*PAGE, "stack"], "left").withColumn("stack", F.coalesce("_put", "stack")).drop("_put")
    return rows.select(*PAGE, "el", "tag", first_family(F.col("stack")).alias("font"), "weight", F.col("tag").isin(*HEADING_TAGS).alias("is_heading"))
