"""Queries over colours outside sRGB: every part as a colour of one of the wide spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spaces
from ..operators import colors
from ..sources.tables import table
from .catalog import query

_SPACES = ("display-p3", "rec2020", "a98-rgb", "prophoto-rgb", "xyz-d65", "srgb-linear")
#: Stored values of a part's colour, in steps that no byte falls halfway between.
_VALUES = ("p_partkey * 7 % 101", "p_size * 2 % 101", "p_partkey * 13 % 101")

# The published matrices of the web's colour spaces, linear values to XYZ and XYZ to linear sRGB.
_TO_XYZ = {
    "display-p3": ((608311 / 1250200, 189793 / 714400, 198249 / 1000160), (35783 / 156275, 247089 / 357200, 198249 / 2500400), (0.0, 32229 / 714400, 5220557 / 5000800)),
    "rec2020": ((63426534 / 99577255, 20160776 / 139408157, 47086771 / 278816314), (26158966 / 99577255, 472592308 / 697040785, 8267143 / 139408157), (0.0, 19567812 / 697040785, 295819943 / 278816314)),
    "a98-rgb": ((573536 / 994567, 263643 / 1420810, 187206 / 994567), (591459 / 1989134, 6239551 / 9945670, 374412 / 4972835), (53769 / 1989134, 351524 / 4972835, 4929758 / 4972835)),
    "prophoto-rgb": ((0.7977666449006423, 0.13518129740053308, 0.0313477341283922), (0.2880748288194013, 0.711835234241873, 0.00008993693872564), (0.0, 0.0, 0.8251046025104602)),
    "xyz-d65": ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)),
}
_D50_TO_D65 = ((0.9554734527042182, -0.023098536874261423, 0.0632593086610217), (-0.028369706963208136, 1.0099954580058226, 0.021041398966943008), (0.012314001688319899, -0.020507696433477912, 1.3303659366080753))
_FROM_XYZ = ((12831 / 3959, -329 / 214, -1974 / 3959), (-851781 / 878810, 1648619 / 878810, 36519 / 878810), (705 / 12673, -2585 / 12673, 705 / 667))


def _times(a, b):
    return tuple(tuple(sum(x * y for x, y in zip(row, column)) for column in zip(*b)) for row in a)


_MATRIX = {s: _times(_FROM_XYZ, _times(_D50_TO_D65, m) if s == "prophoto-rgb" else m) for s, m in _TO_XYZ.items()} | {"srgb-linear": _TO_XYZ["xyz-d65"]}
_CURVE = {
    "display-p3": "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END",
    "rec2020": "CASE WHEN {0} < 0.081243 THEN {0} / 4.5 ELSE pow(({0} + 0.09929682680944) / 1.09929682680944, 1 / 0.45) END",
    "a98-rgb": "pow({0}, 563 / 256)", "prophoto-rgb": "CASE WHEN {0} <= 0.03125 THEN {0} / 16 ELSE pow({0}, 1.8) END", "xyz-d65": "{0}", "srgb-linear": "{0}",
}
_ROW = lambda i: "CASE " + " ".join(f"WHEN space = '{s}' THEN {' + '.join(f'({m!r}::DOUBLE) * l{k}' for k, m in enumerate(_MATRIX[s][i]))}" for s in _SPACES) + " END"
_DECODED = lambda k: "CASE " + " ".join(f"WHEN space = '{s}' THEN {_CURVE[s].format(f'v{k}')}" for s in _SPACES) + " END"
_BYTE = lambda c: f"lpad(to_hex(CAST(floor(CASE WHEN {c} <= 0.0031308 THEN 12.92 * greatest(0, {c}) ELSE 1.055 * pow(least(1, {c}), 1 / 2.4) - 0.055 END * 255 + 0.5) AS INT)), 2, '0')"


@query(f"""WITH p AS (SELECT p_partkey, [{', '.join(repr(s) for s in _SPACES)}][p_partkey % 6 + 1] AS space, {', '.join(f'({v} + 0.3::DOUBLE) / 101.7::DOUBLE AS v{k}' for k, v in enumerate(_VALUES))} FROM part),
d AS (SELECT *, {', '.join(f'{_DECODED(k)} AS l{k}' for k in range(3))} FROM p), m AS (SELECT p_partkey, space, {', '.join(f'{_ROW(i)} AS {c}' for i, c in enumerate('rgb'))} FROM d),
i AS (SELECT *, least(r, g, b) >= 0.001 AND greatest(r, g, b) <= 0.999 AS inside FROM m)
SELECT p_partkey, space, round(r, 3) + 0.0 AS r, round(g, 3) + 0.0 AS g, round(b, 3) + 0.0 AS b, inside, CASE WHEN inside THEN lower('#' || {_BYTE('r')} || {_BYTE('g')} || {_BYTE('b')}) END AS hex FROM i""")
def wide_colours(spark, d):
    """Each part's colour as linear sRGB, and as written in a style sheet where sRGB holds it."""
    values = [(F.expr(v) + 0.3) / 101.7 for v in _VALUES]
    space = F.element_at(F.array(*[F.lit(s) for s in _SPACES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", space.alias("space"), *[v.alias(f"v{k}") for k, v in enumerate(values)])
    linear = None
    for s in _SPACES:
        own = spaces.linear_srgb(s, *[F.col(f"v{k}") for k in range(3)])
        linear = F.when(F.col("space") == s, own) if linear is None else linear.when(F.col("space") == s, own)
    text = F.concat(F.lit("color("), "space", *[F.concat(F.lit(" "), F.col(f"v{k}").cast("string")) for k in range(3)], F.lit(")"))
    rows = rows.withColumn("c", linear).withColumn("hex", colors.written_colour(text))
    inside = (F.least("c.r", "c.g", "c.b") >= 0.001) & (F.greatest("c.r", "c.g", "c.b") <= 0.999)
    return rows.select("p_partkey", "space", *[(F.round(f"c.{n}", 3) + 0.0).alias(n) for n in "rgb"], inside.alias("inside"), F.when(inside, F.col("hex")).alias("hex"))
