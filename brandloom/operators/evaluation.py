"""Accuracy of extraction against known brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import color as C, fonts as N

TOP, NEAR = 2, 10.0


def score_brands(expected: DataFrame, palette: DataFrame, fonts: DataFrame, logos: DataFrame, snapshots: DataFrame) -> DataFrame:
    """expected(site, colors array, fonts array) -> site, evaluated, color_hit, font_hit, logo_hit: a hit among the top two."""
    colours = palette.filter(F.col("rank") <= TOP).join(expected.select("site", F.explode("colors").alias("want")), "site")
    near = C.ciede2000(C.lab("hex"), C.lab("want")) < NEAR
    c = colours.groupBy("site").agg(F.max(near).alias("color_hit"))
    named = fonts.filter(F.col("rank") <= TOP).join(expected.select("site", F.explode("fonts").alias("want")), "site")
    f = named.groupBy("site").agg(F.max(N.names_match(F.col("name"), F.col("want"))).alias("font_hit"))
    s = expected.select("site").join(snapshots.select("site").distinct().withColumn("evaluated", F.lit(True)), "site", "left")
    s = s.join(c, "site", "left").join(f, "site", "left").join(logos.select("site", F.col("logo_url").isNotNull().alias("logo_hit")), "site", "left")
    no = F.lit(False)
    return s.select("site", F.coalesce("evaluated", no).alias("evaluated"), *[F.coalesce(h, no).alias(h) for h in ("color_hit", "font_hit", "logo_hit")])


def totals(scored: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row: evaluated, hits of each kind, total share, passed."""
    own = scored.filter("evaluated")
    hits = [F.coalesce(F.sum(F.col(h).cast("long")), F.lit(0)).alias(f"{h}s") for h in ("color_hit", "font_hit", "logo_hit")]
    s = own.agg(F.count("*").alias("n_evaluated"), *hits)
    total = F.when(F.col("n_evaluated") > 0, (F.col("color_hits") + F.col("font_hits") + F.col("logo_hits")) / (F.col("n_evaluated") * 3))
    return s.withColumn("total", total).withColumn("passed", F.coalesce(F.col("total") >= threshold, F.lit(False)))
