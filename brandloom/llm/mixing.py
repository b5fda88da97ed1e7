"""Mixing sources to target weights, in DataFrame functions only.

Tokens are summed per source. A source's target is its share of the total by weight, limited to `max_rate` times its
size; what a limit cuts off is shared again by weight among the others. In closed form: order the sources by
limit / weight; with the k cheapest limits fixed, the rest share at level (total - fixed limits) / rest of the weights, and a
source is limited exactly if its own ratio is not above the level computed with the sources before it fixed. Every
document is then emitted floor(rate) times plus one Bernoulli copy with probability rate - floor(rate), drawn from a
hash of the seed and the doc_id, so reruns agree.

The per-source table is the only thing gathered (one row per source, after map-side sums); documents are joined to it by
source, where it is broadcast only if Spark's own size limit allows.

Defined cases: null text has size 0; a null source is a source of its own, last in order; sources of size 0 get target 0
and rate 0; empty tables give empty results; equal rows draw the same copy; a null doc_id draws like an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_RATE = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """sizes(source, source_size) -> the same with target. One row per source; the windows run over that table only."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    ranked = sizes.withColumn("_i", (F.row_number().over(everything) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_rate))).withColumn("_all", F.sum("source_size").over(whole) * F.lit(share))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    ranked = ranked.withColumn("_level", level).withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    free = F.min(F.when(~F.col("_full"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(whole)["l"]
    return ranked.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * free).alias("target"))


def mix_counts(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """docs + size, source_size, target, copies, taken; one row per document."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options)
    targets = targets.withColumnRenamed("source", "_target_source")
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["_target_source"]), "left").drop("_target_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    draw = F.conv(F.substring(name, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")
    return joined.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


def emit_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns unchanged."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col("doc_id"), F.col("text"), F.col("source"))
    mixed = mix_counts(inner, **options)
    repeated = mixed.filter("copies > 0").select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return repeated.select(*[F.col("_doc").getField(c).alias(c) for c in names])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS w,
             source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM r),
t AS (SELECT source, source_size, CASE WHEN cap / w <= lvl THEN cap ELSE w * (SELECT arg_min(lvl, cap / w) FROM l WHERE cap / w > lvl) END AS target FROM l),
j AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
      FROM d LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM j
"""
