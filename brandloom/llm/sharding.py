"""Sharding by longest processing time: groups that stay together go, largest first, to the least-loaded shard.

The rule is a heap's: pop the shard with the least load (the lower number on a tie), give it the next group, push it back. Groups are
equal texts. What the heap does depends on sizes alone, and groups of one size follow each other, so the heap's run goes over
(size, number of groups), largest first: one row per distinct size, at most sqrt(2 x all bytes) of them since sizes are distinct integers
(14 million for 100 TB, 16 bytes each). A run of equal groups fills the lowest shards level by level, so the heap hands out whole levels at
once, and the shard of the i-th group of a size follows from the loads before the run in closed form. So no task sees more than the sizes, and
groups are placed where they lie.

Numbers within a size class and slots within a shard come from counts by bucket, summed over at most 4,096 buckets, and numbering within a bucket:
no class and no shard is sorted as one. A text with a billion copies is one group; its copies spread over the buckets of their shard.

Defined cases: null text counts as empty, and is the same group; rows count separately, repeated ones too; a null doc_id comes first within its bucket;
of equal sizes the smaller SHA-256 goes first; an empty table gives an empty result. A group larger than a fair share has a shard to itself as far as
the others allow: groups are never split. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

SHARDS = 8


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, digest; the one reading of the texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """The loads after `count` groups of one size went to the least-loaded shard, one after the other.

    A shard's level is load // size. Shards on the lowest level take one group each, in order of (load % size, shard), and so rise by one level
    together, until the next shard's level is reached: whole levels are dealt at once, and the heap holds the shards that still wait above.
    """
    waiting = [(load // size, load % size, k) for k, load in enumerate(loads)]
    heapq.heapify(waiting)
    after, active, level = list(loads), [], waiting[0][0]
    while count:
        while waiting and waiting[0][0] == level:
            active.append(heapq.heappop(waiting)[1:])
        rounds = count // len(active)
        if waiting:
            rounds = min(rounds, waiting[0][0] - level)
        if rounds:
            for _, k in active:
                after[k] += rounds * size
            count -= rounds * len(active)
            level += rounds
        else:
            for _, k in sorted(active)[:count]:
                after[k] += size
            count = 0
    return after


def schedule(classes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """classes(total, n): n groups of `total` bytes, one row per size -> total, loads: the shards' loads when the first of them is placed."""

    def run(batches):
        loads = [0] * shards
        for batch in batches:
            totals, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            before = []
            for total, n in zip(totals, counts):
                before.append(loads)
                loads = deal(loads, total, n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(before, pa.list_(pa.int64()))], ["total", "loads"])

    # one task, and one row per distinct size for it
    ordered = classes.select("total", "n").repartition(1).sortWithinPartitions(F.desc("total"))
    return ordered.mapInArrow(run, "total long, loads array<long>")


def place_groups(ranked: DataFrame) -> DataFrame:
    """ranked(total, loads, i, ...) + shard: where the heap put the i-th group (from 0) of a size that found these loads.

    Its pushes are the smallest of all (load + t * size, shard). Below level v there are sum(max(0, v - level of a shard)) of them; with the m lowest
    shards active, v is (i + the sum of their levels) div m, valid where it lies between the m-th and the next level, and the remainder is the place
    among the active shards by (load % size, shard).
    """
    rows = ranked.withColumn("_by_level", F.expr("array_sort(transform(loads, (x, k) -> named_struct('level', x div total, 'rest', x % total, 'shard', k)))"))
    tried = "transform(sequence(1, size(_by_level)), m -> named_struct('m', m, 'sum', i + aggregate(slice(_by_level, 1, m), 0L, (a, x) -> a + x.level)))"
    valid = "p.sum div p.m >= _by_level[p.m - 1].level and (p.m = size(_by_level) or p.sum div p.m < _by_level[p.m].level)"
    rows = rows.withColumn("_run", F.expr(f"filter({tried}, p -> {valid})[0]"))
    active = "array_sort(transform(slice(_by_level, 1, _run.m), x -> named_struct('rest', x.rest, 'shard', x.shard)))"
    return rows.withColumn("shard", F.expr(f"cast({active}[cast(_run.sum % _run.m as int)].shard as int)")).drop("_by_level", "_run")


def _leading(hexadecimal: Column) -> Column:
    """A bucket by the first twelve bits: a hot size class or shard is numbered in 4,096 parts."""
    return F.conv(F.substring(hexadecimal, 1, 3), 16, 10).cast("int")


def _starts(counts: DataFrame, by: str) -> DataFrame:
    """counts(by, bucket, n) -> by, bucket, start: how many come before a bucket of its class; at most 4,096 rows a class."""
    before = Window.partitionBy(by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(by, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("start"))


def group_shards(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """sizes(digest, size) of rows -> digest, shard of each group of equal digests."""
    groups = cut(sizes.groupBy("digest").agg(F.sum("size").alias("total")).withColumn("bucket", _leading(F.hex("digest"))))
    counts = groups.groupBy("total", "bucket").agg(F.count("*").alias("n"))
    plan = schedule(counts.groupBy("total").agg(F.sum("n").alias("n")), shards)
    places = _starts(counts, "total").join(plan, "total")
    nth = F.row_number().over(Window.partitionBy("total", "bucket").orderBy("digest"))
    ranked = groups.join(places, ["total", "bucket"]).withColumn("i", (F.col("start") + nth - 1).cast("long"))
    return place_groups(ranked).select("digest", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per document."""
    rows = cut(measured(docs))
    placed = cut(group_shards(rows, shards))
    named = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.lower(F.hex("digest"))).cast("binary"))
    joined = cut(rows.join(placed, "digest").withColumn("bucket", _leading(named)))
    # at most 4,096 rows a shard
    starts = F.broadcast(_starts(joined.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "digest"))
    return joined.join(starts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + nth - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


#: The heap as a recursion over groups, one step a group; CRC-32 over the bytes by its table.
ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits),
d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
u AS (SELECT sha, list_transform(range(len(hx) // 2), lambda i: ('0x' || hx[2 * i + 1:2 * i + 2])::INT::BIGINT) AS bytes FROM (SELECT sha, hex(encode(any_value(text))) AS hx FROM d GROUP BY sha)),
c AS (SELECT sha, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM u, tab),
g AS (SELECT sha, row_number() OVER (ORDER BY sum(size) DESC, sha) AS i, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY sha),
lpt AS (SELECT 0::BIGINT AS i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0] AS loads, NULL::BIGINT AS k
        UNION ALL SELECT g.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + total ELSE x END), CAST(list_position(loads, list_min(loads)) AS BIGINT) FROM lpt JOIN g ON g.i = lpt.i + 1),
p AS (SELECT doc_id, size, d.sha, crc, CAST(k - 1 AS INT) AS shard FROM d JOIN c ON d.sha = c.sha JOIN g ON d.sha = g.sha JOIN lpt ON lpt.i = g.i)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || sha), 1, 3), doc_id NULLS FIRST, sha) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
