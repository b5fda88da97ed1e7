"""What each filter of a chain does, in every order of the chain: a Walsh-Hadamard audit.

A document's failures are a mask, one bit a filter. Per part and label class, one grouping sums the 2^k parities
(-1)^|mask & s| over all documents, for each set s of filters. The transform is its own inverse up to 2^k, so the sums give
back exactly how many documents have each mask, and every order, step and Shapley share follows from those 2^k cells: a filter
removes what it fails and no earlier filter fails, and of the k! orders a document that fails f filters is removed by each of them
in k!/f.

The one condition on other rows (a text that a smaller doc_id has, too) is decided by digest. Rows are summed per doc_id, text and part
first and per text, part, label and mask after that, so a text with any number of copies crosses the second shuffle as a few rows of each task.

Defined cases: null text counts as empty; null lang is the part ''; a null doc_id is larger than any other, has no labels, and rows
with equal doc_id are no copies of each other; labels that are null or absent count for neither label, several rows of a doc_id count if one says 1;
no documents give no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce
from itertools import permutations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10
MARKS = "[#$%&*|]"


def conditions(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, part, digest and booleans a to d: what a text fails on its own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("n_words", F.size("words")).withColumn("n_distinct", F.size(F.array_distinct("words")))
    return rows.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        (F.col("n_words") < MIN_WORDS).alias("a"),
        (100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words")).alias("b"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")) > MAX_CAPITALS * F.char_length("text")).alias("c"),
        F.col("text").rlike(MARKS).alias("d"),
    )


def _bits(*flags: Column) -> Column:
    return reduce(add, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)])


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: documents by what they fail (bit 0 is the first filter) and by label; few rows a text."""
    own = conditions(docs).select("doc_id", "part", "digest", _bits(*map(F.col, "abcd")).alias("own"))
    rows = own.groupBy("doc_id", "digest", "part", "own").agg(F.count("*").alias("n"))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    # a null doc_id comes last, and is nobody's first
    at = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n")
    alike = rows.groupBy("digest", "part", "own", "good", "toxic").agg(F.sum("n").alias("n"), F.min(at).alias("first"))
    least = F.min(F.struct("first.unnamed", "first.doc_id")).over(Window.partitionBy("digest"))
    alike = alike.withColumn("least", least)
    is_first = (F.col("first.unnamed") == F.col("least.unnamed")) & F.col("first.doc_id").eqNullSafe(F.col("least.doc_id"))
    stays = F.when(F.col("least.unnamed"), F.col("n")).when(is_first, F.col("first.n")).otherwise(0)
    counts = F.array(F.struct(F.col("own").alias("mask"), stays.alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - stays).alias("n")))
    cells = alike.select("part", "good", "toxic", F.explode(counts).alias("c")).select("part", "good", "toxic", "c.mask", "c.n")
    return cells.filter("n > 0")


def parity_sums(cells: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic, sums: for each set s of filters the signed sum of n by the parity of |mask & s|."""
    signs = [F.sum(F.col("n") * (1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2))).alias(f"s{s}") for s in range(1 << filters)]
    return cells.groupBy("part", "good", "toxic").agg(*signs).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(1 << filters)]).alias("sums"))


def mask_counts(sums: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic, cells: the sums transformed back; cells[m] documents fail exactly the filters of mask m."""
    size = 1 << filters
    every = F.sequence(F.lit(0), F.lit(size - 1))
    signed = lambda m: F.aggregate(F.transform("sums", lambda v, s: v * (1 - 2 * (F.bit_count(m.bitwiseAND(s)) % 2))), F.lit(0).cast("long"), lambda x, v: x + v)
    return sums.select("part", "good", "toxic", F.transform(every, lambda m: F.floor(signed(m) / size)).alias("cells"))


def order_steps(filters: str) -> Column:
    """All orders of the filters and their steps: the filter's bit and the mask of those before it. A constant."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    steps = [{"filter_order": "".join(p), "step": k + 1, "bit": bit[f], "before": sum(bit[x] for x in p[:k])} for p in permutations(filters) for k, f in enumerate(p)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """failure_cells' rows -> one row per part, order of the filters and step."""
    k, orders = len(filters), factorial(len(filters))
    by_label = mask_counts(parity_sums(cells, k), k)
    summed = lambda name, kept: [F.sum(F.when(kept, F.col("cells")[m]).otherwise(0)).alias(f"{name}{m}") for m in range(1 << k)]
    parts = by_label.groupBy("part").agg(*summed("n", F.lit(True)), *summed("g", F.col("good") == 1), *summed("t", F.col("toxic") == 1))
    parts = parts.select("part", *[F.array(*[f"{x}{m}" for m in range(1 << k)]).alias(x) for x in "ngt"])
    rows = parts.select("part", *"ngt", F.explode(order_steps(filters)).alias("o")).select("part", *"ngt", "o.*")

    def count(values: str, test) -> Column:
        return F.aggregate(F.transform(values, lambda v, m: F.when(test(m.cast("int")), v).otherwise(0)), F.lit(0).cast("long"), lambda x, v: x + v)

    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) > 0
    gone = lambda m: m.bitwiseAND(before) > 0
    here = lambda m: fails(m) & ~gone(m)
    shares = F.transform("n", lambda v, m: F.when(fails(m.cast("int")), v * F.floor(F.lit(orders) / F.greatest(F.bit_count(m), F.lit(1)))).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        count("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        count("n", here).alias("removed"),
        count("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        count("n", lambda m: m == bit).alias("unique_fails"),
        count("g", here).alias("good_lost"),
        count("t", here).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda x, v: x + v).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole texts."""
    return audit(failure_cells(docs, labels))


#: Straight from the conditions, without masks or transforms: each order's first failure by document.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS r FROM t),
u AS (SELECT *, len(words) AS n_words, len(list_distinct(words)) AS n_distinct, min(doc_id) OVER (PARTITION BY text) AS first_id FROM w),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, concat(CASE WHEN n_words < 100 THEN 'A' ELSE '' END, CASE WHEN 100 * n_distinct < 80 * n_words THEN 'B' ELSE '' END,
        CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
        CASE WHEN first_id < coalesce(u.doc_id, 9223372036854775807) THEN 'E' ELSE '' END) AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM u LEFT JOIN l ON u.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT concat(a.k, b.k, c.k, d.k, e.k) AS filter_order FROM x a JOIN x b ON b.k <> a.k JOIN x c ON c.k NOT IN (a.k, b.k) JOIN x d ON d.k NOT IN (a.k, b.k, c.k) JOIN x e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
h AS (SELECT part, fails, n, good, toxic, filter_order, list_min(list_transform(string_split(fails, ''), lambda z: CASE WHEN z = '' THEN 9 ELSE instr(filter_order, z) END)) AS gone_at FROM g, o),
y AS (SELECT h.part, s.filter_order, s.step, sum(n) FILTER (gone_at > step) AS kept, sum(n) FILTER (gone_at = step) AS removed, sum(n) FILTER (gone_at < step AND contains(fails, s.filter_order[step])) AS redundant,
        sum(n) FILTER (fails = s.filter_order[step]) AS unique_fails, sum(good) FILTER (gone_at = step) AS good_lost, sum(toxic) FILTER (gone_at = step) AS toxic_lost, s.filter_order[step] AS k
      FROM h JOIN s ON h.filter_order = s.filter_order GROUP BY h.part, s.filter_order, s.step),
z AS (SELECT part, filter_order[gone_at] AS k, sum(n) AS shapley FROM h WHERE gone_at < 9 GROUP BY 1, 2)
SELECT y.part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(shapley, 0) AS BIGINT) AS shapley
FROM y LEFT JOIN z ON y.part = z.part AND y.k = z.k
"""
