"""Near-duplicate documents: HyperMinHash registers, banding, corrected estimates, exact confirmation.

1. Each text becomes its set of five-word shingles (64-bit hashes). Texts with equal sets form one class, named by its
   smallest doc_id; copies go no further.
2. A shingle's hash picks one of 160 buckets; of the rest, the bucket keeps the smallest value as a register of 16 bits:
   the number of leading zeros (6 bits) and the 10 bits that follow the first one. Empty buckets borrow the register of a
   bucket drawn by a fixed sequence of hashes, the same for every set, so that small sets band as large ones do.
3. Four registers make a band key, 40 keys a set. At a similarity of 0.75 a pair misses all keys with a probability
   of (1 - 0.75^4)^40, 3 in 10 million, if the set is large enough for its registers to be independent. Sets below SMALL shingles, and
   sets that can be linked with one, also (below SMALL: only) take as keys those shingles, in the order of their hashes, of which two linked sets must share one, and their pairs
   skip the estimate, so that small sets lose nothing.
4. In each bucket of a key, members are paired with a centre only (a linear number of pairs). The similarity is estimated
   from equal registers, less the share that collides by chance; pairs whose estimate is within five standard
   deviations of 0.75 go on and are confirmed on full sets. Every bucket has two centres: the member that shares most buckets, and one drawn by hash. Confirmed links are contracted to components.
5. In buckets that still hold several components, members are compared by estimate, in blocks of bounded size; rows between which
   candidate pairs run are tied into groups. Within a group, all candidate pairs across components are confirmed on full sets, block by
   block, and only links that join components are written. No bucket or group is capped, so no link is lost, and no list of
   pairs grows with the square of a group.

Defined cases: null, empty and blank texts have an empty set, are linked with nothing and stay; equal rows are
one class; rows that share a doc_id are told apart by their texts; a null doc_id stays null and sorts after all others, so a component has a null name only
if no row of it has a doc_id; empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut as _cut, small_batches
from .shingles import mix64, shingle_set, shingle_sets

#: Many passes follow each other here: the shuffle files of each are freed at the next cut.
cut = functools.partial(_cut, free=True)

BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
THRESHOLD = (75, 100)
#: Estimates from this value on are confirmed on full sets: 0.75 less five standard deviations of 160 registers.
CANDIDATE = 0.75 - 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: Sets with fewer shingles are not judged by registers.
SMALL = 16
#: Members compared with each other in one task, and the shingles that they have together, at most (in expectation).
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Links that one task looks through for circles at a time.
FOREST = 1_000_000
_BUCKETS = np.arange(REGISTERS, dtype=np.uint64)


@functools.cache
def _drawn(attempt: int) -> np.ndarray:
    """The bucket from which each empty bucket tries to borrow, by attempt; the same for every set."""
    seed = np.full(1, attempt + 1, np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return (mix64(_BUCKETS * np.uint64(0x9E3779B97F4A7C15) + seed) % np.uint64(REGISTERS)).astype(np.int64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """160 registers of a non-empty set: leading zeros and mantissa of each bucket's minimum, empty buckets filled."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(REGISTERS)).astype(np.int64)
    value = mix64(hashes ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(1)
    least = np.full(REGISTERS, np.uint64(2**63), np.uint64)
    np.minimum.at(least, bucket, value)
    filled = least < np.uint64(2**63)
    top = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1].astype(np.int64)  # bits used
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (least >> shift) & np.uint64(2**MANTISSA - 1)
    packed = (((63 - np.minimum(top, 63)).astype(np.uint64) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    source = np.arange(REGISTERS)
    for attempt in range(1_000_000):
        if (done := filled[source]).all():
            break
        source = np.where(done, source, _drawn(attempt))
    return packed[source]


def band_keys(packed: np.ndarray) -> np.ndarray:
    rows = packed.reshape(BANDS, ROWS).astype(np.uint64)
    key = (rows << np.array([48, 32, 16, 0], np.uint64)).sum(axis=1, dtype=np.uint64)
    return mix64(key ^ mix64(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def small_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys for a small set: its first shingles by hash. Sets linked at 75 % share one of their first n - ceil(0.75 n) + 1."""
    p, q = THRESHOLD
    n = len(hashes)
    return mix64(hashes[: n - -(-n * p // q) + 1] ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)


def keys_of(hashes: np.ndarray, packed: np.ndarray) -> np.ndarray:
    p, q = THRESHOLD
    small = len(hashes) * p < SMALL * q  # it can be linked with a set below SMALL
    return np.concatenate(([small_keys(hashes)] if small else []) + ([band_keys(packed)] if len(hashes) >= SMALL else []))


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that two unequal minima share a register: equal leading zeros, then equal mantissas.

    Minima of a and b elements are near-exponential; they fall in one cell of relative width w with probability
    w * ab / (a + b)^2, and the cells' mean relative width is 2^-10 / (2 ln 2).
    """
    a, b = np.maximum(n_a, 1.0), np.maximum(n_b, 1.0)
    return 2.0**-MANTISSA * 0.7213 * a * b / (a + b) ** 2


def estimate(equal_share: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal registers, corrected for collisions by chance."""
    c = chance(n_a, n_b)
    return (equal_share - c) / (1 - c)


def can_link(equal_share: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether the estimate can reach the threshold; pairs with a small set always go on."""
    return (estimate(equal_share, n_a, n_b) >= CANDIDATE) | (np.minimum(n_a, n_b) < SMALL)


SKETCH = "doc_id long, text_hash long, n_shingles long, set_id binary, sig binary, keys array<long>"


def _sketch(batches):
    for batch in batches:
        rows = []
        for doc_id, text_hash, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2).to_pylist())):
            if len(hashes):
                packed = registers(hashes)
                rows.append((doc_id, text_hash, len(hashes), xxhash.xxh3_128_digest(hashes), packed.tobytes(), keys_of(hashes, packed)))
            else:
                rows.append((doc_id, text_hash, 0, None, None, None))
        columns = list(zip(*rows)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "text_hash", "n_shingles", "set_id", "sig", "keys"])


def _hashed(docs: DataFrame) -> DataFrame:
    """docs -> doc_id, text_hash, text; the first two name a row's text."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _place() -> Column:
    """A row's name and its order: rows without a doc_id come last."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("text_hash").alias("text_hash"))


def sketches(docs: DataFrame) -> DataFrame:
    return _hashed(docs).mapInArrow(_sketch, SKETCH)


def _estimates(batches):
    """(a, b, n_a, n_b, sig_a, sig_b) -> pairs whose corrected estimate can reach the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5)]
        n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        keep = can_link((sig[0] == sig[1]).mean(axis=1), n_a, n_b)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])


def _confirm(batches):
    """(a, b, text_a, text_b) -> pairs linked on their full sets."""
    p, q = THRESHOLD
    for batch in batches:
        keep, last, known = [], None, None
        for text_a, text_b in zip(batch.column(2), batch.column(3)):
            one = shingle_set(text_a.as_py())
            if (raw := text_b.as_py()) != last:
                last, known = raw, shingle_set(raw)
            both = len(np.intersect1d(one, known, assume_unique=True))
            keep.append(q * both >= p * (len(one) + len(known) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _sized(pairs: DataFrame) -> DataFrame:
    """Without pairs whose set sizes alone rule the threshold out."""
    p, q = THRESHOLD
    return pairs.filter(F.least("n_a", "n_b") * q >= F.greatest("n_a", "n_b") * p)


def _promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) distinct -> those whose estimate can reach the threshold."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    return _sized(pairs.join(side("a"), "a").join(side("b"), "b")).select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_estimates, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) -> those linked on the full shingle sets; only texts that occur in a pair are moved."""
    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def _forest(batches):
    """(u, v) -> edges that join the same nodes without a circle, FOREST rows at a time."""
    held, n = [], 0

    def trees() -> pa.RecordBatch:
        ends = np.stack([np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)])
        nodes, places = np.unique(ends, return_inverse=True)
        root, kept = list(range(len(nodes))), []

        def top(node: int) -> int:
            while root[node] != node:
                root[node] = node = root[root[node]]
            return node

        for k, (u, v) in enumerate(places.reshape(2, -1).T.tolist()):
            if (u := top(u)) != (v := top(v)):
                root[max(u, v)] = min(u, v)
                kept.append(k)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in ends[:, kept]], ["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= FOREST:
            yield trees()
            held, n = [], 0
    if n:
        yield trees()


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, comp (smallest node reachable), by alternating stars; every pass is linear in the links.

    First each task leaves out links that close a circle among its own, so up to FOREST links become fewer than their nodes.
    """
    ends = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    edges = cut(ends.repartition(-(-ends.count() // FOREST) or 1, "v").mapInArrow(_forest, "u long, v long"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "u", "m")
        stars = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut(stars.distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
        before = state


def _labelled(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    return nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


class _Labels:
    """Components of one task's rows; `links` holds one pair for each merger, so it is never longer than the rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray):
        self.ids, self.links = ids, []
        self.of = np.unique(labels, return_inverse=True)[1]

    def join(self, i: int, others: np.ndarray) -> None:
        for label in np.unique(self.of[others]):
            if label != self.of[i]:
                j = others[np.flatnonzero(self.of[others] == label)[0]]
                self.links.append((int(min(self.ids[i], self.ids[j])), int(max(self.ids[i], self.ids[j]))))
                self.of[self.of == label] = self.of[i]

    def table(self) -> pa.Table:
        a, b = zip(*self.links) if self.links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rows_of(table: pa.Table):
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    return (*(table.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "side")), sig)


def _candidates(i: int, j: np.ndarray, n: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Those of rows j whose estimated similarity to row i can reach the threshold."""
    p, q = THRESHOLD
    j = j[np.minimum(n[j], n[i]) * q >= np.maximum(n[j], n[i]) * p]
    if not len(j):
        return j
    share = (sig[j] == sig[i]).mean(axis=1)
    return j[can_link(share, np.full(len(j), float(n[i])), n[j].astype(float))]


def _others(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first block, and those they are compared with: the second block, or the first where a block meets itself."""
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return first, second if len(second) else first


def _group_candidates(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Pairs that tie together, in one bucket, all rows between which candidate pairs across components run."""
    ids, comp, n, side, sig = _rows_of(table)
    rows, others = _others(side)
    groups = _Labels(ids, ids)
    for i in rows:
        j = _candidates(i, others[(comp[others] != comp[i]) & (groups.of[others] != groups.of[i])], n, sig)
        if len(j):
            groups.join(i, j)
    return groups.table()


def _link_exactly(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links on full sets between rows of one group whose components differ; rows with most candidates first."""
    p, q = THRESHOLD
    ids, comp, n, side, sig = _rows_of(table)
    sets = list(shingle_sets(table.column("text").to_pylist()))
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    rows, others = _others(side)
    linked = _Labels(ids, comp)
    promise = [(-len(_candidates(i, others[comp[others] != comp[i]], n, sig)), ids[i], i) for i in rows]
    for _, _, i in sorted(promise):
        j = _candidates(i, others[linked.of[others] != linked.of[i]], n, sig)
        for s in range(0, len(j), 256):
            part = j[s : s + 256]
            part = part[linked.of[part] != linked.of[i]]
            if not len(part):
                continue
            flat = np.concatenate([sets[k] for k in part])
            at = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            sizes = lengths[part]
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            linked.join(i, part[q * both >= p * (lengths[i] + sizes - both)])
    return linked.table()


def _dealt(rows: DataFrame, group: str) -> DataFrame:
    """rows(group, node, comp, n_shingles, ...) + x, y, side: each pair of blocks of a group is a task's work, blocks of about BLOCK rows by hash.

    A task never holds more than two blocks, however large the group and its texts.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("blocks"))
    placed = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    first = placed.withColumn("y", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).withColumn("x", F.col("block")).withColumn("side", F.lit(0))
    second = placed.filter("block > 0").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).withColumn("y", F.col("block")).withColumn("side", F.lit(1))
    return first.unionByName(second).drop("block", "blocks")


def near_components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per row of docs."""
    return _components_of(docs).drop("text_hash")


def _components_of(docs: DataFrame) -> DataFrame:
    """near_components with text_hash."""
    small_batches(docs.sparkSession)
    sketched = cut(sketches(docs))
    grouped = sketched.filter("n_shingles > 0").groupBy("set_id").agg(F.min(_place()).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    # classes are linked by a number of their own, for a doc_id may stand on several texts
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("node"), "least.*", "set_id", "n_shingles", "sig", "keys"))
    banded = classes.select("node", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = cut(banded.join(shared, "key"))
    texts = _hashed(docs).select(_place().alias("place"), "text").select("place.*", "text")
    named_text = classes.select("node", "nameless", "doc_id", "text_hash")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """One text of each class, with the set that the class stands for."""
        return cut(texts.join(named_text.join(nodes, "node", "left_semi"), ["nameless", "doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"]))

    def links(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        return cut(confirmed(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())))

    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    degree = members.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    weighed = members.join(degree, "node")
    to_centres = None
    for order in (F.struct((-F.col("degree")).alias("d"), F.xxhash64("node").alias("h")), F.xxhash64("node", F.lit(2))):
        centres = weighed.groupBy("key").agg(F.min_by("node", order).alias("b"))
        pairs = members.join(centres, "key").filter("node <> b").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b"))
        to_centres = pairs if to_centres is None else to_centres.unionByName(pairs)
    linked = links(_promising(to_centres.distinct(), classes))
    comp = cut(components(linked))

    rows = _labelled(members, comp)
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    facts = classes.select("node", "n_shingles", "sig")
    ties = cut(_dealt(rows.join(mixed, "key").select("key", "node", "comp").join(facts, "node"), "key").groupBy("key", "x", "y").applyInArrow(_group_candidates, "a long, b long").distinct())
    if not ties.isEmpty():
        groups = components(ties)
        tied = cut(ties.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        grouped = _labelled(tied, groups).withColumnRenamed("comp", "grp")
        known = texts_of(tied)
        blocks = _dealt(_labelled(grouped, comp).join(facts, "node"), "grp").join(known, "node")
        more = cut(blocks.groupBy("grp", "x", "y").applyInArrow(_link_exactly, "a long, b long"))
        comp = cut(components(linked.unionByName(more)))

    # a component is named by its smallest doc_id
    labelled = _labelled(classes.select("node", "set_id", F.struct("nameless", "doc_id", "text_hash").alias("least")), comp)
    first = labelled.groupBy("comp").agg(F.min("least").alias("first"))
    named = labelled.join(first, "comp").select("set_id", "first")
    out = sketched.select("doc_id", "text_hash", "n_shingles", "set_id").join(named, "set_id", "left")
    out = out.withColumn("first", F.coalesce("first", _place()))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(~F.col("first.nameless"), F.col("first.doc_id")).alias("component_id"), (_place() == F.col("first")).alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each near-duplicate group, columns unchanged; of identical rows one stays."""
    verdict = cut(_components_of(docs).groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("same")))
    gone = verdict.filter("not kept").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    same = docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"].cast("binary")) == gone["_gone_hash"])
    left = docs.join(gone, same, "left_anti")
    return left.dropDuplicates(["doc_id", "text"]) if not verdict.filter("kept and same > 1").isEmpty() else left
