"""A trie of conversations by their turns, in succinct level order (LOUDS), one trie per prefix shard.

A turn is known by the SHA-256 of its role and text; a node by its depth and the exclusive or of its path's labels, 128 bits that depend on
the turn and its place. Spark sums rows to distinct nodes first (a prefix that a third of all conversations share is one row of each
task from there on). Nodes under which more than `limit` turns lie are heavy: they make the upper trie, which is merged by itself. Below each stand whole
light subtrees, which are dealt to shards by hash.

A shard's trie is a LOUDS bitvector (for each node in level order a 1 per child and a 0), an array of labels and arrays of what ends at a node.
Levels, parents and depths are read back from the bits. Rollups run over the levels from the last to the first with numpy's add.at and
minimum.at: members, smallest member, leaves and saved tokens. The tops of all light subtrees are summed by the heavy node above them
and enter the upper trie's rollup as one row for each heavy node.

Bounds: the limit is at least SHARD_ROWS and at least the sum of n (n + 1) / 2 over conversations of n turns, divided by MAX_HEAVY, so there are
at most MAX_HEAVY heavy nodes (24 bytes each, broadcast), for each has more than `limit` of these. A shard has about SHARD_ROWS nodes, the largest
subtree has `limit`. A conversation's turns are numbered by one task, as narrow rows that spill. A node's ends pass through its SHA-256 in order, in constant memory.

Defined cases: null role or text is empty; a null turn comes first; turns of one number go by the SHA-256 of length, role and text; repeated rows
are turns of their own; a conversation without a number is none and is left out; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

SHARD_ROWS = 200_000
MAX_HEAVY = 1_000_000
SHARED_TURNS, FAMILY = 6, 100
_NONE = np.iinfo(np.int64).max

TRIE = "shard long, n_nodes long, n_tops long, louds binary, labels binary, above binary, depths binary, chars binary, ends binary, first_end binary, below binary"
NODE = "k1 long, k2 long, p1 long, p2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, is_top boolean"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, pos (from 1), digest, chars; the one reading of the texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(said.cast("binary"), 256)).alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "digest", "chars")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED_TURNS


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns -> (rebuilt turns: conv_id, d, digest, chars; conversations: conv_id, n)."""
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    wanted = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), shared_turns(F.col("conv_id")).alias("h"), "n_own")
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    wanted = wanted.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    wanted = cut(wanted.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))).alias("n")))
    first = turns.filter((F.col("pos") < SHARED_TURNS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = wanted.filter("taken > 0").join(first, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("d"), "digest", "chars")
    own = turns.join(wanted.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "digest", "chars")
    return taken.unionByName(own), wanted.select("conv_id", "n")


def paths(rebuilt: DataFrame) -> DataFrame:
    """rebuilt turns -> conv_id, d, n, chars, l1, l2 (the turn's label), k1, k2 (the node's key)."""
    labelled = rebuilt.select("conv_id", "d", "chars", F.xxhash64("digest", "d").alias("l1"), F.xxhash64("d", "digest").alias("l2"))
    so_far = Window.partitionBy("conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    key = lambda label: F.bit_xor(label).over(so_far)
    return labelled.withColumns({"k1": key("l1"), "k2": key("l2"), "n": F.count("*").over(Window.partitionBy("conv_id"))})


def distinct_nodes(walked: DataFrame, shard_rows: int = SHARD_ROWS, max_heavy: int = MAX_HEAVY) -> tuple[DataFrame, int]:
    """paths' rows -> (nodes: d, k1, k2, p1, p2, chars, ends, first_end, heavy, t1, t2 (the top of a light node's subtree), number of light nodes)."""
    bulk = walked.agg(F.sum(F.expr("n - d + 1"))).first()[0] or 0
    limit = max(shard_rows, bulk // max_heavy)
    heavy = walked.groupBy("d", "k1", "k2").agg(F.sum(F.expr("n - d + 1")).alias("w")).filter(F.col("w") > limit).select("d", "k1", "k2", F.lit(True).alias("heavy"))
    # at most max_heavy rows
    marked = walked.join(F.broadcast(heavy), ["d", "k1", "k2"], "left")
    whole = Window.partitionBy("conv_id")
    marked = marked.withColumn("top", F.coalesce(F.max(F.when(F.col("heavy"), F.col("d"))).over(whole), F.lit(0)) + 1)
    marked = marked.withColumn("t", F.max(F.when(F.col("d") == F.col("top"), F.struct("k1", "k2"))).over(whole))
    light = F.col("d") >= F.col("top")
    ends = F.col("d") == F.col("n")
    keyed = marked.select("d", "k1", "k2", F.expr("k1 ^ l1").alias("p1"), F.expr("k2 ^ l2").alias("p2"), "chars", F.when(light, F.col("t.k1")).alias("t1"), F.when(light, F.col("t.k2")).alias("t2"), ends.cast("long").alias("ends"), F.when(ends, F.col("conv_id")).alias("end_id"))
    nodes = keyed.groupBy("d", "k1", "k2", "p1", "p2", "chars", "t1", "t2").agg(F.sum("ends").alias("ends"), F.min("end_id").alias("first_end"))
    nodes = cut(nodes.withColumn("first_end", F.coalesce("first_end", F.lit(int(_NONE)))).withColumn("heavy", F.col("t1").isNull()))
    return nodes, nodes.filter("not heavy").count()


def build_trie(d: np.ndarray, key: np.ndarray, parent: np.ndarray, values: dict[str, np.ndarray]) -> dict:
    """One trie of nodes with depth, key and parent's key (n x 2); nodes without a parent here are tops, children of an unnamed root.

    Level order: by level, then by the parent's place, then by label. values are reordered with the nodes.
    """
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    keys, parents = (np.ascontiguousarray(x).view(pair).reshape(-1) for x in (key, parent))
    depths = np.unique(d)
    order, above = [], []  # node numbers in level order; each one's parent's place, 0 the root
    waiting: dict[int, np.ndarray] = {int(x): np.flatnonzero(d == x) for x in depths}
    # tops start at the first level whatever their depth; level k of the trie has nodes of several depths
    by_depth = {x: rows[np.argsort(keys[rows])] for x, rows in waiting.items()}
    up = np.full(len(d), -1)
    for x, rows in waiting.items():
        if (ups := by_depth.get(x - 1)) is not None:
            at = np.searchsorted(keys[ups], parents[rows])
            at[at == len(ups)] = 0
            hit = keys[ups[at]] == parents[rows]
            up[rows[hit]] = ups[at[hit]]
    place = np.zeros(len(d), np.int64)
    level, filled, label = np.flatnonzero(up < 0), 1, key ^ parent
    starts = np.argsort(up, kind="stable")
    first = np.searchsorted(up[starts], np.arange(len(d)))
    last = np.searchsorted(up[starts], np.arange(len(d)), side="right")
    n_tops = len(level)
    while len(level):
        at = np.where(up[level] < 0, 0, place[up[level]])
        sort = np.lexsort((label[level, 1], label[level, 0], at))
        level, at = level[sort], at[sort]
        place[level] = filled + np.arange(len(level))
        filled += len(level)
        order.append(level)
        above.append(at)
        spans = [starts[a:b] for a, b in zip(first[level], last[level]) if b > a]
        level = np.concatenate(spans) if spans else level[:0]
    order = np.concatenate(order) if order else np.empty(0, np.int64)
    degrees = np.bincount(np.concatenate(above) if above else np.empty(0, np.int64), minlength=len(order) + 1)
    bits = np.ones(len(order) + len(degrees), np.uint8)
    bits[np.cumsum(degrees + 1) - 1] = 0
    tops = order[:n_tops]
    return {"n_nodes": len(order), "n_tops": n_tops, "louds": np.packbits(bits), "labels": label[order], "above": parent[tops], "depths": d[tops], **{k: v[order] for k, v in values.items()}}


def parents_of(louds: np.ndarray, n_nodes: int) -> np.ndarray:
    """Each node's parent's place by the bits (0: the root): the zeros before a node's 1 close the nodes before its parent."""
    bits = np.unpackbits(louds)[: 2 * n_nodes + 1]
    ones = np.flatnonzero(bits)
    return ones - np.arange(n_nodes)


def levels_of(parents: np.ndarray) -> list[slice]:
    """The nodes of each level, places from 1: a level ends where the next one's parents begin."""
    out, begin, end = [], 1, 1 + int(np.searchsorted(parents, 1))
    while begin < end:
        out.append(slice(begin, end))
        begin, end = end, 1 + int(np.searchsorted(parents, end))
    return out


def roll_up(trie: dict) -> dict:
    """Columns of a trie's nodes in level order: keys, depth, members and what lies below."""
    n = trie["n_nodes"]
    up = np.concatenate([[0], parents_of(trie["louds"], n)])
    levels = levels_of(up[1:])
    key, depth = np.zeros((n + 1, 2), np.int64), np.zeros(n + 1, np.int64)
    for k, level in enumerate(levels):
        over = trie["above"] if k == 0 else key[up[level]]
        key[level] = over ^ trie["labels"][level.start - 1 : level.stop - 1]
        depth[level] = trie["depths"] if k == 0 else depth[up[level]] + 1
    pad = lambda x, empty: np.concatenate([[empty], x])
    below = np.zeros((n + 1, 5), np.int64)  # of subtrees held elsewhere: members, smallest member, children, leaves, saved tokens
    if len(trie["below"]):
        below[1:] = trie["below"]
    members, least = pad(trie["ends"], 0) + below[:, 0], np.minimum(pad(trie["first_end"], _NONE), np.where(below[:, 0] > 0, below[:, 1], _NONE))
    children, leaves, saved = below[:, 2].copy(), below[:, 3].copy(), below[:, 4].copy()
    for level in reversed(levels):
        own = np.arange(level.start, level.stop)
        leaves[own] += children[own] == 0
        saved[own] += (members[own] - 1) * trie["chars"][own - 1]
        np.add.at(members, up[level], members[level])
        np.minimum.at(least, up[level], least[level])
        np.add.at(children, up[level], 1)
        np.add.at(leaves, up[level], leaves[level])
        np.add.at(saved, up[level], saved[level])
    over = key[up[1:]]
    n_tops = trie["n_tops"]
    over[:n_tops] = trie["above"]
    return {
        "k1": key[1:, 0], "k2": key[1:, 1], "p1": over[:, 0], "p2": over[:, 1], "conv_id": least[1:], "depth": depth[1:],
        "parent_conv_id": pa.array(least[up[1:]], mask=np.arange(n) < n_tops), "n_convs": members[1:], "n_children": children[1:], "n_leaves": leaves[1:],
        "saved_tokens": saved[1:], "is_top": np.arange(n) < n_tops,
    }


_PARTS = {"louds": (np.uint8, 0), "labels": (np.int64, 2), "above": (np.int64, 2), "depths": (np.int64, 0), "chars": (np.int64, 0), "ends": (np.int64, 0), "first_end": (np.int64, 0), "below": (np.int64, 5)}


def _packed(key, table):
    """Nodes of a shard to its trie's row."""
    column = lambda c: table.column(c).to_numpy()
    pairs = lambda a, b: np.stack([column(a), column(b)], axis=1)
    below = {"below": np.stack([column(f"b{i}") for i in range(5)], axis=1)} if "b0" in table.column_names else {}
    trie = build_trie(column("d"), pairs("k1", "k2"), pairs("p1", "p2"), {"chars": column("chars"), "ends": column("ends"), "first_end": column("first_end")} | below)
    row = {"shard": pa.array([key[0].as_py()], pa.int64())} | {c: pa.array([trie[c]], pa.int64()) for c in ("n_nodes", "n_tops")}
    return pa.table(row | {c: pa.array([np.ascontiguousarray(trie[c]).tobytes() if c in trie else b""], pa.binary()) for c in _PARTS})


def unpacked(row: dict) -> dict:
    shaped = lambda c: np.frombuffer(row[c], _PARTS[c][0]).reshape(-1, *[_PARTS[c][1]] * (_PARTS[c][1] > 0))
    return {"n_nodes": row["n_nodes"], "n_tops": row["n_tops"], **{c: shaped(c) for c in _PARTS}}


_NODES = [f.split()[0] for f in NODE.split(", ")]


def tries(nodes: DataFrame) -> DataFrame:
    """nodes(shard, d, k1, k2, p1, p2, chars, ends, first_end, and b0 to b4 where subtrees are held elsewhere) -> one LOUDS trie per shard, as binary columns."""
    return nodes.groupBy("shard").applyInArrow(_packed, TRIE)


def trie_nodes(packed: DataFrame) -> DataFrame:
    """tries' rows -> NODE: every node with its rollups, read back from bits and arrays."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                columns = {c: x if isinstance(x, pa.Array) else pa.array(x) for c, x in roll_up(unpacked(row)).items()}
                # a trie's nodes in pieces, for they are more bytes than its bits
                for at in range(0, row["n_nodes"], 50_000):
                    yield pa.RecordBatch.from_arrays([columns[c][at : at + 50_000] for c in _NODES], _NODES)

    return packed.mapInArrow(run, NODE)


def end_digests(ends: DataFrame) -> DataFrame:
    """ends(depth, k1, k2, conv_id) -> depth, k1, k2, ends_sha256: decimal ids in order, joined by commas, hashed as they pass."""
    names = ["depth", "k1", "k2", "ends_sha256"]

    def run(batches):
        now, digest = None, None
        for batch in batches:
            rows = []
            for *node, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
                if node != now:
                    if now:
                        rows.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(str(conv_id).encode())
                else:
                    digest.update(f",{conv_id}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*now, digest.hexdigest())))], schema)

    schema = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    ordered = ends.select("depth", "k1", "k2", "conv_id").repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "conv_id")
    return ordered.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, max_heavy: int = MAX_HEAVY) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rebuilt, sizes = rebuild(cut(turns_of(conversations)))
    walked = cut(paths(rebuilt))
    nodes, n_light = distinct_nodes(walked, shard_rows, max_heavy)
    shards = max(1, -(-n_light // shard_rows))
    light = nodes.filter("not heavy").select(F.pmod(F.xxhash64("t1", "t2"), F.lit(shards)).alias("shard"), "d", "k1", "k2", "p1", "p2", "chars", "ends", "first_end")
    lower = cut(trie_nodes(tries(light)))

    # the root and the heavy nodes, with what hangs below them in other shards; at most max_heavy + 1 rows
    bare = sizes.filter("n = 0").agg(F.count("*").alias("ends"), F.coalesce(F.min("conv_id"), F.lit(int(_NONE))).alias("first_end"))
    zero = F.lit(0).cast("long")
    root = bare.select(zero.alias("d"), zero.alias("k1"), zero.alias("k2"), zero.alias("p1"), zero.alias("p2"), zero.alias("chars"), "ends", "first_end")
    upper = root.unionByName(nodes.filter("heavy").select("d", "k1", "k2", "p1", "p2", "chars", "ends", "first_end"))
    hung = lower.filter("is_top").groupBy((F.col("depth") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.sum("n_convs").alias("b0"), F.min("conv_id").alias("b1"), F.count("*").alias("b2"), F.sum("n_leaves").alias("b3"), F.sum("saved_tokens").alias("b4")
    )
    upper = upper.join(hung, ["d", "k1", "k2"], "left").na.fill(0, [f"b{i}" for i in range(5)]).withColumn("shard", F.lit(-1).cast("long"))
    above = cut(trie_nodes(tries(upper)).filter("n_convs > 0"))

    holds = F.broadcast(above.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_over")))
    found = lower.join(holds, ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_over")).drop("_over").unionByName(above)
    last = walked.filter("d = n").select(F.col("d").alias("depth"), "k1", "k2", "conv_id")
    ends = end_digests(last.unionByName(sizes.filter("n = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")))
    nothing = hashlib.sha256(b"").hexdigest()
    return found.join(ends, ["depth", "k1", "k2"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


#: Paths as lists of digests; a node's subtree by its nodes' paths.
ORACLE = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, length(text) AS chars, sha256(length(role) || ':' || role || text) AS sha, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM t),
i AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT) AS bytes FROM t),
h AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 6 AS h FROM i, tab),
r AS (SELECT h.conv_id, pos AS place, sha, chars FROM h JOIN o ON o.conv_id = h.base AND pos <= h UNION ALL SELECT h.conv_id, pos + 1000000 AS place, sha, chars FROM h JOIN o ON o.conv_id = h.conv_id AND pos > h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, sha, chars FROM r),
k AS (SELECT conv_id, depth, chars, sha256(string_agg(sha, '/') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM d UNION ALL SELECT conv_id, 0, 0, '' FROM h),
e AS (SELECT conv_id, arg_max(node, depth) AS last FROM k GROUP BY conv_id),
n AS (SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM k GROUP BY node),
p AS (SELECT n.*, m.node AS parent, q.conv_id AS parent_conv_id FROM n LEFT JOIN k m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN n q ON q.node = m.node),
c AS (SELECT parent AS node, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT k.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((p.n_convs - 1) * p.chars) AS saved FROM p LEFT JOIN c ON c.node = p.node JOIN k ON k.conv_id = p.conv_id AND k.depth <= p.depth GROUP BY k.node),
z AS (SELECT last AS node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM e GROUP BY last)
SELECT p.conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM p LEFT JOIN c ON c.node = p.node JOIN s ON s.node = p.node LEFT JOIN z ON z.node = p.node
"""
