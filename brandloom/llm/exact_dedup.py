"""Exact deduplication against history through a minimal perfect hash.

History (digests seen before, with the row that won each) is cut into shards of bounded size by a hash of the digest.
Each shard gets a minimal perfect hash: keys fall into small buckets, and every bucket stores the first pilot number
that sends its keys to free slots, so n keys fill exactly n slots. A slot holds the full 32-byte digest and the
locator of the winner. A lookup computes the slot and compares all 32 bytes: equal means a repeat of a known text,
anything else is a new text. Members count for their slot's winner; nonmembers are groups of their own. Only distinct digests travel to the shards,
so a text with a million copies is one lookup; shards are uniform because digests are. Rows find their group by a join of written tables, whose hot
digests adaptive execution splits.

Defined cases: null text counts as empty; rows with equal text and equal doc_id count separately, and one of them is
kept; a null doc_id sorts after all others; an index of repeated digests is refused; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: Digests in one shard of the index: 20,000 x 48 bytes is under 1 MB, whatever the corpus.
SHARD_KEYS = 20_000
BUCKET_KEYS = 4
DIGEST, LOCATOR = 32, 16
_MAX = np.iinfo(np.int64).max

INDEX_SCHEMA = "shard int, n int, pilots binary, digests binary, locators binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_hex(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _halves(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit words of each digest (the digest is already uniform)."""
    words = digests.reshape(-1, DIGEST).view("<u8")
    return words[:, 1].copy(), words[:, 2].copy()


def _slots(low: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    x = low ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def build_mph(digests: bytes, locators: bytes) -> tuple[int, bytes, bytes, bytes]:
    """(n, pilots, digests by slot, locators by slot) for distinct 32-byte digests and their 16-byte locators."""
    keys = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)
    n = len(keys)
    if n == 0:
        return 0, b"", b"", b""
    if len(np.unique(np.ascontiguousarray(keys).view(f"V{DIGEST}"))) < n:
        raise ValueError("a digest occurs twice: no perfect hash has two slots for it")
    high, low = _halves(np.ascontiguousarray(keys))
    buckets = n // BUCKET_KEYS + 1
    bucket = (high % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=buckets)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    pilots, taken, slot = np.zeros(buckets, np.uint32), np.zeros(n, bool), np.empty(n, np.int64)
    block = np.arange(64, dtype=np.uint64)
    for b in np.argsort(-counts, kind="stable"):
        if not (c := counts[b]):
            break
        members = order[starts[b] : starts[b] + c]
        first = 0
        while True:
            tried = _slots(low[members][None, :], block[:, None] + np.uint64(first), n)
            free = ~taken[tried].any(axis=1)
            if c > 1:
                ranked = np.sort(tried, axis=1)
                free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if free.any():
                k = int(free.argmax())
                pilots[b], slot[members] = first + k, tried[k]
                taken[tried[k]] = True
                break
            first += len(block)
    by_slot = np.empty(n, np.int64)
    by_slot[slot] = np.arange(n)
    places = np.frombuffer(locators, np.uint8).reshape(-1, LOCATOR)
    return n, pilots.tobytes(), keys[by_slot].tobytes(), places[by_slot].tobytes()


def lookup_mph(n: int, pilots: bytes, digests: bytes, queries: bytes) -> np.ndarray:
    """Slot of each 32-byte query, or -1 where the slot's digest differs in any byte."""
    asked = np.frombuffer(queries, np.uint8).reshape(-1, DIGEST)
    if n == 0 or len(asked) == 0:
        return np.full(len(asked), -1)
    high, low = _halves(np.ascontiguousarray(asked))
    pilot = np.frombuffer(pilots, np.uint32)
    slot = _slots(low, pilot[(high % np.uint64(len(pilot))).astype(np.int64)], n)
    stored = np.frombuffer(digests, np.uint8).reshape(-1, DIGEST)[slot]
    return np.where((stored == asked).all(axis=1), slot, -1)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def winners(rows: DataFrame) -> DataFrame:
    """digest -> winner (smallest doc_id, then row number) and count; map-side combined, so copies do not travel."""
    place = F.struct(F.coalesce("doc_id", F.lit(int(_MAX))).alias("doc_id"), F.col("row").alias("row"))
    return rows.groupBy("digest").agg(F.min(place).alias("w"), F.count("*").alias("n")).select("digest", F.col("w.doc_id").alias("doc_id"), F.col("w.row").alias("row"), "n")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """history(digest binary, doc_id, row; distinct digests) -> one row per shard, INDEX_SCHEMA."""

    def one(key, table):
        places = np.stack([table.column(c).to_numpy() for c in ("doc_id", "row")], axis=1)
        n, pilots, digests, locators = build_mph(b"".join(table.column("digest").to_pylist()), places.tobytes())
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ("shard", "n", "pilots", "digests", "locators")
        return pa.table({name: pa.array([value], kind) for name, kind, value in zip(names, kinds, (key[0].as_py(), n, pilots, digests, locators))})

    return history.select(_shard(shards).alias("shard"), "digest", "doc_id", "row").groupBy("shard").applyInArrow(one, INDEX_SCHEMA)


def lookup(index: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """asked(digest, doc_id, row, n; distinct) -> the same and `member`; a member's doc_id and row are the historical winner's."""

    def one(key, found, table):
        digests = table.column("digest").to_pylist()
        places = np.stack([table.column(c).to_numpy() for c in ("doc_id", "row")], axis=1)
        member = np.zeros(len(digests), bool)
        if found.num_rows:
            ix = found.to_pylist()[0]
            slot = lookup_mph(ix["n"], ix["pilots"], ix["digests"], b"".join(digests))
            member = slot >= 0
            places[member] = np.frombuffer(ix["locators"], np.int64).reshape(-1, 2)[slot[member]]
        return pa.table({"digest": pa.array(digests, pa.binary()), "doc_id": places[:, 0], "row": places[:, 1], "n": table.column("n"), "member": pa.array(member)})

    asked = asked.select(_shard(shards).alias("shard"), "digest", "doc_id", "row", "n")
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(one, "digest binary, doc_id long, row long, n long, member boolean")


def digests_of(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number; written to the shared folder so that the numbers stay fixed."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest_hex(F.col("text"))).alias("digest")).withColumn("row", F.monotonically_increasing_id()))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256 for every row.

    The lower half of the doc_ids is the history, the rest arrives later; winners of the history therefore always have
    the smaller doc_id. Both halves are read whole.
    """
    rows = digests_of(docs)
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(middle if middle is not None else 0), F.lit(False))
    history, arriving = cut(winners(rows.filter(old))), cut(winners(rows.filter(~old)))
    shards = max(64, -(-max(history.count(), arriving.count()) // SHARD_KEYS))
    looked = cut(lookup(build_index(history, shards), arriving, shards))
    # written down, so that adaptive execution may split a hot digest of the join
    joined = rows.join(cut(groups_of(history, looked)), "digest")
    return joined.select(
        "doc_id",
        F.when(F.col("keep_doc") != F.lit(int(_MAX)), F.col("keep_doc")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def groups_of(history: DataFrame, looked: DataFrame) -> DataFrame:
    """digest, keep_doc, keep_row, group_size: the lookup decides. Members add to the winner that their locator names; each other digest is a group."""
    named = lambda size: [F.col("digest"), F.col("doc_id").alias("keep_doc"), F.col("row").alias("keep_row"), size.alias("group_size")]
    hits = looked.filter("member").select("row", F.col("n").alias("more"))
    known = history.join(hits, "row", "left").select(*named(F.col("n") + F.coalesce("more", F.lit(0))))
    return known.unionByName(looked.filter("not member").select(*named(F.col("n"))))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs without repeats of a text, all columns unchanged; of identical rows one stays."""
    verdict = exact_dedup(docs)
    dropped = cut(verdict.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("same")).filter(~F.col("kept") | (F.col("same") > 1)))
    gone = dropped.filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha"))
    keyed = docs.withColumn("_sha", digest_hex(F.col("text")))
    left = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["_gone_id"]) & (keyed["_sha"] == gone["_gone_sha"]), "left_anti")
    if not dropped.filter("kept").isEmpty():  # rows that share doc_id and text
        left = left.dropDuplicates(["doc_id", "_sha"])
    return left.drop("_sha")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
