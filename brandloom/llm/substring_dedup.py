"""Substring deduplication by content-defined chunks under a gear rolling hash.

At every byte the gear hash of the 16 bytes that end there is rolled on. A chunk begins at a word (a run of bytes outside
[\\x20\\x09-\\x0D]) if the gear hash in front of it is the least in some window of REACH neighbouring words. Cuts depend on the bytes
nearby only, so an insertion shifts chunks but does not change those behind it, and no two cuts are more than REACH words apart.
Inside words of over LONG bytes (text without white space) every place where the hash has three zero bits counts as the beginning of a word.
In stretches where the hash does not change (one word over and over), every REACH-th word is cut.

Chunks are deduplicated by 128-bit digest of their bytes: a digest is repeated if it occurs in more than one document. Runs of
neighbouring repeated chunks of at least MIN_WORDS are repeated passages. A run is split into spans where its chunks' first
documents differ: what stands first here (smallest doc_id, then position) stays, what has its first copy elsewhere can be
removed. Parts from elsewhere below the least length, between parts that stay, stay with them.

Every passage of over 50 words is found. 16 bytes are at most 8 words, so from the ninth word on hashes depend on the passage alone;
windows from there on choose the same cuts in every copy, the first at or before word 24, the last at or after word 36, so that at
least 12 words lie in equal chunks.

Chunks are written once as a compressed table. Digests are counted with map-side combination, so a passage that a third of all
documents share is a few rows by then; the join back is a plain equi-join, whose hot keys adaptive execution splits. Only
repeated chunks travel by document.

Defined cases: null and empty texts have no chunks; every row is a document of its own, so equal rows and rows that share a doc_id may
repeat each other; a null doc_id stays null and sorts after all others; repeats within one document are no repeats unless `within` is
set; empty tables give empty results. Extra columns are ignored. A text is held by one task, with about three times its bytes for its cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import small_batches, write_down
from .shingles import mix64, word_spans

#: Bytes in the gear hash; words in a window; bytes from which a word is cut inside.
WINDOW, REACH, LONG = 16, 16, 64
#: Zero bits of the hash that begin a word within a long one.
INNER_BITS = 3
#: The least repeated passage, in words: see above for those of over 50 words.
MIN_WORDS = 12
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Bytes hashed together, and bytes of short texts that are cut together.
_SEGMENT = 1 << 20
#: Stands in front of every text, so that its first hashes do not depend on its neighbours.
_LEAD = b"\n" * WINDOW


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the gear hash of the 16 bytes that end there: the sum of gear[byte] << age, mod 2^32."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def word_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, in the sense above, and the gear hash in front of each; scratch memory is bounded by _SEGMENT."""
    raw = np.frombuffer(data, np.uint8)
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
    origin = 0  # first byte of the word that the segment's first byte belongs to
    for s in range(0, len(raw), _SEGMENT):
        lead = min(s, WINDOW)
        e = min(s + _SEGMENT, len(raw))
        h = gear_hashes(raw[s - lead : e])
        starts, ends = (x + s for x in word_spans(raw[s:e]))
        within = s > 0 and len(starts) and starts[0] == s and len(word_spans(raw[s - 1 : s])[0])  # the word began before
        first = starts.copy()
        if within:
            first[0] = origin
        found = [starts[1:] if within else starts]
        for a, b in zip(first[ends - first > LONG].tolist(), ends[ends - first > LONG].tolist()):
            a = max(a + LONG, s)
            found.append(np.flatnonzero(h[a - 1 - s + lead : b - 1 - s + lead] >> np.uint32(32 - INNER_BITS) == 0) + a)
        at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
        at = at[at > 0]
        places.append(at)
        hashes.append(h[at - 1 - s + lead])
        if len(ends) and ends[-1] == e:
            origin = int(first[-1])
    return np.concatenate(places), np.concatenate(hashes)


def _extreme(x: np.ndarray, pick) -> np.ndarray:
    """pick (minimum or maximum) over each REACH neighbours."""
    width = 1
    while width < REACH:
        x = pick(x[:-width], x[width:])
        width *= 2
    return x


def _chosen(h: np.ndarray) -> np.ndarray:
    """Which hashes are the least of some window of REACH neighbours; of equal neighbours, every REACH-th."""
    n = len(h)
    if n < REACH:
        return np.zeros(n, bool)
    least = _extreme(h, np.minimum)
    room = np.zeros(REACH - 1, h.dtype)
    picked = _extreme(np.concatenate([room, least, room]), np.maximum) == h  # the greatest minimum of the windows that hold the word
    turn = np.append(True, h[1:] != h[:-1])
    offset = np.arange(n) - np.maximum.accumulate(np.where(turn, np.arange(n), 0))
    return picked & (offset % REACH == 0)


def cut_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Chunks of all texts: number of the text, first and past-last byte in the returned joined bytes, words."""
    data = b"".join(part for t in texts for part in (_LEAD, t))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    past = np.cumsum(sizes + WINDOW)
    begin = past - sizes
    places, hashes = word_starts(data)
    hashes = hashes | np.uint32(1)
    between = np.searchsorted(places, begin)
    marked = np.insert(hashes, between, np.uint32(0))  # the least of all, so that no window over two texts chooses a word
    chosen = np.delete(_chosen(marked), between + np.arange(len(between)))
    cuts = places[chosen]
    starts = np.union1d(begin[sizes > 0], cuts)
    owner = np.searchsorted(begin, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), past[owner])
    words = np.searchsorted(places, ends) - np.searchsorted(places, starts)
    return owner, starts, ends, words, data


def cut_points(data: bytes) -> list[int]:
    """Past-last positions of the chunks of one text."""
    return (cut_texts([data])[2] - WINDOW).tolist()


CHUNKS = "row long, doc_id long, start long, size int, words int, high long, low long"
_FIELDS = [("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("words", pa.int32()), ("high", pa.int64()), ("low", pa.int64())]


def _chunk_batch(rows: np.ndarray, doc_ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
    owner, starts, ends, words, data = cut_texts(texts)
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    digests = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
    first = np.searchsorted(owner, owner)  # of the same text
    columns = (rows[owner], doc_ids.take(pa.array(owner)), starts - starts[first], (ends - starts).astype(np.int32), words.astype(np.int32), digests[:, 0], digests[:, 1])
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [n for n, _ in _FIELDS])


def chunks(docs: DataFrame) -> DataFrame:
    """docs(row, doc_id, text) -> one row per chunk of the UTF-8 bytes of each text."""

    def run(batches):
        for batch in batches:
            rows, texts, begin, size = batch.column(0).to_numpy(), [], 0, 0
            for i, text in enumerate(batch.column(2)):
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= _SEGMENT or i == batch.num_rows - 1:
                    yield _chunk_batch(rows[begin : i + 1], batch.column(1).slice(begin, len(texts)), texts)
                    texts, begin, size = [], i + 1, 0

    return docs.select("row", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, CHUNKS)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs + row, and whether that is the doc_id: a number of each row's own, ascending by doc_id (null last).

    It is the doc_id where that names every row; else rows are sorted by doc_id. Only the latter moves texts.
    """
    keyed = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if keyed.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return keyed.withColumn("row", F.col("doc_id")), True
    placed = keyed.withColumn("_place", F.monotonically_increasing_id())
    return placed.orderBy(F.col("doc_id").asc_nulls_last(), "_place").drop("_place").withColumn("row", F.monotonically_increasing_id()), False


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """docs -> doc_id, start_byte, end_byte, n_chunks, first_doc_id, is_first for every span of the repeated passages.

    `first_doc_id` is the document with the first copy of the span; `is_first` says that this document's copy stays.
    """
    return _spans(numbered(docs.select("doc_id", "text"))[0], min_words, within).drop("row")


def _changed(column: str, over) -> Column:
    return F.coalesce(F.lag(column).over(over) != F.col(column), F.lit(False))


def _spans(rows: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """docs with row -> row and the columns of repeated_spans."""
    small_batches(rows.sparkSession)
    every = write_down(chunks(rows))
    counted = every.groupBy("high", "low").agg(F.min("row").alias("home"), F.max("row").alias("far"), F.count("*").alias("n"))
    # written down, so that adaptive execution may split a hot digest of the join
    repeated = write_down(counted.filter(F.lit(within) & (F.col("n") > 1) | (F.col("home") != F.col("far"))).select("high", "low", "home"))
    found = every.select("row", "start", "size", "words", "high", "low").join(repeated, ["high", "low"])
    found = found.select("row", "start", (F.col("start") + F.col("size")).alias("end"), "words", "home", (F.col("home") == F.col("row")).alias("mine"), *(["high", "low"] if within else []))
    if within:  # of several copies at home only the first one stays
        copies = Window.partitionBy("row", "high", "low").orderBy("start")
        found = found.withColumn("mine", F.col("mine") & (F.row_number().over(copies) == 1)).drop("high", "low")
    by_place = Window.partitionBy("row").orderBy("start")
    broke = F.coalesce(F.lag("end").over(by_place) != F.col("start"), F.lit(False))
    turns = found.withColumn("broke", broke.cast("int")).withColumn("turned", (broke | _changed("mine", by_place) | _changed("home", by_place)).cast("int"))
    parts = turns.withColumn("run", F.sum("broke").over(by_place)).withColumn("part", F.sum("turned").over(by_place)).groupBy("row", "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.sum("words").alias("words"), F.first("home").alias("home"), F.first("mine").alias("mine")
    )
    run = Window.partitionBy("row", "run")
    in_run = run.orderBy("part")
    parts = parts.withColumn("length", F.sum("words").over(run)).filter(F.col("length") >= min_words)
    parts = parts.withColumn("turned", _changed("mine", in_run).cast("int")).withColumn("turn", F.sum("turned").over(in_run))
    # a few shared words within this document's own passage are no passage
    parts = parts.withColumn("own", F.col("mine") | (F.sum("words").over(Window.partitionBy("row", "run", "turn")) < min_words))
    parts = parts.withColumn("turned", (~F.col("own") | _changed("own", in_run)).cast("int")).withColumn("span", F.sum("turned").over(in_run))
    spans = parts.groupBy("row", "run", "span", "own").agg(
        F.min("start").alias("start_byte"), F.max("end").alias("end_byte"), F.sum("n_chunks").alias("n_chunks"), F.min("home").alias("home"), F.max("mine").alias("mine")
    )
    first_row = F.when(F.col("own"), F.col("row")).otherwise(F.col("home"))
    spans = spans.select("row", first_row.alias("first_row"), "start_byte", "end_byte", "n_chunks", (F.col("own") & F.col("mine")).alias("is_first"))
    # every text with chunks has one that begins it, which tells the doc_id of a row
    name = lambda r, d: every.filter("start = 0").select(F.col("row").alias(r), F.col("doc_id").alias(d))
    return spans.join(name("row", "doc_id"), "row").join(name("first_row", "first_doc_id"), "first_row").select("row", "doc_id", "start_byte", "end_byte", "n_chunks", "first_doc_id", "is_first")


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with later copies of repeated passages taken out of `text`; other columns unchanged.

    Bytes that stop being whole characters at a cut are dropped with it.
    """
    rows, by_id = numbered(docs.withColumnRenamed("row", "_own_row") if "row" in docs.columns else docs)
    rows = rows if by_id else write_down(rows)
    spans = _spans(rows, **options).filter(~F.col("is_first"))
    gone = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_spans"))

    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, ranges in zip(texts.to_pylist(), spans.to_pylist()):
            if text is not None and ranges is not None:
                data, kept, last = text.encode(), [], 0
                for a, b in ((r["start_byte"], r["end_byte"]) for r in ranges):
                    kept.append(data[last:a])
                    last = b
                text = b"".join((*kept, data[last:])).decode("utf-8", "ignore")
            out.append(text)
        return pa.array(out, pa.string())

    removed = F.arrow_udf(without, "string")
    joined = rows.join(gone, "row", "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(removed("text", "_spans")))
    joined = joined.drop("row").withColumnRenamed("_own_row", "row") if "row" in docs.columns else joined
    return joined.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(*docs.columns)
