"""Token counts of whole documents; huge ones are encoded in overlapping chunks and spliced.

A text longer than `CHUNK` characters is cut into chunks that overlap. Each overlap is also encoded alone, with character offsets. A
boundary is stable where the character before it is ASCII white space (the tokenizer's pieces never hold white space, so nothing
can reach across it). A splice at such a boundary p is proven where the overlap's tokens from p on are the last ones of the chunk before, and its
tokens up to its last stable boundary are the first ones of the chunk behind: then both chunks agree from p on.
A chunk ends only where its overlap holds such boundaries, so text without white space is never cut. If the encodings of an overlap do
not agree all the same, it is doubled, at last up to the chunk's beginning, which joins the two chunks; the next chunk is then as long as both,
so that even a text in which nothing agrees is encoded in work proportional to its length.

Defined cases: null counts as empty, with 0 tokens; equal texts have equal counts; an empty table gives an empty result;
a text without white space is encoded whole and once, for no boundary in it is proven stable.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 16_000
OVERLAP = 500
_SPACE = np.zeros(128, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BOUNDARY = re.compile(r"(?<=[\t-\r ])[^\t-\r ]")


@functools.cache
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _ids(tokenizer, text: str) -> np.ndarray:
    return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


def _with_places(tokenizer, text: str, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and the characters of the whole text at which they start; slower."""
    e = tokenizer.encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int64), np.array([a for a, _ in e.offsets], np.int64) + base


def _stable(text: str, lo: int, hi: int) -> np.ndarray:
    """Positions p in (lo, hi) with white space before p and none at p."""
    codes = np.frombuffer(text[lo:hi].encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(codes, 127)] & (codes < 128)
    return lo + 1 + np.flatnonzero(space[:-1] & ~space[1:])


def _splice_at(tokenizer, text: str, lo: int, hi: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int, int] | None:
    """(place, tokens of `left` behind it, tokens of `right` before it) of the first proven splice; `left` ends at hi, `right` begins at lo."""
    cuts = _stable(text, lo, hi)
    if len(cuts) < 2:
        return None
    ids, at = _with_places(tokenizer, text[lo:hi], lo)
    head = int(np.searchsorted(at, cuts[-1]))
    if not np.array_equal(right[:head], ids[:head]):
        return None
    for p in cuts[:-1]:
        k = int(np.searchsorted(at, p))
        if k < head and len(left) >= len(ids) - k and np.array_equal(left[len(left) - len(ids) + k :], ids[k:]):
            return int(p), len(ids) - k, k
    return None


def _chunk_end(text: str, least: int, overlap: int) -> tuple[int, int]:
    """Where an overlap begins and where it ends with the chunk: at or behind `least`, with two stable boundaries in between; else at the text's end."""
    start = max(least - overlap, 0)
    places = _BOUNDARY.finditer(text, start + 1)
    if least < len(text) and next(places, None) and (second := next(places, None)):
        return start, max(least, second.start() + 1)
    return len(text), len(text)


def encode_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, int]:
    """The ids of the whole text, from chunks, and the number of splices."""
    done: list[np.ndarray] = []
    begin, first, (start, end) = 0, 0, _chunk_end(text, chunk, overlap)
    left = _ids(tokenizer, text[:end])
    while end < len(text):
        start = max(start, begin)
        after, behind = _chunk_end(text, end + max(chunk, end - begin - chunk), overlap)
        while True:
            right = _ids(tokenizer, text[start:behind])
            if start == begin:  # joined with the chunk before: nothing to splice
                left, first = right, 0
                break
            if found := _splice_at(tokenizer, text, start, end, left, right):
                begin, tail, skipped = found
                done.append(left[first : len(left) - tail])
                left, first = right, skipped
                break
            start = max(begin, 2 * start - end)
        start, end = after, behind
    return np.concatenate([*done, left[first:]]), len(done)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.zeros(len(texts), np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for s in range(0, len(short), 32):
                part = short[s : s + 32]
                counts[part] = [len(e) for e in tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)]
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = len(encode_spliced(tokenizer, t, chunk, overlap)[0])
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
