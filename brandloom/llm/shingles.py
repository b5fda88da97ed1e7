"""Words and five-word shingles of whole texts as 64-bit hashes, without a Python step per word."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5
#: Texts are joined to about so many bytes and worked on together; a longer text is cut at white space into such parts.
SEGMENT = 1 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_SPACE = np.isin(np.arange(256), (0x20, 9, 10, 11, 12, 13))
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The low bytes that a word has in an 8-byte read with so many bytes left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last bytes of the runs outside [\\x20\\x09-\\x0D]."""
    turns = np.flatnonzero(np.diff(_SPACE[raw].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return turns[::2], turns[1::2]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one segment: eight bytes of every word at a time."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    lengths = ends - starts
    padded = data + bytes(8)
    eights = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, 0, (1,))  # the eight bytes from each position on
    h = mix64(lengths.astype(np.uint64))
    live = np.flatnonzero(lengths <= LONG_WORD)
    at, left = starts[live], lengths[live]
    while len(live):
        h[live] = mix64(h[live] ^ ((eights[at] & _LEFT[np.minimum(left, 8)]) * _ODD[0]))
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(memoryview(data)[starts[i] : ends[i]])
    return h, starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of all words, in parts of about SEGMENT bytes that end at white space."""
    found, begin = [], 0
    while begin < len(data):
        end = len(data)
        if begin + SEGMENT < end and (m := _BLANK.search(data, begin + SEGMENT)):
            end = m.start()
        h, starts = _hashed(data[begin:end])
        found.append((h, starts + begin))
        begin = end
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if len(found) > 1 else found[0]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _shingled(h: np.ndarray) -> np.ndarray:
    """A hash of each WIDTH neighbouring words."""
    n = len(h) - WIDTH + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(WIDTH):
        total += h[k : k + n] * _ODD[k]
    return mix64(total)


def shingle_sets(texts: list[bytes | None]):
    """For each text its sorted distinct shingle hashes; fewer than five words are one shingle; no words, none.

    bytes.lower() lowers A-Z only.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or b"") <= SEGMENT):
            size += len(texts[last] or b"")
            last += 1
        group = [t or b"" for t in texts[first:last]]
        h, starts = word_hashes(b"\n".join(group).lower())
        ends = np.cumsum([len(t) + 1 for t in group])
        past = np.searchsorted(starts, ends).tolist()
        shingles = _shingled(h) if len(h) >= WIDTH else np.empty(0, np.uint64)
        a = 0
        for b in past:
            if b - a >= WIDTH:
                yield distinct(shingles[a : b - WIDTH + 1])
            elif b > a:
                yield mix64((h[a:b] * np.array(_ODD[: b - a])).sum(keepdims=True) ^ np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)
            a = b
        first = last


def shingle_set(text: bytes | None) -> np.ndarray:
    return next(shingle_sets([text]))
