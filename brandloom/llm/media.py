"""Media columns: ISO base media files (nested boxes, sample tables) without decoding what they carry.

`probe` walks the boxes of a file, decodes the sample tables of each track (sizes also in their compact form) and the runs of movie fragments, and yields codec, time scale, duration, samples and
the byte ranges and times of its key samples, a row for each track. `wrap_samples` writes the
smallest such file that carries a payload losslessly as 8-bit mono samples of 576 bytes, and `read_samples` returns a
track's bytes by its tables. The payload is never interpreted.

Defined cases: null and empty payloads are one sample of padding; bytes that are no ISO file give a null codec, zero samples and no
ranges, as do files whose tables are cut short, contradict each other (times for another number of samples, samples without a chunk) or point beyond the file; a duration of all ones is unknown; unknown boxes are skipped; equal rows give equal rows; empty tables give empty results. A file is held by one task at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches

SAMPLE = 576
RATE = 48_000
#: Every so many samples one is marked as a keyframe.
KEY_EVERY = 25
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(payload: bytes | None) -> bytes:
    """Bytes 255 appended up to a positive multiple of the sample size."""
    payload = payload or b""
    return payload + b"\xff" * (SAMPLE - len(payload) if not payload else -len(payload) % SAMPLE)


def wrap_samples(payload: bytes) -> bytes:
    """An ISO media file whose only track stores `payload` (a positive multiple of 576 bytes) as raw 8-bit samples."""
    n = len(payload) // SAMPLE
    identity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isommp41")
    mdat = _box(b"mdat", payload)
    first = len(head) + len(mdat) - len(payload)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"co64", struct.pack(">IQ", 1, first)),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0), version=1),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
        _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
    )
    track = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), b"\0" * 16, identity, b"\0" * 8, version=1, flags=3)
    movie = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, len(payload), 0x10000, 0x100), identity, b"\0" * 24, struct.pack(">I", 2), version=1)
    return b"".join((head, mdat, _box(b"moov", movie, _box(b"trak", track, media))))


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, first byte, past last byte) of every box body, parents before children."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in CONTAINERS and len(path) < 16:
            yield from boxes(data, body, start + size, (*path, kind))
        start += size


class Malformed(ValueError):
    """Tables that cannot describe the file they stand in."""


def _table(data: bytes, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    if at + 4 > end:
        raise Malformed("a table without a count")
    count = struct.unpack_from(">I", data, at)[0]
    if at + 4 + count * columns * np.dtype(kind).itemsize > end:
        raise Malformed("a table longer than its box")
    return np.frombuffer(data, kind, count * columns, at + 4).astype(np.int64).reshape(-1, columns)


def _compact_sizes(data: bytes, at: int, end: int) -> np.ndarray:
    """Sizes of 4, 8 or 16 bits each."""
    if at + 8 > end:
        raise Malformed("a table without a count")
    width, count = struct.unpack_from(">3xBI", data, at)
    if width not in (4, 8, 16) or at + 8 + (count * width + 7) // 8 > end:
        raise Malformed("compact sizes that do not fit their box")
    if width == 4:
        pairs = np.frombuffer(data, np.uint8, (count + 1) // 2, at + 8)
        return np.stack([pairs >> 4, pairs & 15], axis=1).reshape(-1)[:count].astype(np.int64)
    return np.frombuffer(data, ">u2" if width == 16 else np.uint8, count, at + 8).astype(np.int64)


def _media_header(data: bytes, at: int, end: int) -> tuple[int, int | None]:
    """Time scale and duration; all ones mean that the duration is unknown."""
    form, start, unknown = (">IQ", 20, 2**64 - 1) if data[at : at + 1] == b"\1" else (">II", 12, 2**32 - 1)
    if at + start + struct.calcsize(form) > end:
        raise Malformed("a media header cut short")
    scale, duration = struct.unpack_from(form, data, at + start)
    if duration >= 2**63 and duration != unknown:
        raise Malformed("a duration out of range")
    return scale, None if duration == unknown else duration


def tracks(data: bytes) -> list[dict]:
    """The tables of each track, decoded: codec, timescale, duration, sizes, offsets, times, keys (sample numbers from 0)."""
    found: list[dict] = []
    fragments: list[dict] = []
    extends: dict[int, tuple] = {}
    for path, at, end in boxes(data):
        kind = path[-1]
        if kind == b"moof":
            fragments.append({"start": at - 8, "runs": []})
        elif b"moof" in path and fragments:
            _fragment_box(data, kind, at, end, fragments[-1])
        elif kind == b"trex" and end - at >= 24:
            number, _, duration, size, flags = struct.unpack_from(">5I", data, at + 4)
            extends[number] = (duration, size, flags)
        if kind == b"trak":
            found.append({})
        if not found or b"trak" not in path:
            continue
        t, body = found[-1], at + 4
        if kind == b"tkhd" and end - at >= 24:
            t["number"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = _media_header(data, at, end)
        elif kind == b"stsd" and end >= body + 12:
            t["codec"] = data[body + 8 : body + 12].decode("latin-1")
        elif kind == b"stts":
            t["stts"] = _table(data, body, end, ">u4", 2)
        elif kind == b"stsc":
            t["stsc"] = _table(data, body, end, ">u4", 3)
        elif kind == b"stsz":
            if body + 8 > end:
                raise Malformed("a table without a count")
            size, n = struct.unpack_from(">II", data, body)
            if size * n > len(data):
                raise Malformed("samples beyond the file")
            t["sizes"] = np.full(n, size, np.int64) if size else _table(data, body + 4, end, ">u4")[:, 0]
        elif kind == b"stz2":
            t["sizes"] = _compact_sizes(data, body, end)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = _table(data, body, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stss":
            t["keys"] = _table(data, body, end, ">u4")[:, 0] - 1
    for t in found:
        _place(t, len(data))
        _append_fragments(t, fragments, extends, len(data))
    return found


def _place(t: dict, length: int) -> None:
    """Offsets and times of the track's samples from its tables; never more memory than the tables themselves take."""
    sizes, chunks, runs = t.get("sizes", np.empty(0, np.int64)), t.get("chunks", np.empty(0, np.int64)), t.get("stsc", np.empty((0, 3), np.int64))
    if len(sizes) and not (len(runs) and len(chunks)):
        raise Malformed("samples without a chunk")
    steps = t.get("stts", np.empty((0, 2), np.int64))
    if "stts" in t and steps[:, 0].sum() != len(sizes):
        raise Malformed("times for another number of samples")
    if len(sizes):
        firsts = runs[:, 0]
        if firsts[0] != 1 or firsts[-1] > len(chunks) or (np.diff(firsts) <= 0).any():
            raise Malformed("chunk runs out of order")
        held = np.minimum(np.repeat(runs[:, 1], np.diff(np.append(firsts, len(chunks) + 1))), len(sizes))
        past = np.cumsum(held)  # samples up to each chunk
        if past[-1] < len(sizes):
            raise Malformed("samples without a chunk")
        chunk = np.searchsorted(past, np.arange(len(sizes)), side="right")
        before = np.cumsum(sizes) - sizes
        t["offsets"] = chunks[chunk] + before - before[np.minimum((past - held)[chunk], len(sizes) - 1)]
        if t["offsets"].min() < 0 or (t["offsets"] + sizes).max() > length:
            raise Malformed("samples beyond the file")
    else:
        t["offsets"] = sizes
    lasts = np.repeat(steps[:, 1], steps[:, 0]) if len(steps) else np.zeros(len(sizes), np.int64)
    t["times"], t["ends"] = np.cumsum(lasts) - lasts, int(lasts.sum())
    t["sizes"] = sizes
    keys = t.get("keys", np.arange(len(sizes)))
    if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
        raise Malformed("key samples that are not there")
    t["keys"] = keys


def _fragment_box(data: bytes, kind: bytes, at: int, end: int, fragment: dict) -> None:
    """A track fragment's header, start time and runs: what they say, optional fields as their flags tell."""
    if kind not in (b"tfhd", b"tfdt", b"trun"):
        return
    if end - at < 8:
        raise Malformed("a fragment's box cut short")
    version, flags = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
    if kind == b"tfhd":
        names = [(1, "base", ">Q"), (2, "description", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")]
        run, place = {"number": struct.unpack_from(">I", data, at + 4)[0], "parts": []}, at + 8
        for bit, name, form in names:
            if flags & bit:
                if place + struct.calcsize(form) > end:
                    raise Malformed("a fragment's header cut short")
                run[name] = struct.unpack_from(form, data, place)[0]
                place += struct.calcsize(form)
        fragment["runs"].append(run)
    elif not fragment["runs"]:
        raise Malformed("a fragment without a header")
    elif kind == b"tfdt":
        form = ">Q" if version == 1 else ">I"
        if at + 4 + struct.calcsize(form) > end:
            raise Malformed("a start time cut short")
        fragment["runs"][-1]["time"] = struct.unpack_from(form, data, at + 4)[0]
    else:
        count, place, part = struct.unpack_from(">I", data, at + 4)[0], at + 8, {}
        for bit, name, form in ((1, "offset", ">i"), (4, "first", ">I")):
            if flags & bit:
                if place + 4 > end:
                    raise Malformed("a run cut short")
                part[name] = struct.unpack_from(form, data, place)[0]
                place += 4
        columns = [name for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
        if place + count * 4 * len(columns) > end:
            raise Malformed("a run longer than its box")
        values = np.frombuffer(data, ">u4", count * len(columns), place).astype(np.int64).reshape(count, len(columns))
        fragment["runs"][-1]["parts"].append(part | {"count": count} | {name: values[:, k] for k, name in enumerate(columns)})


def _append_fragments(t: dict, fragments: list[dict], extends: dict, length: int) -> None:
    """Add the samples of a track's fragments: sizes, offsets, times and keys."""
    for fragment in fragments:
        for run in fragment["runs"]:
            if run["number"] != t.get("number"):
                continue
            duration, size, flags = extends.get(run["number"], (0, 0, 0))
            place, now = run.get("base", fragment["start"]), run.get("time", t["ends"])
            for k, part in enumerate(run["parts"]):
                n = part["count"]
                if n > length:
                    raise Malformed("more samples than bytes")
                each = lambda name, default, n=n, part=part: part[name] if name in part else np.full(n, default, np.int64)
                sizes, lasts = each("size", run.get("size", size)), each("duration", run.get("duration", duration))
                marks = each("flags", run.get("flags", flags)).copy()
                if "first" in part and n:
                    marks[0] = part["first"]
                if "offset" in part:
                    place = run.get("base", fragment["start"]) + part["offset"]
                offsets = place + np.cumsum(sizes) - sizes
                if n and (offsets.min() < 0 or offsets[-1] + sizes[-1] > length or now >= 2**62):
                    raise Malformed("samples beyond the file")
                t["keys"] = np.concatenate([t["keys"], len(t["sizes"]) + np.flatnonzero(marks & 0x10000 == 0)])
                t["times"] = np.concatenate([t["times"], now + np.cumsum(lasts) - lasts])
                t["sizes"], t["offsets"] = np.concatenate([t["sizes"], sizes]), np.concatenate([t["offsets"], offsets])
                place, now = int(place + sizes.sum()), int(now + lasts.sum())
            t["ends"] = now


def read_samples(data: bytes, track: dict) -> bytes:
    """The track's sample bytes in order; neighbouring samples are read as one range."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cuts = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    firsts, lasts = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(offsets)]]) - 1
    return b"".join(data[offsets[i] : ends[j]] for i, j in zip(firsts, lasts))


def key_ranges(track: dict) -> list[tuple[int, int]]:
    """(first byte, past last byte) of each keyframe's sample."""
    return [(int(track["offsets"][k]), int(track["offsets"][k] + track["sizes"][k])) for k in track["keys"]]


def _listed(track: dict) -> list[dict]:
    """The key samples' ranges, and their times in the track's scale."""
    return [{"start": a, "end": b, "time": int(track["times"][k])} for (a, b), k in zip(key_ranges(track), track["keys"])]


TRACK = "codec string, timescale long, duration long, samples long, keyframes array<struct<start:bigint,end:bigint,time:bigint>>"
PROBE = f"track int, {TRACK}"
_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("time", pa.int64())]))


def _probe_one(data: bytes | None) -> list[tuple]:
    """A row of PROBE for each track with a codec; one without a codec where there is none."""
    try:
        known = [t for t in tracks(data or b"") if "codec" in t]
    except (struct.error, ValueError, OverflowError):  # Malformed among them
        known = []
    return [(k, t["codec"], t.get("timescale"), t.get("duration"), len(t["sizes"]), _listed(t)) for k, t in enumerate(known)] or [(None, None, None, None, 0, [])]


def probe(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """key and the decoded tables of each track of each file in the binary column `media`."""

    def run(batches):
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGES)
        for batch in batches:
            found = [_probe_one(m.as_py()) for m in batch.column(1)]
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
            columns = list(zip(*itertools.chain.from_iterable(found))) or [[]] * 6
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(columns, types))], ["key", "track", "codec", "timescale", "duration", "samples", "keyframes"])

    small_batches(df.sparkSession)
    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, {PROBE}").withColumnRenamed("key", key)


def store_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, media: each text as an ISO media file."""

    def run(batches):
        for batch in batches:
            files = [wrap_samples(pad(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.large_binary() if sum(map(len, files)) > 2**30 else pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, media binary")


STORED = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {TRACK}"


def _stored_row(doc_id, text: bytes | None) -> tuple:
    media = wrap_samples(pad(text))
    track = tracks(media)[0]
    payload = read_samples(media, track)
    ranges = _listed(track)
    feature = f"{track['codec'].strip()};{track['timescale']};{track['duration']};{len(track['sizes'])};{len(ranges)};{ranges[-1]['start']}-{ranges[-1]['end']}"
    return (
        doc_id, len(text or b""), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, track["codec"], track["timescale"], track["duration"], len(track["sizes"]), ranges,
    )


def media_digests(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> what is read back from each stored file; columns of STORED."""
    small_batches(docs.sparkSession)

    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), _RANGES)
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "timescale", "duration", "samples", "keyframes"]
        for batch in batches:
            rows = [_stored_row(k, t.as_py()) for k, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, STORED)
