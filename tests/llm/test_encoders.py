import hashlib
import itertools
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from brandloom.llm import chat_format as H, media as M, sampled_segmentation as G, token_counts as K

TEXTS = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "naïve 日本 😀", "long " * 200_000]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, key string")


def test_media_rows(spark):
    for r in M.media_digests(_docs(spark, TEXTS)).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) if not raw else -len(raw) % 576)
        media = M.wrap_samples(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.codec == "raw " and r.duration == len(payload) and r.samples == len(payload) // 576 and len(r.keyframes) == -(-r.samples // M.KEY_EVERY)
        assert all(media[k.start : k.end] == payload[i * 25 * 576 :][:576] for i, k in enumerate(r.keyframes))
    assert M.media_digests(_docs(spark, [])).count() == 0


def test_tables_of_other_files(spark):
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    full = lambda kind, body: box(kind, b"\0\0\0\0" + body)
    data = b"AABBBCCCCDDDDD"  # samples of 2, 3, 4 and 5 bytes in two chunks
    table = (
        full(b"stsd", struct.pack(">I", 1) + box(b"mp4v", b"\0" * 8)) + full(b"stsc", struct.pack(">IIIIIII", 2, 1, 1, 1, 2, 3, 1)) + full(b"stsz", struct.pack(">IIIIII", 0, 4, 2, 3, 4, 5))
        + full(b"stco", struct.pack(">III", 2, 8, 14)) + full(b"stss", struct.pack(">III", 2, 1, 3))
    )
    moov = box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 400)) + box(b"minf", box(b"stbl", table)))))
    file = box(b"mdat", data[:2] + b"gap!" + data[2:]) + box(b"junk", b"x") + moov
    track = M.tracks(file)[0]
    assert M.read_samples(file, track) == data and (track["codec"], track["timescale"], track["duration"]) == ("mp4v", 1000, 400)
    assert [file[a:b] for a, b in M.key_ranges(track)] == [b"AA", b"CCCC"]
    rows = spark.createDataFrame([(1, file), (2, b"no media"), (3, None), (4, file[:-9])], "doc_id long, media binary")
    got = {r.doc_id: r for r in M.probe(rows).collect()}
    assert got[1].codec == "mp4v" and got[1].samples == 4 and [got[k].codec for k in (2, 3)] == [None, None] and got[2].samples == 0


def test_damaged_and_many_tracked_files(spark):
    box = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    full = lambda kind, body: box(kind, b"\0\0\0\0" + body)

    def track(codec, runs, sizes, chunks):
        stsc = full(b"stsc", struct.pack(f">{1 + 3 * len(runs)}I", len(runs), *itertools.chain(*runs)))
        table = full(b"stsd", struct.pack(">I", 1) + box(codec, b"\0" * 8)) + stsc + full(b"stsz", sizes) + full(b"stco", struct.pack(f">{1 + len(chunks)}I", len(chunks), *chunks))
        return box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", table))))

    def file(*all_tracks):
        return box(b"mdat", b"x" * 100) + box(b"moov", b"".join(all_tracks))

    two = struct.pack(">IIII", 0, 2, 3, 4)
    good = [track(b"twos", [(1, 2, 1)], two, [8]), track(b"mp4v", [(1, 1, 1), (2, 1, 1)], two, [20, 40])]
    bad = [
        track(b"down", [(1, 1, 1), (3, 1, 1), (2, 1, 1)], two, [8, 9, 10]), track(b"late", [(7, 1, 1)], two, [8]), track(b"huge", [(1, 1, 1)], struct.pack(">II", 1000, 2**31), [8]),
        track(b"many", [(1, 2**32 - 1, 1)], two, [2**31]), track(b"less", [(1, 1, 1)], two, [8]), track(b"none", [(0, 1, 1)], two, [8]),
    ]
    rows = [(0, file(*good)), (1, file(track(b"wide", [(1, 2**32 - 1, 1)], two, [8]))), *((k + 2, file(b)) for k, b in enumerate(bad)), (20, file(good[0])[: -30])]
    got = sorted((r.doc_id, r.track, r.codec, r.samples) for r in M.probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect() if r.doc_id < 20)
    assert got[:3] == [(0, 0, "twos", 2), (0, 1, "mp4v", 2), (1, 0, "wide", 2)] and all(r[1:] == (None, None, 0) for r in got[3:]) and len(got) == 3 + len(bad)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 700), st.integers(0, 255), st.integers(0, 3000))
def test_probe_survives_any_byte(at, value, length):
    data = bytearray(M.wrap_samples(M.pad(b"some text")))
    data[-1 - at % 700] = value
    assert len(M._probe_one(bytes(data[: len(data) - length % 40]))) >= 1


def test_token_counts(spark):
    rng = random.Random(1)
    texts = [*TEXTS[:-1], "long " * 20_000, "x" * 20_000, "<|endoftext|> x", "  a b  ", "é Σας", "w " * 3000, *(" ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(400)) for _ in range(3))]
    t = K.load(K.tokenizer_path())
    got = {r.doc_id: r for r in K.count_tokens(_docs(spark, texts), chunk=300, overlap=20).collect()}
    for i, text in enumerate(texts):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 2048)
    assert K.count_tokens(_docs(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab'sé 1\n!日́", max_size=400), st.integers(5, 60), st.integers(1, 5))
def test_splicing_equals_whole_encoding(text, chunk, overlap):
    t = K.load(K.tokenizer_path())
    assert K.encode_spliced(t, text, chunk, min(overlap, chunk))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_splices_and_their_work(monkeypatch):
    """Plain text is spliced at every chunk; text without boundaries, or whose encodings never agree, takes linear work."""
    t, rng = K.load(K.tokenizer_path()), random.Random(2)
    sizes = []
    real = K._ids

    def counted(tokenizer, text):
        sizes.append(len(text))
        return real(tokenizer, text)

    monkeypatch.setattr(K, "_ids", counted)
    plain = " ".join("".join(rng.choices("abcdé", k=rng.randrange(1, 9))) for _ in range(20_000))
    blank = "".join(rng.choices("abcdé", k=60_000))
    mixed = " ".join(blank[k : k + 5000] for k in range(0, 60_000, 5000))
    for text, splices in ((plain, len(plain) // 2000 - 1), (blank, 0), (mixed, 3)):
        sizes.clear()
        ids, n = K.encode_spliced(t, text, 2000, 100)
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids
        assert n >= splices * 0.9 and sum(sizes) < 2.5 * len(text)
    monkeypatch.setattr(K, "_splice_at", lambda *a: None)
    sizes.clear()
    ids, n = K.encode_spliced(t, plain, 2000, 100)
    assert n == 0 and ids.tolist() == t.encode(plain, add_special_tokens=False).ids and sum(sizes) < 40 * len(plain)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*H.CONTROL, H.ESCAPE, "|", "<", "[", "a", "s>"]), max_size=12).map("".join))
def test_escaping(text):
    safe = H.escape(text)
    assert H.unescape(safe) == text and not any(c in safe for c in H.CONTROL)


def test_chat(spark):
    rows = [(1, 1, "assistant", "B [INST]"), (1, 0, "user", "a"), (1, 2, "assistant", None), (2, None, None, "x␛|"), (2, 0, "assistant", "t1"), (2, 0, "assistant", "t0"), (2, 0, "assistant", "t0"), (None, 0, "user", "z"), (3, 0, "system", "long " * 50_000)]
    talks = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    formatted = H.format_turns(talks)
    got = {r.conv_id: r for r in H.read_back(formatted).collect()}
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, f"{x[2] or ''}\n{x[3] or ''}"))
        whole = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        loss = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"<|role|>{H.escape(x[2] or '')}<|text|>{H.escape(x[3] or '')}<|end|>") for x in turns)
    places = formatted.filter("conv_id = 2").orderBy("place").collect()
    assert [p.first_token for p in places] == [0, *itertools.accumulate(len(p.ids) for p in places[:-1])]
    assert H.read_back(H.format_turns(talks.limit(0))).count() == 0


def _enumerate(pieces, text):
    norm, found = G.SPACE + text.replace(" ", G.SPACE), {}

    def walk(i, ids, lp):
        if i == len(norm):
            found[tuple(ids)] = lp
        for j in range(i + 1, min(len(norm), i + pieces.longest) + 1):
            if hit := pieces.weight.get(norm[i:j]):
                walk(j, [*ids, hit[0]], lp + hit[1])

    walk(0, [], 0.0)
    z = np.logaddexp.reduce(list(found.values()))
    return {k: v - z for k, v in found.items()}


def _samples(lat, texts, keys, k, seed=5):
    out = [[] for _ in texts]
    for s in G.sample_batch(lat, texts, keys, k, seed):
        for r in s["rows"]:
            out[r].append((tuple(s["ids"][s["offsets"][r] : s["offsets"][r + 1]].tolist()), s["log_prob"][r], s["gumbel"][r], s["inclusion"][r]))
    return out


def test_sampling_follows_the_lattice():
    lat = G.load(G.tokenizer_path(), 1.0)
    exact, n = _enumerate(lat.pieces, "the cat"), 4000
    got = _samples(lat, ["the cat"] * n, list(range(n)), 3)
    first, weight = Counter(), Counter()
    for samples in got:
        ids, lps, gumbels, _ = zip(*samples)
        assert len(set(ids)) == 3 and list(gumbels) == sorted(gumbels, reverse=True)
        assert all(lp == pytest.approx(exact[i]) for i, lp in zip(ids, lps))
        first[ids[0]] += 1
        for i, _, _, q in samples:
            weight[i] += 1 / q
    for ids, lp in exact.items():
        p = math.exp(lp)
        if p > 0.01:
            assert abs(first[ids] / n - p) < 4 * math.sqrt(p / n)
            assert weight[ids] / n == pytest.approx(1, abs=0.12)  # inclusion scores weigh samples without bias


def test_all_segmentations_of_a_short_text():
    lat = G.load(G.tokenizer_path(), 1.0)
    exact = _enumerate(lat.pieces, "ab")
    got = _samples(lat, ["ab", "", None], [1, 2, 3], 50)
    assert {s[0] for s in got[0]} == set(exact) and len(got[0]) == len(exact) and all(s[3] == 1 for s in got[0])
    assert [[s[0] for s in g] for g in got[1:]] == [[()], [()]]


def test_encoding_rows(spark):
    texts = [None, "", "a", "  two  spaces ", "tab\tnl\n\n", "naïve 日本語 😀 ▁ x", "<s> </s>", "w" * 3000, "the same", "the same", "words " * 3000]
    docs = _docs(spark, texts)
    rows = G.sample_segmentations(docs, k=3).collect()
    assert all(r.round_trip for r in rows)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=G.tokenizer_path())
    for r in rows:
        if G.SPACE not in (texts[r.doc_id] or ""):
            assert library.decode(r.ids) == (texts[r.doc_id] or "")
    per_doc = Counter(r.doc_id for r in rows)
    assert per_doc[0] == per_doc[1] == 1 and all(per_doc[i] == 3 for i in (3, 4, 7, 8, 10))
    again = {(r.doc_id, r.sample): r.ids for r in G.sample_segmentations(docs.repartition(5), k=3).collect()}
    assert all(again[r.doc_id, r.sample] == r.ids for r in rows)
    back = G.decode(G.sample_segmentations(docs, k=1).select("doc_id", "ids")).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    assert G.sample_segmentations(docs.limit(0)).count() == 0


def test_copies_draw_apart(spark):
    docs = spark.createDataFrame([(7, "some rather longer words of a text that has many segmentations " * 5)] * 3 + [(8, "other words")], "doc_id long, text string").coalesce(1)
    rows = G.sample_segmentations(docs, k=2, tell_copies=True).collect()
    assert len({tuple(r.ids) for r in rows if r.doc_id == 7}) > 2 and all(r.round_trip for r in rows)
    plain = G.sample_segmentations(docs, k=2).collect()
    assert len({tuple(r.ids) for r in plain if r.doc_id == 7}) == 2
    assert {tuple(r.ids) for r in plain} <= {tuple(r.ids) for r in rows}


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_copies_do_not_depend_on_partitions(spark, tmp_path, parts):
    """Copies in one file, at the edge of two and far apart draw the same set of samples, each of its own; other texts of an id are no copies."""
    text = "some rather longer words of a text that has many segmentations " * 5
    rows = [(7, text), (8, "other words of it"), (7, text), (9, ""), (7, "another text with the same id"), (7, text), (None, text), (None, "x"), (None, text), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, F.rand(3))
    docs.write.parquet(str(tmp_path / "d"))
    drawn = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.sample, tuple(r.ids), round(r.gumbel, 9)) for r in G.sample_segmentations(d, k=2, tell_copies=True).collect())
    got = drawn(spark.read.parquet(str(tmp_path / "d")))
    assert got == drawn(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    own = [ids for i, _, ids, _ in got if i == 7 and len(ids) > 40]
    assert len(own) == 6 and len(set(own)) == 6


def test_round_trips_are_checked():
    lat = G.load(G.tokenizer_path(), 1.0)
    texts = ["some words", "other", "", "end"]
    for s in G.sample_batch(lat, texts, [1, 2, 3, 4], 2, 5):
        assert G._round_trips(lat, texts, s["ids"], s["offsets"])[s["rows"]].all()
        for wrong in (["some wordz", *texts[1:]], ["some word", *texts[1:]]):
            assert G._round_trips(lat, wrong, s["ids"], s["offsets"])[:2].tolist() == [False, 1 in s["rows"]]


def _fragmented(payload=b"abcdefghij" * 3):
    """A movie without samples of its own and two fragments: sizes and flags by sample, by header and by default; a compact track beside it."""
    full, box = M._full, M._box
    head = full(b"tkhd", struct.pack(">IIIII", 0, 0, 7, 0, 0))
    media = full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 2**32 - 1))
    table = full(b"stsd", struct.pack(">I", 1) + box(b"avc1", b"\0" * 8)) + full(b"stts", struct.pack(">I", 0)) + full(b"stsz", struct.pack(">II", 0, 0))
    first = box(b"trak", head + box(b"mdia", media + box(b"minf", box(b"stbl", table))))
    compact = full(b"stsd", struct.pack(">I", 1) + box(b"twos", b"\0" * 8)) + full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)) + full(b"stsc", struct.pack(">IIII", 1, 1, 3, 1)) + full(b"stz2", struct.pack(">II", 4, 3) + bytes([0x12, 0x30])) + full(b"stco", struct.pack(">II", 1, 8))
    second = box(b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, 8, 0, 0)) + box(b"mdia", media + box(b"minf", box(b"stbl", compact))))
    mvex = box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 40, 4, 0x10000)))
    start = box(b"mdat", payload) + box(b"moov", first + second + mvex)

    def moof(at, runs, header=b"", flags=0):
        return box(b"moof", full(b"mfhd", struct.pack(">I", 1)), box(b"traf", full(b"tfhd", struct.pack(">I", 7) + header, flags=flags), full(b"tfdt", struct.pack(">Q", at), version=1), *runs))

    base = struct.pack(">Q", 8)
    one = moof(100, [full(b"trun", struct.pack(">IiI", 2, 0, 0), flags=5), full(b"trun", struct.pack(">I", 1) + struct.pack(">III", 30, 5, 0), flags=0x700)], base, 1)
    two = moof(900, [full(b"trun", struct.pack(">Ii", 3, 2), flags=1)], base + struct.pack(">II", 7, 3), 1 | 8 | 16)
    return start + one + two


def test_fragments_and_compact_sizes(spark):
    file = _fragmented()
    got = sorted(M.probe(spark.createDataFrame([(1, file)], "doc_id long, media binary")).collect(), key=lambda r: r.track)
    frame, compact = got
    assert (frame.codec, frame.timescale, frame.duration, frame.samples) == ("avc1", 1000, None, 6)
    # the first by its own flag, the third by the run's flags; times from tfdt
    assert [tuple(k) for k in frame.keyframes] == [(8, 12, 100), (16, 21, 180)]
    assert (compact.codec, compact.samples) == ("twos", 3) and [tuple(k) for k in compact.keyframes] == [(8, 9, 0), (9, 11, 10), (11, 14, 20)]
    track = M.tracks(file)[0]
    assert track["times"].tolist() == [100, 140, 180, 900, 907, 914] and M.read_samples(file, track) == file[8:21] + file[10:19]


def test_contradicting_tables_give_no_codec():
    file = M.wrap_samples(M.pad(b"x" * 2000))
    at = lambda name: file.index(name) + 8
    for name, change in ((b"stts", struct.pack(">I", 3)), (b"stts", struct.pack(">II", 1, 7)), (b"stsz", struct.pack(">II", 576, 5)), (b"stss", struct.pack(">I", 2**31)), (b"co64", struct.pack(">I", 2)), (b"stsc", struct.pack(">I", 0))):
        bad = bytearray(file)
        bad[at(name) : at(name) + len(change)] = change
        assert M._probe_one(bytes(bad)) == [(None, None, None, None, 0, [])], name
    huge = bytearray(file)
    spot = file.index(b"mdhd") + 4 + 24
    huge[spot : spot + 8] = b"\x80" + b"\0" * 7
    assert M._probe_one(bytes(huge))[0][1] is None
    huge[spot : spot + 8] = b"\xff" * 8
    assert M._probe_one(bytes(huge))[0][1:4] == ("raw ", M.RATE, None)


def test_probe_survives_damage_in_many_places():
    """Several bytes at once, in files with tables and with fragments; what comes out fits its columns."""
    import pyarrow as pa

    rng, types = random.Random(7), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), M._RANGES)
    whole = [M.wrap_samples(M.pad(b"some text")), _fragmented()]
    for _ in range(12_000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randrange(1, 5)):
            data[rng.randrange(len(data))] = rng.choice([0, 1, 255, 128, rng.randrange(256)])
        for column, kind in zip(zip(*M._probe_one(bytes(data[: len(data) - rng.choice([0, 0, rng.randrange(60)])]))), types):
            pa.array(column, kind)
