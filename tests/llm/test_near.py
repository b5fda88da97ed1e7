import random

import numpy as np
from pyspark.sql import functions as F

from brandloom.llm import near_dedup as N, shingles, substring_dedup as S

WORDS = [f"w{i}" for i in range(5000)]


def _brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def _corpus(seed=1):
    rng = random.Random(seed)
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    base = rng.choices(WORDS, k=120)
    for _ in range(150):  # one large group around a text, at many distances
        w = list(base)
        for _ in range(rng.randrange(0, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        add(w)
    passage = rng.choices(WORDS, k=40)
    for _ in range(60):  # a shared passage, too little to be linked
        add(rng.choices(WORDS, k=50) + passage)
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 12):
        w = rng.choices(WORDS, k=n)
        add(w)
        add([x.upper() for x in w])
        add(w + ["end"])
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t\n")]
    return rows


def _got(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_shingles int, key string")
    return {r.doc_id: r for r in N.near_components(docs).collect()}


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)  # so that groups are split into several blocks
    rows = _corpus()
    want, got = _brute(rows), _got(spark, rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_repeated_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "x"), (None, "q r s t u v", None)], "doc_id long, text string, comp string")
    assert [(r.doc_id, r.component_id) for r in N.near_components(docs).orderBy("doc_id").collect()] == [(None, None), (1, 1), (1, 1), (2, 1)]
    left = N.keep_one_of_each(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "None"]
    assert N.near_components(docs.limit(0)).count() == 0


def test_small_sets_lose_nothing(spark):
    rng, rows = random.Random(3), []
    for n in range(3, 22):
        for _ in range(25):
            w = rng.choices(WORDS, k=n + 4)
            cut = min(-(-n * 3 // 4), n)  # keeps ceil(0.75 n) shingles of n: exactly at, or just above, the threshold
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[: cut + 4]))]
    assert {i: (r.n_shingles, r.component_id) for i, r in _got(spark, rows).items()} == _brute(rows)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(2)
    off = []
    for share in (0.5, 0.75, 0.9):
        for _ in range(40):
            n = 400
            common = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 2**63, (n - len(common)) // 2, dtype=np.uint64)]) for _ in range(2))
            same = (N.registers(a) == N.registers(b)).mean()
            true = len(common) / (len(a) + len(b) - len(common))
            off.append(N.estimate(np.array([same]), np.array([len(a)]), np.array([len(b)]))[0] - true)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06


def test_shingles_of_short_texts():
    assert len(shingles.shingle_set(None)) == len(shingles.shingle_set(b" \n")) == 0
    assert len(shingles.shingle_set(b"one two")) == 1
    assert shingles.shingle_set(b"A b c d e").tolist() == shingles.shingle_set(b"a\tb c\x0bd e").tolist()


def test_chunks_cover_and_resist_insertions():
    rng = random.Random(4)
    text = " ".join(rng.choices(WORDS, k=3000)).encode()

    def pieces(data):
        ends = S.cut_points(data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    whole = pieces(text)
    assert b"".join(whole) == text and max(len(p.split()) for p in whole) <= 2 * S.REACH
    moved = set(pieces(b"inserted words " + text[:5000] + b" and more " + text[5000:]))
    assert sum(p in moved for p in whole) > 0.97 * len(whole)
    assert S.cut_points(b"") == []


def test_planted_passages(spark):
    rng = random.Random(5)
    clean = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(0, 300)))) for i in range(60)]
    planted = []
    for k in range(20):
        passage = " ".join(rng.choices(WORDS, k=70))
        for copy in range(2):
            planted.append((100 + 2 * k + copy, " ".join(rng.choices(WORDS, k=80)) + " " + passage + " " + " ".join(rng.choices(WORDS, k=80))))
    rows = [*clean, *planted, (900, None), (901, ""), (902, "line " * 400)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int")
    spans = S.repeated_spans(docs).collect()
    assert {r.doc_id for r in spans} == {i for i, _ in planted}
    assert all(r.is_first == (r.doc_id % 2 == 0) and r.first_doc_id == r.doc_id - r.doc_id % 2 for r in spans)
    assert {r.doc_id for r in S.repeated_spans(docs, within=True, min_words=10).collect()} >= {902}
    left = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert S.remove_repeats(docs).columns == docs.columns
    for i, t in rows:
        assert left[i] == t if i % 2 == 0 or i < 100 or i >= 900 else len(left[i]) < len(t)
    assert S.repeated_spans(docs.limit(0)).count() == 0


def test_copy_of_an_edited_copy(spark):
    rng = random.Random(6)
    head, old, new, tail = (" ".join(rng.choices(WORDS, k=k)) + " " for k in (90, 25, 25, 90))
    rows = [(1, head + old + tail), (2, head + new + tail), (3, head + new + tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = sorted(S.repeated_spans(docs).collect(), key=lambda r: (r.doc_id, r.start_byte))
    assert [(r.doc_id, r.first_doc_id, r.is_first) for r in spans] == [(1, 1, True)] * 2 + [(2, 1, False), (2, 2, True), (2, 1, False), (3, 1, False), (3, 2, False), (3, 1, False)]
    left = {r.doc_id: r.text for r in S.remove_repeats(docs).collect()}
    assert left[1] == rows[0][1] and new[30:-30] in left[2] and len(left[2]) < len(new) + 160 and len(left[3]) < 160


def test_every_passage_of_over_fifty_words(spark):
    rng = random.Random(7)
    some = lambda k, sep, words: sep.join(rng.choices(words, k=k))
    rows, letters = [], [chr(c) for c in range(97, 123)]
    for k in range(300):
        sep, words = [(" ", WORDS), ("\n", WORDS), ("\t", letters), ("\r\n", WORDS), (" ", letters)][k % 5]
        passage = some(51, sep, words)
        for copy in range(2):
            rows.append((2 * k + copy, "".join((some(rng.randrange(30), sep, words), rng.choice(["x", " "]), passage, rng.choice(["y", " "]), some(rng.randrange(30), sep, words)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in S.repeated_spans(docs).filter(F.col("is_first") == (F.col("doc_id") % 2 == 0)).collect()} == {i for i, _ in rows}
    monotone = " ".join(rng.choices(letters, k=5000)).encode()
    assert S.cut_texts([monotone])[3].sum() == 5000


def test_segments_and_neighbours_do_not_move_cuts(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices(WORDS, k=2000)).encode(), b"", b"x" * 3000, bytes(rng.choices(range(97, 123), k=5000)), "語彙".encode() * 300, b"one two", "".join(rng.choices("甲乙丙丁戊己庚辛", k=3000)).encode()]
    whole = [S.cut_points(t) for t in texts]
    owner, starts, ends, words, data = S.cut_texts(texts)
    first = {k: int(starts[owner == k].min()) for k in set(owner.tolist())}
    assert [[int(e) - first[k] for e in ends[owner == k]] for k in range(len(texts)) if k in first] == [w for w in whole if w]
    assert len(whole[3]) > 5 and len(whole[6]) > 10
    monkeypatch.setattr(S, "_SEGMENT", 777)
    assert [S.cut_points(t) for t in texts] == whole
    many = S.cut_texts([b"ab " * 4000])
    assert len(many[0]) < 4000 / S.REACH + 20


def test_text_without_blanks(spark):
    rng = random.Random(10)
    some = lambda k: "".join(rng.choices([chr(c) for c in range(0x4E00, 0x4E00 + 800)], k=k))
    passage = some(400)
    docs = spark.createDataFrame([(1, some(300) + passage + some(300)), (2, some(200) + passage), (3, some(600))], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc_id, r.is_first) for r in S.repeated_spans(docs).collect()} == {(1, 1, True), (2, 1, False)}


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(9)
    texts = [rng.choices(WORDS, k=k) for k in (60, 200, 90, 140)]
    changed = [[*w[:-1], "other"] for w in texts]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, changed[0]), (8, changed[1]), (9, changed[2]), (3, changed[3])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_components(docs).collect()), key=str)
    assert got == sorted([(None, 56, 7, False), (None, 196, 8, False), (5, 86, 5, True), (5, 136, 3, False), (7, 56, 7, True), (8, 196, 8, True), (9, 86, 5, False), (3, 136, 3, True)], key=str)
    left = [(r.doc_id, len(r.text.split())) for r in N.keep_one_of_each(docs).collect()]
    assert sorted(left, key=str) == sorted([(7, 60), (8, 200), (5, 90), (3, 140)], key=str)
    nameless = docs.filter("doc_id is null")
    assert [(r.component_id, r.kept) for r in N.near_components(nameless).collect()] == [(None, True)] * 2
    real = spark.createDataFrame([(None, "one text"), (-1, "another text")], "doc_id long, text string")
    assert N.keep_one_of_each(real).count() == 2

    spans = S.repeated_spans(docs).collect()
    assert sorted(((r.doc_id, r.is_first) for r in spans), key=str) == [(3, True), (5, False), (5, True), (7, True), (8, True), (9, False), (None, False), (None, False)]
    kept = [(r.doc_id, len(r.text.split())) for r in S.remove_repeats(docs).collect()]
    assert len(kept) == 8 and {(7, 60), (8, 200), (5, 90), (3, 140)} <= set(kept) and all(n < 30 for i, n in kept if i in (None, 9))
    same = spark.createDataFrame([(1, " ".join(texts[0]))] * 2, "doc_id long, text string")
    assert sorted(r.is_first for r in S.repeated_spans(same).collect()) == [False, True]


def test_links_become_forests_before_components(spark, monkeypatch):
    """A clique's links are its members' square; what the passes see of them is fewer than the members."""
    import pyarrow as pa

    pairs = [(a, b) for c in range(0, 300, 100) for a in range(c, c + 60) for b in range(a + 1, c + 60)] + [(59, 100), (7, 7)]
    u, v = (pa.array([p[i] for p in pairs[:-1]], pa.int64()) for i in (1, 0))
    whole = pa.RecordBatch.from_arrays([u, v], ["u", "v"])
    assert sum(b.num_rows for b in N._forest(iter([whole.slice(0, 2000), whole.slice(2000)]))) == 180 - 2
    assert list(N._forest(iter([]))) == []
    links = spark.createDataFrame(pairs, "a long, b long")
    for bound in (1_000_000, 500):
        monkeypatch.setattr(N, "FOREST", bound)
        got = {r.node: r.comp for r in N.components(links).collect()}
        assert got == {n: 200 if n >= 200 else 0 for c in range(0, 300, 100) for n in range(c, c + 60) if n not in (0, 200)}  # the least stands for itself
    assert N.components(links.limit(0)).count() == 0
