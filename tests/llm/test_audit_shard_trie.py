import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from brandloom.llm import filter_audit as A, prefix_trie as T, sharding as S

RANDOM = random.Random(11)
LONG = "Word " * 30_000
TEXTS = [None, "", " \t\n", "one two three", "ONE TWO", "a#b " * 120, " ".join(f"w{i}" for i in range(150)), " ".join(["same"] * 150), "A" * 40 + " b" * 200, LONG, "é" * 500 + " $"]


def _docs(spark, rows):
    """doc_id, text, lang and columns whose names the operators use themselves."""
    names = ("digest", "size", "shard", "mask", "part", "n", "bucket", "first")
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))


ROWS = [(i, RANDOM.choice(TEXTS), RANDOM.choice(["en", "de", None])) for i in range(60)] + [(None, "one two three", "en"), (None, "one two three", "en"), (None, LONG, None), (7, "one two three", "en"), (7, "one two three", "en"), (7, "one two three", "de")]
LABELS = [(i, RANDOM.choice([0, 1, None]), RANDOM.choice([0, 1, None])) for i in range(0, 60, 2)] + [(4, 1, 1), (None, 1, 1)]


# op11 ------------------------------------------------------------------------------------------------------------------


def _fails(doc_id, text, rows):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    rank = lambda i: float("inf") if i is None else i
    tests = {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": re.search("[#$%&*|]", text) is not None, "E": any((t or "") == text and rank(i) < rank(doc_id) for i, t, _ in rows),
    }
    return {k for k, v in tests.items() if v}


def _brute_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out = {}
    failing = [(lang or "", i, _fails(i, t, rows)) for i, t, lang in rows]
    for order in map("".join, permutations("ABCDE")):
        for part, doc_id, fails in failing:
            first = min((order.index(f) for f in fails), default=9)
            for k, f in enumerate(order):
                row = out.setdefault((part, order, k + 1), Counter())
                row["kept"] += first > k
                row["removed"] += first == k
                row["redundant"] += first < k and f in fails
                row["unique_fails"] += fails == {f}
                row["good_lost"] += first == k and doc_id in good
                row["toxic_lost"] += first == k and doc_id in toxic
                row["shapley"] += 120 // len(fails) if f in fails else 0
    return {(*k, *(v[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = A.filter_audit(_docs(spark, ROWS), labels).collect()
    assert {tuple(r) for r in got} == _brute_audit(ROWS, LABELS)
    assert len(got) == 3 * 120 * 5


def test_audit_of_empty_tables(spark):
    docs, labels = _docs(spark, ROWS[:3]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(docs.limit(0), labels).count() == 0
    assert {r.good_lost for r in A.filter_audit(docs, labels).collect()} == {0}


def test_sums_give_back_the_cells(spark):
    """The transform is inverted exactly, with other numbers of filters, too."""
    for filters in (1, 3, 5):
        counts = {m: RANDOM.randrange(10**12) for m in range(1 << filters)}
        cells = spark.createDataFrame([("p", 0, 0, m, n) for m, n in counts.items()], "part string, good int, toxic int, mask int, n long")
        assert A.mask_counts(A.parity_sums(cells, filters), filters).first().cells == list(counts.values())


# op12 ------------------------------------------------------------------------------------------------------------------


def _heap(sizes, shards):
    loads = [(0, k) for k in range(shards)]
    out = []
    for size in sizes:
        load, k = heapq.heappop(loads)
        out.append(k)
        heapq.heappush(loads, (load + size, k))
    return out


@pytest.mark.parametrize("shards", [1, 2, 3, 8])
def test_levels_equal_the_heap(shards):
    for _ in range(400):
        loads = [RANDOM.randrange(RANDOM.choice([1, 7, 90, 5000])) for _ in range(shards)]
        size, count = RANDOM.randrange(1, 60), RANDOM.randrange(120)
        heap = [(load, k) for k, load in enumerate(loads)]
        heapq.heapify(heap)
        want = list(loads)
        for _ in range(count):
            load, k = heapq.heappop(heap)
            want[k] = load + size
            heapq.heappush(heap, (load + size, k))
        assert S.deal(loads, size, count) == want
    assert sum(S.deal([0] * shards, 3, 10**15)) == 3 * 10**15  # at once, not one by one


@pytest.mark.parametrize("shards", [3, 8])
def test_places_equal_the_heap(spark, shards):
    """Many groups of few sizes, and one that outweighs all others."""
    sizes = sorted([RANDOM.choice([5, 5, 5, 9, 14, 40]) for _ in range(700)] + [3000, 12_000, 1, 1], reverse=True)
    rows, start = [], 0
    loads = [0] * shards
    for size in sorted(set(sizes), reverse=True):
        n = sizes.count(size)
        rows += [(size, list(loads), i, start + i) for i in range(n)]
        loads, start = S.deal(loads, size, n), start + n
    placed = S.place_groups(spark.createDataFrame(rows, "total long, loads array<long>, i long, at long")).orderBy("at").collect()
    assert [r.shard for r in placed] == _heap(sizes, shards)


def test_sharding_equals_brute_force(spark):
    got = S.shard_documents(_docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    totals = Counter()
    for _, t, _ in ROWS:
        totals[sha(t)] += len((t or "").encode()) + 1
    order = sorted(totals, key=lambda g: (-totals[g], g))
    shard = dict(zip(order, _heap([totals[g] for g in order], 8)))
    text = {sha(t): t for _, t, _ in ROWS}
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", shard[sha(t)], None) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want and len(text) == len(totals)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    again = S.shard_documents(_docs(spark, ROWS[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))  # on another layout


def test_sharding_of_an_empty_table(spark):
    assert S.shard_documents(_docs(spark, ROWS[:1]).limit(0)).count() == 0


# op13 ------------------------------------------------------------------------------------------------------------------


def _talks():
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 206, 300, -5]:
        for k in range(RANDOM.choice([1, 2, 4, 7, 12])):
            rows.append((c, RANDOM.choice([k, k, None]), RANDOM.choice(["user", "assistant", None]), RANDOM.choice(["hi", "yes", "", None, "é" * 7])))
    for c in range(400, 460):  # a first turn and whole talks that very many share
        rows += [(c, k, "user", "same") for k in range(3 if c % 2 else 9)]
    rows += [(130, 0, "user", LONG), (131, 0, "user", LONG), (None, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 0, "user", "hi")]
    return rows


def _brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, sha, (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        leaves, saved = (0 if children[node] else 1), ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        for x in children[node]:
            more = below(x)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = set()
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if whole[c] == node)
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("shard_rows", "max_heavy"), [(200_000, 1_000_000), (40, 1000), (3, 1000), (5, 4)])
def test_trie_equals_brute_force(spark, shard_rows, max_heavy):
    """One trie; many shards below heavy levels; nearly all levels heavy; a limit that the bound on heavy nodes sets."""
    rows = _talks()
    talks = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, depth int")
    got = T.prefix_trie(talks, shard_rows, max_heavy).collect()
    want = _brute_trie(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_trie_of_an_empty_table(spark):
    assert T.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bits_give_back_the_tree():
    """A tree of random parents: level order, bits, parents, levels and labels."""
    for n in (1, 2, 50, 400):
        up = [-1, *(RANDOM.randrange(i) for i in range(1, n))]
        depth = np.zeros(n, np.int64)
        for i in range(n):
            depth[i] = 3 if up[i] < 0 else depth[up[i]] + 1
        key = np.array([[RANDOM.getrandbits(60), i] for i in range(n)], np.int64)
        parent = np.array([key[u] if u >= 0 else [5, 5] for u in up], np.int64)
        trie = T.build_trie(depth, key, parent, {"chars": np.arange(n), "ends": np.ones(n, np.int64), "first_end": np.arange(n)})
        order = trie["chars"]
        places = T.parents_of(trie["louds"], n)
        assert [up[order[i]] if up[order[i]] >= 0 else None for i in range(n)] == [order[p - 1] if p else None for p in places]
        sizes = Counter(depth.tolist())
        assert [s.stop - s.start for s in T.levels_of(places)] == [sizes[d] for d in sorted(sizes)]
        rolled = T.roll_up(trie | {"below": np.empty((0, 5), np.int64)})
        assert (np.stack([rolled["k1"], rolled["k2"]], axis=1) == key[order]).all() and rolled["n_convs"][0] == n and (rolled["depth"] == depth[order]).all()
