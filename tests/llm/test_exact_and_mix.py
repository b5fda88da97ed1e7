import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brandloom.llm import exact_dedup as E, mixing as M

DOCS = [(3, "a  b", "s"), (1, "a\tb", "s"), (2, None, None), (5, "", "s"), (1, "a b", "t"), (None, "a b", "t"), (7, " a b", "u"), (8, "x" * 100_000, "u"), (9, "x" * 100_000, "u")]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], "doc_id long, text string, source string, digest string, row int")


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 5000])
def test_perfect_hash(n):
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    places = np.arange(2 * n, dtype=np.int64).tobytes()
    size, pilots, digests, locators = E.build_mph(b"".join(keys), places)
    slots = E.lookup_mph(size, pilots, digests, b"".join(keys))
    assert size == n and sorted(slots.tolist()) == list(range(n))
    if n:
        assert (np.frombuffer(locators, np.int64).reshape(-1, 2)[slots, 0] == np.arange(n) * 2).all()
        assert (E.lookup_mph(size, pilots, digests, hashlib.sha256(b"other").digest() * 3) == -1).all()


def test_repeated_digests_are_refused():
    with pytest.raises(ValueError, match="twice"):
        E.build_mph(hashlib.sha256(b"a").digest() * 2, bytes(2 * E.LOCATOR))


def test_the_lookup_decides(spark):
    rows = [(i, f"text {i % 5}", "s") for i in range(20)]
    assert {r.group_size for r in E.exact_dedup(_frame(spark, rows)).collect()} == {4}
    history = spark.createDataFrame([(b"d" * 32, 1, 1, 2)], "digest binary, doc_id long, row long, n long")
    asked = spark.createDataFrame([(b"d" * 32, 9, 9, 3)], "digest binary, doc_id long, row long, n long")
    groups = lambda member: sorted((r.keep_row, r.group_size) for r in E.groups_of(history, asked.withColumn("member", F.lit(member)).withColumn("row", F.lit(1 if member else 9))).collect())
    assert groups(True) == [(1, 5)] and groups(False) == [(1, 2), (9, 3)]


def test_exact_dedup(spark):
    got = E.exact_dedup(_frame(spark, DOCS)).collect()
    assert len(got) == len(DOCS)
    for r in got:
        same = [(i is None, i) for i, t, _ in DOCS if hashlib.sha256(_norm(t).encode()).hexdigest() == r.text_sha256]
        assert r.keep_id == min(same)[1] and r.group_size == len(same)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for rows in groups.values():
        assert sum(r.kept for r in rows) == 1 and next(r for r in rows if r.kept).doc_id == rows[0].keep_id
    assert E.exact_dedup(_frame(spark, [])).count() == 0


def test_keep_distinct(spark):
    docs = _frame(spark, [*DOCS, DOCS[1]])
    left = E.keep_distinct(docs)
    assert left.columns == docs.columns
    assert sorted(_norm(r.text) for r in left.collect()) == sorted({_norm(t) for _, t, _ in DOCS})


def _targets(sizes):
    """Shares by weight; what is above a limit is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in free), 1)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in free}}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "B", "c", None, "dd"][min(4, int(rng.exponential(1.2)))]) for i in range(2000)] + [(None, None, "empty"), (5, "w w", "a")]
    docs = _frame(spark, rows)
    got = M.mix_counts(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    expected = _targets(sizes)
    taken = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
        assert r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 0.1 * t + 150
    again = {(r.doc_id, r.text): r.taken for r in M.mix_counts(docs.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text] == r.taken for r in got)
    copies = M.emit_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)
    assert M.mix_counts(_frame(spark, [])).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("name", ["op4_exact_dedup", "op7_chat_format", "op10_source_mix"])
def test_oracle(spark, name):
    import duckdb

    from brandloom.llm import queries as Q

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    rel = con.sql(Q.ORACLES[name])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted(tuple(norm(v) for v in row) for row in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in rel.columns) for r in Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect())
    assert got == want
