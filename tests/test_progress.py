"""The section store: replays, half-written batches, versions, compaction."""

import random

from pyspark.sql import functions as F

from brandloom.streaming import progress as P

R = random.Random(4)
SECTIONS = ("a", "b", "c")


def _frame(spark, rows):
    return spark.createDataFrame(rows, P.ROW)


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_replays_change_nothing(spark, tmp_path):
    store = P.SectionStore(spark, str(tmp_path / "s"))
    assert store.rows().count() == 0 and P.section_states(store.rows(), SECTIONS).count() == 0
    store.upsert(_frame(spark, [("r", "a", 1, "running", None, 1), ("r", "a", 1, "done", "x", 2), ("r", "b", 1, "done", "y", 3)]), 0)
    store.upsert(_frame(spark, [("r", "a", 1, "done", "late", 0), ("r", "c", 1, "done", "z", 4)]), 1)
    before = _rows(store.rows())
    assert before == [("r", "a", 1, "done", "x", 2), ("r", "b", 1, "done", "y", 3), ("r", "c", 1, "done", "z", 4)]
    store.upsert(_frame(spark, [("r", "a", 1, "failed", None, 99)]), 1)
    P.SectionStore(spark, str(tmp_path / "s")).upsert(_frame(spark, [("q", "a", 1, "failed", None, 99)]), "0")
    assert _rows(store.rows()) == before


def test_a_batch_without_its_marker_is_not_read(spark, tmp_path):
    store = P.SectionStore(spark, str(tmp_path))
    store.upsert(_frame(spark, [("r", "a", 1, "done", "x", 1)]), 0)
    _frame(spark, [("r", "a", 1, "failed", None, 9)]).write.parquet(str(tmp_path / "rows/torn"))
    assert _rows(store.rows()) == [("r", "a", 1, "done", "x", 1)]


def test_versions_against_brute_force(spark, tmp_path):
    store, everything = P.SectionStore(spark, str(tmp_path)), {}
    for batch in range(5):
        rows = [(R.choice("rst"), R.choice([*SECTIONS, "other"]), R.randrange(4), R.choice(["done", "done", "failed", "running"]), f"d{batch}-{k}", batch * 100 + R.randrange(100)) for k in range(25)]
        rows = list({r[5]: r for r in rows}.values())
        store.upsert(_frame(spark, rows), batch)
        if batch == 3:
            store.compact()
            store.upsert(_frame(spark, rows), 2)  # committed before the compaction
        for r in rows:
            everything[r[:3]] = max(everything.get(r[:3], r), r, key=lambda x: x[5])
    assert _rows(store.rows()) == sorted(everything.values()) and len(store.parts()) == 5
    for s in P.section_states(store.rows(), SECTIONS).collect():
        own = {(v, name): r for (report, name, v), r in everything.items() if report == s.report and name in SECTIONS}
        newest = max(v for v, _ in own)
        whole = [v for v in range(4) if all(own.get((v, x), [None] * 4)[3] == "done" for x in SECTIONS)]
        assert (s.whole_version, s.newest_version) == (max(whole, default=None), newest)
        assert s.done == [x for x in SECTIONS if own.get((newest, x), [None] * 4)[3] == "done"] and s.percent == round(len(s.done) / 3 * 100)
        shown = {r.section: (r.version, r.data) for r in P.visible_sections(store.rows(), SECTIONS).filter(f"report = '{s.report}'").collect()}
        if whole:
            assert shown == {x: (max(whole), own[max(whole), x][4]) for x in SECTIONS}
        else:
            finished = {x: max((v for (v, name), r in own.items() if name == x and r[3] == "done"), default=None) for x in SECTIONS}
            assert shown == {x: (v, own[v, x][4]) for x, v in finished.items() if v is not None}


def test_steps(spark):
    got = {r.s: r.v for r in spark.createDataFrame([("crawling",), ("completed",), ("failed",)], "s string").select("s", P.step_of(F.col("s")).alias("v")).collect()}
    assert got["crawling"].percent == 3 and got["completed"].step == "Done" and got["failed"] is None
