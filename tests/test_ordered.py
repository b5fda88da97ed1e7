"""Ordered streams against their batch rules: several batches, late rows, ties, quiet keys, another time zone."""

import datetime as dt
import random
import time

import pytest

from brandloom.streaming import ordered, state

R = random.Random(6)
START = dt.datetime(2024, 3, 9, 20, 0, 0, 123456)
SCHEMA = "id long, key string, ts timestamp"


def _rows(n=400):
    rows, now = [], START
    for i in range(n):
        now += dt.timedelta(seconds=R.choice([0, 1, 400, 3000, 9000]))
        rows.append((i, R.choice("abcde" if i < n // 2 else "cdefgh"), now))
    return rows


def _batches(rows, folder, spark, parts=4):
    """Files in order of time, but some rows come one file late."""
    per = -(-len(rows) // parts)
    for k in range(parts):
        own = [r for i, r in enumerate(rows) if min(parts - 1, i // per + (i % 11 == 0)) == k]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by time


def _run(stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def _brute_cache(rows, ttl, forget):
    read, out = {}, []
    for i, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        at = read.get(key)
        fresh = at is not None and ts < at + dt.timedelta(seconds=ttl)
        outcome = "hit" if fresh else "miss" if at is None or ts >= at + dt.timedelta(seconds=ttl + forget) else "refetch"
        read[key] = at if fresh else ts
        out.append((i, key, outcome, read[key]))
    return sorted(out)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_streams_equal_batch_rules(spark, tmp_path, zone):
    own = ordered.session_for_state(spark)
    own.conf.set("spark.sql.session.timeZone", zone)
    rows = _rows()
    _batches([*rows, (10_000, "last", rows[-1][2] + dt.timedelta(days=9))], str(tmp_path / "in"), spark)
    table = own.read.parquet(str(tmp_path / "in")).filter("key <> 'last'")
    stream = lambda: own.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    _run(ordered.cache_lookups_stream(stream(), 7200, 40_000, "6 days"), str(tmp_path / "cache"))
    got = {(r.id, r.key, r.outcome, r.us, r.read) for r in own.read.parquet(str(tmp_path / "cache/out")).selectExpr("*", "unix_micros(ts) us", "unix_micros(read_at) read").collect()}
    want = {(r.id, r.key, r.outcome, r.us, r.read) for r in ordered.cache_lookups(table, 7200, 40_000).selectExpr("*", "unix_micros(ts) us", "unix_micros(read_at) read").collect()}
    assert got == want and {o for _, _, o, *_ in got} == {"hit", "miss", "refetch"} and len(got) == len(rows)

    _run(ordered.admit_all_stream(stream(), 3, 8, "6 days", buckets=3), str(tmp_path / "quota"))
    got = sorted((r.id, r.key, r.day, r.admitted) for r in own.read.parquet(str(tmp_path / "quota/out")).collect())
    want = sorted((r.id, r.key, r.day, r.admitted) for r in state.admit(table, 3, 8).selectExpr("id", "key", "cast(day as string) day", "admitted").collect())
    assert got == want and 0 < sum(a for *_, a in got) < len(got)
    assert len({d for _, _, d, a in got if a}) > 5


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_cache_equals_a_plain_loop(spark, batch):
    """Batches of any size give the same rows: a key's run goes on over their edges."""
    rows = _rows(600)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r.id, r.key, r.outcome, r.read_at) for r in ordered.cache_lookups(spark.createDataFrame(rows, SCHEMA), 7200, 40_000).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == _brute_cache(rows, 7200, 40_000)


def test_null_keys_and_empty(spark):
    rows = [(1, None, START), (2, None, START), (3, "", START), (4, None, START + dt.timedelta(hours=1))]
    got = {r.id: r.outcome for r in ordered.cache_lookups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "miss", 2: "hit", 3: "miss", 4: "refetch"}
    assert ordered.cache_lookups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_keys_share_lanes(spark, tmp_path):
    """The state that is read and written grows with lanes, not with keys."""
    own = ordered.session_for_state(spark)
    rows = [(i, None if i == 7 else f"k{i}", START + dt.timedelta(seconds=i)) for i in range(1500)]
    own.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = own.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, build in (("quota", lambda: ordered.admit_all_stream(stream, buckets=2)), ("cache", lambda: ordered.cache_lookups_stream(stream, late="1 second", lanes=2))):
        query = build().writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        held = [operator.numRowsTotal for progress in query.recentProgress for operator in progress.stateOperators]
        assert held and max(held) <= 50
    assert own.read.parquet(str(tmp_path / "cache")).filter("key is null and outcome = 'miss'").count() == 1
