"""Streams whose state must see a key's rows in the order of their time: a cache with a lifetime, and chained quotas.

Rows wait in state until the watermark has passed them, so rows that come late, but within the allowed time, take their place in order; then they are folded and leave.
What is kept besides is one small number a key, dropped by an event-time timer. Keys share lanes, and a lane's state is read and written as a whole. State lives in RocksDB (`session_for_state`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import cut, drop_folder, shared_dir
from .state import GLOBAL, PER_KEY

#: Fixed value: how long a site's robots file is taken as read.
TTL_SECONDS = 3600
#: How long a key is remembered after what was read has expired; asked for later, it counts as new.
FORGET_SECONDS = 30 * 86_400
DAY_US = 86_400_000_000
OUTCOMES = ["miss", "hit", "refetch"]
#: Lanes that a stream's keys are dealt to. A call to the state costs far more than a row, so many keys share a lane and its state.
LANES = 256


def session_for_state(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB; the caller's settings stay."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


def _runs(codes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal codes."""
    edges = np.flatnonzero(np.diff(codes)) + 1
    return zip([0, *edges], [*edges, len(codes)]) if len(codes) else iter(())


def _reads(ts: np.ndarray, read_at: int | None, span: int, keep: int) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Outcomes (places in OUTCOMES) and reads of one key's requests in order, and its last read; the next read is found by bisection."""
    outcome, reads, at = np.zeros(len(ts), np.int8), np.empty(len(ts), np.int64), 0
    while at < len(ts):
        if read_at is None or ts[at] >= read_at + span:
            outcome[at] = 0 if read_at is None or ts[at] >= read_at + keep else 2
            read_at = int(ts[at])
            reads[at] = read_at
            at += 1
        until = int(np.searchsorted(ts, read_at + span))
        outcome[at:until], reads[at:until] = 1, read_at
        at = max(at, until)
    return outcome, reads, read_at


def cache_lookups(requests: DataFrame, ttl: int = TTL_SECONDS, forget: int = FORGET_SECONDS) -> DataFrame:
    """requests(key, ts, id) + outcome, read_at: 'hit' while what was read is younger than `ttl` seconds, then 'refetch'; 'miss' for a key's first request and after `forget` seconds more.

    Rows are ordered within partitions and pass through in batches; within one, the next read is found by bisection, so a key with any number of
    requests takes one value of memory and a step for each read.
    """
    span, keep = ttl * 1_000_000, (ttl + forget) * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, read_at, known = None, None, False
        for batch in batches:
            keys, ts = batch.column(0).dictionary_encode(), batch.column(1).cast(pa.int64()).to_numpy()
            codes = keys.indices.fill_null(-1).to_numpy()
            names = [*keys.dictionary.to_pylist(), None]
            outcome, reads = np.zeros(len(ts), np.int8), np.empty(len(ts), np.int64)
            for begin, end in _runs(codes):
                key = names[codes[begin]]
                if not known or key != last_key:
                    last_key, read_at, known = key, None, True
                outcome[begin:end], reads[begin:end], read_at = _reads(ts[begin:end], read_at, span, keep)
            said = pa.DictionaryArray.from_arrays(pa.array(outcome), OUTCOMES).dictionary_decode()
            yield pa.RecordBatch.from_arrays([*batch.columns, said, pa.array(reads).cast(batch.schema.field("ts").type)], [*batch.schema.names, "outcome", "read_at"])

    rows = requests.select("key", "ts", "id").repartition("key").sortWithinPartitions("key", "ts", "id")
    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, f"key {kind['key']}, ts {kind['ts']}, id {kind['id']}, outcome string, read_at {kind['ts']}")


def _lane(lanes: int) -> Column:
    return F.concat(F.lit("keys "), F.pmod(F.xxhash64("key"), F.lit(lanes)).cast("string"))


class _InOrder(StatefulProcessor):
    """Holds a lane's rows until the watermark passes them, then hands them to `fold` in the order of time and id. Times are microseconds since 1970.

    A lane has the rows of many keys. Arriving rows are kept as one value of the state a frame, what is kept of the keys as one value a lane.
    """

    columns = {"us": "long", "id": "long", "key": "string"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ", ".join(f"{c} array<{kind}>" for c, kind in self.columns.items()))
        self.kept = handle.getValueState("kept", "names array<string>, amounts array<long>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        first = None
        for new in rows:
            if len(new):
                self.pending.appendValue(tuple(_plain(new[c]) for c in self.columns))
                first = min(x for x in (first, int(new["us"].min())) if x is not None)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(self.pending.get()) if self.pending.exists() else []
        rows = pd.DataFrame({c: pd.Series([v for frame in held for v in frame[k]], dtype=object if kind == "string" else None) for k, (c, kind) in enumerate(self.columns.items())})
        over = rows["us"].to_numpy(np.int64) <= mark * 1000
        ready, rest = rows[over].sort_values(["us", "id"]), rows[~over]
        if len(ready):
            self.pending.clear()
            if len(rest):
                self.pending.put([tuple(_plain(rest[c]) for c in self.columns)])
        if len(rest):
            self.handle.registerTimer(int(rest["us"].min()) // 1000 + 1)
        before = dict(zip(*self.kept.get())) if self.kept.exists() else {}
        out, after, until = self.fold(key, ready, before, mark * 1000)
        until = until // 1000 + 1
        if not after or mark >= until and not len(rest):
            self.kept.clear()
        else:
            self.kept.update((list(after), list(after.values())))
            self.handle.registerTimer(max(until, mark + 1))
        return iter([out]) if len(out) else iter(())

    def close(self) -> None:
        pass


def _plain(column: pd.Series) -> list:
    return column.astype(object).where(column.notna(), None).tolist()


def _instants(us) -> pd.Series:
    return pd.to_datetime(pd.Series(us, dtype="int64"), unit="us", utc=True)


class _Cache(_InOrder):
    """Of each key of a lane its last read is kept, until it is forgotten."""

    def __init__(self, ttl: int, forget: int):
        self.span, self.keep = ttl * 1_000_000, (ttl + forget) * 1_000_000

    def fold(self, key, rows, before, mark):
        codes, names = pd.factorize(rows["key"])
        order = np.argsort(codes, kind="stable")
        rows, codes, names = rows.iloc[order], codes[order], [*names, None]
        ts = rows["us"].to_numpy(np.int64)
        outcome, reads = np.zeros(len(ts), np.int8), np.zeros(len(ts), np.int64)
        for begin, end in _runs(codes):
            name = names[codes[begin]]
            outcome[begin:end], reads[begin:end], before[name] = _reads(ts[begin:end], before.get(name), self.span, self.keep)
        out = pd.DataFrame({"key": rows["key"].to_list(), "ts": _instants(ts), "id": rows["id"].to_list(), "outcome": np.array(OUTCOMES, dtype=object)[outcome], "read_at": _instants(reads)})
        kept = {name: at for name, at in before.items() if at + self.keep > mark}
        return out, kept, max(kept.values(), default=0) + self.keep


def cache_lookups_stream(requests: DataFrame, ttl: int = TTL_SECONDS, forget: int = FORGET_SECONDS, late: str = "1 hour", lanes: int = LANES) -> DataFrame:
    """A stream of requests(key string, ts, id long) -> the rows of `cache_lookups`, each when the watermark has passed it."""
    rows = requests.select("key", "ts", "id", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    return rows.withColumn("lane", _lane(lanes)).groupBy("lane").transformWithStateInPandas(_Cache(ttl, forget), "key string, ts timestamp, id long, outcome string, read_at timestamp", "append", "eventTime")


def _day_end(day: str) -> int:
    """When a day is over in every time zone."""
    return pd.Timestamp(day).value // 1000 + 2 * DAY_US


class _Quota(_InOrder):
    """Of a lane's rows of a day the first `per_key` of each key are open, and of these the first `everyone` stay open; rows that came closed pass by."""

    def __init__(self, per_key: int | None, everyone: int):
        self.per_key, self.everyone = per_key, everyone

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        if key[1] != "day" and self.per_key is None:
            return (self._out(key, new, False) for new in rows if len(new))
        return super().handleInputRows(key, rows, timerValues)

    def _out(self, key, rows, open_) -> pd.DataFrame:
        return pd.DataFrame({"id": rows["id"].to_list(), "ts": _instants(rows["us"].to_numpy()), "us": rows["us"].to_list(), "key": _plain(rows["key"]), "day": key[0], "open": open_})

    def fold(self, key, rows, before, mark):
        open_ = np.ones(len(rows), bool)
        if self.per_key is not None:
            known = rows["key"].map(lambda k: before.get(k, 0)).to_numpy(np.int64)
            open_ = known + rows.groupby("key", dropna=False).cumcount().to_numpy() < self.per_key
        rank = sum(before.values()) + np.cumsum(open_)
        for name in rows["key"][open_] if self.per_key is not None else [None] * len(rows):
            before[name] = before.get(name, 0) + 1
        return self._out(key, rows, open_ & (rank <= self.everyone)), before, _day_end(key[0])


def run_to_end(table: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream that `build` makes of a table's rows gives, as far as its watermark comes with them; its files lie in the shared folder and go when it has ended."""
    spark = table.sparkSession
    own = session_for_state(spark)
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/in")
    stream = build(own.readStream.schema(table.schema).parquet(f"{folder}/in"))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = cut(spark.read.schema(stream.schema).parquet(f"{folder}/out"))
    drop_folder(spark, folder)
    return rows


def admit_all_stream(requests: DataFrame, per_key: int = PER_KEY, everyone: int = GLOBAL, late: str = "1 hour", buckets: int = 64) -> DataFrame:
    """A stream of requests(id, ts, key) -> the rows of `state.admit`: id, key, day, admitted.

    Two chained steps, each by day and lane: the first leaves open `per_key` rows of a key and, of these, `everyone` of each bucket of keys; the second `everyone` of the day.
    A row among the day's first is among its bucket's first, so the second sees no more than buckets * everyone open rows of a day; closed rows pass it by in their buckets' lanes.
    """

    def step(rows: DataFrame, lane: Column, of_key: int | None) -> DataFrame:
        return rows.withColumn("lane", lane).groupBy("day", "lane").transformWithStateInPandas(
            _Quota(of_key, everyone), "id long, ts timestamp, us long, key string, day string, open boolean", "append", "eventTime", eventTimeColumnName="ts"
        )

    dated = requests.select("id", "ts", F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("us"), F.lit(True).alias("open")).withWatermark("ts", late)
    dated = dated.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = step(step(dated, _lane(buckets), per_key), F.when(F.col("open"), "day").otherwise(_lane(buckets)), None)
    return last.select("id", "key", "day", F.col("open").alias("admitted"))
