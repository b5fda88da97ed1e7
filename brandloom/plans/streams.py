"""Queries over events as a stream, and the batch rules that they equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, drop_folder, shared_dir
from ..sources.tables import table
from ..streaming import ordered, progress
from .catalog import query


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


#: Reads by key: the first request, and each first one that is an hour or more after the last read.
_CACHE = """e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id AS id FROM events),
f AS (SELECT key, min(ts) AS read_at FROM e GROUP BY key UNION ALL SELECT e.key, min(e.ts) FROM f JOIN e ON e.key = f.key AND e.ts >= f.read_at + INTERVAL 1 HOUR GROUP BY e.key, f.read_at),
r AS (SELECT key, read_at, lag(read_at) OVER (PARTITION BY key ORDER BY read_at) AS before FROM (SELECT DISTINCT key, read_at FROM f)),
l AS (SELECT e.key, e.ts, e.id, r.read_at, r.before, row_number() OVER (PARTITION BY e.key, r.read_at ORDER BY e.ts, e.id) AS k FROM e ASOF JOIN r ON e.key = r.key AND e.ts >= r.read_at),
o AS (SELECT key, ts, id, read_at, CASE WHEN k > 1 THEN 'hit' WHEN before IS NULL OR ts >= before + INTERVAL 1 HOUR + INTERVAL 30 DAY THEN 'miss' ELSE 'refetch' END AS outcome FROM l)"""


@query(f"WITH RECURSIVE {_CACHE} SELECT key, id, outcome, epoch_us(read_at) AS read_us FROM o")
def robots_cache(spark, d):
    """What a cache with a lifetime of an hour does with every request."""
    return ordered.cache_lookups(_requests(spark, d)).select("key", "id", "outcome", F.unix_micros("read_at").alias("read_us"))


@query(f"WITH RECURSIVE {_CACHE}, m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events) SELECT key, id, outcome, epoch_us(read_at) AS read_us FROM o, m WHERE ts <= date_trunc('millisecond', mark)")
def robots_cache_stream(spark, d):
    """The same cache over the requests as a stream, as far as the watermark has come."""
    return ordered.run_to_end(_requests(spark, d), ordered.cache_lookups_stream).select("key", "id", "outcome", F.unix_micros("read_at").alias("read_us"))


@query("""WITH m AS (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 HOUR) AS mark FROM events),
r AS (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS key, CAST(ts AS DATE) AS day FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY day, key ORDER BY ts, id) AS rk FROM r),
g AS (SELECT id, row_number() OVER (PARTITION BY day ORDER BY ts, id) AS rd FROM k WHERE rk <= 3)
SELECT k.id, key, strftime(day, '%Y-%m-%d') AS day, coalesce(rd <= 50, false) AS admitted FROM k LEFT JOIN g ON k.id = g.id, m WHERE ts <= mark""")
def quota_admission_stream(spark, d):
    """Daily quotas by key and for everyone over the requests as a stream, as far as the watermark has come."""
    return ordered.run_to_end(_requests(spark, d), ordered.admit_all_stream)


def _updates(spark: SparkSession, d: str) -> DataFrame:
    """Events as a job's writes: each tells how a section of a report's version went; weeks are versions."""
    events = table(spark, d, "events")
    section = F.element_at(F.array(*[F.lit(s) for s in progress.SECTIONS]), (F.col("event_id") * 7 % 12 + 1).cast("int"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "running").otherwise("done")
    return events.select(
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("report"), section.alias("section"), F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / 7).cast("long").alias("version"), status.alias("status"),
        F.col("props").alias("data"), F.col("event_id").alias("seq"),
    )


_UPDATES = f"""u AS (SELECT 'r' || (user_id % 20) AS report, event_id * 7 % 12 AS place, [{', '.join(repr(s) for s in progress.SECTIONS)}][event_id * 7 % 12 + 1] AS section, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS version, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'done' END AS status, props AS data, event_id AS seq FROM events),
l AS (SELECT report, place, section, version, arg_max(status, seq) AS status, arg_max(data, seq) AS data FROM u GROUP BY report, place, section, version),
v AS (SELECT report, version, count(*) FILTER (status = 'done') AS n, coalesce(string_agg(section, ',' ORDER BY place) FILTER (status = 'done'), '') AS done, coalesce(string_agg(section, ',' ORDER BY place) FILTER (status = 'failed'), '') AS failed FROM l GROUP BY report, version),
s AS (SELECT report, max(version) FILTER (n = 12) AS whole_version, max(version) AS newest_version, arg_max(done, version) AS done, arg_max(failed, version) AS failed, CAST(floor(arg_max(n, version) / 12.0 * 100 + 0.5) AS INT) AS percent FROM v GROUP BY report)"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The updates as a stream through the store, in several batches of which the first is replayed."""
    folder = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    store = progress.SectionStore(spark, f"{folder}/store")
    updates = _updates(spark, d)
    updates.repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def twice(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, batch_id)
        store.upsert(batch.withColumn("status", F.lit("never")), batch_id)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = cut(store.rows())
    drop_folder(spark, folder)
    return rows


@query(f"WITH {_UPDATES} SELECT report, CAST(whole_version AS BIGINT) AS whole_version, CAST(newest_version AS BIGINT) AS newest_version, done, failed, percent FROM s")
def section_states(spark, d):
    """How far each report is: its last whole version, and the sections of its newest."""
    return progress.section_states(_stored(spark, d)).select("report", "whole_version", "newest_version", F.array_join("done", ",").alias("done"), F.array_join("failed", ",").alias("failed"), "percent")


@query(f"""WITH {_UPDATES} SELECT l.report, section, CAST(version AS BIGINT) AS version, data FROM l JOIN s ON l.report = s.report WHERE status = 'done' AND (whole_version IS NULL OR version = whole_version)
QUALIFY row_number() OVER (PARTITION BY l.report, section ORDER BY version DESC) = 1""")
def visible_sections(spark, d):
    """What readers are shown of each report."""
    return progress.visible_sections(_stored(spark, d))
