"""Keyed state of the service, over logs: quotas, jobs, caches, retention, views. Batch forms and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Limits and lifetimes.
PER_KEY, GLOBAL, PDF_PER_KEY, REGENERATIONS = 3, 50, 30, 3
CACHE_HOURS, STALE_SECONDS, PRIVATE_DAYS, PUBLIC_DAYS, COUNTER_DAYS = 24, 90, 30, 180, 7
TERMINAL = ("completed", "failed")
BOTS = "(?i)bot|crawler|spider|preview|facebookexternalhit|slackbot|discordbot|whatsapp|embedly|quora|pinterest|vkshare|w3c_validator"


def admit(requests: DataFrame, per_key: int = PER_KEY, everyone: int = GLOBAL) -> DataFrame:
    """requests(id, ts, key) + admitted: at most `per_key` a key and day and `everyone` a day, all or nothing, in order of ts, id.

    An attempt counts against the day only if its key still had room, so two ranks decide. The day's ranking is cut to `everyone` of
    each key's first `per_key` attempts, the only ones that can be admitted.
    """
    day = F.to_date("ts")
    order = [F.col("ts"), F.col("id")]
    mine = F.row_number().over(Window.partitionBy(day, "key").orderBy(*order))
    ranked = requests.withColumn("day", day).withColumn("rn_key", mine)
    open_ = ranked.filter(F.col("rn_key") <= per_key)
    admitted = open_.withColumn("rn_day", F.row_number().over(Window.partitionBy("day").orderBy(*order))).filter(F.col("rn_day") <= everyone).select("id", F.lit(True).alias("_in"))
    return ranked.join(admitted, "id", "left").select("id", "ts", "key", "day", F.coalesce("_in", F.lit(False)).alias("admitted"))


def usage(admitted: DataFrame, per_key: int = PER_KEY) -> DataFrame:
    """Per key and day: used, remaining, when the quota is whole again."""
    s = admitted.groupBy("key", "day").agg(F.sum(F.col("admitted").cast("long")).alias("used"))
    return s.select("key", "day", "used", F.greatest(F.lit(0), F.lit(per_key) - F.col("used")).alias("remaining"), F.date_add("day", 1).alias("resets_on"))


def after_refunds(changes: DataFrame) -> DataFrame:
    """changes(key, day, seq, delta +1 or -1) -> key, day, used: a refund never takes the count below zero.

    The floored running sum ends at sum - min(0, least running sum).
    """
    by = Window.partitionBy("key", "day").orderBy("seq")
    rows = changes.withColumn("run", F.sum("delta").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "day").agg((F.sum("delta") - F.least(F.lit(0), F.min("run"))).alias("used"))


def kept_counters(counters: DataFrame, today) -> DataFrame:
    return counters.filter(F.col("day") >= F.date_sub(today, COUNTER_DAYS))


def current_jobs(log: DataFrame) -> DataFrame:
    """log(job, ts, seq, status) -> job, status, last_ts: the latest entry."""
    return log.groupBy("job").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("last_ts"))


def reap(jobs: DataFrame, now) -> DataFrame:
    """jobs(job, status, last_ts) -> the same; unfinished ones silent for 90 seconds have failed."""
    stale = ~F.col("status").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("last_ts") >= STALE_SECONDS)
    return jobs.withColumn("reaped", stale).withColumn("status", F.when(F.col("reaped"), "failed").otherwise(F.col("status")))


def cached_reports(reports: DataFrame, now) -> DataFrame:
    """The latest completed, unexpired original report of each site."""
    fit = reports.filter((F.col("status") == "completed") & F.col("source_report").isNull() & (F.col("expires_at") > now) & F.col("data").isNotNull())
    return fit.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("created_at"), F.desc("id")))).filter("_n = 1").drop("_n")


def in_flight(reports: DataFrame, now) -> DataFrame:
    """The latest live job of each site."""
    live = reports.filter(~F.col("status").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("heartbeat_at") < STALE_SECONDS))
    return live.withColumn("_n", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("created_at"), F.desc("id")))).filter("_n = 1").drop("_n")


def clones(cached: DataFrame, requests: DataFrame) -> DataFrame:
    """A requester's own copy of a cached report: requests(request, site) -> request, site, source_report, data, expires_at."""
    return requests.join(cached.select("site", F.col("id").alias("source_report"), "data", "expires_at"), "site").select("request", "site", "source_report", "data", "expires_at")


def retained(reports: DataFrame, now) -> DataFrame:
    """Without private reports over 30 days old and public ones over 180."""
    age = F.when(F.col("is_public"), PUBLIC_DAYS).otherwise(PRIVATE_DAYS)
    return reports.filter(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= age * 86_400)


def view_counts(views: DataFrame) -> DataFrame:
    """views(report, user_agent) -> report, n_views, without bots."""
    return views.filter(~F.coalesce(F.col("user_agent").rlike(BOTS), F.lit(False))).groupBy("report").agg(F.count("*").alias("n_views"))


def regenerations(claims: DataFrame, limit: int = REGENERATIONS) -> DataFrame:
    """claims(report, seq) + granted: the first `limit` of each report."""
    return claims.withColumn("granted", F.row_number().over(Window.partitionBy("report").orderBy("seq")) <= limit)


# Streams.
def daily_usage_stream(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of requests(ts, key) -> attempts per key and UTC day; state goes a day and `late` after the day."""
    return requests.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "key").agg(F.count("*").alias("attempts")).select(F.col("window.start").alias("day"), "key", "attempts")


def silent_jobs_stream(beats: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of beats(ts, job) -> one row per run of heartbeats that 90 seconds of silence ended."""
    return beats.withWatermark("ts", late).groupBy(F.session_window("ts", f"{STALE_SECONDS} seconds"), "job").agg(F.count("*").alias("beats")).select("job", F.col("session_window.start").alias("first_beat"), F.col("session_window.end").alias("silent_at"), "beats")


def view_counts_stream(views: DataFrame) -> DataFrame:
    return view_counts(views)


def admit_stream(requests: DataFrame, per_key: int = PER_KEY) -> DataFrame:
    """A stream of requests(id, ts, key) -> id, key, day, admitted by the per-key limit: one small counter per key and day, dropped by event time.

    The day's global limit is applied to each day's admitted rows afterwards (`admit`), since as a stream it would be one key's state.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        rows["admitted"] = [used + i < per_key for i in range(len(rows))]
        state.update((min(per_key, used + len(rows)),))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(pd.Timestamp(key[1]).timestamp() * 1000) + 2 * 86_400_000))
        yield pd.DataFrame({"id": rows["id"], "key": key[0], "day": key[1], "admitted": rows["admitted"]})

    dated = requests.withWatermark("ts", "1 day").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return dated.groupBy("key", "day").applyInPandasWithState(step, "id long, key string, day string, admitted boolean", "used int", "append", GroupStateTimeout.EventTimeTimeout)
