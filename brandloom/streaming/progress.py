"""Reports that grow section by section: a store that a stream writes to, batch by batch, and readers that see whole versions.

A batch is written under a name of its own and counts from the moment its marker stands, an empty file that is made in one step: a batch that is replayed after a failure
changes nothing, and a half-written one is never read. Of the rows for one section and version the one with the highest number holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import drop_folder

# Sections of a report; what a job says at each of its steps, and how far it is.
SECTIONS = ("pages", "colors", "typography", "logo", "seo", "geo", "social", "marketing", "brand_name", "tone", "summary", "consistency")
STEPS = (
    ("queued", "Waiting to start...", 0), ("crawling", "Reading the website...", 3), ("extracting", "Extracting colors, fonts and content...", 46),
    ("analyzing", "Analyzing voice and positioning...", 55), ("generating", "Writing marketing copy and insights...", 78), ("completed", "Done", 100),
)
ROW = "report string, section string, version long, status string, data string, seq long"
DONE = "done"


def step_of(status: Column) -> Column:
    """struct(step, percent) of a job's status; null for a failed one, whose step stays what it was."""
    out = None
    for name, step, percent in STEPS:
        value = F.struct(F.lit(step).alias("step"), F.lit(percent).alias("percent"))
        out = F.when(status == name, value) if out is None else out.when(status == name, value)
    return out


class SectionStore:
    """Rows (ROW) of reports in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> dict[str, str]:
        """Committed batches and the folders of their rows, told by the names of their markers. Of two for one batch the first name holds."""
        path, fs = self._fs("markers")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return dict(n.split("=", 1) for n in sorted(names, reverse=True) if "=" in n and not n.startswith("."))

    def upsert(self, batch: DataFrame, batch_id: int | str) -> None:
        """For foreachBatch: the last row of each section and version of the batch. The marker is an empty file, made last."""
        if str(batch_id) in self.parts():
            return
        part = uuid.uuid4().hex
        last = batch.groupBy("report", "section", "version").agg(F.max_by(F.struct("status", "data", "seq"), "seq").alias("r")).select("report", "section", "version", "r.*")
        last.write.parquet(f"{self.folder}/rows/{part}")
        marker, fs = self._fs(f"markers/{batch_id}={part}")
        fs.create(marker).close()

    def compact(self) -> None:
        """Write all committed rows into one part; it takes the place of the batches it holds, which stay committed."""
        held = self.parts()
        part = uuid.uuid4().hex
        self.rows().write.parquet(f"{self.folder}/rows/{part}")
        # rows are idempotent, so a reader in between sees some twice and none missing
        for batch, old in held.items():
            marker, fs = self._fs(f"markers/{batch}={part}")
            fs.create(marker).close()
            fs.delete(self._fs(f"markers/{batch}={old}")[0], False)
        for old in set(held.values()):
            drop_folder(self.spark, f"{self.folder}/rows/{old}")

    def rows(self) -> DataFrame:
        """The last row of each report, section and version, of committed batches."""
        folders = [f"{self.folder}/rows/{part}" for part in sorted(set(self.parts().values()))]
        if not folders:
            return self.spark.createDataFrame([], ROW)
        each = self.spark.read.schema(ROW).parquet(*folders)
        return each.groupBy("report", "section", "version").agg(F.max_by(F.struct("status", "data", "seq"), "seq").alias("r")).select("report", "section", "version", "r.*")


def section_states(rows: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """rows (one per report, section and version) -> report, whole_version, newest_version, done, failed, percent.

    whole_version: the latest version of which every section is done (null: none yet). done and failed list the newest version's sections in the order of the report; percent is the share of it that is done.
    """
    known = rows.filter(F.col("section").isin(*sections))
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct(place.alias("place"), "section")))), lambda x: x["section"])
    versions = known.groupBy("report", "version").agg(listed(F.col("status") == DONE).alias("done"), listed(F.col("status") == "failed").alias("failed"))
    return versions.groupBy("report").agg(
        F.max(F.when(F.size("done") == len(sections), F.col("version"))).alias("whole_version"), F.max("version").alias("newest_version"), F.max_by("done", "version").alias("done"), F.max_by("failed", "version").alias("failed")
    ).withColumn("percent", F.floor(F.size("done") / len(sections) * 100 + 0.5).cast("int"))


def visible_sections(rows: DataFrame, sections: tuple[str, ...] = SECTIONS) -> DataFrame:
    """What a reader is shown: report, section, version, data. The last whole version; of a report that has none, each section's last finished row."""
    whole = section_states(rows, sections).select("report", "whole_version")
    finished = rows.filter(F.col("section").isin(*sections) & (F.col("status") == DONE)).join(whole, "report")
    latest = F.row_number().over(Window.partitionBy("report", "section").orderBy(F.desc("version")))
    shown = finished.filter("whole_version is null or version = whole_version").withColumn("_n", latest)
    return shown.filter("_n = 1").select("report", "section", "version", "data")
