"""Reading and writing: driver tables, page corpora, third-party records, evaluation snapshots, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.merge import RECORD

SNAPSHOT = "capturedAt string, finalUrl string, pages array<struct<url:string,html:string,colorAreas:map<string,double>>>, cssContents map<string,array<string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Third-party brand records as JSON lines; wrong shapes become nulls."""
    return spark.read.schema(RECORD).json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped JSON snapshots, one site a file."""
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True)


def snapshot_pages(snapshots: DataFrame) -> DataFrame:
    """pages(url, html, page_ord, color_areas)."""
    rows = snapshots.select(F.posexplode("pages").alias("k", "p"))
    return rows.select("p.url", "p.html", (F.col("k") + 1).alias("page_ord"), F.col("p.colorAreas").alias("color_areas"))


def snapshot_stylesheets(snapshots: DataFrame, parsed: DataFrame) -> DataFrame:
    """site, page_ord, page_url, css_ord, css of the snapshot's sheets."""
    rows = snapshots.select(F.explode("cssContents").alias("page_url", "sheets")).select("page_url", F.posexplode("sheets").alias("css_ord", "css"))
    return rows.join(parsed.select("site", "page_ord", F.col("url").alias("page_url")), "page_url").select("site", "page_ord", "page_url", "css_ord", "css")


def write_snapshots(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON text under the day they were made, with their expiry a day later."""
    rows = reports.select("site", F.to_date("generated_at").alias("day"), (F.col("generated_at") + F.expr("INTERVAL 24 HOURS")).alias("expires_at"), F.to_json(F.struct(*reports.columns)).alias("data"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Written reports; text that is no report gives null."""
    return spark.read.parquet(path).withColumn("report", F.from_json("data", schema))
