"""A table of reports for point reads: rows lie in folders by a hash of their slug, files are sorted and carry Bloom filters.

A read by slug opens one bucket's folder, and of its files only row groups whose statistics and Bloom filter admit the slug. A read by id goes through an index of the same layout,
id to slug. A read of many keys is a join on bucket and key, so only buckets that are asked for are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a bucket at which the number of buckets for a table is aimed.
BUCKET_ROWS = 1_000_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _lay(rows: DataFrame, path: str, key: str, buckets: int, ndv: int) -> None:
    placed = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
    writer = placed.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket")
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(ndv)).parquet(path)


class ReportTable:
    """Reports by slug and id below a folder; `meta` holds the number of buckets."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def write(self, reports: DataFrame, buckets: int | None = None) -> None:
        """reports(id, slug, ...): lay them out; the number of buckets follows the number of rows."""
        n = reports.count()
        buckets = buckets or max(1, -(-n // BUCKET_ROWS))
        ndv = max(1, -(-n // buckets)) * 2
        _lay(reports, f"{self.folder}/by_slug", "slug", buckets, ndv)
        _lay(reports.select("id", "slug"), f"{self.folder}/by_id", "id", buckets, ndv)
        self.spark.createDataFrame([(buckets, reports.schema.json())], "buckets int, shape string").coalesce(1).write.mode("overwrite").json(f"{self.folder}/meta")

    def _buckets(self) -> int:
        return self.spark.read.schema("buckets int, shape string").json(f"{self.folder}/meta").first().buckets

    def _one(self, part: str, key: str, value) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{part}")
        literal = F.lit(value).cast(rows.schema[key].dataType)
        number = self.spark.range(1).select(bucket_of(literal, self._buckets())).first()[0]
        return rows.filter((F.col("bucket") == number) & (F.col(key) == literal)).drop("bucket")

    def by_slug(self, slug: str) -> DataFrame:
        return self._one("by_slug", "slug", slug)

    def by_id(self, key) -> DataFrame:
        """The report of an id, by way of its slug."""
        found = self._one("by_id", "id", key).first()
        return self.by_slug(found.slug).filter(F.col("id") == F.lit(key)) if found else self.spark.read.parquet(f"{self.folder}/by_slug").drop("bucket").limit(0)

    def _many(self, part: str, key: str, keys: DataFrame) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{part}")
        asked = keys.select(key).distinct().withColumn("bucket", bucket_of(F.col(key), self._buckets()))
        return rows.join(asked, ["bucket", key]).drop("bucket")

    def of_slugs(self, keys: DataFrame) -> DataFrame:
        """keys(slug) -> their reports."""
        return self._many("by_slug", "slug", keys)

    def of_ids(self, keys: DataFrame) -> DataFrame:
        """keys(id) -> their reports."""
        wanted = self._many("by_id", "id", keys)
        return self.of_slugs(wanted).join(wanted.select("id").distinct(), "id", "left_semi")
