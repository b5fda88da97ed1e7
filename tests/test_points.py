"""Point reads: rows, and what of the files they open."""

import glob
import os
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from brandloom.sources.points import ReportTable, bucket_of

N, BUCKETS = 20_000, 16


@pytest.fixture(scope="module")
def reports(spark, tmp_path_factory):
    table = ReportTable(spark, str(tmp_path_factory.mktemp("points") / "reports"))
    rows = spark.range(N).select(F.col("id"), F.concat(F.lit("slug-"), F.md5(F.col("id").cast("string"))).alias("slug"), (F.col("id") % 7).alias("views"))
    table.write(rows.unionByName(spark.createDataFrame([(N, "slug-twin", 1), (N + 1, "slug-twin", 2)], rows.schema)), BUCKETS)
    return table, {r.id: r.slug for r in rows.collect()}


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_bucket_is_opened(reports):
    table, slugs = reports
    for i in (0, 7, 19_999):
        found = table.by_slug(slugs[i])
        assert [tuple(r) for r in found.collect()] == [(i, slugs[i], i % 7)] and [tuple(r) for r in table.by_id(i).collect()] == [(i, slugs[i], i % 7)]
        plan = _plan(found)
        # the bucket is a condition on folders, the slug one on row groups
        assert re.search(r"PartitionFilters: \[.*bucket#\d+ = \d+", plan) and "EqualTo(slug" in plan
        scans = [x for x in _leaves(found._jdf.queryExecution().executedPlan()) if x.metrics().contains("numFiles")]
        assert [x.metrics().apply("numFiles").value() for x in scans] == [1]


def _leaves(plan):
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found = plan.collectLeaves()
    return [found.apply(k) for k in range(found.size())]


def test_bloom_filters_are_written(reports):
    """Besides its columns and footer a file holds a filter of at least a byte for each key of a bucket."""
    table, _ = reports
    files = glob.glob(f"{table.folder}/by_slug/bucket=*/*.parquet")
    assert len(files) == BUCKETS
    meta = pq.ParquetFile(files[0]).metadata
    held = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns))
    assert os.path.getsize(files[0]) - held - meta.serialized_size > N / BUCKETS


def test_none_twins_and_many(spark, reports):
    table, slugs = reports
    assert table.by_slug("nothing").count() == 0 and table.by_id(-1).count() == 0
    assert sorted(r.id for r in table.by_slug("slug-twin").collect()) == [N, N + 1] and [r.views for r in table.by_id(N + 1).collect()] == [2]
    ids = spark.createDataFrame([(i,) for i in (3, 3, 5, N, -4)], "id long")
    assert sorted(r.id for r in table.of_ids(ids).collect()) == [3, 5, N]
    asked = spark.createDataFrame([(slugs[9],), ("nothing",), (None,)], "slug string")
    got = table.of_slugs(asked)
    assert [r.id for r in got.collect()] == [9]
    assert "bucket" in _plan(got) and spark.range(1).select(bucket_of(F.lit("a"), 4)).first()[0] in range(4)
