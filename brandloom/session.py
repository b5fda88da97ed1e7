"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def get_spark(app: str = "brandloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a machine-local one only where that is unset and Spark itself is local (tests)."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", ""):
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """Write `df` to the shared checkpoint folder now and read it from there from now on.

    Spark's cleaner frees the shuffle files of frames that nobody holds any more when the driver collects garbage, which a driver with
    a free heap does every 30 minutes only. Operators with many passes ask for it with `free`, lest the files of all passes pile up.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    kept = df.checkpoint(eager=True)
    if free:
        context._jvm.System.gc()
    return kept


def write_down(df: DataFrame) -> DataFrame:
    """Like `cut`, but as compressed Parquet of which later reads take only the columns they need."""
    folder = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Let tasks trade texts with Python in batches of 4 MB instead of 64, which every task holds several times; a setting of the user's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "4194304b")


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
