"""Session settings and table access shared by all modules."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parcelight")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="parcelight-")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only where driver and executors are
    one process does a temporary folder do instead."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_dir()
    raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def discard(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this process has written and returns their number. Results that still read
    from them must have been stored before."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for path in _written:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    n = len(_written)
    _written.clear()
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df once to the shared folder and reads it back, so that no later stage
    computes it again and a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")  # nothing reads the shuffle files of this write again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)
