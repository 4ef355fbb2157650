"""Session settings and the table loader."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", shuffle: int = 8, app: str = "corpusflow") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


LOAD_PARTITIONS = "corpusflow.load.partitions"


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table; timestamps without zone become UTC instants.

    Its splits are those of the files, unless ``LOAD_PARTITIONS`` is set: a bench on tables of one row
    group sets it, so that all cores get rows."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{root}/{name}.parquet"
    df = spark.read.parquet(path)
    parts = spark.conf.get(LOAD_PARTITIONS, None)
    if parts:
        df = df.repartition(int(parts))
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    for c in ntz:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names. Only a local session may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="corpusflow-")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame) -> DataFrame:
    """Write a table that several later steps read, and continue from the written copy.

    The copy cuts the lineage, survives lost executors, and gives the readers column pruning
    and real sizes. The shuffles behind it are of no more use: their files go when it is written."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
