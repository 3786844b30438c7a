"""Session helpers: local defaults for tests and benches, shared-folder lookup."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = 8, app: str = "liasse") -> SparkSession:
    """Session for tests and benches on one machine. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LIASSE_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and the session runs on one
    machine (tests) a temporary folder is made; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="liasse-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def written_once(df_of, spark: SparkSession, name: str) -> DataFrame:
    """A derived table written once per application to the shared folder and read from there."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spread(df_of()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer parts than the session has cores, dealt out evenly.

    Only small inputs (one file, one row group) are ever moved; a large scan
    has parts enough and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write a table once to the shared folder and go on from the copy.

    For results that several later steps read; a lost executor then costs a
    re-read, not a recomputation. ``codec``: another compression than the session's.
    """
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/staged-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.parquet(path)
