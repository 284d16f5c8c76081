"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "statloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``; without it a run on a cluster stops here, since
    its executors would write to different disks. Only a local run gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="statloom-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    Iterative operators call this once per round: the plan stays short, the rows survive the loss
    of any executor, and the reader knows the table's true size.
    """
    path = scratch_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table that ``cut_lineage`` wrote under ``df`` once nothing reads it any more."""
    files = df.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    if not folder.rsplit("/", 1)[-1].startswith("round-"):
        return
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table written by an operator."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def bucket_count(spark: SparkSession) -> int:
    """How many value ranges a distributed global order is cut into."""
    return max(2, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def spread(df: DataFrame) -> DataFrame:
    """Give a costly per-row step every core when the scan has fewer splits than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
