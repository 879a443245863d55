"""Session settings, the shared work folder, and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REGISTERED: set[str] = set()


def build_session(app: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, also set as the checkpoint folder.

    Where the session names none, a local temporary folder is used; that is only fit for local
    mode, so on any other master an error is raised instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder, in a folder of this application that is deleted when its driver ends."""
    home = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if home not in _REGISTERED:
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _REGISTERED.add(home)
    return f"{home}/{label}-{uuid.uuid4().hex}"


def write_read(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, where the files have fewer splits than there are cores.

    For small tables whose rows are dear to work on; a table with splits enough is returned as it is,
    without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.queryExecution().toRdd().getNumPartitions() < cores else rows


def write_bucketed(df: DataFrame, label: str, by: str, buckets: int, partition: str | None = None) -> DataFrame:
    """write_read for a table bucketed and sorted by one column, and partitioned by another.

    df should come hash-partitioned into as many parts by that column, so that each task writes one bucket.
    """
    spark = df.sparkSession
    name = f"siltstone_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", scratch_path(spark, label)).bucketBy(buckets, by).sortBy(by)
    (writer.partitionBy(partition) if partition else writer).saveAsTable(name)
    return spark.table(name)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a write_read table that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if "/scratch-" in name:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if not local:
        return df
    return df.withColumns({c: F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in local})
