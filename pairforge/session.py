"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold for any size of input; sizes of partitions are left to the cluster.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    conf = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.memory": "6g",
    } | extra
    spark = SparkSession.builder.master(master).appName("pairforge").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and all executors are on this machine (master local) is a local temporary folder
    taken instead, and set, so that later calls and DataFrame.checkpoint() use the same place. On a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="pairforge-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pairforge-{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Writes df to path and reads it back: lineage is cut and lost executors cost no recomputation."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    spark = df.sparkSession
    return spark.read.schema(spark.read.parquet(path).schema if partition_by else df.schema).parquet(path)


def spread(df: DataFrame, small_bytes: int = 16 << 20) -> DataFrame:
    """df for work that is slow for each row: an input of few, small files is dealt out to all cores.

    A Parquet file of one row group is one task, however many cores there are. Where every core gets a file or
    `small_bytes` of input anyway, nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= small_bytes * cores or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes an intermediate table that nothing reads any more."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)
