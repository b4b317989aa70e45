"""Session access shared by every operator: tables in, staged results out."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _UNSET_DIR:
        _UNSET_DIR.append("file://" + tempfile.mkdtemp(prefix="quarrymill-"))
        atexit.register(_remove, spark, _UNSET_DIR[0])
    return _UNSET_DIR[0]


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, latest change) of a stored table, from its file listing: whether something kept from it is still current."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:
        pass


class Stage:
    """Written tables of one operator call. They cut the lineage and survive the loss of any executor.

    A table that no later plan reads can be dropped at once with `drop`; the rest go when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(_remove, spark, self.root)

    def write(self, df: DataFrame, name: str = "t", partition_by: tuple[str, ...] = ()) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _remove(self.spark, getattr(df, "_staged_path", os.devnull + "/none"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in far fewer partitions (a few small files) than there are cores; else as it is.

    Only for scans before costly per-row work: larger inputs have more partitions than cores and are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
