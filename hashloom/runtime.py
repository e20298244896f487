"""Lineage cuts that survive the loss of an executor, files of the shared folder, and table access."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hashloom.errors import StoreError


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a temporary folder of this machine serves a local master, as in tests; on a
    cluster that is refused.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise StoreError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hashloom-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder.

    Spark removes the files once df is out of use if spark.cleaner.referenceTracking.cleanCheckpoints
    is on, as session() has it; only static settings reach a session that already runs.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder of written tables in the shared folder, removed at the end of the with block.

    What leaves the block has to be durable by itself. Written tables are compressed and read by
    column, so large intermediate rows take less disk than as checkpoints.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df, computed once and written to the folder."""
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n}")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that costs far more than moving a row.

    A table of many files has them anyway and isn't moved; only one small file would go to a single task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_dir() -> str:
    """Folder of the public tokenizers' vocabulary files; a parameter, never copied."""
    return os.environ.get("HASHLOOM_TOKENIZERS", "/opt/tokenizers")


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of a path in any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop_path(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
