"""Shared storage: tables that cut lineage, where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='framesift-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: How much larger a table counts than its files. Spark takes a column's share of the compressed files for its size and broadcasts what
#: seems small: six million numbered rows seem 8 MB. Counted so, a join is planned with a shuffle, and broadcasts if what is shuffled is small.
UNPACKED = 100.0


def count_unpacked(spark: SparkSession) -> SparkSession:
    """spark, with tables counted as they are in memory and not as their files are."""
    name = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(name, "1.0")) < UNPACKED:
        spark.conf.set(name, str(UNPACKED))
    return spark


class Growing:
    """A table that grows by parts. Each part is written once to the shared folder; all parts are read as one scan, so plans stay small."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = count_unpacked(spark), f"{shared_dir(spark)}/framesift/{name}-{uuid.uuid4().hex}", None

    def add(self, df: DataFrame) -> DataFrame:
        """The part that df is, read back."""
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(part)
        self.schema = self.schema or df.schema
        _delete_at_end(self.spark, self.path)
        return self.spark.read.schema(self.schema).parquet(part)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: lineage ends there. Spark's JVM deletes it as it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framesift/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; otherwise Spark shuffles for the join."""
    return F.broadcast(df) if rows <= most else df.hint("merge")
