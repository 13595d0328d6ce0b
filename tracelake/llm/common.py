"""What several operators share: shared-folder tables, lineage cuts, table reads."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import shared_dir


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tracelake-{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Intermediate tables in the shared folder, deleted once what depends on them is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, what: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again.

        This cuts lineage as a checkpoint does, survives lost executors, and Catalyst sees the true
        size, so it broadcasts the table only below ``spark.sql.autoBroadcastJoinThreshold``.
        """
        path = fresh_path(self.spark, what)
        self.paths.append(path)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def table(df: DataFrame, what: str) -> DataFrame:
    """A table of :class:`Scratch` that stays."""
    return Scratch(df.sparkSession).table(df, what)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
