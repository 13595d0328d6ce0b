"""Numbers over a whole list, without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import cut


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """Adds each row's 0-based place in the whole order (ties anyhow, but within equal keys).

    Rows are dealt to ranges of the order; each range is numbered by itself from the number of rows before
    it. The ranges come from a sample, so they are cut once and read by both the counts and the numbers.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranges = cut(rows.repartitionByRange(*keys).withColumn("part_", F.spark_partition_id()))
    before = ranges.groupBy("part_").agg(F.count("*").alias("n_"))
    # a row a range
    before = before.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"))
    at = F.row_number().over(Window.partitionBy("part_").orderBy(*keys)) - 1
    return ranges.withColumn("in_", at).join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("in_")).drop("part_", "in_", "before_")
