"""Consecutive numbers in a given order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.runtime import durable


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """df with the column ``name``: start, start + 1, ... in ``order``, which should be unique for one fixed result.

    Rows are range-partitioned and numbered within their partition; the driver adds up one count a
    partition, and a small table of these joins back. The partitioning samples its input first, so
    df is read twice: hand in what is cheap to read again, else a durable result. Nulls come first.
    An empty df stays empty.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    base, offsets = start, []
    for part in sorted(counts):
        offsets.append((part, base))
        base += counts[part]
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("bigint")).drop("_part")
    first = spark.createDataFrame(offsets, "_part int, _first bigint")
    placed = ranged.join(F.broadcast(first), "_part")  # a row a partition
    return placed.withColumn(name, (F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_first")).cast("bigint")).drop("_part", "_first")
