"""Confusion matrices and ROC over a grid of thresholds.

Matches are never crossed with thresholds: they are counted by (group, distance, length, truth)
first, and these counts are crossed with the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.functions.bits import relative

THRESHOLDS = 99


def thresholds(spark: SparkSession, n: int = THRESHOLDS) -> DataFrame:
    """(threshold_idx, threshold): i / (n + 1) as 32-bit floats, i from 1."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("threshold_idx"), (F.col("id") / (n + 1)).cast("float").alias("threshold"))


def classification(threshold: Column, entry: Column, actual: Column) -> Column:
    """TP, FN, FP or TN: predicted the same if the entry is strictly below the threshold; null without entry or truth."""
    near = entry < threshold
    return F.when(entry.isNull() | actual.isNull(), F.lit(None)).when(near & actual, "TP").when(~near & actual, "FN").when(near, "FP").otherwise("TN")


def counted(matches: DataFrame, group: list[str], same: Column) -> DataFrame:
    """(*group, hamming_distance, hash_len, same, n). Matches without a distance, length or truth are left out."""
    rows = matches.where(F.col("hamming_distance").isNotNull() & F.col("hash_len").isNotNull()).withColumn("same", same).where(F.col("same").isNotNull())
    return rows.groupBy(*group, "hamming_distance", "hash_len", "same").agg(F.count(F.lit(1)).alias("n"))


def confusion(counts: DataFrame, group: list[str], grid: DataFrame) -> DataFrame:
    """(*group, threshold_idx, threshold, tp, fn, fp, tn); the grid is a hundred rows or so. No counts give no rows."""
    rows = counts.withColumn("entry", relative(F.col("hamming_distance"), F.col("hash_len"))).where(F.col("entry").isNotNull())
    rows = rows.groupBy(*group, "entry", "same").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(grid))
    near = F.col("entry") < F.col("threshold")
    cell = lambda rule: F.sum(F.when(rule, F.col("n")).otherwise(0)).cast("bigint")
    return rows.groupBy(*group, "threshold_idx", "threshold").agg(cell(F.col("same") & near).alias("tp"), cell(F.col("same") & ~near).alias("fn"), cell(~F.col("same") & near).alias("fp"), cell(~F.col("same") & ~near).alias("tn"))


def merged(confusions: DataFrame) -> DataFrame:
    """All groups put together, threshold by threshold."""
    return confusions.groupBy("threshold_idx", "threshold").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("tp", "fn", "fp", "tn")))


def rates(roc: DataFrame) -> DataFrame:
    """With fp_rate and tp_rate as 32-bit floats; null where there is no actual negative or positive."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")).cast("float")
    return roc.withColumn("fp_rate", share("fp", "tn")).withColumn("tp_rate", share("tp", "fn"))


def rate_histogram(rated: DataFrame) -> DataFrame:
    """(axis, bin, n): how many points have their rate in each bin of 0.01."""
    axes = [rated.select(F.lit(a).alias("axis"), F.floor(F.col(a).cast("double") * 100).cast("int").alias("bin")) for a in ("fp_rate", "tp_rate")]
    return axes[0].unionByName(axes[1]).where("bin is not null").groupBy("axis", "bin").agg(F.count(F.lit(1)).alias("n"))
