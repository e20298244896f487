"""Top N items within every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_row_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows with equal keys, the one least in ``order``; columns keys + order.

    A partial aggregate, so repeats combine before the shuffle, and the shuffle is by the whole
    key: a group that holds a third of all rows still spreads. Null keys are equal to each other,
    nulls in ``order`` come first.
    """
    best = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in order))


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in ``order``, which must name a unique last key for one fixed result.

    row_number under a rank filter: the optimiser's group-limit operator keeps n rows of a group
    in each partition before the shuffle by group, so a group of any size brings at most
    n x partitions rows to its task, and again n after it. Groups smaller than n come out whole; n
    below 1 gives nothing; an empty table gives an empty result. Extra columns are kept.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    rank = "_rank"
    while rank in df.columns:
        rank += "_"
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n).drop(rank)
