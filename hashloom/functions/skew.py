"""Joins whose large side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on, so there are at most 1 / SHARE = 500 heavy keys.
SHARE = 0.002
SALTS = 32


def heavy_keys(df: DataFrame, key: str, share: float = SHARE) -> list:
    """The keys that hold at least ``share`` of df's rows; never more than 1 / share of them.

    Counting combines on the map side, so a hot key costs one row a partition. Nulls are no key.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return heavy_of(counts, key, "n", share)


def heavy_of(counts: DataFrame, key: str, n: str, share: float = SHARE, total: int | None = None) -> list:
    """heavy_keys of a table that has the rows already counted by key.

    One job: the largest counts come to the driver, 1 / share of them at most, and the total, where
    it isn't handed in, is observed on the way.
    """
    seen = Observation()
    most = int(1 / share) + 1
    rows = counts.select(F.col(key).alias("k"), F.col(n).cast("bigint").alias("n")).observe(seen, F.sum("n").alias("total"))
    largest = rows.orderBy(F.col("n").desc_nulls_last()).limit(most).collect()
    least = max(1000, int(((seen.get["total"] if total is None else total) or 0) * share))
    return [r["k"] for r in largest if (r["n"] or 0) >= least]


def salted_join(big: DataFrame, small: DataFrame, key: str, heavy: list, how: str = "inner", on: Column | None = None, salts: int = SALTS) -> DataFrame:
    """big joined to small on ``key``, the rows of a heavy key spread over ``salts`` tasks.

    Only small's rows under heavy keys are repeated (salts times), all others go once. The salt is
    a hash of the row, so a task that runs again yields the same rows. Column names of the two
    sides must differ except for the key. ``on`` is a further condition. Null keys join nothing.
    """
    if not heavy:
        joined = big.join(small.withColumnRenamed(key, "_key"), (F.col(key) == F.col("_key")) & (on if on is not None else F.lit(True)), how)
        return joined.select(*big.columns, *(c for c in small.columns if c != key)) if how in ("inner", "left") else joined
    hot = F.col(key).isin(heavy)
    left = big.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    right = small.withColumn("_salt2", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).withColumnRenamed(key, "_key")
    condition = (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_salt2"))
    if on is not None:
        condition = condition & on
    joined = left.join(right, condition, how)
    return joined.select(*big.columns, *(c for c in small.columns if c != key)) if how in ("inner", "left") else joined.drop("_salt")
