"""Percentiles of very large numeric columns, from summaries that can be put together.

The summaries are randomized compactor hierarchies (KLL): each level holds items of weight
2^level, a full level is sorted and every other item moves up; sketches merge level by level.
Spark's built-in KLL aggregate does this inside the JVM, with partial aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashloom.runtime import durable

K = 1600


def rank_error(k: int = K) -> float:
    """Rank error of one quantile, as a share of the rows, held with probability 0.99.

    2.296 / k^0.9021 is the published fit for compactor hierarchies of parameter k.
    """
    return 2.296 / k**0.9021


def sketches(df: DataFrame, group: list[str], value: str, piece: list[str], k: int = K) -> DataFrame:
    """One summary for each group and piece (a day, a file): (*group, *piece, sketch, n).

    Rows with a null value don't count; null group columns form a group of their own. The value
    must be an integer column. An empty table has no summaries.
    """
    return df.where(F.col(value).isNotNull()).groupBy(*group, *piece).agg(F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(parts: DataFrame, group: list[str], k: int = K) -> DataFrame:
    """Summaries of the same group put together: (*group, sketch, n)."""
    return parts.groupBy(*group).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"), F.sum("n").alias("n"))


def percentiles(merged: DataFrame, group: list[str], pcts: list[int]) -> DataFrame:
    """(*group, pct, value) with the sketch's rank error."""
    ranks = F.array(*(F.lit(p / 100.0) for p in pcts))
    return merged.select(*group, F.explode(F.arrays_zip(F.array(*map(F.lit, pcts)).alias("pct"), F.kll_sketch_get_quantile_bigint("sketch", ranks).alias("value"))).alias("x")).select(*group, F.col("x.pct").alias("pct"), F.col("x.value").alias("value"))


def write_sketches(parts: DataFrame, path: str, piece: list[str]) -> None:
    """Keeps the summaries, a folder for each piece; pieces that come again replace theirs, the others stay."""
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*piece).parquet(path)


def bounded_percentiles(merged: DataFrame, group: list[str], pcts: list[int], k: int = K) -> DataFrame:
    """(*group, pct, value, low, high) from the summaries alone: the estimate, and the values at its rank less and plus the rank error.

    The true percentile lies between low and high with the probability that rank_error names.
    """
    at = lambda p: F.array(*(F.lit(min(1.0, max(0.0, x))) for x in p))
    ranks = [p / 100.0 for p in pcts]
    e = rank_error(k)
    read = lambda p, name: F.kll_sketch_get_quantile_bigint("sketch", at(p)).alias(name)
    rows = merged.select(*group, F.array(*map(F.lit, pcts)).alias("pct"), read(ranks, "value"), read([r - e for r in ranks], "low"), read([r + e for r in ranks], "high"))
    return rows.select(*group, F.explode(F.arrays_zip("pct", "value", "low", "high")).alias("x")).select(*group, *(F.col(f"x.{c}").alias(c) for c in ("pct", "value", "low", "high")))


#: Parts of a bracket that are counted by themselves.
SLICES = 16


def brackets(merged: DataFrame, group: list[str], pcts: list[int], k: int = K, widen: float = 2.0) -> DataFrame:
    """For each pct the values at its rank less and plus ``widen`` times the rank error, columns lo_i and hi_i; ``cuts`` has values in between."""
    slack = widen * rank_error(k)
    lo, hi = ([min(1.0, max(0.0, p / 100.0 + s * slack)) for p in pcts] for s in (-1, 1))
    cuts = sorted({a + (b - a) * i / SLICES for a, b in zip(lo, hi, strict=True) for i in range(SLICES + 1)})
    read = lambda p: F.kll_sketch_get_quantile_bigint("sketch", F.array(*map(F.lit, p)))
    got = merged.select(*group, F.col("n").alias("total"), read(lo).alias("lo"), read(hi).alias("hi"), read(cuts).alias("cuts"))
    return got.select(*group, "total", *(F.col("lo")[i].alias(f"lo_{i}") for i in range(len(pcts))), *(F.col("hi")[i].alias(f"hi_{i}") for i in range(len(pcts))), "cuts")


def exact_percentiles(rows: DataFrame, group: list[str], value: str, merged: DataFrame, pcts: list[int], k: int = K, widen: float = 2.0) -> DataFrame:
    """(*group, pct, value): the least value with at least pct percent of the group's rows not above it.

    The summaries name a bracket for each percentile; one more pass counts the values inside the
    brackets one by one and everything between two brackets as one cell. The running count goes in
    two levels, over slices of a group and over the cells of a slice, so that no task counts a whole
    group. A bracket the sketch got wrong (its error bound is a probability) is noticed, since the
    percentile then falls into a between-cell; those groups are counted in full.
    """
    rows = rows.select(*group, value)
    bounds = durable(brackets(merged, group, pcts, k, widen))
    n = len(pcts)
    other = [f"_b_{c}" for c in group]
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in zip(group, other, strict=True)))
    named = bounds.select(*(F.col(c).alias(o) for c, o in zip(group, other, strict=True)), *(c for c in bounds.columns if c not in group))
    v = F.col(value)
    joined = rows.where(v.isNotNull()).join(named.drop("cuts"), same)
    inside = reduce(lambda a, b: a | b, (v.between(F.col(f"lo_{i}"), F.col(f"hi_{i}")) for i in range(n)))
    below = [F.when(F.col(f"hi_{i}") < v, F.col(f"hi_{i}")) for i in range(n)]
    floor = F.greatest(*below) if n > 1 else below[0]
    cells = joined.select(*group, "total", F.when(inside, v.cast("bigint")).otherwise(floor).alias("cell"), (~inside).alias("between")).groupBy(*group, "total", "cell", "between").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(named.select(*other, "cuts"), same).withColumn("slice", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("cell"))), F.lit(-1))).drop("cuts", *other)
    cells = durable(cells)
    first = durable(_settled(cells, group, other, same, pcts, "total"))
    good = first.where(~F.col("missed")).drop("missed")
    missed = first.where("missed").select(*(F.col(c).alias(o) for c, o in zip(group, other, strict=True))).distinct()
    if not missed.take(1):
        return good
    full = rows.where(v.isNotNull()).join(missed, same, "left_semi").groupBy(*group, v.cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("n")).withColumn("between", F.lit(False))
    full = full.join(named.select(*other, "cuts", "total"), same).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("cell")))).drop("cuts", *other)
    return good.join(missed, same, "left_anti").unionByName(_settled(durable(full), group, other, same, pcts, "total").drop("missed"))


def _settled(cells: DataFrame, group: list[str], other: list[str], same: Column, pcts: list[int], total: str) -> DataFrame:
    """(*group, pct, value, missed) by the running count of cells (*group, total, slice, cell, between, n) in the order of (slice, cell, between)."""
    slices = cells.groupBy(*group, "slice").agg(F.sum("n").alias("in_slice"))  # a group has as many slices as brackets have cuts
    before = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*(F.col(c).alias(o) for c, o in zip(group, other, strict=True)), F.col("slice").alias("_slice"), "before")
    running = Window.partitionBy(*group, "slice").orderBy(F.col("cell").asc_nulls_first(), "between").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cells.join(before, same & (F.col("slice") == F.col("_slice"))).withColumn("upto", F.col("before") + F.sum("n").over(running))
    per = counted.withColumn("pct", F.explode(F.array(*map(F.lit, pcts)))).where(F.col("upto") * 100 >= F.col("pct") * F.col(total))
    return per.groupBy(*group, "pct").agg(F.min_by(F.struct("cell", "between"), "upto").alias("x")).select(*group, "pct", F.col("x.cell").alias("value"), F.col("x.between").alias("missed"))
