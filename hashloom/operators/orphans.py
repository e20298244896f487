"""References to records that do not exist, no longer exist, or came only later.

Parent keys are sorted within buckets of BUCKET consecutive values and compressed to contiguous
runs. Each distinct reference is matched as-of to the preceding run start; one beyond the run's
end has no record. A run also keeps the latest arrival in it: a reference first made after that
is settled by the run alone, only the others look up their own parent's arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashloom.functions.skew import heavy_of, salted_join
from hashloom.runtime import durable

BUCKET = 1 << 16


def contiguous_runs(parents: DataFrame, key: str, at: str, bucket: int = BUCKET) -> DataFrame:
    """(bucket, start, end, last_at, n) of the runs of consecutive keys.

    A run ends at a gap in the keys, at a bucket's end, and where the day of arrival changes, so
    that one late parent doesn't cloud its whole run. Rows with a null key or a null arrival count
    as absent; repeated keys fall into the same run. An empty table has no runs.
    """
    by = Window.partitionBy("bucket").orderBy("k", "t")
    rows = (
        parents.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .select(F.col(key).cast("bigint").alias("k"), F.col(at).alias("t"))
        .withColumn("bucket", F.floor(F.col("k") / F.lit(bucket)).cast("bigint"))
        .withColumn("pk", F.lag("k").over(by))
        .withColumn("pt", F.lag("t").over(by))
    )
    broken = F.col("pk").isNull() | (F.col("k") - F.col("pk") > 1) | ((F.col("k") > F.col("pk")) & (F.to_date("t") != F.to_date("pt")))
    return (
        rows.withColumn("run", F.sum(broken.cast("int")).over(by))
        .groupBy("bucket", "run")
        .agg(F.min("k").alias("start"), F.max("k").alias("end"), F.max("t").alias("last_at"), F.count(F.lit(1)).alias("n"))
        .drop("run")
    )


def orphan_references(children: DataFrame, child_id: str, ref: str, child_at: str, parents: DataFrame, parent_id: str, parent_at: str, bucket: int = BUCKET) -> DataFrame:
    """(child_id, child_at) of the children whose reference isn't null and has no parent by then.

    By then: a parent with that id and an arrival at or before the child's own. A child without an
    arrival time is an orphan, since no parent can be shown to precede it; a parent without one
    never counts. Repeated child rows come out as often as they come in. The references are
    counted before any shuffle by key, so a hot reference is one row of the match.
    """
    kids = children.where(F.col(ref).isNotNull()).select(F.col(child_id).alias("child_id"), F.col(ref).cast("bigint").alias("ref"), F.col(child_at).alias("child_at"))
    refs = kids.groupBy("ref").agg(F.min("child_at").alias("first_at"), F.count(F.lit(1)).alias("refs"), F.count("child_at").alias("dated"))
    runs = contiguous_runs(parents, parent_id, parent_at, bucket)
    both = runs.select("bucket", F.col("start").alias("k"), F.lit(0).alias("kind"), F.struct("end", "last_at").alias("run"), F.lit(None).cast(children.schema[child_at].dataType).alias("first_at"), F.lit(None).cast("bigint").alias("refs"), F.lit(None).cast("bigint").alias("dated"))
    both = both.unionByName(refs.select(F.floor(F.col("ref") / F.lit(bucket)).cast("bigint").alias("bucket"), F.col("ref").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast(both.schema["run"].dataType).alias("run"), "first_at", "refs", "dated"))
    preceding = Window.partitionBy("bucket").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = both.withColumn("run", F.last("run", ignorenulls=True).over(preceding)).where("kind = 1")
    beyond = F.col("run").isNull() | (F.col("k") > F.col("run.end"))
    settled = ~beyond & (F.col("first_at") >= F.col("run.last_at")) & (F.col("dated") == F.col("refs"))
    open_refs = durable(matched.where(~F.coalesce(settled, F.lit(False))).select(F.col("k").alias("ref"), "first_at", "refs", "dated", beyond.alias("beyond")))

    arrival = parents.where(F.col(parent_id).isNotNull()).select(F.col(parent_id).cast("bigint").alias("ref"), F.col(parent_at).alias("t"))
    doubtful = open_refs.where(~F.col("beyond"))
    looked_up = doubtful.join(arrival.join(doubtful.select("ref"), "ref", "left_semi").groupBy("ref").agg(F.min("t").alias("parent_at")), "ref", "left")
    late = F.col("parent_at").isNull() | (F.col("first_at") < F.col("parent_at")) | (F.col("dated") < F.col("refs"))
    bad = durable(open_refs.where("beyond").select("ref", F.lit(None).cast(parents.schema[parent_at].dataType).alias("parent_at"), "refs").unionByName(looked_up.where(late).select("ref", "parent_at", "refs")))

    heavy = heavy_of(bad, "ref", "refs")
    unmet = F.col("parent_at").isNull() | F.col("child_at").isNull() | (F.col("child_at") < F.col("parent_at"))
    return salted_join(kids, bad.select("ref", "parent_at"), "ref", heavy, on=unmet).select("child_id", "child_at")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by table and month: (child_table, period, orphans)."""
    return orphans.groupBy("child_table", "period").agg(F.count(F.lit(1)).alias("orphans"))
