"""Reference checks over the image store's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hashloom.operators.orphans import orphan_references, orphan_report
from hashloom.runtime import table

#: child table, its reference, parent table
REFERENCES = (("matches", "hash1_id", "hashes"), ("hashes", "mod_image_id", "modified_images"), ("run_images", "image_id", "images"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose reference has no record at the time they arrived."""
    parts = []
    for child, ref, parent in REFERENCES:
        kids, parents = table(spark, sf_dir, child).select("id", ref, "loaded_at"), table(spark, sf_dir, parent).select("id", "loaded_at")
        found = orphan_references(kids, "id", ref, "loaded_at", parents, "id", "loaded_at")
        parts.append(found.select(F.lit(child).alias("child_table"), F.date_format("child_at", "yyyy-MM").alias("period"), F.col("child_id")))
    return reduce(DataFrame.unionByName, parts)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf_dir))


_ORPHANS = " UNION ALL ".join(
    f"SELECT '{child}' AS child_table, strftime(c.loaded_at, '%Y-%m') AS period, c.id AS child_id FROM {child} c "
    f"WHERE c.{ref} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{ref} AND p.loaded_at <= c.loaded_at)"
    for child, ref, parent in REFERENCES
)

QUERIES = {"p5_found": p5_found, "p5_report": p5_report}
SQL = {"p5_found": _ORPHANS, "p5_report": f"SELECT child_table, period, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY child_table, period"}
