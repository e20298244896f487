"""Session settings the engine is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution re-plans joins, splits skewed partitions and merges small ones at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "hashloom", shared: str | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; a session that already runs keeps its own static ones.

    ``shared`` is the folder all executors share, for spark.checkpoint.dir; a cluster's own setting
    holds where it is left out.
    """
    if shared:
        extra = {"spark.checkpoint.dir": shared, **extra}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | extra).getOrCreate()
