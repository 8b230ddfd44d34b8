"""Session defaults for local runs and tests; on a cluster the submitted conf wins."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "pactlens", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Return a session with AQE, UTC timestamps and Arrow switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Wide rule and masking plans have thousands of expressions; a stack trace for each costs seconds on the driver.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()
