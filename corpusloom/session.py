"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "corpusloom", **conf: str) -> SparkSession:
    """Session with adaptive execution and UTC; extra settings use ``__`` for dots.

    Settings that belong to the cluster (partitions, memory, checkpoint folder) are left to its defaults
    unless they are passed in.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # list aggregates over many small groups: hash up to this many groups before sorting the input
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
        # call-site capture per column expression dominates planning of rule-heavy projections
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
