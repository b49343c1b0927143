"""Session settings used by the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "tabforge", **conf: str) -> SparkSession:
    """Start (or reuse) a session with the settings the package expects.

    On a cluster the master and the checkpoint folder come from ``spark-submit``;
    only engine settings that hold at any scale are set here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
