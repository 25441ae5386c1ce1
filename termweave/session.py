"""SparkSession factory."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "termweave", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution on.

    ``master`` and the partition count are left to the cluster's own settings
    unless they are given; in local mode 8 shuffle partitions are enough. ``conf``
    holds further settings, with ``__`` for each dot.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("TERMWEAVE_DRIVER_MEMORY", "8g"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
