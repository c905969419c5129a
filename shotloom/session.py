"""The Spark session that the library's entry points and tests use."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def get_spark(app: str = "shotloom", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC; an active session is used as it is."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master:
        settings |= {"spark.master": master, "spark.driver.memory": "4g", "spark.driver.host": "127.0.0.1"}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
