"""Session construction for local runs, tests and the bench."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "lexiforge", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE, Arrow)."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("LEXIFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
