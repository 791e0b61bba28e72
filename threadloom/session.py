"""A local session with the settings that the library expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "threadloom", **options: str) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    defaults = {
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "8g",
    }
    made = SparkSession.builder.appName(name).config(map=defaults | options).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made
