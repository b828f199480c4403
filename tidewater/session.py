"""Session settings that every entry point of the package shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidewater", cpus: int | str | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings win."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables of a data folder; the path may belong to any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
