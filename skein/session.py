"""Session helper for tests, the bench and notebooks."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .storage import DEAL


def local_session(app: str = "skein", cores: str | int = "*", partitions: int = 8, memory: str = "8g", deal: int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench assume; ``deal`` is the number of tasks that small tables of texts are dealt to."""
    extra = {} if deal is None else {DEAL: str(deal)}
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", memory))
        .config("spark.driver.host", "127.0.0.1")
        .config(map=extra)
        .getOrCreate()
    )
