"""Sessions, and the package's way to executors that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cpus: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context; Spark's own file server carries it."""
    sc = spark.sparkContext
    if getattr(sc, "_driftloom_sent", False):
        return spark
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="driftloom-"), "driftloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._driftloom_sent = True
    return spark
