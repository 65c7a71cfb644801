"""Session settings the operators are written for."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, app: str = "dawnscore", **extra: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(SETTINGS)
    conf.update({
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("DAWNSCORE_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package: once per application, unless it is installed there anyway."""
    context = spark.sparkContext
    if getattr(context, "_dawnscore_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "dawnscore.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(root, "dawnscore")):
            for name in sorted(names):
                if name.endswith(".py"):
                    source = os.path.join(folder, name)
                    archive.write(source, os.path.relpath(source, root))
    context.addPyFile(path)  # Spark's file server hands it to every worker
    context._dawnscore_shipped = True
