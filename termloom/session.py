"""Session defaults, and shipping this package to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "termloom") -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TERMLOOM_DRIVER_MEMORY", "6g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the workers through Spark's file server, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    where = tempfile.mkdtemp(prefix="termloom-")
    path = os.path.join(where, "termloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_HERE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(_HERE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
