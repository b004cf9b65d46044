"""Session builder with the settings every operator assumes."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(app: str = "kilnspark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A UTC session with adaptive execution.

    The session's own settings are made in any case. Those that size a machine (master,
    driver memory, shuffle partitions) are for local runs: with a master given from
    outside, as spark-submit does, they are left to whoever started the cluster, and so
    is every one of them that spark-submit has named.
    """
    cores = os.environ.get("BENCH_CPUS", "8")
    given = dict(SparkConf().getAll())
    outside = "spark.master" in given and master is None
    builder = SparkSession.builder.appName(app)
    own = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    local = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": str(partitions or int(cores)),
    }
    if not outside:
        builder = builder.master(master or os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        own |= local
    for key, value in own.items():
        if key not in given:
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once for each application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-kiln-")), "kilnspark.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
