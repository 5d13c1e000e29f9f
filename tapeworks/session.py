"""A Spark session set up for event-time work."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: State store that keeps state outside the heap and that stateful Python needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(name: str = "tapeworks", master: str | None = None, parallelism: int | None = None, **conf: str) -> SparkSession:
    """``parallelism`` sets the number of shuffle partitions, fixed at the first
    start of a stateful stream."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.streaming.stateStore.providerClass": ROCKSDB, **conf}
    if parallelism:
        settings["spark.sql.shuffle.partitions"] = str(parallelism)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return utc(builder.getOrCreate())


def utc(spark: SparkSession) -> SparkSession:
    """Event times are epoch milliseconds; UTC keeps window starts aligned to it."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return shipped(spark)


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, whose Python workers import it; once
    for a Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_tapeworks_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._tapeworks_shipped = True
    return spark
