"""Tables as streams: files cut by arrival, end markers, one-shot runs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import event_time
from ..operators.windows import EVENT_TIME
from .progress import figures


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the executors see too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_streams"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def chunked(df: DataFrame, arrival: str, span: int, path: str, marker: DataFrame | None = None) -> int:
    """Write ``df`` as a folder of files, one per span of arrival, in that order;
    then ``marker``. A stream over it moves its watermark between files only, so
    ``span`` should be no longer than what counts as late. ``df`` is read twice,
    for its first and last arrival and once to be written: dealt by span, so that a
    task writes whole files. Spans without rows have no file."""
    spans = df.withColumn("part", F.floor(F.col(arrival) / span))
    first, last = spans.agg(F.min("part"), F.max("part")).first()
    count = 0 if first is None else int(last - first + 1)
    if count:
        spans.withColumn("part", F.lpad((F.col("part") - first).cast("string"), 9, "0")).repartition("part").sortWithinPartitions("part", arrival).write.partitionBy("part").parquet(path)
        in_order(df.sparkSession, path, "part=*/*.parquet")
    if marker is not None:
        marker.select(*df.columns).coalesce(1).write.parquet(f"{path}/part={count:09d}")
        count += 1
    return count


def in_order(spark: SparkSession, path: str, files: str) -> None:
    """Streams take files by their time of change; let that follow their names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(str(f.getPath()) for f in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{files}")))
    now = fs.getFileStatus(at).getModificationTime()
    for i, f in enumerate(found):  # a second apart, the last one now
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f), now - 1000 * (len(found) - i), -1)


def stream(spark: SparkSession, path: str, schema, ts: str | None = "ts", lag_ms: int = 3_000) -> DataFrame:
    """The files of ``chunked`` as a stream, a file at a time, oldest first."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    return df.withColumn(EVENT_TIME, event_time(ts)).withWatermark(EVENT_TIME, f"{lag_ms} milliseconds") if ts else df


def run_once(df: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None, reports: list[dict] | None = None) -> DataFrame:
    """Drain a stream into Parquet and read it; ``reports`` gets each batch's figures."""
    spark = df.sparkSession
    checkpoint = checkpoint or f"{path.rstrip('/')}_checkpoint"
    out = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = out.outputMode("append").format("parquet").option("path", path).start()
    else:
        query = out.outputMode(mode).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    if reports is not None:
        reports += [figures(json.loads(p.json)) for p in query.recentProgress]
    return spark.read.schema(df.schema).parquet(path)

