"""Declared tables as DataFrames: files, lines, Kafka and WebSocket feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import decode
from ..functions.time import event_time
from ..model import TableDef
from ..operators.lateness import watermark_in_order
from ..operators.windows import EVENT_TIME
from ..session import utc

#: Rows of a file per span of the running watermark.
SPAN_ROWS, SPAN_MS = 100_000, 3_600_000
#: Place of a row in a table of files: file by path, block of the file, row. The
#: last numbers the rows in the order in which a task reads them.
FILE, BLOCK, ROW, PARTITION = "__file", "__block", "__row", "__partition"


def read(spark: SparkSession, table: TableDef, stream: bool = False) -> DataFrame:
    """The table's rows. A table with event time carries what late-row handling
    needs: a stream its watermark, a file table ``__wm`` in order of arrival."""
    utc(spark)
    if table.connector == "file":
        return _timed(_file(spark, table, stream), table)
    if table.connector == "kafka":
        rows = _kafka(spark, table, stream)
        return _timed(rows, table) if stream else rows
    if table.connector == "websocket":
        from .websocket import WebSocketSource

        spark.dataSource.register(WebSocketSource)
        options = {k: table.options[k] for k in ("url", "subscribe", "max_messages") if k in table.options}
        lines = spark.readStream.format(WebSocketSource.name()).options(**options).load()
        return _timed(decode(lines, table.schema, required=[]), table)
    raise ValueError(f"table {table.name}: {table.connector!r} can't be read")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def placed(files: DataFrame) -> DataFrame:
    """A freshly read table of files with ``FILE``, ``BLOCK`` and ``ROW``. Spark reads
    large files first and in pieces, so none of them alone is the order of rows."""
    return files.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.monotonically_increasing_id().alias(ROW))


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key, for feeds that may deliver twice (at least once). A stream
    needs a watermark, which bounds how long keys are remembered."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def _file(spark: SparkSession, table: TableDef, stream: bool) -> DataFrame:
    fmt = table.options.get("format", "json")
    if fmt not in ("json", "parquet"):
        raise ValueError(f"table {table.name}: format {fmt!r} can't be read")
    reader = (spark.readStream.option("maxFilesPerTrigger", 1) if stream else spark.read).schema(table.schema).format(fmt)
    # Field names that differ in case only are different fields.
    return reader.load(table.options["path"])


def _kafka(spark: SparkSession, table: TableDef, stream: bool) -> DataFrame:
    o = table.options
    options = {"kafka.bootstrap.servers": o["brokers"], "subscribe": o["topic"], "startingOffsets": o.get("auto_offset_reset", "latest" if stream else "earliest")}
    if "group_id" in o:
        options["kafka.group.id"] = o["group_id"]
    raw = (spark.readStream if stream else spark.read).format("kafka").options(**options).load()
    rows = decode(raw.select(F.col("value").cast("string").alias("value"), F.col("partition").alias(PARTITION), F.col("timestamp").alias(BLOCK), F.col("offset").alias(ROW)), table.schema, required=[], keep=[PARTITION, BLOCK, ROW])
    if stream or not table.event_time:
        return rows.drop(PARTITION, BLOCK, ROW)
    # A finished topic: in the order of the log's time, the slowest partition decides.
    parts = sorted(r[0] for r in rows.select(PARTITION).distinct().collect())
    return watermark_in_order(rows, table.event_time, [F.floor(F.unix_millis(BLOCK) / SPAN_MS)], [F.col(BLOCK), F.col(PARTITION), F.col(ROW)], table.lag_ms, sources=(PARTITION, parts) if parts else None).drop(PARTITION, BLOCK, ROW)


def _timed(df: DataFrame, table: TableDef) -> DataFrame:
    ts = table.event_time
    if not ts:
        return df
    if df.isStreaming:
        # Windows fire once, so allowed lateness is a longer wait.
        return df.withColumn(EVENT_TIME, event_time(f"`{ts}`")).withWatermark(EVENT_TIME, f"{table.lag_ms + table.lateness_ms} milliseconds")
    rows = placed(df)
    spans = [F.col(FILE), F.col(BLOCK), F.floor(F.col(ROW) / SPAN_ROWS)]
    return watermark_in_order(rows, ts, spans, [F.col(ROW)], table.lag_ms).drop(FILE, BLOCK, ROW)
