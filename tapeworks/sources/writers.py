"""Sinks of declared tables: files, keyed files, Kafka, discard, lines."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import TableDef


def fitted(df: DataFrame, table: TableDef) -> DataFrame:
    """The sink's columns by name, in its types; a missing one is an error."""
    if missing := [c for c in table.schema.names if c not in df.columns]:
        raise ValueError(f"table {table.name}: no column {missing}")
    return df.select(*(F.col(f.name).cast(f.dataType) for f in table.schema))


def write(df: DataFrame, table: TableDef) -> None:
    """A finished table to its sink."""
    df = fitted(df, table)
    if table.connector == "file":
        if table.options.get("mode") == "upsert":
            df = newest(df, table.primary_key, table.order_by)
        df.write.mode("overwrite").format(table.options.get("format", "json")).save(table.options["path"])
    elif table.connector == "kafka":
        kafka_rows(df).write.format("kafka").options(**{"kafka.bootstrap.servers": table.options["brokers"], "topic": table.options["topic"]}).save()
    elif table.connector == "blackhole":
        df.write.format("noop").mode("overwrite").save()
    else:
        raise ValueError(f"table {table.name}: {table.connector!r} can't be written")


def kafka_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def start(df: DataFrame, table: TableDef, checkpoint: str, once: bool = True, interval_ms: int | None = None) -> StreamingQuery:
    """A stream to its sink. ``once``: take what is there and stop; else go on, with
    a batch (and so a checkpoint) every ``interval_ms``. Appending files are exactly
    once; upserts are idempotent; Kafka is at least once (``readers.deduplicated``
    takes repeats out on reading)."""
    df = fitted(df, table)

    def out_of(rows: DataFrame):
        out = rows.writeStream.queryName(table.name).option("checkpointLocation", checkpoint)
        return out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{interval_ms} milliseconds") if interval_ms else out

    out = out_of(df)
    if table.connector == "blackhole":
        return out.outputMode("update").format("noop").start()
    if table.connector == "kafka":
        return out_of(kafka_rows(df)).format("kafka").options(**{"kafka.bootstrap.servers": table.options["brokers"], "topic": table.options["topic"]}).start()
    if table.connector != "file":
        raise ValueError(f"table {table.name}: {table.connector!r} can't be written")
    if table.options.get("mode") == "upsert":
        keyed = KeyedTable(df.sparkSession, table.options["path"], table.primary_key, order=table.order_by)
        return out.outputMode("update").foreachBatch(keyed.merge).start()
    return out.outputMode("append").format(table.options.get("format", "json")).option("path", table.options["path"]).start()


def newest(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The last row of each key: by ``order``, then by its place in ``df`` (rows of
    a later partition come later). Combined on the map side first."""
    place = F.struct(*(order or []), "__place")
    rest = [c for c in df.columns if c not in keys]
    best = df.withColumn("__place", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*rest, F.lit(1).alias("__one")), place).alias("__best"))
    return best.select(*keys, *(F.col(f"__best.`{c}`").alias(c) for c in rest)).select(*df.columns)


class KeyedTable:
    """A Parquet table that keeps the newest row of each key.

    Rows lie in ``BUCKETS`` folders by a hash of ``spread`` (the keys, or what they
    share: a window, say). A merge writes the buckets that its batch touches anew,
    beside the old ones, and then adds a small file that names the folder of every
    bucket; readers see a whole version. Folders that neither the last version nor
    the one before names are removed. A batch that was merged already is not merged
    again.
    """

    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str, keys: list[str], spread: list[str] | None = None, order: list[str] | None = None) -> None:
        self.spark, self.path, self.keys, self.spread, self.order = spark, path.rstrip("/"), keys, spread or keys, order

    def _pointer(self) -> dict:
        try:
            rows = self.spark.read.text(f"{self.path}/_current").collect()
        except Exception as e:  # no version yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {"batch": -1, "folders": {}, "dropped": []}
        return max((json.loads(r[0]) for r in rows), key=lambda p: p["batch"])

    def _rows(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in sorted(folders))) if folders else None

    def read(self) -> DataFrame | None:
        return self._rows(list(self._pointer()["folders"].values()))

    def merge(self, batch: DataFrame, batch_id: int, replace: list[str] | None = None) -> None:
        """Put ``batch`` in place of rows with its keys. ``replace``: all rows that
        share these columns with the batch go (a window's old ranks, say); they hold
        the columns that rows are spread by."""
        now = self._pointer()
        if batch_id <= now["batch"]:
            return
        if missing := set(self.spread) - set(replace or self.keys):
            raise ValueError(f"rows are spread by {sorted(missing)}")
        # The batch is read three times; a stream's would be made anew each time.
        batch = batch.persist()
        try:
            self._merge(now, batch, batch_id, replace or self.keys)
        finally:
            batch.unpersist()

    def _merge(self, now: dict, batch: DataFrame, batch_id: int, replace: list[str]) -> None:
        bucket = F.pmod(F.xxhash64(*self.spread), F.lit(self.BUCKETS)).cast("int").alias("__bucket")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        if not touched:
            return
        rows = newest(batch, self.keys, self.order)
        old = self._rows([f for b, f in now["folders"].items() if int(b) in touched])
        if old is not None:
            rows = old.join(batch.select(*replace).distinct(), replace, "left_anti").unionByName(rows)
        folder = f"v{batch_id}-{uuid.uuid4().hex[:8]}"
        # One file for a bucket; rows of a batch are many times fewer than the table's.
        rows.select("*", bucket).repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        folders = now["folders"] | {str(b): f"{folder}/__bucket={b}" for b in touched}
        gone = [f for f in now["folders"].values() if f not in folders.values()]
        pointer = json.dumps({"batch": batch_id, "folders": folders, "dropped": gone})
        self.spark.createDataFrame([(pointer,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_current")
        for f in now["dropped"]:
            self._remove(f)

    def _remove(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def upsert_top_n(keyed: KeyedTable, partition: list[str], order: list, n: int):
    """A foreachBatch function: final windows of a batch become their top rows;
    all rows of a window are final in the same batch."""
    def put(batch: DataFrame, batch_id: int) -> None:
        w = Window.partitionBy(*partition).orderBy(*order)
        best = batch.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
        keyed.merge(best, batch_id, replace=partition)

    return put
