"""Checkpointed keyed state as tables: query and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state(spark: SparkSession, checkpoint: str, slots: list[str] | None = None, batch_id: int | None = None, operator: int = 0) -> DataFrame:
    """(slot, user_key, value, key_group): state of one stateful operator, keys
    and values as JSON. ``slots``: names of a stateful processor's variables;
    without them the state of a built-in operator is one slot, ``state``."""
    reader = spark.read.format("statestore").option("operatorId", operator)
    if batch_id is not None:
        reader = reader.option("batchId", batch_id)
    parts = []
    for slot in slots or [None]:
        df = (reader.option("stateVarName", slot) if slot else reader).load(checkpoint)
        value = F.col("value") if "value" in df.columns else F.col("list_element")
        parts.append(df.select(F.lit(slot or "state").alias("slot"), F.to_json("key").alias("user_key"), F.to_json(value).alias("value"), F.col("partition_id").alias("key_group")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def state_query(spark: SparkSession, checkpoint: str, sql: str, **which) -> DataFrame:
    """SQL over the snapshot as table ``state``."""
    state(spark, checkpoint, **which).createOrReplaceTempView("state")
    return spark.sql(sql)


def state_export(spark: SparkSession, checkpoint: str, path: str, **which) -> None:
    state(spark, checkpoint, **which).write.mode("overwrite").parquet(path)


def batches(spark: SparkSession, checkpoint: str) -> list[int]:
    """Ids of the batches that have a snapshot, oldest first."""
    rows = spark.read.format("state-metadata").load(checkpoint).select("minBatchId", "maxBatchId").first()
    return list(range(rows[0], rows[1] + 1)) if rows else []
