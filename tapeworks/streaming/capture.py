"""A flight recorder for streams: capture input by epoch, replay, verify.

The recorder keeps every micro-batch of a source as Parquet under its epoch. An
operator (a function from stream to stream) runs over the captured epochs one at
a time, so its batches are the captured ones; a replay from a fresh checkpoint
sees the same batches and must emit the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .feed import folder, in_order

Operator = Callable[[DataFrame], DataFrame]


def record(source: DataFrame, path: str) -> None:
    """Keep what the source has now, batch by batch, under ``path``/epoch=N."""
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch:06d}")

    source.writeStream.option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, records) of a capture."""
    rows = spark.read.parquet(f"{path}/epoch=*").select(F.regexp_extract(F.input_file_name(), r"epoch=(\d+)", 1).cast("long").alias("epoch"))
    return rows.groupBy("epoch").agg(F.count("*").alias("records"))


def run(spark: SparkSession, path: str, schema, operator: Operator, out: str, checkpoint: str, last: int | None = None, mode: str = "append") -> None:
    """Run an operator over the captured epochs up to ``last``; its emissions go
    to ``out``/epoch=N."""
    epochs = sorted(r[0] for r in listing(spark, path).select("epoch").collect())
    in_order(spark, path, "epoch=*/*.parquet")  # copies of a capture have other times
    picked = [e for e in epochs if last is None or e <= last]
    paths = "{" + ",".join(f"epoch={e:06d}" for e in picked) + "}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{paths}")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch:06d}")

    operator(source).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def fingerprint(df: DataFrame) -> tuple:
    """The same for equal bags of rows, in any order."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    return tuple(df.select(row.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first())


def verify(spark: SparkSession, path: str, schema, operator: Operator, emitted: str, epoch: int | None = None, mode: str = "append") -> bool:
    """Replay from an empty state up to ``epoch`` and compare the emissions."""
    again = folder(spark, "replay")
    run(spark, path, schema, operator, f"{again}/out", f"{again}/checkpoint", epoch, mode)
    which = "epoch=*" if epoch is None else f"epoch={epoch:06d}"
    return fingerprint(spark.read.parquet(f"{emitted}/{which}")) == fingerprint(spark.read.parquet(f"{again}/out/{which}"))


_TEST = '''"""Replays a captured input and expects the captured emissions."""
import importlib
import json
from pathlib import Path

HERE = Path(__file__).parent


def test_replay(spark):
    from tapeworks.streaming import capture

    about = json.loads((HERE / "bundle.json").read_text())
    operator = getattr(importlib.import_module(about["module"]), about["operator"])
    schema = spark.read.parquet(f"{HERE}/input/epoch=*").schema
    assert capture.verify(spark, f"{HERE}/input", schema, operator, f"{HERE}/expected", mode=about["mode"])
'''


def emit_test(spark: SparkSession, path: str, emitted: str, to: str, module: str, operator: str, mode: str = "append", state: DataFrame | None = None) -> None:
    """A bundle {input, expected, state, test}: everything to replay elsewhere.
    ``module`` and ``operator`` name an importable function."""
    for source, name in ((path, "input"), (emitted, "expected")):
        for (epoch,) in listing(spark, source).select("epoch").collect():
            spark.read.parquet(f"{source}/epoch={epoch:06d}").coalesce(1).write.mode("overwrite").parquet(f"{to}/{name}/epoch={epoch:06d}")
    if state is not None:
        state.write.mode("overwrite").parquet(f"{to}/state")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    about = json.dumps({"module": module, "operator": operator, "mode": mode})
    for name, text in (("bundle.json", about), ("test_replay.py", _TEST)):
        at = hadoop.Path(f"{to}/{name}")
        stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()
