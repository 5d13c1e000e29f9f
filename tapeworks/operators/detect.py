"""A price-spike detector with an exponential average per key.

Rows of a key come in arrival order. Once ``warmup`` rows were taken in, a row
farther from the average than ``threshold`` (relative, strictly) is an alert and
changes nothing; any other row moves the average. The next state depends on the
verdict, so this is a fold over a key's rows: rows are dealt by key and sorted, and
a task runs through them batch by batch with two numbers of state, giving alerts as
it finds them. No key's rows meet in memory, but one key is one task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight of a new price, alert threshold and rows before alerts (fixed values).
ALPHA, THRESHOLD, WARMUP = 0.05, 0.15, 12


@dataclass
class Detector:
    """One key's detector, row by row (streams and tests)."""
    threshold: float = THRESHOLD
    warmup: int = WARMUP
    average: float | None = None
    seen: int = 0

    def take(self, price: float) -> tuple[float, float] | None:
        """(average, deviation) of an alert."""
        if self.average is not None and self.seen >= self.warmup:
            apart = abs(price - self.average)
            deviation = apart / self.average if self.average else math.inf if apart else 0.0
            if deviation > self.threshold:
                return self.average, deviation
        self.average = price if self.average is None else (1 - ALPHA) * self.average + ALPHA * price
        self.seen += 1
        return None


def spike_alerts(df: DataFrame, key: str = "symbol", arrival: str = "arrival_seq", ts: str = "ts", price: str = "px", row_id: str = "trade_id", threshold: float = THRESHOLD, warmup: int = WARMUP) -> DataFrame:
    """(ts, key, price, ewma, deviation, id) of every alert; rows without a price
    are left out."""
    rows = df.where(F.col(price).isNotNull()).select(F.col(key).alias("key"), F.col(arrival).alias("o"), F.col(row_id).cast("long").alias("id"), F.col(ts).cast("long").alias("ts"), F.col(price).cast("double").alias("px"))
    rows = rows.repartition("key").sortWithinPartitions("key", "o", "id").select("key", "id", "ts", "px")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, detector = None, Detector(threshold, warmup)
        for batch in batches:
            found, keys, prices = [], batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for i, px in enumerate(prices):
                if keys[i] != now:
                    now, detector = keys[i], Detector(threshold, warmup)
                if alert := detector.take(px):
                    found.append((i, *alert))
            if found:
                at, averages, deviations = zip(*found)
                picked = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([picked.column(2), picked.column(0), picked.column(3), pa.array(averages, pa.float64()), pa.array(deviations, pa.float64()), picked.column(1)], names=["ts", "key", "px", "ewma", "deviation", "id"])

    kind = rows.schema["key"].dataType.simpleString()
    alerts = rows.mapInArrow(fold, f"ts long, key {kind}, px double, ewma double, deviation double, id long")
    return alerts.select(F.col("ts").alias(ts), F.col("key").alias(key), F.col("px").alias(price), "ewma", "deviation", F.col("id").alias(row_id))
