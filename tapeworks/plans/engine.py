"""Runs scripts of declared tables and inserts.

A file table that another statement wrote is read when it is asked for, so scripts
compose through their files. ``stream=True`` reads files as streams; Kafka and
WebSocket tables always stream. Inserts of streams start queries; ``await_all``
waits for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import TableDef
from ..operators.lateness import WATERMARK, row_on_time
from ..sources.readers import read
from ..sources.writers import fitted, start, write
from ..streaming.feed import folder
from ..streaming.progress import summary
from . import ddl
from .rewrite import match_query, spark_sql


class Engine:
    def __init__(self, spark: SparkSession, stream: bool = False, checkpoints: str | None = None, interval_ms: int | None = None) -> None:
        """``interval_ms``: streams go on, with a batch and so a checkpoint this often;
        without it they take what is there and stop."""
        self.spark, self.stream, self.checkpoints, self.interval_ms = spark, stream, checkpoints, interval_ms
        self.tables: dict[str, TableDef] = {}
        self.collected: dict[str, DataFrame] = {}
        self.queries: list[StreamingQuery] = []

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        for q in self.queries:
            q.stop()

    def execute(self, script: str) -> DataFrame | None:
        """Run every statement; the result of the last one if it is a query."""
        out = None
        for text in ddl.statements(script):
            statement = ddl.parse(text)
            out = None
            if isinstance(statement, ddl.Create):
                self.tables[statement.table.name] = statement.table
            elif isinstance(statement, ddl.Drop):
                if statement.name not in self.tables and not statement.if_exists:
                    raise ValueError(f"no table {statement.name}")
                self.tables.pop(statement.name, None)
                self.spark.catalog.dropTempView(statement.name)
            elif isinstance(statement, ddl.Insert):
                self._insert(statement)
            else:
                out = self.query(statement.query)
        return out

    def run_file(self, path: str) -> DataFrame | None:
        return self.execute("\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(path).collect()))

    def _streams(self, name: str) -> bool:
        t = self.tables.get(name)
        return bool(t) and (t.connector == "websocket" or (t.connector in ("file", "kafka") and self.stream))

    def _late(self, name: str) -> int | None:
        t = self.tables.get(name)
        return t.lateness_ms if t and t.event_time and t.connector in ("file", "kafka") and not self._streams(name) else None

    def _columns(self, name: str) -> list[str] | None:
        """Event time comes last."""
        t = self.tables.get(name)
        if t is None:
            return None
        return [*(c for c in t.schema.names if c != t.event_time), *([t.event_time] if t.event_time else [])]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise ValueError(f"no table {name}")
        if name in self.collected:
            return self.collected[name]
        return read(self.spark, self.tables[name], self._streams(name))

    def query(self, sql: str) -> DataFrame:
        matched = match_query(sql, self.table)
        if matched is not None:
            return matched
        for name in ddl.sources(sql) & set(self.tables):
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(spark_sql(sql, self._late, self._streams, self._columns))

    def _insert(self, statement: ddl.Insert) -> None:
        target = self.tables.get(statement.target)
        if target is None:
            raise ValueError(f"no table {statement.target}")
        df = self.query(statement.query)
        if df.isStreaming:
            checkpoint = f"{self.checkpoints or folder(self.spark, 'checkpoint')}/{target.name}"
            if target.connector == "collect":
                query = fitted(df, target).writeStream.format("memory").queryName(target.name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
                self.queries.append(query)
            else:
                self.queries.append(start(df, target, checkpoint, self.interval_ms is None, self.interval_ms))
        elif target.connector == "collect":
            self.collected[target.name] = fitted(df, target)
        else:
            write(df, target)

    def collect(self, name: str):
        """A collected table as a pyarrow table."""
        if name in self.collected:
            return self.collected[name].toArrow()
        self.await_all()
        return self.spark.table(name).toArrow()

    def await_all(self) -> None:
        for q in self.queries:
            q.awaitTermination()

    def progress(self) -> list[dict]:
        """Of every stream its rows so far, rates, watermark, state and last batch."""
        return [summary(q) for q in self.queries]


def punctual(df: DataFrame, ts: str) -> DataFrame:
    """Rows that were not behind the watermark when they arrived."""
    return df.where(row_on_time(ts)) if WATERMARK in df.columns else df
