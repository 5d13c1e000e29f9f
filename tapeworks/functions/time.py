"""Arithmetic on epoch milliseconds, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ts: str | Column, size_ms: int) -> Column:
    """Start of the epoch-aligned span of ``size_ms`` that holds ``ts``."""
    return col(ts) - F.pmod(col(ts), F.lit(size_ms))


def event_time(ts: str | Column) -> Column:
    """The timestamp that Spark's watermarks and windows need."""
    return F.timestamp_millis(col(ts))


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds of a timestamp, with or without a zone (then UTC)."""
    return F.unix_millis(col(ts).cast("timestamp"))


def relative_spread(bid: str | Column, ask: str | Column) -> Column:
    return (col(ask) - col(bid)) / ((col(bid) + col(ask)) / 2)


def relative_deviation(value: str | Column, around: str | Column) -> Column:
    return F.abs(col(value) - col(around)) / col(around)
