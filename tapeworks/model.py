"""Declared tables: columns, connector options and event time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(),
    "VARCHAR": T.StringType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
}
UNIT_MS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}

#: Options that a declaration may carry.
OPTIONS = frozenset({
    "connector", "format", "path", "mode", "primary_key", "order_by", "event_time_column", "watermark_lag_ms", "allowed_lateness_ms",
    "brokers", "topic", "group_id", "auto_offset_reset", "columnar_decode", "url", "subscribe", "max_messages",
})


def milliseconds(text: str) -> int:
    """``5 minutes``, ``'5' MINUTE`` or ``INTERVAL '5' MINUTE`` in milliseconds."""
    m = re.fullmatch(r"\s*(?:interval\s+)?'?\s*(\d+)\s*'?\s*([a-z]+?)s?\s*'?\s*", text, re.IGNORECASE)
    if not m or m[2].lower() not in UNIT_MS:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * UNIT_MS[m[2].lower()]


@dataclass(frozen=True)
class TableDef:
    name: str
    schema: T.StructType
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if unknown := set(self.options) - OPTIONS:
            raise ValueError(f"table {self.name}: unknown options {sorted(unknown)}")
        if self.event_time and self.event_time not in self.schema.names:
            raise ValueError(f"table {self.name}: no column {self.event_time}")

    @property
    def connector(self) -> str:
        return self.options.get("connector", "file")

    @property
    def event_time(self) -> str | None:
        return self.options.get("event_time_column")

    @property
    def lag_ms(self) -> int:
        return int(self.options.get("watermark_lag_ms", 0))

    @property
    def lateness_ms(self) -> int:
        return int(self.options.get("allowed_lateness_ms", 0))

    @property
    def primary_key(self) -> list[str]:
        return [c.strip() for c in self.options.get("primary_key", "").split(",") if c.strip()]

    @property
    def order_by(self) -> list[str]:
        """What tells the newest row of a key; the place of a row decides last."""
        return [c.strip() for c in self.options.get("order_by", "").split(",") if c.strip()]
