"""Interval joins: equal keys, and a time within a span after another's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aliased(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))


def interval_join(left: DataFrame, right: DataFrame, key: str, upper_ms: int, lower_ms: int = 0, ts: str = "ts", names: tuple[str, str] = ("l", "r"), bucketed: bool = False) -> DataFrame:
    """All pairs with equal ``key`` and left.ts between right.ts + lower and
    right.ts + upper, both included. Columns are ``<name>_<column>``.

    Plain: an equi-join on the key with the range as a further condition; right
    for many keys. Bucketed: rows also meet by spans of the interval's length,
    which spreads few or hot keys over many tasks; each right row goes to the
    spans its interval touches, a left row to its own, so a pair meets once.
    """
    l, r = names
    a, b = _aliased(left, l), _aliased(right, r)
    lo, hi = F.col(f"{r}_{ts}") + lower_ms, F.col(f"{r}_{ts}") + upper_ms
    on = (F.col(f"{l}_{key}") == F.col(f"{r}_{key}")) & F.col(f"{l}_{ts}").between(lo, hi)
    if not bucketed:
        return a.join(b, on)
    width = max(1, upper_ms - lower_ms)
    span = lambda t: F.floor(t / width)
    a = a.withColumn("__lb", span(F.col(f"{l}_{ts}")))
    b = b.withColumn("__rb", F.explode(F.sequence(span(lo), span(hi))))
    return a.join(b, on & (F.col("__lb") == F.col("__rb"))).drop("__lb", "__rb")


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, upper_ms: int, lower_ms: int = 0, et: str = "__et", names: tuple[str, str] = ("l", "r")) -> DataFrame:
    """The same on two streams with watermarks; the range over event times lets
    Spark drop rows from state once no partner can come."""
    l, r = names
    a, b = _aliased(left, l), _aliased(right, r)
    span = lambda ms: F.expr(f"INTERVAL {ms} MILLISECONDS")
    return a.join(b, (F.col(f"{l}_{key}") == F.col(f"{r}_{key}")) & (F.col(f"{l}_{et}") >= F.col(f"{r}_{et}") + span(lower_ms)) & (F.col(f"{l}_{et}") <= F.col(f"{r}_{et}") + span(upper_ms)))
