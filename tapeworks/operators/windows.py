"""Event-time windows: tumbling, hopping, session and cumulative.

Windows are [start, end) in epoch milliseconds and aligned to the epoch. The
same call works on tables and on streams; a stream needs a watermark on
``EVENT_TIME`` (see ``streaming.sources``) and then drops late rows itself, per
window. Tables take a per-row watermark column instead (``lateness``).

Hopping and cumulative windows without a late mask are built from panes: rows
are first added up per key and step, and panes are what is multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import epoch_ms, event_time, floor_to
from .lateness import WATERMARK, window_open

EVENT_TIME = "__et"


@dataclass(frozen=True)
class Win:
    """kind: tumble (size), hop (size, step), cumulate (size, step), session (gap as size)."""
    kind: str
    size: int
    step: int = 0


def tumble(size_ms: int) -> Win:
    return Win("tumble", size_ms)


def hop(size_ms: int, slide_ms: int) -> Win:
    return Win("hop", size_ms, slide_ms)


def session(gap_ms: int) -> Win:
    return Win("session", gap_ms)


def cumulate(step_ms: int, size_ms: int) -> Win:
    if size_ms % step_ms:
        raise ValueError("the size must be a multiple of the step")
    return Win("cumulate", size_ms, step_ms)


@dataclass(frozen=True)
class Agg:
    """fn: max, min, avg, sum, count; count of ``*`` has no column."""
    name: str
    fn: str
    column: str | None = None


_PARTIAL = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}


def _direct(a: Agg) -> Column:
    return (F.count("*") if a.column is None else getattr(F, a.fn)(a.column)).alias(a.name)


def starts(ts: str | Column, win: Win) -> Column:
    """Starts of all windows of a row, as an array."""
    if win.kind == "hop":
        last = floor_to(ts, win.step)
        first = last - (win.size // win.step - (0 if win.size % win.step else 1)) * win.step
        own = F.sequence(first, last, F.lit(win.step))
        at = F.col(ts) if isinstance(ts, str) else ts
        return F.filter(own, lambda s: s + win.size > at) if win.size % win.step else own
    return F.array(floor_to(ts, win.size))


def ends(ts: str | Column, win: Win) -> Column:
    """Ends of the cumulative windows of a row, as an array."""
    return F.sequence(floor_to(ts, win.step) + win.step, floor_to(ts, win.size) + win.size, F.lit(win.step))


def expand(df: DataFrame, win: Win, ts: str = "ts") -> DataFrame:
    """``df`` with a row for each window: window_start, window_end."""
    if win.kind == "cumulate":
        return df.withColumn("window_end", F.explode(ends(ts, win))).withColumn("window_start", floor_to(ts, win.size))
    out = df.withColumn("window_start", floor_to(ts, win.size) if win.kind == "tumble" else F.explode(starts(ts, win)))
    return out.withColumn("window_end", F.col("window_start") + win.size)


def aggregate(df: DataFrame, win: Win, keys: list[str], aggs: list[Agg], ts: str = "ts", lateness_ms: int = 0, wm: str = WATERMARK) -> DataFrame:
    """(keys, window_start, window_end, aggregates). A table with a ``wm`` column
    loses rows to windows that were closed when they arrived."""
    bounds = ["window_start", "window_end"]
    if df.isStreaming:
        return _streaming(df, win, keys, aggs)
    late = wm in df.columns
    if win.kind == "session":
        if late:
            raise ValueError("late rows of sessions are a matter of streams")
        # The count is always used: if a caller drops all aggregates, Spark 4.1 would
        # plan the grouping without merging the sessions.
        grouped = df.groupBy(*keys, F.session_window(event_time(ts), f"{win.size} milliseconds").alias("w")).agg(*map(_direct, aggs), F.count("*").alias("__n")).where("__n > 0")
        return grouped.select(*keys, epoch_ms("w.start").alias("window_start"), epoch_ms("w.end").alias("window_end"), *(a.name for a in aggs))
    if win.kind == "tumble" or late or (win.kind == "hop" and win.size % win.step):
        rows = expand(df, win, ts)
        rows = rows.where(window_open("window_end", lateness_ms, wm)) if late else rows
        return rows.groupBy(*keys, *bounds).agg(*map(_direct, aggs))
    panes = df.groupBy(*keys, floor_to(ts, win.step).alias("__pane")).agg(*(c for i, a in enumerate(aggs) for c in _pane_parts(i, a)))
    return expand(panes, win, "__pane").groupBy(*keys, *bounds).agg(*(_from_panes(i, a) for i, a in enumerate(aggs)))


def _pane_parts(i: int, a: Agg) -> list[Column]:
    if a.fn == "avg":
        return [F.sum(a.column).alias(f"__s{i}"), F.count(a.column).alias(f"__n{i}")]
    return [_direct(Agg(f"__p{i}", a.fn, a.column))]


def _from_panes(i: int, a: Agg) -> Column:
    if a.fn == "avg":
        return (F.sum(f"__s{i}") / F.sum(f"__n{i}")).alias(a.name)
    return _PARTIAL[a.fn](f"__p{i}").alias(a.name)


def _streaming(df: DataFrame, win: Win, keys: list[str], aggs: list[Agg]) -> DataFrame:
    ms = lambda n: f"{n} milliseconds"
    if win.kind == "session":
        rows = df.withColumn("w", F.session_window(EVENT_TIME, ms(win.size)))
    elif win.kind == "tumble":
        rows = df.withColumn("w", F.window(EVENT_TIME, ms(win.size)))
    else:
        rows = df.withColumn("w", F.window(EVENT_TIME, ms(win.size), ms(win.step)))
    end = epoch_ms("w.end")
    if win.kind == "cumulate":
        # The hopping windows that end inside the row's own block of ``size``; a
        # late row is lost to closed ones only.
        rows = rows.where(end <= floor_to(epoch_ms(EVENT_TIME), win.size) + win.size)
        start = floor_to(end - 1, win.size)
    else:
        start = epoch_ms("w.start")
    grouped = rows.groupBy(*keys, "w").agg(*map(_direct, aggs))
    return grouped.select(*keys, start.alias("window_start"), end.alias("window_end"), *(a.name for a in aggs))
