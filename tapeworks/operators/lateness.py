"""Watermarks in arrival order for batch tables, and late-row masks.

A stream's watermark when a row arrives is the largest event time among the rows
before it, less the lag. For a table with a column of arrival, that is a running
maximum. One global window would put all rows into one task; here rows fall into
spans of arrival, maxima per span are combined before the shuffle, the running
maximum over spans (one small row each) is joined back, and inside a span an
ordinary window adds the rows before.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WATERMARK = "__wm"


def with_watermark(df: DataFrame, ts: str, arrival: str, lag_ms: int, tie: str | None = None, span: int = 3_600_000, name: str = WATERMARK, sources: tuple[str, list] | None = None) -> DataFrame:
    """``df`` with the watermark at each row's arrival; null for the first row.

    ``span``: width of a span in units of ``arrival``. Rows with equal arrival
    come in the order of ``tie``. ``sources``: a column and its values, if rows come
    from several feeds (a topic's partitions, say); the watermark is then the
    smallest of theirs, and null until each has had a row.
    """
    order = [F.col(arrival)] if tie is None else [F.col(arrival), F.col(tie)]
    return watermark_in_order(df, ts, [F.floor(F.col(arrival) / span)], order, lag_ms, name, sources)


def watermark_in_order(df: DataFrame, ts: str, spans: list[Column], order: list[Column], lag_ms: int, name: str = WATERMARK, sources: tuple[str, list] | None = None) -> DataFrame:
    """The same for rows whose order is that of ``spans`` and then ``order``."""
    cut = [f"__span{i}" for i in range(len(spans))]
    times = [F.when(F.col(sources[0]) == F.lit(v), F.col(ts)) for v in sources[1]] if sources else [F.col(ts)]
    rows = df.withColumns(dict(zip(cut, spans)))
    per_span = rows.groupBy(*cut).agg(*(F.max(t).alias(f"__m{i}") for i, t in enumerate(times)))
    before = Window.orderBy(*cut).rowsBetween(Window.unboundedPreceding, -1)
    earlier = per_span.select(*cut, *(F.max(f"__m{i}").over(before).alias(f"__earlier{i}") for i in range(len(times))))
    inside = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__inside{i}": F.max(t).over(inside) for i, t in enumerate(times)}).join(earlier, cut, "left")
    # greatest() skips nulls, so the first row of all keeps a null.
    most = [F.greatest(f"__inside{i}", f"__earlier{i}") for i in range(len(times))]
    least = most[0] if len(most) == 1 else F.when(reduce(and_, (m.isNotNull() for m in most)), F.least(*most))
    return rows.withColumn(name, least - F.lit(lag_ms)).drop(*cut, *(f"__{k}{i}" for k in ("inside", "earlier") for i in range(len(times))))


def row_on_time(ts: str = "ts", wm: str = WATERMARK) -> Column:
    """For operators that drop row by row (running statistics, joins)."""
    return F.col(wm).isNull() | (F.col(ts) > F.col(wm))


def window_open(window_end: str | Column, lateness_ms: int = 0, wm: str = WATERMARK) -> Column:
    """For windows: a row is lost only to windows that have closed by then."""
    end = F.col(window_end) if isinstance(window_end, str) else window_end
    return F.col(wm).isNull() | (end + F.lit(lateness_ms) > F.col(wm))
