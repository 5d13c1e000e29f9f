"""Keyed stateful operators for streams, on ``transformWithState``.

Rows wait in state until the watermark passes their event time and leave in
(ts, id) order, so results do not depend on how input was cut into batches; rows
behind the watermark are dropped before they get here. State needs the RocksDB
provider (``session.build``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import THRESHOLD, WARMUP, Detector
from ..operators.match import Pattern, match_rows
from ..operators.windows import EVENT_TIME


class Ordered(StatefulProcessor):
    """Buffers rows (ts, id, value) and hands them on in order, once each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, id long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.ts, r.id, r.value) for r in rows]
        # One timer for the newest row; older ones leave when later input comes.
        self.handle.registerTimer(max(r[0] for r in new))
        return self._leave(key, timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._leave(key, expiredTimerInfo.getExpiryTimeInMs(), [])

    def _leave(self, key, limit: int, new: list[tuple]) -> Iterator[Row]:
        """Hand on the rows up to ``limit``; the others wait."""
        rows = sorted([*(tuple(r) for r in self.waiting.get()), *new]) if self.waiting.exists() else sorted(new)
        ready, rest = [r for r in rows if r[0] <= limit], [r for r in rows if r[0] > limit]
        if rest:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        return iter(list(self.take(key[0], ready)) if ready else [])

    def take(self, key, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RunningStats(Ordered):
    """State beside the buffer: rows so far and the last values."""
    OUT = "key string, ts long, id long, value double, n_so_far long, mean double, prev double"

    def __init__(self, rows: int = 100) -> None:
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n long")
        self.last = handle.getValueState("last", "values array<double>")

    def take(self, key, rows):
        n = self.count.get()[0] if self.count.exists() else 0
        last = list(self.last.get()[0]) if self.last.exists() else []
        for ts, id_, value in rows:
            prev = last[-1] if last else None
            last = [*last, value][-self.rows :]
            n += 1
            yield Row(key=key, ts=ts, id=id_, value=value, n_so_far=n, mean=sum(last) / len(last), prev=prev)
        self.count.update((n,))
        self.last.update((last,))


class Matcher(Ordered):
    """Row patterns over a stream. ``define``: per variable a test of (value,
    previous value or None). A match is final once a row follows it."""
    OUT = "key string, starts array<long>, ends array<long>"

    def __init__(self, pattern: str, define: dict[str, Callable[[float, float | None], bool]]) -> None:
        self.pattern, self.define = Pattern.parse(pattern, {}), define

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "labels string, times array<long>, prev double")

    def _label(self, value: float, prev: float | None) -> str:
        fits = (not (t := self.define.get(v)) or t(value, prev) for v in self.pattern.variables)
        return chr(0x4E00 + sum(1 << i for i, f in enumerate(fits) if f))

    def take(self, key, rows):
        labels, times, prev = self.open.get() if self.open.exists() else ("", [], None)
        times = list(times)
        for ts, _, value in rows:
            labels += self._label(value, prev)
            times.append(ts)
            prev = value
        done = 0
        for spans in match_rows(labels, self.pattern):
            if spans[-1][1] == len(labels):
                break
            done = spans[-1][1]
            yield Row(key=key, starts=[times[s] if s < e else None for s, e in spans], ends=[times[e - 1] if s < e else None for s, e in spans])
        most = self.pattern.longest()
        keep = max(done, len(labels) - most) if most else done
        self.open.update((labels[keep:], times[keep:], prev))


class SpikeDetector(StatefulProcessor):
    """The detector in order of arrival: rows of one call are sorted by it."""
    OUT = "ts long, symbol string, px double, ewma double, deviation double, trade_id long"

    def __init__(self, threshold: float = THRESHOLD, warmup: int = WARMUP) -> None:
        self.threshold, self.warmup = threshold, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ewma = handle.getValueState("ewma", "value double")
        self.seen = handle.getValueState("seen", "value long")

    def handleInputRows(self, key, rows, timerValues):
        d = Detector(self.threshold, self.warmup, self.ewma.get()[0] if self.ewma.exists() else None, self.seen.get()[0] if self.seen.exists() else 0)
        out = []
        for r in sorted(rows, key=lambda r: r.arrival_seq):
            if found := d.take(r.px):
                out.append(Row(ts=r.ts, symbol=key[0], px=r.px, ewma=found[0], deviation=found[1], trade_id=r.trade_id))
        if d.average is not None:
            self.ewma.update((d.average,))
            self.seen.update((d.seen,))
        return iter(out)

    def close(self) -> None:
        pass


def ordered(df: DataFrame, key: str, ts: str, id_col: str, value: str, processor: Ordered) -> DataFrame:
    """Run an ordered operator over a stream with a watermark on its event time."""
    rows = df.selectExpr(f"`{key}` AS key", f"`{ts}` AS ts", f"`{id_col}` AS id", f"CAST(`{value}` AS DOUBLE) AS value", EVENT_TIME)
    return rows.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime")


def detect(df: DataFrame, processor: SpikeDetector | None = None) -> DataFrame:
    """Spike alerts of a stream (symbol, ts, px, trade_id, arrival_seq)."""
    processor = processor or SpikeDetector()
    return df.groupBy("symbol").transformWithState(statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="None")
