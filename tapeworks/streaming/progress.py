"""What streams are doing: rates, watermarks, state and lag, as plain values."""

from __future__ import annotations

import json

from pyspark.sql.streaming import StreamingQuery


def figures(progress: dict) -> dict:
    """The parts of one batch's progress report that tell how a stream does. A rate
    of input over that of processing means that it falls behind."""
    state = progress.get("stateOperators", [])
    return {
        "batch": progress["batchId"], "rows": progress.get("numInputRows", 0), "input_rows_per_s": progress.get("inputRowsPerSecond"), "processed_rows_per_s": progress.get("processedRowsPerSecond"),
        "watermark": progress.get("eventTime", {}).get("watermark"), "state_rows": sum(s["numRowsTotal"] for s in state), "late_rows": sum(s.get("numRowsDroppedByWatermark", 0) for s in state), "took_ms": progress.get("durationMs", {}).get("triggerExecution"),
    }


def summary(query: StreamingQuery) -> dict:
    """A stream's name and state, rows over the reports that Spark keeps, and the
    figures of its last batch."""
    reports = [json.loads(p.json) for p in query.recentProgress]
    error = query.exception()
    last = figures(reports[-1]) if reports else {}
    return {"name": query.name, "active": query.isActive, "error": str(error) if error else None, **last, "rows": sum(r.get("numInputRows", 0) for r in reports)}
