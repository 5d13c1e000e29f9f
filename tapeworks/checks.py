"""Checks of a tape's results against its manifest, and golden figures.

``figures`` runs every scene over a tape's trades and quotes, given in order of
arrival, and counts rows; ``problems`` compares what they hold with the incidents
of the manifest, whatever the seed. Figures of one seed can be frozen to a file.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.time import relative_spread
from .operators import analytics, detect, joins, lateness, match
from .operators import windows as W
from .sources.readers import BLOCK, FILE, ROW, SPAN_ROWS, placed

MINUTE, HOUR, LAG = 60_000, 3_600_000, 3_000
BARS = [W.Agg("hi", "max", "px"), W.Agg("lo", "min", "px"), W.Agg("avg_px", "avg", "px"), W.Agg("vol", "sum", "qty"), W.Agg("n", "count")]
TOTALS = [W.Agg("vol", "sum", "qty"), W.Agg("n", "count")]
#: A fall by about 1 % a minute and the recovery; ordinary minutes move far less.
DEFINE = {"rise": "avg_px / PREV(avg_px) > 1.0035", "dip": "avg_px / PREV(avg_px) < 0.9965", "pause": "abs(avg_px / PREV(avg_px) - 1) < 0.0035"}
PATTERN = "top dip{3,9} pause? rise{2,9}"
MEASURES = "FIRST(dip.avg_px) AS px_began, LAST(dip.avg_px) AS px_lowest, LAST(rise.avg_px) AS px_ended, FIRST(dip.window_start) AS began, LAST(dip.window_start) AS lowest, LAST(rise.window_start) AS ended"


def scenes(late: DataFrame, quotes: DataFrame) -> dict[str, DataFrame]:
    trades = late.drop(lateness.WATERMARK)
    grace = W.aggregate(late, W.tumble(MINUTE), ["symbol"], BARS, lateness_ms=MINUTE)
    return {
        "bars": W.aggregate(late, W.tumble(MINUTE), ["symbol"], BARS),
        "bars_grace": grace,
        "leaders": analytics.top_n(W.aggregate(late, W.hop(5 * MINUTE, MINUTE), ["symbol"], TOTALS), ["window_start"], [F.desc("vol"), F.asc("symbol")], 3),
        "spreads": joins.interval_join(late.where(lateness.row_on_time()), quotes, "symbol", 300, names=("t", "q")),
        "reversals": match.match_recognize(grace, ["symbol"], "window_start", match.measures_of(MEASURES), PATTERN, DEFINE),
        "sessions": W.aggregate(trades, W.session(2_000), ["symbol"], TOTALS),
        "board": W.aggregate(late, W.cumulate(10 * MINUTE, HOUR), ["symbol"], TOTALS),
        "running": analytics.running_stats(late.where(lateness.row_on_time()), "symbol", "ts", "trade_id", "px"),
        "alerts": detect.spike_alerts(trades, arrival="arrival_seq"),
    }


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """A written tape: its trades with the watermark at their arrival and a key of
    their order, quotes, manifest."""
    rows = placed(spark.read.schema("ts long, symbol string, px double, qty long, side string, venue string, trade_id long").json(f"{folder}/trades.ndjson"))
    spans = [F.col(FILE), F.col(BLOCK), F.floor(F.col(ROW) / SPAN_ROWS)]
    trades = lateness.watermark_in_order(rows, "ts", spans, [F.col(ROW)], LAG).withColumn("arrival_seq", F.struct(FILE, BLOCK, ROW)).drop(FILE, BLOCK, ROW)
    quotes = spark.read.schema("ts long, symbol string, bid double, ask double, bid_sz long, ask_sz long").json(f"{folder}/quotes.ndjson")
    return trades, quotes, json.loads("".join(r[0] for r in spark.read.text(f"{folder}/manifest.json").collect()))


def figures(out: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of every scene, and trades counted with and without lateness."""
    counts = {name: df.count() for name, df in out.items()}
    return counts | {f"{name}_trades": out[name].agg(F.sum("n")).first()[0] for name in ("bars", "bars_grace")}


def problems(out: dict[str, DataFrame], trades: DataFrame, manifest: dict) -> list[str]:
    """What the scenes get wrong; empty if all is well."""
    got, counts, incidents = figures(out), manifest["counts"], manifest["incidents"]
    wrong: list[str] = []

    def expect(ok: bool, what: str) -> None:
        if not ok:
            wrong.append(what)

    expect(got["bars_grace_trades"] - got["bars_trades"] == counts["late_trades"], "late trades lost without lateness")
    expect(got["bars_grace_trades"] == counts["trades"], "all trades counted with lateness")
    expect(got["running"] == counts["trades"] - counts["late_trades"], "rows of the running statistics")
    total = {r.symbol: r.v for r in trades.groupBy("symbol").agg(F.sum("qty").alias("v")).collect()}
    hour = {r.symbol: r.vol for r in out["board"].where(f"window_end - window_start = {HOUR}").collect()}
    expect(hour == total, "volumes of the whole hour")
    ends = out["running"].groupBy("symbol").agg(F.max_by("ma100", F.struct("ts", "trade_id")).alias("m"), F.min("px").alias("lo"), F.max("px").alias("hi"))
    expect(ends.where("m < lo OR m > hi").isEmpty(), "means within the prices")
    if p := incidents["wrong_print"]:
        bar = out["bars_grace"].where(f"symbol = '{p['symbol']}' AND window_start = {p['ts'] - p['ts'] % MINUTE}").collect()
        expect(len(bar) == 1 and abs(bar[0].hi - p["px"]) <= 1e-6, "the wrong print's bar")
        expect([r.trade_id for r in out["alerts"].collect()] == [p["trade_id"]], "one alert, the wrong print")
    if b := incidents["burst"]:
        inside = out["leaders"].where(f"window_start <= {b['from_ts']} AND window_start + {5 * MINUTE} >= {b['to_ts']}")
        first = analytics.window_leader(inside, "window_start", "symbol", "vol").collect()
        expect(bool(first) and {r.symbol for r in first} == {b["symbol"]}, "the burst leads its windows")
        longest = out["sessions"].where(f"symbol = '{b['symbol']}'").agg(F.max(F.col("window_end") - F.col("window_start"))).first()[0]
        expect(longest is not None and longest >= 0.8 * (b["to_ts"] - b["from_ts"]), "the burst is one session")
    if v := incidents["fall"]:
        inside = (F.col("t_ts") >= v["from_ts"]) & (F.col("t_ts") < v["to_ts"])
        spread = relative_spread("q_bid", "q_ask")
        a, c = out["spreads"].where(f"t_symbol = '{v['symbol']}'").agg(F.avg(F.when(inside, spread)), F.avg(F.when(~inside, spread))).first()
        expect(bool(a and c) and 2 < a / c < 4, "spreads widen in the fall")
        found = [r for r in out["reversals"].where(f"symbol = '{v['symbol']}'").collect() if r.began >= v["from_ts"] - 2 * MINUTE and abs(r.lowest - (v["turn_ts"] - MINUTE)) <= MINUTE]
        expect(len(found) == 1, "one reversal in the fall")
        expect(all(r.px_lowest < min(r.px_began, r.px_ended) for r in found), "the trough is the lowest")
    return wrong


def golden(out: dict[str, DataFrame], path: str, freeze: bool = False) -> list[str]:
    """Figures that differ from those in a file; ``freeze`` writes them to it."""
    now, at = figures(out), Path(path)
    if freeze:
        at.write_text(json.dumps(now, indent=2, sort_keys=True) + "\n")
        return []
    kept = json.loads(at.read_text())
    return [f"{k}: {kept.get(k)} was frozen, now {now.get(k)}" for k in sorted(kept.keys() | now.keys()) if kept.get(k) != now.get(k)]
