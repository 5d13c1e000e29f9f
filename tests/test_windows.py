"""Windows, lateness, joins, statistics, patterns and the detector on the tape."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tapeworks.functions.records import decode, render, render_fixed
from tapeworks.functions.time import relative_spread
from tapeworks.model import TableDef, milliseconds
from tapeworks.operators import analytics, detect, joins, lateness, match
from tapeworks.operators import windows as W
from tapeworks.tape import generate

BARS = [W.Agg("hi", "max", "px"), W.Agg("avg_px", "avg", "px"), W.Agg("vol", "sum", "qty"), W.Agg("n", "count")]
MINUTE = 60_000


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def late_trades(spark, trades):
    return lateness.with_watermark(trades, "ts", "arrival_ms", 3_000, "trade_id", span=MINUTE).cache()


def test_durations_and_declarations():
    assert milliseconds("INTERVAL '5' MINUTE") == 300_000 and milliseconds("2 seconds") == 2_000
    with pytest.raises(ValueError):
        milliseconds("5 fortnights")
    from pyspark.sql.types import LongType, StructType

    with pytest.raises(ValueError):
        TableDef("t", StructType().add("a", LongType()), {"event_time_column": "b"})


def test_tape_is_deterministic_and_well_formed(spark, tape, trades):
    again = generate(spark, scale=0.25)
    assert again.manifest == tape.manifest
    assert again.trades.repartition(3).exceptAll(tape.trades).isEmpty() and again.quotes.exceptAll(tape.quotes).isEmpty()
    few = [generate(spark, seed=s, symbols=3, minutes=4, scale=0.05) for s in (7, 8)]
    assert not few[0].trades.exceptAll(few[1].trades).isEmpty() and few[0].manifest["incidents"]["wrong_print"] is None
    ordinary = trades.where(~F.col("trade_id").isin(tape.manifest["counts"]["late_trade_ids"]))
    delay = ordinary.agg(F.min(F.col("arrival_ms") - F.col("ts")), F.max(F.col("arrival_ms") - F.col("ts"))).first()
    assert 0 <= delay[0] and delay[1] <= 2_800
    late = trades.where(F.col("trade_id").isin(tape.manifest["counts"]["late_trade_ids"]))
    wait = late.select((F.col("arrival_ms") - F.col("ts") + F.col("ts") % MINUTE - MINUTE).alias("w"))
    assert wait.count() == 25 and wait.where("w NOT BETWEEN 30000 AND 45000").isEmpty()
    assert trades.select("trade_id").distinct().count() == tape.manifest["counts"]["trades"] == trades.count()
    assert tape.quotes.count() == tape.manifest["counts"]["quotes"]
    assert tape.symbols.select("symbol").distinct().count() == 12 and tape.quotes.where("bid >= ask").isEmpty()


def test_bars_lateness_and_wrong_print(tape, trades, late_trades):
    sums = [W.aggregate(late_trades, W.tumble(MINUTE), ["symbol"], BARS, lateness_ms=ms).agg(F.count("*"), F.sum("n")).first() for ms in (0, 60_000)]
    assert [s[0] for s in sums] == [720, 720]
    assert sums[1][1] == trades.count() and sums[1][1] - sums[0][1] == 25
    wrong = tape.manifest["incidents"]["wrong_print"]
    bar = W.aggregate(trades, W.tumble(MINUTE), ["symbol"], BARS).where(f"symbol = '{wrong['symbol']}' AND window_start = {wrong['ts'] - wrong['ts'] % MINUTE}").collect()
    assert len(bar) == 1 and bar[0].hi == pytest.approx(wrong["px"], abs=1e-6)


def test_prefix_watermark_against_a_scan(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(10_000), rng.randrange(5_000)) for i in range(400)]
    df = spark.createDataFrame(data, "id long, ts long, arrival long")
    got = {r.id: r["__wm"] for r in lateness.with_watermark(df, "ts", "arrival", 100, "id", span=700).collect()}
    top = None
    for i, ts, _ in sorted(data, key=lambda r: (r[2], r[0])):
        assert got[i] == (None if top is None else top - 100)
        top = ts if top is None else max(top, ts)


def test_leaders_burst_and_cumulate(tape, trades, late_trades):
    hops = W.aggregate(trades, W.hop(5 * MINUTE, MINUTE), ["symbol"], BARS)
    assert analytics.top_n(hops, ["window_start"], [F.desc("vol"), F.asc("symbol")], 3).count() == 192
    burst = tape.manifest["incidents"]["burst"]
    inside = analytics.window_leader(hops, "window_start", "symbol", "vol").where(f"window_start <= {burst['from_ts']} AND window_start + 300000 >= {burst['to_ts']}").collect()
    assert len(inside) == 3 and {r.symbol for r in inside} == {burst["symbol"]}
    board = W.aggregate(late_trades, W.cumulate(10 * MINUTE, 60 * MINUTE), ["symbol"], BARS)
    assert board.count() == 72
    hour = board.where("window_end - window_start = 3600000")
    assert rows(hour, "symbol", "vol") == rows(trades.groupBy("symbol").agg(F.sum("qty").alias("vol")), "symbol", "vol")


@pytest.mark.parametrize("win", [W.hop(5_000, 2_000), W.hop(6_000, 2_000), W.cumulate(2_000, 6_000), W.tumble(3_000)])
def test_windows_against_a_scan(spark, win):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(20_000), rng.random()) for _ in range(300)] + [("a", 6_000, 0.5), ("a", 5_999, 0.5)]
    df = spark.createDataFrame(data, "symbol string, ts long, px double").withColumn("qty", F.lit(1).cast("long"))
    want = {}
    for k, ts, px in data:
        if win.kind == "cumulate":
            start = ts - ts % win.size
            spans = [(start, e) for e in range(ts - ts % win.step + win.step, start + win.size + 1, win.step)]
        else:
            step = win.step or win.size
            spans = [(s, s + win.size) for s in range(-win.size // step * step, 22_000, step) if s <= ts < s + win.size]
        for s in spans:
            want.setdefault((k, *s), []).append(px)
    got = W.aggregate(df, win, ["symbol"], BARS).collect()
    assert {(r.symbol, r.window_start, r.window_end) for r in got} == set(want)
    for r in got:
        own = want[r.symbol, r.window_start, r.window_end]
        assert r.n == len(own) and r.hi == max(own) and r.avg_px == pytest.approx(sum(own) / len(own))


def test_sessions(spark, tape, trades):
    df = spark.createDataFrame([("a", t, 1) for t in (1_000, 3_000, 5_001)], "symbol string, ts long, qty long")
    got = W.aggregate(df, W.session(2_000), ["symbol"], [W.Agg("n", "count")])
    assert rows(got, "window_start", "window_end", "n") == [(1_000, 5_000, 2), (5_001, 7_001, 1)]
    burst = tape.manifest["incidents"]["burst"]
    full = W.aggregate(trades, W.session(4_000), ["symbol"], [W.Agg("n", "count")]).where(f"symbol = '{burst['symbol']}'")
    assert full.agg(F.max(F.col("window_end") - F.col("window_start"))).first()[0] >= 0.8 * (burst["to_ts"] - burst["from_ts"])


def test_interval_join_and_spread(spark, tape, trades, quotes):
    plain = joins.interval_join(trades, quotes, "symbol", 300, names=("t", "q")).cache()
    bucketed = joins.interval_join(trades, quotes, "symbol", 300, names=("t", "q"), bucketed=True)
    assert plain.count() == bucketed.count() > 0
    assert plain.select("t_trade_id", "q_ts", "q_bid").exceptAll(bucketed.select("t_trade_id", "q_ts", "q_bid")).isEmpty()
    fall = tape.manifest["incidents"]["fall"]
    inside = (F.col("t_ts") >= fall["from_ts"]) & (F.col("t_ts") < fall["to_ts"])
    spread = relative_spread("q_bid", "q_ask")
    a, b = plain.where(f"t_symbol = '{fall['symbol']}'").agg(F.avg(F.when(inside, spread)), F.avg(F.when(~inside, spread))).first()
    assert 2 < a / b < 4
    edge = spark.createDataFrame([("a", 0), ("a", 300), ("a", 301)], "symbol string, ts long")
    for bucket in (False, True):
        out = joins.interval_join(edge, spark.createDataFrame([("a", 0)], "symbol string, ts long"), "symbol", 300, bucketed=bucket)
        assert rows(out, "l_ts") == [(0,), (300,)]


def test_running_stats(trades, late_trades):
    punctual = late_trades.where(lateness.row_on_time())
    out = analytics.running_stats(punctual, "symbol", "ts", "trade_id", "px").cache()
    assert out.count() == trades.count() - 25
    last = out.groupBy("symbol").agg(F.max_by("ma100", F.struct("ts", "trade_id")).alias("m"), F.min("px").alias("lo"), F.max("px").alias("hi")).collect()
    assert all(r.lo <= r.m <= r.hi for r in last)
    assert out.where("n_so_far = 1 AND prev_px IS NOT NULL").isEmpty()


def _fits(spark, labels, pattern, define=None, name="a"):
    """Of each match the first and last fall, the pause and the last rise."""
    df = spark.createDataFrame([(name, i, c) for i, c in enumerate(labels)], "k string, i int, c string")
    define = define or {v: f"c = '{v}'" for v in "fpr"}
    measures = [("FIRST", "f", "i", "a"), ("LAST", "f", "i", "b"), ("LAST", "r", "i", "c"), ("FIRST", "p", "i", "d")]
    return [tuple(r)[1:] for r in sorted(match.match_recognize(df, ["k"], "i", measures, pattern, define).collect(), key=lambda r: r.a)]


def test_patterns(spark):
    valley = "x f{2,5} p? r{1,3}"
    assert _fits(spark, "xxffffprrrrx", valley) == [(2, 5, 9, 6)]
    assert _fits(spark, "xffrxfffprr", valley) == [(1, 2, 3, None), (5, 7, 10, 8)]
    assert _fits(spark, "frr", valley) == _fits(spark, "", valley) == []
    assert _fits(spark, "ffffffffr", valley) == [(3, 7, 8, None)]  # the row before may be a fall
    # Overlapping conditions need backtracking: f takes all it can, then gives back.
    both = {"f": "c IN ('f', 'y')", "p": "c = 'p'", "r": "c IN ('r', 'y')"}
    assert _fits(spark, "xfyyy", "x f+ r{3}", both) == [(1, 1, 4, None)]
    with pytest.raises(ValueError):
        match.Pattern.parse("a | b", {})


def test_patterns_over_many_batches_and_partitions(spark):
    import random
    import re

    rng = random.Random(4)
    texts = {f"k{j}": "".join(rng.choice("ffrrpxy") for _ in range(rng.choice([1, 40, 700]))) for j in range(6)} | {None: "xfffrr" * 30}
    df = spark.createDataFrame([(k, i, c) for k, t in texts.items() for i, c in enumerate(t)], "k string, i int, c string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for pattern, regex in (("x f{2,6} p? r{1,3}", "(.)(f{2,6})(p?)(r{1,3})"), ("x f+ r{2}", "(.)(f+)()(r{2})"), ("f{1,2}? r*", "(f{1,2}?)()()(r*)")):
            out = match.match_recognize(df, ["k"], "i", [("FIRST", "f", "i", "a"), ("LAST", "r", "i", "b")], pattern, {v: f"c = '{v}'" for v in "fpr"})
            group = 2 if pattern[0] == "x" else 1
            want = {(k, m.start(group), m.end(4) - 1 if m[4] else None) for k, t in texts.items() for m in re.finditer(regex, t)}
            assert {tuple(r) for r in out.collect()} == want and len(want) > 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_watermark_of_several_feeds(spark):
    import random

    rng = random.Random(2)
    rows_in = [(i, rng.randrange(3) if i > 20 else rng.randrange(2), 1_000 * i + rng.randrange(9_000)) for i in range(200)]
    df = spark.createDataFrame(rows_in, "arrival long, part int, ts long").repartition(4)
    got = {r.arrival: r["__wm"] for r in lateness.with_watermark(df, "ts", "arrival", 500, span=13, sources=("part", [0, 1, 2])).collect()}
    most = {}
    for arrival, part, ts in rows_in:
        assert got[arrival] == (min(most.values()) - 500 if len(most) == 3 else None)
        most[part] = max(ts, most.get(part, ts))


def test_equal_to_a_threshold_matches_no_label(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate((80.0, 20.0, 5.0, 5.0))], "k string, i int, p double")
    define = {"f": "p < PREV(p) * 0.25", "r": "p > PREV(p)"}
    out = match.labelled(df, ["k"], "i", match.Pattern.parse("f r", define)).select("__label").collect()
    assert {r[0] for r in out} == {"一"}


def _alerts(prices, threshold, warmup):
    """Places of alerts by the rule, in plain words: far from the average, once warm."""
    out, average, seen = [], None, 0
    for i, px in enumerate(prices):
        if average is not None and seen >= warmup and abs(px - average) > threshold * average:
            out.append((i, average))
        else:
            average, seen = px if average is None else average * 0.95 + px * 0.05, seen + 1
    return out


def test_detector(spark, trades, tape):
    rng = random.Random(12)
    feeds = {k: [rng.uniform(9, 11) * (rng.choice([0.5, 2.0]) if rng.random() < 0.05 else 1) for _ in range(rng.choice([5, 13, 400]))] for k in ("one", "two", "three", "four")}
    for threshold, warmup in ((0.15, 12), (0.3, 0), (0.6, 40)):
        want = {(k, i): avg for k, prices in feeds.items() for i, avg in _alerts(prices, threshold, warmup)}
        for k, prices in feeds.items():  # row by row, and cut anywhere with the state carried on
            d, cut = detect.Detector(threshold, warmup), rng.randrange(len(prices))
            for i, px in enumerate(prices):
                if i == cut:
                    d = detect.Detector(threshold, warmup, d.average, d.seen)
                found = d.take(px)
                assert (found is not None) == ((k, i) in want) and (found is None or found[0] == pytest.approx(want[k, i]))
            assert d.seen == len(prices) - sum(x == k for x, _ in want)
        rows_in = [(k, len(prices) - i, 10 * i, px, i) for k, prices in feeds.items() for i, px in enumerate(prices)]
        df = spark.createDataFrame(rows_in, "symbol string, back long, ts long, px double, trade_id long").withColumn("arrival_seq", -F.col("back")).repartition(5)
        got = detect.spike_alerts(df, threshold=threshold, warmup=warmup).collect()
        assert {(r.symbol, r.trade_id) for r in got} == set(want) and len(got) == len(want)
        assert all(r.ewma == pytest.approx(want[r.symbol, r.trade_id]) and r.deviation == pytest.approx(abs(r.px / r.ewma - 1)) and r.ts == 10 * r.trade_id for r in got)
    zero = spark.createDataFrame([("Z", i, i, 0.0 if i < 20 else 1.0, i) for i in range(21)] + [("Z", 30, 30, None, 30)], "symbol string, arrival_seq long, ts long, px double, trade_id long")
    assert [(a.trade_id, a.deviation) for a in detect.spike_alerts(zero).collect()] == [(20, float("inf"))]
    found = detect.spike_alerts(trades).collect()
    assert [a.trade_id for a in found] == [tape.manifest["incidents"]["wrong_print"]["trade_id"]]


def test_running_stats_in_blocks(spark):
    rng = random.Random(8)
    rows_in = [(k, rng.randrange(4_000), i, rng.random() if rng.random() > 0.1 else None) for i, k in enumerate(rng.choices("aaab", k=900))]
    df = spark.createDataFrame(rows_in, "k string, ts long, id long, px double").repartition(4)
    want = analytics.running_stats(df, "k", "ts", "id", "px", rows=7)
    for span, block in ((300, 50), (10_000, 7), (1, 900)):
        got = analytics.running_stats_in_blocks(df, "k", "ts", "id", "px", rows=7, span=span, block=block)
        assert got.columns == want.columns
        pick = lambda d: sorted((r.id, r.n_so_far, r.prev_px, None if r.ma7 is None else round(r.ma7, 9)) for r in d.collect())
        assert pick(got) == pick(want)


def test_json_records(spark):
    from pyspark.sql.types import DoubleType, LongType, StringType, StructType

    schema = StructType().add("ts", LongType()).add("symbol", StringType()).add("px", DoubleType())
    lines = ['{"ts":1,"symbol":"a","px":2.5,"x":0}', '{"px":"3.5","symbol":"b","ts":"2"}', '{"ts":1,"symbol":"a"}', '{"ts":"z","symbol":"a","px":1}', "not json", ""]
    df = spark.createDataFrame([Row(value=v) for v in lines])
    got = decode(df, schema)
    assert rows(got, "ts", "symbol", "px") == [(1, "a", 2.5), (2, "b", 3.5)]
    out = got.select(render("ts", "px").alias("j"), render_fixed(["px"], ["ts", "symbol"], ["ts", "symbol", "px"]).alias("f")).orderBy("ts").first()
    assert out.j == '{"ts":1,"px":2.5}' and out.f == '{"ts":1,"symbol":"a","px":2.500000}'
