"""Streams against tables: windows, joins, state, restart, capture, sinks, feeds."""

import base64
import contextlib
import hashlib
import json
import socket
import threading

import pytest
from pyspark.sql import functions as F

from tapeworks import tape as T
from tapeworks.operators import analytics, detect, joins, match
from tapeworks.operators import windows as W
from tapeworks.sources import websocket
from tapeworks.sources.readers import read, read_lines
from tapeworks.sources.writers import KeyedTable, upsert_top_n, write, write_lines
from tapeworks.model import TableDef
from tapeworks.streaming import capture, feed, state, stateful

NAMES = ["TKAZ", "TKCX", "TKFU", "TKIR"]
AGGS = [W.Agg("vol", "sum", "qty"), W.Agg("n", "count")]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def some(trades):
    return trades.where(F.col("symbol").isin(NAMES) & (F.col("ts") < T.BASE_MS + 20 * 60_000)).cache()


@pytest.fixture(scope="module")
def punctual(some, tape):
    return some.where(~F.col("trade_id").isin(tape.manifest["counts"]["late_trade_ids"])).cache()


def live(spark, df, tmp_path, span=60_000, lag_ms=3_000, marker=True, name="in"):
    end = T.end_markers(spark, 60, 4).withColumn("arrival_ms", F.col("ts")).withColumn("arrival_seq", F.lit(10**9).cast("long"))
    feed.chunked(df, "arrival_ms", span, str(tmp_path / name), end if marker else None)
    return feed.stream(spark, str(tmp_path / name), df.schema, lag_ms=lag_ms)


@pytest.mark.parametrize("win", [W.tumble(60_000), W.hop(300_000, 60_000), W.cumulate(600_000, 3_600_000), W.session(2_000)], ids=lambda w: w.kind)
def test_windows_agree_with_tables(spark, punctual, tmp_path, win):
    stream = live(spark, punctual, tmp_path, span=300_000)
    # The marker ends the tape's hour and no later one.
    got = feed.run_once(W.aggregate(stream, win, ["symbol"], AGGS), str(tmp_path / "out"))
    want = W.aggregate(punctual, win, ["symbol"], AGGS)
    columns = ("symbol", "window_start", "window_end", "vol", "n")
    ended = F.col("window_end") <= T.BASE_MS + 60 * 60_000
    assert rows(got.where(ended), *columns) == rows(want.where(ended), *columns)
    assert got.where("symbol LIKE 'EOS%'").isEmpty()


@pytest.fixture(scope="module")
def around_a_straggler(some, tape):
    """Some minutes around a trade that arrives late; few batches at short spans."""
    first = some.where(F.col("trade_id").isin(tape.manifest["counts"]["late_trade_ids"])).agg(F.min("ts")).first()[0]
    return some.where((F.col("ts") >= first - 120_000) & (F.col("ts") < first + 180_000)).cache()


def test_late_rows_grace_and_flush(spark, around_a_straggler, some, tape, tmp_path):
    everything, some = some, around_a_straggler
    lost = some.where(F.col("trade_id").isin(tape.manifest["counts"]["late_trade_ids"])).count()
    assert lost > 0
    counted = {}
    for lag in (3_000, 63_000):
        stream = live(spark, some, tmp_path, span=13_000, lag_ms=lag, name=f"in{lag}")
        out = feed.run_once(W.aggregate(stream, W.tumble(60_000), ["symbol"], AGGS), str(tmp_path / f"out{lag}"))
        counted[lag] = out.agg(F.sum("n")).first()[0]
    assert counted[63_000] == some.count() and counted[3_000] == some.count() - lost
    stream = live(spark, everything.where("symbol = 'TKAZ'"), tmp_path, span=300_000, marker=False, name="open")
    out = feed.run_once(W.aggregate(stream, W.tumble(60_000), ["symbol"], AGGS), str(tmp_path / "open_out"))
    assert out.count() < 20  # nothing closes the last minute


def test_cumulate_recovers_stragglers_in_later_windows(spark, around_a_straggler, tmp_path):
    some = around_a_straggler
    stream = live(spark, some, tmp_path, span=13_000)
    out = feed.run_once(W.aggregate(stream, W.cumulate(60_000, 3_600_000), ["symbol"], AGGS), str(tmp_path / "out"))
    last = out.where(f"window_end = {T.BASE_MS + 30 * 60_000}").agg(F.sum("n")).first()[0]
    assert last is None or last == some.count()


def test_interval_join(spark, punctual, quotes, tmp_path):
    q = quotes.where("symbol = 'TKCX'").where(F.col("ts") < T.BASE_MS + 5 * 60_000)
    t = punctual.where("symbol = 'TKCX'").where(F.col("ts") < T.BASE_MS + 5 * 60_000).select("ts", "symbol", "px", "trade_id", "arrival_ms")
    feed.chunked(t, "arrival_ms", 120_000, str(tmp_path / "t"))
    feed.chunked(q, "arrival_ms", 120_000, str(tmp_path / "q"))
    left, right = feed.stream(spark, str(tmp_path / "t"), t.schema), feed.stream(spark, str(tmp_path / "q"), q.schema)
    pairs = joins.stream_interval_join(left, right, "symbol", 300, names=("t", "q")).select("t_trade_id", "q_ts", "q_bid")
    reports = []
    got = feed.run_once(pairs, str(tmp_path / "out"), reports=reports)
    want = joins.interval_join(t, q, "symbol", 300, names=("t", "q"))
    # Rows that no partner can follow any more have left the state.
    assert max(r["state_rows"] for r in reports) < 0.8 * (t.count() + q.count()) and reports[-1]["watermark"] > "2026-01-05T09:0"
    assert rows(got, "t_trade_id", "q_ts") == rows(want, "t_trade_id", "q_ts")


def test_running_stats_and_pattern(spark, punctual, tmp_path):
    few = punctual.where("symbol = 'TKCX'").where(F.col("ts") < T.BASE_MS + 10 * 60_000)
    stream = live(spark, few, tmp_path, span=120_000)
    out = feed.run_once(stateful.ordered(stream, "symbol", "ts", "trade_id", "px", stateful.RunningStats()), str(tmp_path / "out"))
    want = {r.trade_id: r for r in analytics.running_stats(few, "symbol", "ts", "trade_id", "px").collect()}
    got = [r for r in out.collect() if not r.key.startswith("EOS")]
    assert len(got) == len(want)
    for r in got:
        w = want[r.id]
        assert (r.n_so_far, r.prev) == (w.n_so_far, w.prev_px) and r.mean == pytest.approx(w.ma100)

    steps = {"f": lambda v, p: p is not None and v < p, "r": lambda v, p: p is not None and v > p}
    stream = live(spark, few, tmp_path, span=120_000, name="again")
    found = feed.run_once(stateful.ordered(stream, "symbol", "ts", "trade_id", "px", stateful.Matcher("x f{2,7} r{2,6}", steps)), str(tmp_path / "matches"))
    first = match.match_recognize(few.withColumn("o", F.struct("ts", "trade_id")), ["symbol"], "o", [("FIRST", "x", "ts", "a"), ("LAST", "r", "ts", "b")], "x f{2,7} r{2,6}", {"f": "px < PREV(px)", "r": "px > PREV(px)"})
    assert sorted((r.starts[0], r.ends[2]) for r in found.collect()) == rows(first, "a", "b") != []


def test_detector_survives_a_restart(spark, some, tape, tmp_path):
    wrong = tape.manifest["incidents"]["wrong_print"]
    tkcx = some.where("symbol = 'TKCX'")
    path, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    mine = tkcx.where(F.col("arrival_ms") < wrong["ts"] - 60_000)
    n = feed.chunked(mine, "arrival_ms", 600_000, path)
    stream = lambda: stateful.detect(feed.stream(spark, path, tkcx.schema, ts=None))
    assert feed.run_once(stream(), out, checkpoint=ck).count() == 0
    seen = state.state(spark, ck, ["ewma", "seen"])
    assert {r.slot for r in seen.collect()} == {"ewma", "seen"} and json.loads(seen.where("slot = 'seen'").first().value)["value"] == mine.count()
    tkcx.where(F.col("arrival_ms") >= wrong["ts"] - 60_000).coalesce(1).write.parquet(f"{path}/part={n:09d}")
    got = feed.run_once(stream(), out, checkpoint=ck)
    assert [r.trade_id for r in got.collect()] == [wrong["trade_id"]]
    assert rows(got, "trade_id", "ewma") == rows(detect.spike_alerts(tkcx), "trade_id", "ewma")


def totals(stream):
    return stream.groupBy("symbol").agg(F.sum("qty").alias("vol"), F.count("*").alias("n"))


def test_state_capture_and_replay(spark, some, tmp_path):
    path = str(tmp_path / "in")
    feed.chunked(some, "arrival_ms", 400_000, path)
    out = feed.run_once(totals(feed.stream(spark, path, some.schema, ts=None)), str(tmp_path / "out"), "complete", str(tmp_path / "ck"))
    assert rows(out, "symbol", "vol", "n") == rows(totals(some), "symbol", "vol", "n")
    assert rows(state.state_query(spark, str(tmp_path / "ck"), "SELECT slot, COUNT(*) AS keys FROM state GROUP BY slot"), "slot", "keys") == [("state", 4)]
    state.state_export(spark, str(tmp_path / "ck"), str(tmp_path / "exported"))
    assert spark.read.parquet(str(tmp_path / "exported")).columns == ["slot", "user_key", "value", "key_group"]
    ids = state.batches(spark, str(tmp_path / "ck"))
    assert state.state(spark, str(tmp_path / "ck"), batch_id=ids[0]).count() == 4

    taken, emitted = str(tmp_path / "capture"), str(tmp_path / "emitted")
    capture.record(feed.stream(spark, path, some.schema, ts=None), taken)
    assert capture.listing(spark, taken).agg(F.sum("records")).first()[0] == some.count()
    capture.run(spark, taken, some.schema, totals, emitted, str(tmp_path / "run"), mode="complete")
    assert capture.verify(spark, taken, some.schema, totals, emitted, mode="complete")
    assert capture.verify(spark, taken, some.schema, totals, emitted, epoch=0, mode="complete")
    assert not capture.verify(spark, taken, some.schema, lambda s: totals(s.where("qty > 100")), emitted, mode="complete")
    capture.emit_test(spark, taken, emitted, str(tmp_path / "bundle"), "tests.test_streaming", "totals", "complete", state.state(spark, str(tmp_path / "ck")))
    scope = {"__file__": str(tmp_path / "bundle/test_replay.py")}
    exec((tmp_path / "bundle/test_replay.py").read_text(), scope)
    scope["test_replay"](spark)


def test_upsert_of_top_rows(spark, tmp_path):
    keyed = KeyedTable(spark, str(tmp_path / "keyed"), ["w", "s"], ["w"])
    put = upsert_top_n(keyed, ["w"], [F.desc("v"), F.asc("s")], 2)
    frame = lambda *r: spark.createDataFrame(list(r), "w long, s string, v long")
    put(frame((1, "a", 5), (1, "b", 4), (1, "c", 3), (2, "a", 1)), 0)
    put(frame((1, "c", 9), (1, "a", 5), (1, "b", 4)), 1)
    put(frame((9, "z", 9)), 1)  # merged already
    assert rows(keyed.read(), "w", "s", "v") == [(1, "a", 5), (1, "c", 9), (2, "a", 1)]


def test_keyed_table_rewrites_touched_buckets_and_drops_old_ones(spark, tmp_path):
    import glob

    keyed = KeyedTable(spark, str(tmp_path / "keyed"), ["k"], order=["at"])
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string, at long")
    keyed.merge(frame(*((i, "old", 0) for i in range(300))), 0)
    first = dict(keyed._pointer()["folders"])
    keyed.merge(frame((7, "late", 1), (7, "newest", 3), (7, "new", 2), (900, "x", 1)), 1)
    second = keyed._pointer()["folders"]
    assert 1 <= sum(first.get(b) != f for b, f in second.items()) <= 2
    assert rows(keyed.read().where("k IN (7, 900)"), "k", "v") == [(7, "newest"), (900, "x")] and keyed.read().count() == 301
    for n in range(2, 5):
        keyed.merge(frame((7, f"v{n}", n)), n)
    kept = {p.split("keyed/")[1] for p in glob.glob(str(tmp_path / "keyed/v*/__bucket=*"))}
    assert len(kept) <= len(second) + 2 and set(keyed._pointer()["folders"].values()) <= kept
    with pytest.raises(ValueError):
        KeyedTable(spark, str(tmp_path / "other"), ["w", "s"]).merge(frame((1, "a", 1)).toDF("w", "s", "v"), 0, replace=["w"])


def test_newest_rows(spark):
    from tapeworks.sources.writers import newest

    df = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "c", 6), (2, "d", None), (None, "e", 1)], "k long, v string, at long").coalesce(1)
    assert rows(newest(df.where("k IS NOT NULL"), ["k"], ["at"]), "k", "v") == [(1, "b"), (2, "d")]
    assert rows(newest(df.where("k IS NOT NULL"), ["k"]), "k", "v") == [(1, "c"), (2, "d")]


def test_arrival_order_of_several_files(spark, tmp_path):
    """Files of unequal size: Spark reads the large one first."""
    base = T.BASE_MS
    small = [(base + i * 1_000, i) for i in range(5)]
    large = [(base + 3_600_000 + i * 100, 5 + i) for i in range(5_000)]
    for name, part in (("part-0", small), ("part-1", large)):
        (tmp_path / "t").mkdir(exist_ok=True)
        (tmp_path / "t" / f"{name}.json").write_text("".join(json.dumps({"ts": ts, "n": n}) + "\n" for ts, n in part))
    t = TableDef("t", spark.createDataFrame([(1, 1)], "ts long, n long").schema, {"connector": "file", "format": "json", "path": str(tmp_path / "t"), "event_time_column": "ts", "watermark_lag_ms": "0"})
    got = {r.n: r["__wm"] for r in read(spark, t).collect()}
    most = None
    for ts, n in small + large:
        assert got[n] == most
        most = max(ts, most or ts)
    assert read(spark, t).columns == ["ts", "n", "__wm"]


def test_deduplicated_feeds(spark):
    from tapeworks.sources.readers import deduplicated

    df = spark.createDataFrame([(1, 2), (1, 2), (2, 2)], "symbol long, window_start long")
    assert deduplicated(df, ["symbol", "window_start"]).count() == 2


def test_sinks(spark, some, tmp_path):
    schema = some.select("trade_id", "px").schema
    for mode, key in (("append", {}), ("upsert", {"mode": "upsert", "primary_key": "trade_id"})):
        t = TableDef("t", schema, {"connector": "file", "format": "json", "path": str(tmp_path / mode), **key})
        write(some.unionByName(some), t)
        assert read(spark, t).count() == some.count() * (1 if key else 2)
    write_lines(some.select(F.to_json(F.struct("trade_id")).alias("value")), str(tmp_path / "lines"))
    assert read_lines(spark, str(tmp_path / "lines")).count() == some.count()
    write(some, TableDef("n", schema, {"connector": "blackhole"}))
    with pytest.raises(ValueError):
        write(some.drop("px"), TableDef("n", schema, {"connector": "blackhole"}))
    with pytest.raises(ValueError):
        read(spark, TableDef("n", schema, {"connector": "blackhole"}))


def _serve(sent, got, cut=False):
    """A WebSocket server that takes one client and sends ``sent``; ``cut``: it goes
    without saying so."""
    server = socket.create_server(("127.0.0.1", 0))

    def run():
        client, _ = server.accept()
        with client:
            head = b""
            while not head.endswith(b"\r\n\r\n"):
                head += client.recv(1)
            key = next(line.split(b": ")[1] for line in head.split(b"\r\n") if line.lower().startswith(b"sec-websocket-key"))
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
            client.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n")
            first = client.recv(2)
            mask_and_data = client.recv(4 + (first[1] & 127))
            got.append(bytes(b ^ mask_and_data[i % 4] for i, b in enumerate(mask_and_data[4:])).decode())
            client.sendall(b"\x89\x00")
            for m in sent:
                data = m.encode()
                size = bytes([len(data)]) if len(data) < 126 else b"\x7e" + len(data).to_bytes(2, "big")
                client.sendall(b"\x81" + size + data)
            if cut:
                return
            client.sendall(b"\x88\x00")
            with contextlib.suppress(ConnectionError):  # answers to ping and end, or the client is gone
                while client.recv(64):
                    pass

    threading.Thread(target=run, daemon=True).start()
    return f"ws://127.0.0.1:{server.getsockname()[1]}/feed"


def test_websocket_messages_and_reader():
    got = []
    sent = [json.dumps({"n": i, "pad": "x" * (200 if i == 1 else 3)}) for i in range(5)]
    assert list(websocket.messages(_serve(sent, got), "hello")) == sent and got == ["hello"]
    feed_cut, seen = websocket.messages(_serve(sent, [], cut=True), "hello"), []
    with pytest.raises(ConnectionError):
        seen += [m for m in feed_cut if not seen.append(m)]
    assert seen == sent
    reader = websocket.WebSocketReader({"url": "u", "max_messages": "3"}, connect=lambda url, subscribe: iter("abcdef"))
    found, at = reader.read(reader.initialOffset())
    assert list(found) == [("a",), ("b",), ("c",)] and at == {"messages": 3}
    assert list(reader.read(at)[0]) == []


def test_websocket_table(spark, tmp_path):
    sent = [json.dumps({"e": "trade", "s": "X", "p": str(100 + i), "T": T.BASE_MS + i * 30_000}) for i in range(6)]
    from tapeworks.plans.engine import Engine

    with Engine(spark, checkpoints=str(tmp_path / "ck")) as e:
        e.execute(f"""CREATE TABLE feed (s VARCHAR, p VARCHAR, "T" BIGINT) WITH (connector='websocket', format='json', url='{_serve(sent, [])}', subscribe='go', max_messages='6', event_time_column='T', watermark_lag_ms='3000');
            CREATE TABLE out (s VARCHAR, ts BIGINT, px DOUBLE) WITH (connector='file', format='json', path='{tmp_path}/out');
            INSERT INTO out SELECT s, "T" AS ts, CAST(p AS DOUBLE) AS px FROM feed""")
        e.await_all()
    got = spark.read.schema("s string, ts long, px double").json(f"{tmp_path}/out")
    assert rows(got, "px") == [(100.0 + i,) for i in range(6)]
