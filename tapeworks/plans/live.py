"""Queries that run as streams, or as scripts of the SQL front end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, joins
from ..operators import windows as W
from ..sources.writers import KeyedTable, upsert_top_n
from ..streaming import capture, feed, state, stateful
from .catalog import BARS, COUNTS, DEFINE, HOPS, HOUR, JOIN, LATE, MEASURES, MINUTE, ORACLES, PATTERN, TAPE, _board, _rounded, query, tape
from .engine import Engine

#: Arrival spans of the replayed files: a tenth of the time range at least, so that
#: a replay is a few batches; rows are in order but for late ones.
PARTS = 6


def _marker(rows: DataFrame, lag_ms: int) -> DataFrame:
    """Rows so late in time that every window, lag and session has ended by then;
    their own windows never fire."""
    top = rows.agg(F.max("ts").alias("m"))
    own = {"trade_id": F.lit(-1).cast("long"), "ts": F.col("m") + lag_ms + 30 * 24 * HOUR, "symbol": F.lit("EOS"), "user_id": F.lit(-1).cast("long"), "px": F.lit(1.0), "qty": F.lit(1).cast("long"), "arrival": F.col("m") + lag_ms + 30 * 24 * HOUR}
    return top.select(*(own[c].cast(rows.schema[c].dataType).alias(c) for c in rows.columns))


def _stream(spark: SparkSession, sf_dir: str, lag_ms: int = 3_000, where: str | None = None, late: bool = False) -> tuple[DataFrame, str]:
    rows = tape(spark, sf_dir)
    rows = rows.where(where) if where else rows
    path = feed.folder(spark, "replay")
    first, last = rows.agg(F.min("arrival"), F.max("arrival")).first()
    span = max(1, (last - first) // PARTS + 1)
    order = "arrival" if late else "ts"
    feed.chunked(rows, order, span, path, _marker(rows, lag_ms))
    return feed.stream(spark, path, rows.schema, lag_ms=lag_ms), path


def _drained(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    return feed.run_once(df, f"{path}_out", mode)


@query(ORACLES["candles"])
def stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _stream(spark, sf_dir)
    return _rounded(_drained(W.aggregate(rows, W.tumble(HOUR), ["symbol"], BARS), path), "avg_px")


@query(ORACLES["candles"])
def stream_candles_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive up to two hours late; a watermark lag of lag plus lateness keeps all."""
    rows, path = _stream(spark, sf_dir, lag_ms=3_000 + 3 * HOUR, late=True)
    return _rounded(_drained(W.aggregate(rows, W.tumble(HOUR), ["symbol"], BARS), path), "avg_px")


@query(ORACLES["volume_leaders"])
def stream_volume_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final hopping windows, ranked and merged into a keyed table batch by batch."""
    rows, path = _stream(spark, sf_dir)
    hops = W.aggregate(rows, W.hop(6 * HOUR, HOUR), ["symbol"], [W.Agg("vol", "sum", "qty")]).select(F.col("window_start").alias("wstart"), "symbol", "vol")
    keyed = KeyedTable(spark, f"{path}_keyed", ["wstart", "symbol"], ["wstart"])
    put = upsert_top_n(keyed, ["wstart"], [F.desc("vol"), F.asc("symbol")], 3)
    hops.writeStream.outputMode("append").option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return keyed.read()


@query(ORACLES["cumulate_board"])
def stream_cumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _stream(spark, sf_dir)
    return _drained(W.aggregate(rows, W.cumulate(2 * HOUR, 12 * HOUR), ["symbol"], COUNTS), path)


@query(ORACLES["sessions"])
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _stream(spark, sf_dir)
    out = _drained(W.aggregate(rows, W.session(30 * MINUTE), ["user_id"], COUNTS), path)
    return out.select("user_id", "window_start", "window_end", "n", "vol")


@query(ORACLES["interval_join"])
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["user_id", "ts", "trade_id", "px", W.EVENT_TIME]
    left, path = _stream(spark, sf_dir, where="symbol = 'purchase'")
    right, _ = _stream(spark, sf_dir, where="symbol = 'view'")
    pairs = joins.stream_interval_join(left.select(*columns), right.select(*columns), "user_id", 6 * HOUR, names=("t", "q"))
    out = pairs.where("t_user_id >= 0").select(F.col("t_user_id").alias("user_id"), "t_ts", "t_trade_id", "q_trade_id", "t_px", "q_px", F.round(F.col("q_px") - F.col("t_px"), 6).alias("spread_abs"))
    return _drained(out, path)


@query(ORACLES["user_totals"])
def stream_user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running aggregate without a window, updated batch by batch."""
    rows, path = _stream(spark, sf_dir)
    totals = rows.where("user_id >= 0").groupBy("user_id").agg(F.sum("qty").alias("vol"), F.count("*").alias("n"))
    return _drained(totals, path, "complete")


def _stateful(spark: SparkSession) -> None:
    from ..session import ROCKSDB

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@query(ORACLES["running_stats"])
def stream_running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    rows, path = _stream(spark, sf_dir)
    out = _drained(stateful.ordered(rows, "symbol", "ts", "trade_id", "px", stateful.RunningStats()), path).where("key <> 'EOS'")
    return out.selectExpr("id AS trade_id", "ts", "key AS symbol", "value AS px", "n_so_far", "round(mean, 8) AS ma100", "prev AS prev_px")


@query(ORACLES["spike_alerts"])
def stream_spike_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _stateful(spark)
    rows, path = _stream(spark, sf_dir, late=True)
    named = rows.select("symbol", "ts", "px", "trade_id", (F.col("arrival") * 1_000_000 + F.col("trade_id")).alias("arrival_seq"))
    return _rounded(_drained(stateful.detect(named, stateful.SpikeDetector(threshold=1.5)), path), "ewma", "deviation")


@query(ORACLES["user_totals"])
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of ``stream_user_totals``, read from the checkpointed state."""
    rows, path = _stream(spark, sf_dir)
    totals = rows.where("user_id >= 0").groupBy("user_id").agg(F.sum("qty").alias("vol"), F.count("*").alias("n"))
    feed.run_once(totals, f"{path}_out", "complete", f"{path}_checkpoint")
    kept = spark.read.format("statestore").load(f"{path}_checkpoint")
    first, second = kept.schema["value"].dataType.names[:2]
    return kept.select("key.user_id", F.col("value")[first].alias("vol"), F.col("value")[second].alias("n"))


@query(ORACLES["user_totals"])
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emissions of a captured run; a replay that differs from it is an error."""
    rows, path = _stream(spark, sf_dir)
    capture.record(rows.drop(W.EVENT_TIME), f"{path}_capture")
    schema = tape(spark, sf_dir).schema
    operator = lambda s: s.where("user_id >= 0").groupBy("user_id").agg(F.sum("qty").alias("vol"), F.count("*").alias("n"))
    capture.run(spark, f"{path}_capture", schema, operator, f"{path}_emitted", f"{path}_checkpoint", mode="complete")
    if not capture.verify(spark, f"{path}_capture", schema, operator, f"{path}_emitted", mode="complete"):
        raise ValueError("the replay differs")
    last = capture.listing(spark, f"{path}_emitted").agg(F.max("epoch")).first()[0]
    return spark.read.parquet(f"{path}_emitted/epoch={last:06d}")


DECLARED = """CREATE TABLE tape (trade_id BIGINT, ts BIGINT, symbol VARCHAR, user_id BIGINT, px DOUBLE, qty BIGINT, arrival BIGINT)
    WITH (connector='file', format='parquet', path='{path}'{more});
"""
TIMED = ", event_time_column='ts', watermark_lag_ms='3000'"


def _script(spark: SparkSession, sf_dir: str, text: str, late: bool = False) -> DataFrame:
    path = feed.folder(spark, "declared")
    rows = tape(spark, sf_dir)
    (rows.orderBy("arrival", "trade_id") if late else rows).write.parquet(path)
    return Engine(spark).execute(DECLARED.format(path=path, more=TIMED if late else "") + text)


@query(ORACLES["candles_drop"])
def sql_scene_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_script(spark, sf_dir, "SELECT symbol, window_start, window_end, MAX(px) AS hi, MIN(px) AS lo, AVG(px) AS avg_px, SUM(qty) AS vol, COUNT(*) AS n FROM tape GROUP BY TUMBLE(ts, INTERVAL '1' HOUR), symbol", late=True), "avg_px")


@query(ORACLES["volume_leaders"])
def sql_scene_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script(spark, sf_dir, """SELECT ranked.wstart, ranked.symbol, ranked.vol FROM (SELECT sums.*, ROW_NUMBER() OVER (PARTITION BY sums.wstart ORDER BY sums.vol DESC, sums.symbol) AS place FROM (
        SELECT window_start AS wstart, symbol, SUM(qty) AS vol FROM tape GROUP BY symbol, HOP(ts, INTERVAL '6' HOUR, INTERVAL '1' HOUR)) AS sums) AS ranked WHERE ranked.place < 4""")


@query(f"WITH {LATE} {_board('late', 'WHERE wm IS NULL OR w > wm')}")
def sql_scene_cumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script(spark, sf_dir, "SELECT symbol, window_start, window_end, SUM(qty) AS vol, COUNT(*) AS n FROM tape GROUP BY CUMULATE(ts, INTERVAL '2' HOUR, INTERVAL '12' HOUR), symbol", late=True)


@query(ORACLES["sessions"])
def sql_scene_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script(spark, sf_dir, "SELECT user_id, window_start, window_end, COUNT(*) AS n, SUM(qty) AS vol FROM tape GROUP BY SESSION(ts, INTERVAL '30' MINUTE), user_id")


@query(f"WITH {TAPE} {JOIN}")
def sql_scene_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script(spark, sf_dir, f"""SELECT t_user_id AS user_id, t_ts, t_trade_id, q_trade_id, t_px, q_px, ROUND(q_px - t_px, 6) AS spread_abs
        FROM tape t JOIN tape q ON t.user_id = q.user_id AND t.ts BETWEEN q.ts + 0 AND q.ts + {6 * HOUR} WHERE t_symbol = 'purchase' AND q_symbol = 'view'""")


@query(ORACLES["running_stats_punctual"])
def sql_scene_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_script(spark, sf_dir, """SELECT trade_id, ts, symbol, px, COUNT(px) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS n_so_far,
        AVG(px) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS ma100, LAG(px, 1) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS prev_px FROM tape""", late=True), "ma100")


@query(ORACLES["reversal_pattern"])
def sql_scene_reversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = _rounded(W.aggregate(tape(spark, sf_dir), W.tumble(6 * HOUR), ["symbol"], [W.Agg("avg_px", "avg", "px")]), "avg_px").select("symbol", "window_start", "avg_px")
    path = feed.folder(spark, "declared")
    bars.write.parquet(path)
    define = ", ".join(f"{v} AS {c}" for v, c in DEFINE.items())
    return Engine(spark).execute(f"""CREATE TABLE bars (symbol VARCHAR, window_start BIGINT, avg_px DOUBLE) WITH (connector='file', format='parquet', path='{path}');
        SELECT * FROM bars MATCH_RECOGNIZE (PARTITION BY symbol ORDER BY window_start MEASURES {MEASURES} PATTERN ({PATTERN}) DEFINE {define})""")


@query(f"WITH {TAPE}, {HOPS} SELECT symbol, count(*) AS windows FROM hops GROUP BY 1")
def hop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_n(W.aggregate(tape(spark, sf_dir), W.hop(6 * HOUR, HOUR), ["symbol"], [W.Agg("n", "count")]), ["symbol", "window_start"], [F.desc("n")], 1).groupBy("symbol").agg(F.count("*").alias("windows"))


@query("SELECT 'state' AS slot, count(DISTINCT user_id) AS keys FROM events")
def state_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a snapshot, exported to Parquet and read back."""
    rows, path = _stream(spark, sf_dir)
    totals = rows.where("user_id >= 0").groupBy("user_id").agg(F.sum("qty").alias("vol"), F.count("*").alias("n"))
    feed.run_once(totals, f"{path}_out", "complete", f"{path}_checkpoint")
    state.state_export(spark, f"{path}_checkpoint", f"{path}_state")
    counted = state.state_query(spark, f"{path}_checkpoint", "SELECT slot, COUNT(*) AS keys FROM state GROUP BY slot")
    return counted.join(spark.read.parquet(f"{path}_state").select("slot").distinct(), "slot")
