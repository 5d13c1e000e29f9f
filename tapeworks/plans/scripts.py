"""Queries that run whole scripts: sources, inserts, sinks, and reading them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows as W
from ..sources.readers import read_lines
from ..sources.writers import write_lines
from ..streaming import feed, stateful
from .catalog import HOUR, LATE, ORACLES, PATTERN, TAPE, _hours, _rounded, query, tape
from .engine import Engine

DAY = 24 * HOUR
#: The tape as a user declares it; more options follow.
TICKS = """CREATE TABLE ticks (trade_id BIGINT, ts BIGINT, symbol VARCHAR, user_id BIGINT, px DOUBLE, qty BIGINT, arrival BIGINT)
    WITH (connector='file', format='{kind}', path='{path}'{more});
"""


def _ticks(spark: SparkSession, sf_dir: str, kind: str = "json", more: str = "") -> tuple[str, str]:
    """The declaration of the tape, written in order of arrival, and a new folder."""
    path = feed.folder(spark, "script")
    tape(spark, sf_dir).orderBy("arrival", "trade_id").write.format(kind).save(f"{path}/ticks")
    return TICKS.format(kind=kind, path=f"{path}/ticks", more=more), path


@query(_hours(LATE, f"WHERE wm IS NULL OR ts // {HOUR} * {HOUR} + {HOUR} + 5400000 > wm"))
def script_insert_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines to bars with lateness, inserted into JSON lines and read again."""
    declared, path = _ticks(spark, sf_dir, more=", event_time_column='ts', watermark_lag_ms='3000', allowed_lateness_ms='5400000'")
    out = Engine(spark).execute(f"""{declared}
        CREATE TABLE hourly (symbol VARCHAR, window_start BIGINT, window_end BIGINT, hi DOUBLE, lo DOUBLE, avg_px DOUBLE, vol BIGINT, n BIGINT) WITH (connector='file', format='json', path='{path}/hourly');
        CREATE TABLE unused (x BIGINT) WITH (connector='blackhole');
        INSERT INTO hourly SELECT window_start, window_end, symbol, COUNT(*) AS n, SUM(qty) AS vol, AVG(px) AS avg_px, MIN(px) AS lo, MAX(px) AS hi FROM ticks GROUP BY symbol, TUMBLE(ts, INTERVAL '1' HOUR);
        DROP TABLE unused; DROP TABLE IF EXISTS unused; -- the second finds none
        SELECT * FROM hourly""")
    return _rounded(out, "avg_px")


@query(f"WITH {TAPE} SELECT symbol, ts // {DAY} * {DAY} AS day, CAST(sum(qty) AS BIGINT) AS vol, round(sum(px), 4) AS total_px FROM tape GROUP BY ALL")
def script_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script's output with event time is another's input: hours, then days. The
    hours are inserted in order, so none is late for its day."""
    declared, path = _ticks(spark, sf_dir)
    out = Engine(spark).execute(f"""{declared}
        CREATE TABLE hourly (window_start BIGINT, symbol VARCHAR, vol BIGINT, total_px DOUBLE) WITH (connector='file', format='json', path='{path}/hourly', event_time_column='window_start');
        INSERT INTO hourly SELECT window_start, symbol, SUM(qty) AS vol, SUM(px) AS total_px FROM ticks GROUP BY TUMBLE(ts, INTERVAL '1' HOUR), symbol ORDER BY window_start, symbol;
        SELECT symbol, window_start AS day, SUM(vol) AS vol, SUM(total_px) AS total_px FROM hourly GROUP BY TUMBLE(window_start, INTERVAL '1' DAY), symbol""")
    return out.select("symbol", "day", "vol", F.round("total_px", 4).alias("total_px"))


@query(f"WITH {TAPE} SELECT trade_id, symbol, CASE WHEN trade_id % 7 = 0 THEN qty + 1 ELSE qty END AS qty FROM tape")
def script_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keyed by trade_id, some of them corrected: the newest stays."""
    declared, path = _ticks(spark, sf_dir, "parquet")
    return Engine(spark).execute(f"""{declared}
        CREATE TABLE latest (trade_id BIGINT, symbol VARCHAR, qty BIGINT) WITH (connector='file', format='parquet', mode='upsert', primary_key='trade_id', order_by='qty', path='{path}/latest');
        INSERT INTO latest SELECT trade_id, symbol, qty + 1 AS qty FROM ticks WHERE trade_id % 7 = 0 UNION ALL SELECT trade_id, symbol, qty FROM ticks;
        SELECT * FROM latest""")


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN value END AS px, CASE WHEN event_id % 3 > 0 THEN CAST(event_id AS BIGINT) ELSE -1 END AS n FROM events")
def script_dirty_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that come as text, some of them not numbers: these give null."""
    path = feed.folder(spark, "script")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.select("event_id", F.when(F.col("event_id") % 5 == 0, "oops").otherwise(F.col("value").cast("string")).alias("p"), F.when(F.col("event_id") % 3 == 0, "12x").otherwise(F.col("event_id").cast("string")).alias("q")).write.json(f"{path}/dirty")
    return Engine(spark).execute(f"""CREATE TABLE dirty (event_id BIGINT, p VARCHAR, q VARCHAR) WITH (connector='file', format='json', path='{path}/dirty');
        SELECT event_id, CAST(p AS DOUBLE) AS px, COALESCE(CAST(CAST(q AS VARCHAR) AS BIGINT), -1) AS n FROM dirty""")


@query(f"WITH {TAPE} SELECT symbol, count(*) AS n, CAST(sum(qty) AS BIGINT) AS vol FROM tape WHERE px > 20 GROUP BY 1")
def script_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted into a collecting table, taken out in Arrow form."""
    declared, _ = _ticks(spark, sf_dir, "parquet")
    with Engine(spark) as engine:
        engine.execute(f"""{declared} CREATE TABLE kept (symbol VARCHAR, n BIGINT, vol BIGINT) WITH (connector='collect');
            INSERT INTO kept SELECT symbol, COUNT(*) AS n, SUM(qty) AS vol FROM ticks WHERE px > 20 GROUP BY symbol""")
        return spark.createDataFrame(engine.collect("kept"))


@query("SELECT event_id, event_id || ' ' || event_type AS line FROM events")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written and read again."""
    path = feed.folder(spark, "script")
    write_lines(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws(" ", "event_id", "event_type").alias("value")), f"{path}/lines")
    return read_lines(spark, f"{path}/lines").select(F.split("value", " ")[0].cast("long").alias("event_id"), F.col("value").alias("line"))


@query(f"SELECT symbol, began, lowest, ended FROM ({ORACLES['reversal_pattern']}) JOIN (SELECT event_type AS symbol, max(epoch_us(ts) // 1000 // {6 * HOUR} * {6 * HOUR}) AS last FROM events GROUP BY 1) USING (symbol) WHERE ended < last")
def stream_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern over a stream of bars. A match is final once a bar follows it, so
    one that ends with a symbol's last bar stays open."""
    from .live import _drained, _stateful

    _stateful(spark)
    bars = _rounded(W.aggregate(tape(spark, sf_dir), W.tumble(6 * HOUR), ["symbol"], [W.Agg("avg_px", "avg", "px")]), "avg_px")
    rows = bars.select("symbol", F.col("window_start").alias("ts"), F.xxhash64("symbol", "window_start").alias("id"), "avg_px")
    top = rows.agg(F.max("ts").alias("m"))
    marker = top.select(F.lit("EOS").alias("symbol"), (F.col("m") + 30 * DAY).alias("ts"), F.lit(-1).cast("long").alias("id"), F.lit(1.0).alias("avg_px"))
    path = feed.folder(spark, "replay")
    feed.chunked(rows, "ts", 12 * DAY, path, marker)
    near = lambda low, high: lambda v, p: p is not None and low < v / p < high
    steps = {"dip": near(0, 0.98), "rise": near(1.02, float("inf")), "pause": lambda v, p: p is not None and abs(v / p - 1) < 0.02}
    found = stateful.ordered(feed.stream(spark, path, rows.schema, lag_ms=0), "symbol", "ts", "id", "avg_px", stateful.Matcher(PATTERN, steps))
    out = _drained(found, path).where("key <> 'EOS'")
    return out.select(F.col("key").alias("symbol"), F.col("starts")[1].alias("began"), F.col("ends")[1].alias("lowest"), F.col("ends")[3].alias("ended"))
