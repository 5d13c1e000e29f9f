"""Registered queries over the events table, and the SQL that gives the same rows.

Events stand in for a tape: event_type or user_id is the symbol, value the price
and value * 100 the quantity. They come in order, so disorder is added by a rule:
a delay under three seconds, or two hours for a few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import decode, render_fixed
from ..functions.time import epoch_ms, floor_to, relative_deviation
from ..operators import analytics, detect, joins, match
from ..operators import windows as W
from ..operators.lateness import row_on_time, with_watermark
from ..session import utc

MINUTE, HOUR = 60_000, 3_600_000
LAG = 3_000
BARS = [W.Agg("hi", "max", "px"), W.Agg("lo", "min", "px"), W.Agg("avg_px", "avg", "px"), W.Agg("vol", "sum", "qty"), W.Agg("n", "count")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trade_id, ts, symbol, user_id, px, qty, arrival)."""
    utc(spark)
    ts, e = epoch_ms("ts"), spark.read.parquet(f"{sf_dir}/events.parquet")
    late = F.when(F.col("event_id") % 401 == 7, F.lit(7_200_000)).otherwise(F.col("event_id") * 7919 % 2800)
    return e.select(F.col("event_id").alias("trade_id"), ts.alias("ts"), F.col("event_type").alias("symbol"), "user_id", F.col("value").alias("px"), F.round(F.col("value") * 100).cast("long").alias("qty"), (ts + late).cast("long").alias("arrival"))


def late_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_watermark(tape(spark, sf_dir), "ts", "arrival", LAG, "trade_id", span=6 * HOUR)


TAPE = """tape AS (SELECT event_id AS trade_id, epoch_us(ts) // 1000 AS ts, event_type AS symbol, user_id, value AS px,
    CAST(round(value * 100) AS BIGINT) AS qty,
    epoch_us(ts) // 1000 + CASE WHEN event_id % 401 = 7 THEN 7200000 ELSE event_id * 7919 % 2800 END AS arrival FROM events)"""
LATE = TAPE + """, late AS (SELECT *, max(ts) OVER (ORDER BY arrival, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3000 AS wm FROM tape)"""
BAR_SQL = "max(px) AS hi, min(px) AS lo, round(avg(px), 8) AS avg_px, CAST(sum(qty) AS BIGINT) AS vol, count(*) AS n"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 8) for c in columns})


def _hours(kind: str, more: str = "") -> str:
    return f"""WITH {kind} SELECT symbol, ts // {HOUR} * {HOUR} AS window_start, ts // {HOUR} * {HOUR} + {HOUR} AS window_end, {BAR_SQL}
        FROM {'late' if 'late AS' in kind else 'tape'} {more} GROUP BY ALL"""


@query(_hours(TAPE))
def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.aggregate(tape(spark, sf_dir), W.tumble(HOUR), ["symbol"], BARS), "avg_px")


@query(_hours(LATE, f"WHERE wm IS NULL OR ts // {HOUR} * {HOUR} + {HOUR} > wm"))
def candles_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.aggregate(late_tape(spark, sf_dir), W.tumble(HOUR), ["symbol"], BARS), "avg_px")


@query(_hours(LATE, f"WHERE wm IS NULL OR ts // {HOUR} * {HOUR} + {HOUR} + 5400000 > wm"))
def candles_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ninety minutes of allowed lateness recover some of the late rows."""
    return _rounded(W.aggregate(late_tape(spark, sf_dir), W.tumble(HOUR), ["symbol"], BARS, lateness_ms=5_400_000), "avg_px")


HOPS = f"""hops AS (SELECT symbol, w AS window_start, w + 6 * {HOUR} AS window_end, {BAR_SQL}
    FROM (SELECT *, unnest(range(ts // {HOUR} * {HOUR} - 5 * {HOUR}, ts // {HOUR} * {HOUR} + 1, {HOUR})) AS w FROM tape) GROUP BY ALL)"""


@query(f"WITH {TAPE}, {HOPS} SELECT * FROM hops")
def hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.aggregate(tape(spark, sf_dir), W.hop(6 * HOUR, HOUR), ["symbol"], BARS), "avg_px")


@query(f"WITH {TAPE}, {HOPS} SELECT window_start AS wstart, symbol, vol FROM hops QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY vol DESC, symbol) <= 3")
def volume_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = W.aggregate(tape(spark, sf_dir), W.hop(6 * HOUR, HOUR), ["symbol"], [W.Agg("vol", "sum", "qty")])
    return analytics.top_n(hops.select(F.col("window_start").alias("wstart"), "symbol", "vol"), ["wstart"], [F.desc("vol"), F.asc("symbol")], 3)


@query(f"WITH {TAPE} SELECT symbol, ts // {HOUR} * {HOUR} AS window_start, round(sum(px), 4) AS total_px FROM tape GROUP BY ALL")
def sum_of_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = W.aggregate(tape(spark, sf_dir), W.tumble(HOUR), ["symbol"], [W.Agg("total_px", "sum", "px")])
    return sums.select("symbol", "window_start", F.round("total_px", 4).alias("total_px"))


@query(f"WITH {TAPE}, {HOPS} SELECT window_start, min_by(symbol, (-vol, symbol)) AS symbol, max(vol) AS vol FROM hops GROUP BY 1")
def window_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = W.aggregate(tape(spark, sf_dir), W.hop(6 * HOUR, HOUR), ["symbol"], [W.Agg("vol", "sum", "qty")])
    return analytics.window_leader(hops, "window_start", "symbol", "vol")


def _board(source: str, where: str = "") -> str:
    block = 12 * HOUR
    return f"""SELECT symbol, ts // {block} * {block} AS window_start, w AS window_end, CAST(sum(qty) AS BIGINT) AS vol, count(*) AS n
        FROM (SELECT *, unnest(range(ts // {2 * HOUR} * {2 * HOUR} + {2 * HOUR}, ts // {block} * {block} + {block} + 1, {2 * HOUR})) AS w FROM {source}) {where} GROUP BY ALL"""


COUNTS = [W.Agg("vol", "sum", "qty"), W.Agg("n", "count")]


@query(f"WITH {TAPE} {_board('tape')}")
def cumulate_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.aggregate(tape(spark, sf_dir), W.cumulate(2 * HOUR, 12 * HOUR), ["symbol"], COUNTS)


@query(f"WITH {LATE} {_board('late', 'WHERE wm IS NULL OR w > wm')}")
def cumulate_board_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows are lost to closed windows only, and count in the later ones."""
    return W.aggregate(late_tape(spark, sf_dir), W.cumulate(2 * HOUR, 12 * HOUR), ["symbol"], COUNTS)


SESSIONS = f"""marks AS (SELECT *, CASE WHEN ts - lag(ts) OVER o <= {30 * MINUTE} THEN 0 ELSE 1 END AS opens FROM tape WINDOW o AS (PARTITION BY user_id ORDER BY ts, trade_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING) AS s FROM marks),
    sessions AS (SELECT user_id, min(ts) AS window_start, max(ts) + {30 * MINUTE} AS window_end, count(*) AS n, CAST(sum(qty) AS BIGINT) AS vol FROM numbered GROUP BY user_id, s)"""


@query(f"WITH {TAPE}, {SESSIONS} SELECT * FROM sessions")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.aggregate(tape(spark, sf_dir), W.session(30 * MINUTE), ["user_id"], COUNTS).select("user_id", "window_start", "window_end", "n", "vol")


@query(f"WITH {TAPE}, {SESSIONS} SELECT user_id, max(window_end - window_start) AS longest_ms FROM sessions GROUP BY 1")
def max_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).groupBy("user_id").agg(F.max(F.col("window_end") - F.col("window_start")).alias("longest_ms"))


STATS = """SELECT trade_id, ts, symbol, px, count(px) OVER o AS n_so_far, round(avg(px) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS ma100,
    lag(px, 1) OVER o AS prev_px FROM {} WINDOW o AS (PARTITION BY symbol ORDER BY ts, trade_id)"""


@query(f"WITH {TAPE} {STATS.format('tape')}")
def running_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).select("trade_id", "ts", "symbol", "px")
    return _rounded(analytics.running_stats(rows, "symbol", "ts", "trade_id", "px"), "ma100")


@query(f"WITH {TAPE} {STATS.format('tape')}")
def running_stats_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan for hot keys: no window holds a whole key."""
    rows = tape(spark, sf_dir).select("trade_id", "ts", "symbol", "px")
    return _rounded(analytics.running_stats_in_blocks(rows, "symbol", "ts", "trade_id", "px", span=6 * HOUR, block=10_000), "ma100")


@query(f"WITH {LATE} {STATS.format('(SELECT * FROM late WHERE wm IS NULL OR ts > wm)')}")
def running_stats_punctual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = late_tape(spark, sf_dir).where(row_on_time()).select("trade_id", "ts", "symbol", "px")
    return _rounded(analytics.running_stats(rows, "symbol", "ts", "trade_id", "px"), "ma100")


JOIN = f"""SELECT t.user_id, t.ts AS t_ts, t.trade_id AS t_trade_id, q.trade_id AS q_trade_id, t.px AS t_px, q.px AS q_px, round(q.px - t.px, 6) AS spread_abs
    FROM tape t JOIN tape q ON t.user_id = q.user_id AND t.ts BETWEEN q.ts + 0 AND q.ts + {6 * HOUR} WHERE t.symbol = 'purchase' AND q.symbol = 'view'"""


def _pairs(spark: SparkSession, sf_dir: str, bucketed: bool) -> DataFrame:
    rows = tape(spark, sf_dir).select("user_id", "ts", "trade_id", "px", "symbol")
    side = lambda kind: rows.where(F.col("symbol") == kind).drop("symbol")
    out = joins.interval_join(side("purchase"), side("view"), "user_id", 6 * HOUR, names=("t", "q"), bucketed=bucketed)
    return out.select(F.col("t_user_id").alias("user_id"), "t_ts", "t_trade_id", "q_trade_id", "t_px", "q_px", F.round(F.col("q_px") - F.col("t_px"), 6).alias("spread_abs"))


@query(f"WITH {TAPE} {JOIN}")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, False)


@query(f"WITH {TAPE} {JOIN}")
def interval_join_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, True)


@query(f"""WITH {TAPE} SELECT symbol, round(avg(abs(px - 50) / 50) FILTER (WHERE ts >= 1705000000000 AND ts < 1705600000000), 8) AS inside,
    round(avg(abs(px - 50) / 50) FILTER (WHERE NOT (ts >= 1705000000000 AND ts < 1705600000000)), 8) AS outside FROM tape GROUP BY 1""")
def spread_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of a relative deviation inside and outside of a span of time."""
    rows = tape(spark, sf_dir)
    inside = (F.col("ts") >= 1_705_000_000_000) & (F.col("ts") < 1_705_600_000_000)
    far = relative_deviation("px", F.lit(50.0))
    return _rounded(rows.groupBy("symbol").agg(F.avg(F.when(inside, far)).alias("inside"), F.avg(F.when(~inside, far)).alias("outside")), "inside", "outside")


#: A dip of some bars, perhaps a pause, and a rise after it.
PATTERN = "top dip{2,6} pause? rise{1,6}"
DEFINE = {"rise": "avg_px / PREV(avg_px) > 1.02", "dip": "avg_px / PREV(avg_px) < 0.98", "pause": "abs(avg_px / PREV(avg_px) - 1) < 0.02"}
MEASURES = "FIRST(dip.avg_px) AS px_began, LAST(dip.avg_px) AS px_lowest, LAST(rise.avg_px) AS px_ended, FIRST(dip.window_start) AS began, LAST(dip.window_start) AS lowest, LAST(rise.window_start) AS ended"


@query(f"""WITH RECURSIVE {TAPE}, bars AS (SELECT symbol, ts // {6 * HOUR} * {6 * HOUR} AS window_start, round(avg(px), 8) AS avg_px FROM tape GROUP BY ALL),
    steps AS (SELECT *, row_number() OVER o AS i, avg_px / lag(avg_px) OVER o AS r FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY window_start)),
    labels AS (SELECT *, CASE WHEN r < 0.98 THEN 'd' WHEN abs(r - 1) < 0.02 THEN 't' WHEN r > 1.02 THEN 'u' ELSE 'o' END AS c FROM steps),
    texts AS (SELECT symbol, string_agg(c, '' ORDER BY i) AS s FROM labels GROUP BY symbol),
    found AS (SELECT symbol, s, 0 AS before, '' AS gap, '' AS hit, 0 AS k FROM texts UNION ALL
        SELECT symbol, s[length(gap) + length(hit) + 1:], before + length(gap) + length(hit), g, m, k + 1 FROM (
            SELECT symbol, s, before, gap, hit, k, regexp_extract(s[length(gap) + length(hit) + 1:], '^(.*?)(.d{{2,6}}t?u{{1,6}})', 1) AS g, regexp_extract(s[length(gap) + length(hit) + 1:], '^(.*?)(.d{{2,6}}t?u{{1,6}})', 2) AS m FROM found) WHERE m <> ''),
    spans AS (SELECT symbol, before + length(gap) + 2 AS d1, before + length(gap) + 1 + length(regexp_extract(hit, '^.(d+)', 1)) AS d2, before + length(gap) + length(hit) AS u2 FROM found WHERE k > 0)
    SELECT symbol, a.window_start AS began, b.window_start AS lowest, c.window_start AS ended, a.avg_px AS px_began, b.avg_px AS px_lowest, c.avg_px AS px_ended
    FROM spans JOIN steps a USING (symbol) JOIN steps b USING (symbol) JOIN steps c USING (symbol) WHERE a.i = d1 AND b.i = d2 AND c.i = u2""")
def reversal_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = W.aggregate(tape(spark, sf_dir), W.tumble(6 * HOUR), ["symbol"], [W.Agg("avg_px", "avg", "px")])
    return match.match_recognize(_rounded(bars, "avg_px"), ["symbol"], "window_start", match.measures_of(MEASURES), PATTERN, DEFINE)


@query(f"""WITH RECURSIVE {TAPE}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival, trade_id) AS i FROM tape),
    f AS (SELECT symbol, i, ts, px, trade_id, CAST(NULL AS DOUBLE) AS before, px AS ewma, 1 AS seen, false AS alert FROM n WHERE i = 1 UNION ALL
        SELECT n.symbol, n.i, n.ts, n.px, n.trade_id, f.ewma,
            CASE WHEN f.seen >= 12 AND abs(n.px - f.ewma) / f.ewma > 1.5 THEN f.ewma ELSE 0.95 * f.ewma + 0.05 * n.px END,
            f.seen + CASE WHEN f.seen >= 12 AND abs(n.px - f.ewma) / f.ewma > 1.5 THEN 0 ELSE 1 END, f.seen >= 12 AND abs(n.px - f.ewma) / f.ewma > 1.5
        FROM f JOIN n ON n.symbol = f.symbol AND n.i = f.i + 1)
    SELECT ts, symbol, px, round(before, 8) AS ewma, round(abs(px - before) / before, 8) AS deviation, trade_id FROM f WHERE alert""")
def spike_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    ordered = rows.withColumn("arrival_seq", F.struct("arrival", "trade_id"))
    return _rounded(detect.spike_alerts(ordered, threshold=1.5), "ewma", "deviation")


@query(f"WITH {TAPE} SELECT user_id, CAST(sum(qty) AS BIGINT) AS vol, count(*) AS n FROM tape GROUP BY 1")
def user_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).groupBy("user_id").agg(F.sum("qty").alias("vol"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat JSON decoded by a declared schema, beside its row's id."""
    utc(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.concat(F.lit('{"event_id":'), "event_id", F.lit(","), F.substring("props", F.lit(2), F.length("props"))).alias("value"))
    return decode(lines, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())]))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","value":' || printf('%.6f', value) || '}' AS line FROM events""")
def json_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", render_fixed(["value"], ["event_id", "event_type"], ["event_id", "event_type", "value"]).alias("line"))


@query(f"WITH {TAPE} SELECT symbol, ts // {HOUR} * {HOUR} AS window_start, CAST(sum(qty) AS BIGINT) AS vol FROM tape GROUP BY ALL ORDER BY vol DESC, symbol, window_start LIMIT 5")
def top_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = W.aggregate(tape(spark, sf_dir), W.tumble(HOUR), ["symbol"], [W.Agg("vol", "sum", "qty")])
    return analytics.top_rows(bars.select("symbol", "window_start", "vol"), [F.desc("vol"), F.asc("symbol"), F.asc("window_start")], 5)


@query(f"WITH {TAPE} SELECT ts % 60000 AS into_minute, ts - ts % 60000 AS minute, trade_id FROM tape WHERE px <= 10 AND qty > 100")
def floor_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).where("px <= 10 AND qty > 100")
    return rows.select((F.col("ts") % 60_000).alias("into_minute"), floor_to("ts", MINUTE).alias("minute"), "trade_id")


@query(f"""WITH {TAPE} SELECT symbol, ts // {HOUR} * {HOUR} AS window_start, min_by(px, (ts, trade_id)) AS open, max_by(px, (ts, trade_id)) AS close FROM tape GROUP BY ALL""")
def open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("ts", "trade_id")
    return tape(spark, sf_dir).groupBy("symbol", floor_to("ts", HOUR).alias("window_start")).agg(F.min_by("px", order).alias("open"), F.max_by("px", order).alias("close"))


from . import live, scripts  # noqa: E402, F401  the queries that run as streams or scripts
