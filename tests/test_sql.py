"""Scripts of the SQL front end over the tape, against the DataFrame operators."""

import json

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import analytics, joins
from tapeworks.operators import windows as W
from tapeworks.plans import ddl, rewrite
from tapeworks.plans.engine import Engine

HALF = 30_000


def deals(folder, *options):
    """A declaration of the tape's trades; columns in another order than the file's."""
    more = "".join(f", {o}" for o in options)
    return f"CREATE TABLE deals (trade_id BIGINT, symbol VARCHAR, px DOUBLE, qty BIGINT, ts BIGINT) WITH (connector='file', format='json', path='{folder}/trades.ndjson'{more});\n"


TIMED = ("event_time_column='ts'", "watermark_lag_ms='3000'")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_statements_and_comments():
    assert ddl.statements("-- x;y\nDROP TABLE old; SELECT 'a;b' ; \n") == ["DROP TABLE old", "SELECT 'a;b'"]
    with pytest.raises(ValueError):
        ddl.parse("CREATE TABLE t (a BIGINT) WITH (colour='1')")
    assert ddl.sources("SELECT n, SUM(x) AS total FROM a, b JOIN (SELECT n FROM c AS d WHERE e > 1) AS f ON n = m GROUP BY g, h") == {"a", "b", "c", "("}
    declared = ddl.parse("""CREATE TABLE push (kind VARCHAR, "When" BIGINT) WITH (connector='websocket', url='wss://h', event_time_column='When')""").table
    assert declared.schema.names == ["kind", "When"] and declared.event_time == "When"


def test_inserted_strips_with_and_without_lateness(spark, tape, tape_dir, tmp_path):
    found = {}
    for wait in (0, 90_000):
        with Engine(spark) as e:
            e.execute(deals(tape_dir, *TIMED, f"allowed_lateness_ms='{wait}'") + f"""
                CREATE TABLE strip (sym VARCHAR, opened BIGINT, low DOUBLE, high DOUBLE, middle DOUBLE, pieces BIGINT, deals BIGINT) WITH (connector='file', format='json', path='{tmp_path}/strip');
                INSERT INTO strip SELECT COUNT(*) AS deals, symbol AS sym, SUM(qty) AS pieces, window_start AS opened, AVG(px) AS middle, MIN(px) AS low, MAX(px) AS high
                FROM deals GROUP BY symbol, TUMBLE(ts, INTERVAL '30' SECOND)""")
            strip = e.table("strip")
            assert strip.where(f"opened % {HALF} <> 0 OR NOT middle BETWEEN low AND high").isEmpty()
            found[wait] = strip.agg(F.sum("deals")).first()[0]
    assert found[90_000] == tape.manifest["counts"]["trades"] == found[0] + 25


def test_a_pattern_over_what_another_script_wrote(spark, tape, tape_dir, tmp_path):
    """The bars have event time, and are read from several files."""
    with Engine(spark) as e:
        e.execute(deals(tape_dir) + f"""
            CREATE TABLE minutes (starts BIGINT, sym VARCHAR, mean DOUBLE) WITH (connector='file', format='json', path='{tmp_path}/minutes', event_time_column='starts');
            INSERT INTO minutes SELECT window_start AS starts, symbol AS sym, AVG(px) AS mean FROM deals GROUP BY TUMBLE(ts, INTERVAL '1' MINUTE), symbol ORDER BY starts""")
        assert e.table("minutes").count() == 720
        e.execute("""CREATE TABLE valleys (sym VARCHAR, foot BIGINT, rim BIGINT, depth DOUBLE) WITH (connector='collect');
            INSERT INTO valleys SELECT * FROM minutes MATCH_RECOGNIZE (PARTITION BY sym ORDER BY starts
              MEASURES LAST(slide.starts) AS foot, LAST(climb.starts) AS rim, LAST(slide.mean) AS depth
              PATTERN (edge slide{4,7} rest? climb{3,})
              DEFINE climb AS mean > 1.004 * PREV(mean), slide AS mean < 0.996 * PREV(mean), rest AS mean BETWEEN 0.996 * PREV(mean) AND 1.004 * PREV(mean))""")
        (only,) = e.collect("valleys").to_pylist()
    fall = tape.manifest["incidents"]["fall"]
    assert only["sym"] == fall["symbol"] and abs(only["foot"] - fall["turn_ts"]) <= 120_000 < only["rim"] - only["foot"]


def test_ranked_hops_into_a_keyed_table(spark, trades, tape_dir, tmp_path):
    with Engine(spark) as e:
        e.execute(deals(tape_dir) + f"""
            CREATE TABLE busiest (opened BIGINT, sym VARCHAR, pieces BIGINT) WITH (connector='file', format='parquet', mode='upsert', primary_key='opened,sym', path='{tmp_path}/busiest');
            INSERT INTO busiest SELECT opened, sym, pieces FROM (SELECT b.*, RANK() OVER (PARTITION BY b.opened ORDER BY b.pieces DESC, b.sym) AS place FROM
                (SELECT symbol AS sym, window_start AS opened, SUM(qty) AS pieces FROM deals GROUP BY symbol, HOP(ts, INTERVAL '10' MINUTE, INTERVAL '2' MINUTE)) AS b) AS ranked WHERE place < 3""")
        hops = W.aggregate(trades, W.hop(600_000, 120_000), ["symbol"], [W.Agg("pieces", "sum", "qty")])
        want = analytics.top_n(hops, ["window_start"], [F.desc("pieces"), F.asc("symbol")], 2)
        assert rows(e.table("busiest"), "opened", "sym", "pieces") == rows(want, "window_start", "symbol", "pieces")


def test_panes(spark, trades, tape_dir):
    """Hopping and cumulative windows are added up from panes, with the same result."""
    aggs = [W.Agg("hi", "max", "px"), W.Agg("mean", "avg", "px"), W.Agg("n", "count")]
    picked = "SELECT window_end, MAX(px) AS hi, AVG(px) AS mean, COUNT(*) AS n, symbol, window_start FROM deals WHERE qty > 20 GROUP BY"
    with Engine(spark) as e:
        e.execute(deals(tape_dir))
        for call, win in (("HOP(ts, INTERVAL '3' MINUTE, INTERVAL '1' MINUTE)", W.hop(180_000, 60_000)), ("CUMULATE(ts, INTERVAL '5' MINUTE, INTERVAL '20' MINUTE)", W.cumulate(300_000, 1_200_000))):
            sql = f"{picked} {call}, symbol HAVING COUNT(*) > 3"
            assert "__pane" in rewrite.spark_sql(sql, e._late, e._streams, e._columns)
            want = W.aggregate(trades.where("qty > 20"), win, ["symbol"], aggs).where("n > 3")
            columns = ("symbol", "window_start", "window_end", "hi", "n")
            got = e.query(sql)
            assert rows(got, *columns) == rows(want, *columns)
            assert got.agg(F.sum("mean")).first()[0] == pytest.approx(want.agg(F.sum("mean")).first()[0])
        for sql in (f"{picked} HOP(ts, INTERVAL '3' MINUTE, INTERVAL '2' MINUTE), symbol", "SELECT symbol, COUNT(DISTINCT qty) AS n FROM deals GROUP BY HOP(ts, INTERVAL '2' MINUTE, INTERVAL '1' MINUTE), symbol",
                    "SELECT symbol, MAX(ts - window_start) AS n FROM deals GROUP BY HOP(ts, INTERVAL '2' MINUTE, INTERVAL '1' MINUTE), symbol"):
            assert "__pane" not in rewrite.spark_sql(sql, e._late, e._streams, e._columns) and e.query(sql).count() > 0


def test_joins_boards_statistics_and_sessions(spark, tape, tape_dir, trades, quotes):
    with Engine(spark) as e:
        e.execute(deals(tape_dir, *TIMED) + f"""
            CREATE TABLE offers (symbol VARCHAR, ask DOUBLE, bid DOUBLE, ts BIGINT) WITH (connector='file', format='json', path='{tape_dir}/quotes.ndjson');
            CREATE TABLE near (trade_id BIGINT, cost DOUBLE) WITH (connector='collect');
            INSERT INTO near SELECT d_trade_id AS trade_id, o_ask - d_px AS cost FROM deals AS d JOIN offers AS o ON d.ts BETWEEN o.ts + 0 AND o.ts + 250 AND o.symbol = d.symbol;
            CREATE TABLE board (sym VARCHAR, since BIGINT, until BIGINT, pieces BIGINT) WITH (connector='collect');
            INSERT INTO board SELECT symbol AS sym, window_start AS since, window_end AS until, SUM(qty) AS pieces FROM deals GROUP BY CUMULATE(ts, INTERVAL '15' MINUTE, INTERVAL '1' HOUR), symbol;
            CREATE TABLE so_far (trade_id BIGINT, place BIGINT, recent DOUBLE, earlier DOUBLE) WITH (connector='collect');
            INSERT INTO so_far SELECT trade_id, COUNT(qty) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS place, AVG(px) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS recent,
              LAG(px, 1) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS earlier FROM deals;
            CREATE TABLE runs (sym VARCHAR, began BIGINT, ended BIGINT, deals BIGINT) WITH (connector='collect');
            INSERT INTO runs SELECT window_end AS ended, symbol AS sym, window_start AS began, COUNT(*) AS deals FROM deals GROUP BY SESSION(ts, INTERVAL '3' SECOND), symbol;
            CREATE TABLE void (symbol VARCHAR) WITH (connector='blackhole');
            INSERT INTO void SELECT symbol FROM deals""")
        assert e.collect("near").num_rows == joins.interval_join(trades, quotes, "symbol", 250).count()
        assert e.collect("board").num_rows == 12 * 4
        assert e.collect("so_far").num_rows == tape.manifest["counts"]["trades"] - 25
        assert e.collect("runs").num_rows == W.aggregate(trades, W.session(3_000), ["symbol"], [W.Agg("n", "count")]).count()
        whole = {r["sym"]: r["pieces"] for r in e.collect("board").to_pylist() if r["until"] - r["since"] == 3_600_000}
        assert whole == {r["symbol"]: r["v"] for r in trades.groupBy("symbol").agg(F.sum("qty").alias("v")).collect()}


def test_dropped_and_missing_tables(spark, tape_dir):
    with Engine(spark) as e:
        e.execute(deals(tape_dir))
        with pytest.raises(ValueError):
            e.execute("DROP TABLE nothing")
        e.execute("DROP TABLE IF EXISTS nothing; DROP TABLE deals")
        for sql in ("INSERT INTO deals SELECT 1 AS trade_id", "ALTER TABLE deals"):
            with pytest.raises(ValueError):
                e.execute(sql)


def test_casts_of_dirty_values_give_null(spark, tmp_path):
    (tmp_path / "d.json").write_text("".join(json.dumps({"v": v}) + "\n" for v in ("1.5", "oops", "", None)))
    with Engine(spark) as e:
        out = e.execute(f"CREATE TABLE d (v VARCHAR) WITH (connector='file', format='json', path='{tmp_path}/d.json'); SELECT CAST(v AS DOUBLE) AS x, CAST(cast(v AS double) AS VARCHAR) AS y FROM d")
        assert [tuple(r) for r in out.collect()] == [(1.5, "1.5"), (None, None), (None, None), (None, None)]


def test_streaming_script(spark, trades, tmp_path):
    from tapeworks import tape as T
    from tapeworks.streaming import feed

    some = trades.where("symbol IN ('TKAZ', 'TKCX')")
    marker = T.end_markers(spark, 60, 4).withColumn("arrival_ms", F.col("ts")).withColumn("arrival_seq", F.lit(10**9).cast("long"))
    feed.chunked(some, "arrival_ms", 600_000, str(tmp_path / "in"), marker)
    with Engine(spark, stream=True, checkpoints=str(tmp_path / "ck")) as e:
        e.execute(f"""CREATE TABLE deals (qty BIGINT, ts BIGINT, symbol VARCHAR) WITH (connector='file', format='parquet', path='{tmp_path}/in/part=*', event_time_column='ts', watermark_lag_ms='3000', allowed_lateness_ms='60000');
            CREATE TABLE strip (opened BIGINT, sym VARCHAR, deals BIGINT) WITH (connector='file', format='json', path='{tmp_path}/strip');
            INSERT INTO strip SELECT COUNT(*) AS deals, window_start AS opened, symbol AS sym FROM deals GROUP BY TUMBLE(ts, INTERVAL '2' MINUTE), symbol""")
        e.await_all()
        assert {p["rows"] > 0 for p in e.progress()} == {True}
    got = spark.read.json(f"{tmp_path}/strip")
    assert got.count() == 60 and got.agg(F.sum("deals")).first()[0] == some.count()
