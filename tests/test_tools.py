"""The command line and the checker, over a small written tape."""

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tapeworks import checks
from tapeworks.__main__ import main


def test_check_and_goldens(spark, tape_dir, tmp_path, capsys):
    golden = str(tmp_path / "golden.json")
    assert main(["check", "--tape", tape_dir, "--golden", golden, "--freeze"], spark) == 0
    figures = json.loads((tmp_path / "golden.json").read_text())
    assert (figures["bars"], figures["leaders"], figures["board"], figures["reversals"], figures["alerts"]) == (720, 192, 72, 1, 1)
    assert figures["bars_grace_trades"] - figures["bars_trades"] == 25
    figures["bars"] = 1
    (tmp_path / "golden.json").write_text(json.dumps(figures))
    trades, quotes, manifest = checks.load(spark, tape_dir)
    out = checks.scenes(trades, quotes)
    assert checks.golden(out, golden) == ["bars: 1 was frozen, now 720"]
    manifest["counts"]["trades"] += 1
    assert len(checks.problems(out, trades, manifest)) == 2


def test_detect_and_run(spark, tape, tape_dir, tmp_path, capsys):
    assert main(["detect", "--in", "/nowhere", "--out", str(tmp_path / "x")], spark) == 2
    assert main(["detect", "--in", f"{tape_dir}/trades.ndjson", "--out", str(tmp_path / "alerts")], spark) == 0
    said = capsys.readouterr().out
    assert "1 alerts" in said and str(tape.manifest["incidents"]["wrong_print"]["trade_id"]) in said
    (line,) = spark.read.text(str(tmp_path / "alerts")).collect()
    assert json.loads(line[0])["deviation"] > 6
    assert main(["tape", "--out", str(tmp_path / "t"), "--minutes", "1", "--scale", "0.05"], spark) == 0
    sql = f"CREATE TABLE trades (symbol VARCHAR) WITH (connector='file', format='json', path='{tmp_path}/t/trades.ndjson'); SELECT COUNT(*) AS n FROM trades"
    assert main(["run", "-e", sql], spark) == 0
    (tmp_path / "s.sql").write_text(sql)
    assert main(["run", str(tmp_path / "s.sql")], spark) == 0


def totals(stream):
    return stream.groupBy("symbol").agg(F.count("*").alias("n"))


def test_recorder(spark, trades, tmp_path, capsys):
    from tapeworks.streaming import feed

    n = feed.chunked(trades.where("symbol = 'TKAZ'"), "arrival_ms", 1_200_000, str(tmp_path / "in"))
    assert main(["capture", "--in", f"{tmp_path}/in/part=*", "--out", str(tmp_path / "taken")], spark) == 0
    assert main(["captured", "--dir", str(tmp_path / "taken")], spark) == 0
    assert capsys.readouterr().out.count("records") == 2 * n
    own = ["--dir", str(tmp_path / "taken"), "--operator", "tests.test_tools:totals", "--mode", "complete"]
    assert main(["replay", *own, "--out", str(tmp_path / "emitted")], spark) == 0
    assert main(["replay", *own, "--out", str(tmp_path / "x"), "--verify", str(tmp_path / "emitted")], spark) == 0
    assert main(["replay", *own, "--out", str(tmp_path / "x"), "--verify", str(tmp_path / "emitted"), "--epoch", "0"], spark) == 0
    spark.read.parquet(str(tmp_path / "emitted/epoch=000000")).withColumn("n", F.col("n") + 1).write.parquet(str(tmp_path / "other/epoch=000000"))
    assert main(["replay", *own, "--out", str(tmp_path / "x"), "--verify", str(tmp_path / "other"), "--epoch", "0"], spark) == 1
    assert main(["emit-test", *own, "--emitted", str(tmp_path / "emitted"), "--out", str(tmp_path / "bundle")], spark) == 0
    assert json.loads((tmp_path / "bundle/bundle.json").read_text())["operator"] == "totals"


def test_progress_and_interval(spark, trades, tmp_path, capsys):
    from tapeworks.streaming import feed

    feed.chunked(trades.where("symbol = 'TKAZ'"), "arrival_ms", 1_200_000, str(tmp_path / "in"))
    sql = f"CREATE TABLE deals (symbol VARCHAR, qty BIGINT) WITH (connector='file', format='parquet', path='{tmp_path}/in/part=*'); CREATE TABLE out (symbol VARCHAR, qty BIGINT) WITH (connector='file', format='json', path='{tmp_path}/out'); INSERT INTO out SELECT symbol, qty FROM deals"
    assert main(["run", "-e", sql, "--stream", "--progress", "--checkpoint-dir", str(tmp_path / "ck")], spark) == 0
    (last,) = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert last["name"] == "out" and last["rows"] == trades.where("symbol = 'TKAZ'").count() and not last["active"]
    from tapeworks.plans.engine import Engine

    with Engine(spark, stream=True, checkpoints=str(tmp_path / "ck2"), interval_ms=200) as e:
        e.execute(sql.replace("/out'", "/more'"))
        e.queries[0].processAllAvailable()
        assert e.queries[0].isActive and spark.read.json(f"{tmp_path}/more").count() == last["rows"]


def test_jobs_over_http(spark, tape_dir, tmp_path):
    from tapeworks.server import serve

    server = serve(spark, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = lambda path, data=None: json.loads(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}", data).read())
    script = f"CREATE TABLE deals (symbol VARCHAR) WITH (connector='file', format='json', path='{tape_dir}/trades.ndjson'); CREATE TABLE n (symbol VARCHAR, n BIGINT) WITH (connector='file', format='json', path='{tmp_path}/n'); INSERT INTO n SELECT symbol, COUNT(*) AS n FROM deals GROUP BY symbol"
    assert ask("/run?name=counts&parallelism=3", script.encode()) == {"job": 0}
    assert ask("/run", b"DROP TABLE nothing") == {"job": 1}
    for job in server.jobs.jobs:
        job.thread.join(60)
    first, second = ask("/jobs")
    assert (first["name"], first["state"], second["state"]) == ("counts", "done", "failed"), first["error"]
    assert "nothing" in second["error"]
    assert spark.read.json(f"{tmp_path}/n").count() == 12 and server.jobs.jobs[0].engine.spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert ask("/stop?job=0", b"") == {"job": 0}
    with pytest.raises(urllib.error.HTTPError):
        ask("/stop?job=9", b"")
    server.shutdown()
