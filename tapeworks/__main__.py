"""Command line: python -m tapeworks COMMAND

    tape --out DIR [--seed N --minutes N --symbols N --scale X --stragglers N]
    run FILE | run -e SQL [--stream] [--checkpoint-dir DIR] [--interval-ms N] [--parallelism N] [--name NAME] [--progress]
    serve [--port N --host HOST]
    capture --in DIR --out DIR
    captured --dir DIR
    replay --dir DIR --operator MODULE:FUNCTION --out DIR [--mode M] [--verify EMITTED [--epoch N]]
    emit-test --dir DIR --emitted DIR --out DIR --operator MODULE:FUNCTION [--mode M]
    detect --in FILE --out DIR [--threshold X --warmup N]
    state-query --dir DIR --sql SQL [--id N --slot NAME ...]
    state-export --dir DIR --out DIR [--id N --slot NAME ...]
    check --tape DIR [--golden FILE --freeze]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tapeworks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    tape = sub.add_parser("tape")
    tape.add_argument("--out", required=True)
    for name, kind, default in (("seed", int, 42), ("minutes", int, 60), ("symbols", int, 12), ("scale", float, 1.0), ("stragglers", int, 25)):
        tape.add_argument(f"--{name}", type=kind, default=default)
    run = sub.add_parser("run")
    run.add_argument("file", nargs="?")
    run.add_argument("-e", dest="sql")
    run.add_argument("--stream", action="store_true")
    run.add_argument("--checkpoint-dir")
    run.add_argument("--interval-ms", type=int)
    run.add_argument("--parallelism", type=int)
    run.add_argument("--name", default="tapeworks")
    run.add_argument("--progress", action="store_true")
    serving = sub.add_parser("serve")
    serving.add_argument("--port", type=int, default=8210)
    serving.add_argument("--host", default="127.0.0.1")
    taken = sub.add_parser("capture")
    taken.add_argument("--in", dest="source", required=True)
    taken.add_argument("--out", required=True)
    sub.add_parser("captured").add_argument("--dir", required=True)
    for name in ("replay", "emit-test"):
        again = sub.add_parser(name)
        again.add_argument("--dir", required=True)
        again.add_argument("--out", required=True)
        again.add_argument("--operator", required=True)
        again.add_argument("--mode", default="append")
        again.add_argument("--verify" if name == "replay" else "--emitted", dest="emitted", required=name == "emit-test")
        if name == "replay":
            again.add_argument("--epoch", type=int)
    found = sub.add_parser("detect")
    found.add_argument("--in", dest="source", required=True)
    found.add_argument("--out", required=True)
    found.add_argument("--threshold", type=float, default=0.15)
    found.add_argument("--warmup", type=int, default=12)
    for name, needs in (("state-query", "--sql"), ("state-export", "--out")):
        s = sub.add_parser(name)
        s.add_argument("--dir", required=True)
        s.add_argument(needs, required=True)
        s.add_argument("--id", type=int)
        s.add_argument("--slot", action="append")
    check = sub.add_parser("check")
    check.add_argument("--tape", required=True)
    check.add_argument("--golden")
    check.add_argument("--freeze", action="store_true")
    return p


TRADE = T.StructType().add("ts", T.LongType()).add("symbol", T.StringType()).add("px", T.DoubleType()).add("qty", T.LongType()).add("trade_id", T.LongType())


def _recorder(a: argparse.Namespace, spark: SparkSession) -> int:
    """The flight recorder: 1 if a replay differs from what was emitted."""
    import importlib

    from .streaming import capture

    if a.command == "capture":
        schema = spark.read.parquet(a.source).schema
        capture.record(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(a.source), a.out)
        a.dir = a.out
    if a.command in ("capture", "captured"):
        for r in capture.listing(spark, a.dir).orderBy("epoch").collect():
            print(f"epoch {r.epoch}: {r.records} records")
        return 0
    module, _, name = a.operator.partition(":")
    operator = getattr(importlib.import_module(module), name)
    if a.command == "emit-test":
        capture.emit_test(spark, a.dir, a.emitted, a.out, module, name, a.mode)
        return 0
    schema = spark.read.parquet(f"{a.dir}/epoch=*").schema
    if not a.emitted:
        capture.run(spark, a.dir, schema, operator, a.out, f"{a.out}/_checkpoint", mode=a.mode)
        return 0
    same = capture.verify(spark, a.dir, schema, operator, a.emitted, a.epoch, a.mode)
    print("the replay is the same" if same else "the replay differs")
    return int(not same)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "detect" and not os.path.exists(a.source):
        print(f"no file {a.source}", file=sys.stderr)
        return 2
    from .session import build, utc

    spark = utc(spark) if spark else build(getattr(a, "name", "tapeworks"), parallelism=getattr(a, "parallelism", None))
    if a.command == "tape":
        from .tape import generate

        generate(spark, a.seed, a.minutes, a.symbols, a.scale, a.stragglers).write(a.out)
    elif a.command == "run":
        from .plans.engine import Engine

        with Engine(spark, a.stream, a.checkpoint_dir, a.interval_ms) as e:
            out = e.execute(a.sql) if a.sql else e.run_file(a.file)
            while a.progress and any(q.isActive for q in e.queries):
                time.sleep((a.interval_ms or 1_000) / 1_000)
                print(json.dumps(e.progress()))
            e.await_all()
            if a.progress:
                print(json.dumps(e.progress()))
            if out is not None:
                out.show(truncate=False)
    elif a.command == "detect":
        from .functions.records import decode, render_fixed
        from .operators.detect import spike_alerts
        from .sources.readers import BLOCK, FILE, ROW, placed, read_lines
        from .sources.writers import write_lines

        # A line's place in its file, and the file's among others, is its arrival.
        lines = placed(read_lines(spark, a.source))
        rows = decode(lines, TRADE, keep=[FILE, BLOCK, ROW]).withColumn("arrival_seq", F.struct(FILE, BLOCK, ROW))
        alerts = spike_alerts(rows, threshold=a.threshold, warmup=a.warmup).cache()
        order = ["ts", "symbol", "px", "ewma", "deviation", "trade_id"]
        rendered = alerts.select(render_fixed(["px", "ewma", "deviation"], ["ts", "symbol", "trade_id"], order).alias("value"))
        write_lines(rendered, a.out)
        n = 0
        for r in rendered.toLocalIterator():
            print("ALERT", r[0])
            n += 1
        print(f"{n} alerts")
    elif a.command == "serve":
        from .server import serve

        serve(spark, a.port, a.host).serve_forever()
    elif a.command in ("capture", "captured", "replay", "emit-test"):
        return _recorder(a, spark)
    elif a.command in ("state-query", "state-export"):
        from .streaming import state

        which = {"slots": a.slot, "batch_id": a.id}
        if a.command == "state-query":
            state.state_query(spark, a.dir, a.sql, **which).show(truncate=False)
        else:
            state.state_export(spark, a.dir, a.out, **which)
    else:
        from . import checks

        trades, quotes, manifest = checks.load(spark, a.tape)
        out = checks.scenes(trades, quotes)
        found = checks.problems(out, trades, manifest) + (checks.golden(out, a.golden, a.freeze) if a.golden else [])
        print("\n".join(found) or "all is well")
        return int(bool(found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
