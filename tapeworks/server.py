"""Scripts submitted over HTTP, each a job with its own parallelism and name.

    POST /run?name=bars&parallelism=4&stream=1   body: a script; answers {"job": 0}
    GET  /jobs                                   every job, its state and progress
    POST /stop?job=0                             stops a job's streams

A job runs in a session of its own beside the others of this driver: tables and
settings are not shared, executors are. Only the local machine is listened to unless
another host is given; there is no login.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from .plans.engine import Engine
from .session import utc


class Job:
    def __init__(self, spark: SparkSession, number: int, name: str, script: str, parallelism: int | None, stream: bool) -> None:
        session = spark.newSession()
        if parallelism:
            session.conf.set("spark.sql.shuffle.partitions", str(parallelism))
        self.number, self.name, self.script, self.state, self.error = number, name, script, "running", None
        self.engine = Engine(utc(session), stream)
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        try:
            self.engine.execute(self.script)
            self.engine.await_all()
            self.state = "done"
        except Exception as e:
            self.state, self.error = "failed", str(e)[:2_000]

    def report(self) -> dict:
        return {"job": self.number, "name": self.name, "state": self.state, "error": self.error, "streams": self.engine.progress()}


class Jobs:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jobs, self.lock = spark, [], threading.Lock()

    def submit(self, script: str, name: str, parallelism: int | None, stream: bool) -> Job:
        with self.lock:
            job = Job(self.spark, len(self.jobs), name or f"job{len(self.jobs)}", script, parallelism, stream)
            self.jobs.append(job)
        job.thread.start()
        return job


def serve(spark: SparkSession, port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that answers once ``serve_forever`` is called."""
    jobs = Jobs(spark)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, code: int, what) -> None:
            body = json.dumps(what).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if urlsplit(self.path).path == "/jobs":
                self._answer(200, [j.report() for j in jobs.jobs])
            else:
                self._answer(404, {"error": "GET /jobs"})

        def do_POST(self) -> None:
            at, script = urlsplit(self.path), self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
            asked = {k: v[-1] for k, v in parse_qs(at.query).items()}
            try:
                if at.path == "/run":
                    job = jobs.submit(script, asked.get("name", ""), int(asked["parallelism"]) if "parallelism" in asked else None, asked.get("stream", "0") not in ("", "0"))
                    self._answer(200, {"job": job.number})
                elif at.path == "/stop":
                    for q in jobs.jobs[int(asked["job"])].engine.queries:
                        q.stop()
                    self._answer(200, {"job": int(asked["job"])})
                else:
                    self._answer(404, {"error": "POST /run or /stop"})
            except (KeyError, ValueError, IndexError) as e:
                self._answer(400, {"error": f"{type(e).__name__}: {e}"})

        def log_message(self, *_) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    server.jobs = jobs  # type: ignore[attr-defined]
    return server
