"""The queries behind an HTTP service, on the standard library: ``POST /query``, ``GET /health``, ``GET /metrics``."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.api import MOST_HITS, Engine
from ledgerloom.operators import catalog, quantiles
from ledgerloom.streaming.streams import MOST, WINDOW_S, admit

SHORTEST, LONGEST = 3, 500


class BadRequest(ValueError):
    pass


def checked(body: dict) -> tuple[str, str, int]:
    """Question, mode and number of hits of a request, or an error that says what is wrong."""
    question, mode, k = body.get("question"), body.get("mode", "hybrid"), body.get("k", 10)
    if not isinstance(question, str) or not SHORTEST <= len(question.strip()) <= LONGEST:
        raise BadRequest(f"question must have {SHORTEST} to {LONGEST} characters")
    if mode not in ("vector", "text", "hybrid"):
        raise BadRequest("mode must be vector, text or hybrid")
    if not isinstance(k, int) or not 1 <= k <= MOST_HITS:
        raise BadRequest(f"k must be 1 to {MOST_HITS}")
    return question, mode, k


def metrics(runs: DataFrame) -> dict:
    """Count, share of refusals and latencies of the logged runs, 0 where there are none."""
    own = runs.where("latency_ms >= 0 and not isnan(latency_ms)").withColumn("all", F.lit(1))
    row = own.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("refused").cast("int")).alias("refused")).first()
    points = quantiles.continuous(own, ["all"], "latency_ms", {"p50": 50, "p95": 95}).first()
    return {
        "queries": row.n,
        "refusal_rate": round(row.refused or 0.0, 4),
        "p50_ms": round(points.p50, 1) if points else 0.0,
        "p95_ms": round(points.p95, 1) if points else 0.0,
    }


class Service:
    """One engine, a limiter for each client, and the runs to report on."""

    def __init__(self, spark: SparkSession, engine: Engine, runs: DataFrame, most: int = MOST, window: float = WINDOW_S, store: catalog.Store | None = None):
        """With a ``store``, every question is logged there and counts in the metrics; ``runs`` are those before."""
        self.spark, self.engine, self.runs, self.most, self.window, self.store = spark, engine, runs, most, window, store
        self.kept: dict[str, list[float]] = {}

    def handle(self, method: str, path: str, body: bytes, client: str, now: float | None = None) -> tuple[int, dict]:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok", "spark": self.spark.version}
        if (method, path) == ("GET", "/metrics"):
            logged = self.store.read("query_runs", catalog.RUNS) if self.store else None
            columns = ["refused", "latency_ms"]
            return 200, metrics(self.runs.select(columns) if logged is None else self.runs.select(columns).unionByName(logged.select(columns)))
        if (method, path) != ("POST", "/query"):
            return 404, {"error": "not found"}
        self.kept[client], allowed = admit(self.kept.get(client, []), time.monotonic() if now is None else now, self.most, self.window)
        if not allowed:
            return 429, {"error": "too many requests"}
        try:
            question, mode, k = checked(json.loads(body or b"{}"))
        except ValueError as e:
            return 422, {"error": str(e)}
        asked = self.spark.createDataFrame([(1, question)], "question_id long, query string")
        answers = self.engine.ask(asked, k, mode) if self.store is None else self.engine.ask_logged(self.store, asked, k, mode)
        row = answers.drop("question_id").first()
        return 200, row.asDict(recursive=True)


def serve(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, out = service.handle(self.command, self.path, body, self.client_address[0])
            data = json.dumps(out, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
