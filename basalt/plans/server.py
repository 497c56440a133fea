"""A small HTTP front: POST /v1/query, GET /health and /metrics.

For a notebook or a smoke test; in production Spark Connect or the Thrift server stand in
its place. A result is cut at ``max_rows``, which the answer says.
"""

from __future__ import annotations

import hmac
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from basalt.plans.dialect import DialectError
from basalt.plans.engine import Engine


class QueryServer:
    """Serves an engine. ``token``: if given, requests must bear it exactly."""

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 0, token: str | None = None, max_rows: int = 1000) -> None:
        self.engine, self.token, self.max_rows = engine, token, max_rows
        self.counts = {"queries": 0, "failures": 0, "milliseconds": 0.0}
        self._lock = threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None:
                pass

            def answer(self, status: int, body: dict) -> None:
                data = json.dumps(body, default=str).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def allowed(self) -> bool:
                given = self.headers.get("Authorization", "")
                if outer.token is None or hmac.compare_digest(given.encode(), f"Bearer {outer.token}".encode()):
                    return True
                self.answer(401, {"error": "a bearer token is needed"})
                return False

            def do_GET(self) -> None:
                if self.path == "/health":
                    self.answer(200, {"status": "ok"})
                elif self.path == "/metrics":
                    if self.allowed():
                        self.answer(200, dict(outer.counts))
                else:
                    self.answer(404, {"error": "no such path"})

            def do_POST(self) -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if self.path != "/v1/query":
                    self.answer(404, {"error": "no such path"})
                elif self.allowed():
                    self.answer(*outer.query(body))

        self._http = ThreadingHTTPServer((host, port), Handler)
        self.port = self._http.server_address[1]

    def query(self, body: bytes) -> tuple[int, dict]:
        try:
            asked = json.loads(body)
            text, strict, workers = asked["sql"], bool(asked.get("strict", False)), asked.get("workers")
            if not isinstance(text, str) or (workers is not None and (not isinstance(workers, int) or workers < 1)):
                raise ValueError("sql is a text, workers a number from 1")
        except (ValueError, KeyError, TypeError) as why:
            return 400, {"error": f"not a query: {why}"}
        began = time.perf_counter()
        try:
            frame = self.engine.sql(text, strict)
            if workers:
                frame = frame.coalesce(workers)
            planned = time.perf_counter()
            rows = [list(r) for r in frame.limit(self.max_rows + 1).collect()]
        except Exception as why:
            with self._lock:
                self.counts["failures"] += 1
            return (400 if isinstance(why, DialectError) or "AnalysisException" in type(why).__name__ or "ParseException" in type(why).__name__ else 500), {"error": str(why)[:2000]}
        ended = time.perf_counter()
        with self._lock:
            self.counts["queries"] += 1
            self.counts["milliseconds"] += 1000 * (ended - began)
        timeline = [[round(1000 * (planned - began), 3), "planned"], [round(1000 * (ended - began), 3), "rows returned"]]
        return 200, {"columns": frame.columns, "rows": rows[: self.max_rows], "cut": len(rows) > self.max_rows, "timeline_ms": timeline}

    def start(self) -> "QueryServer":
        threading.Thread(target=self._http.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self._http.shutdown()
        self._http.server_close()
