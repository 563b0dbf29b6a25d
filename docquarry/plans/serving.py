"""The completion service over a saved index of one file, on the standard library's HTTP server."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

from docquarry.operators.service import INTERNAL, LIMITED, accept, complete

Retrieve = Callable[[str, int], list[dict]]
Generate = Callable[[str, str], str]
SERVICE = {"service": "docquarry", "protocol_version": "1.0", "model_type": "retrieval", "capabilities": ["query", "health"]}


class Service:
    """Routes of the service: (method, path, body) -> (status, JSON value).

    Requests beyond ``limit`` in ``window`` seconds get 429, invalid ones 400, failures of retrieval or generation 500.
    ``log`` gets one dict a completion.
    """

    def __init__(
        self, retrieve: Retrieve, generate: Generate | None = None, limit: int = 5, window: float = 1.0,
        log: Callable[[dict], None] | None = None, clock: Callable[[], float] = time.monotonic,
    ):
        self.retrieve, self.generate, self.limit, self.window, self.log, self.clock = retrieve, generate, limit, window, log, clock
        self._held: list[float] = []

    def answer(self, method: str, path: str, body: str = "") -> tuple[int, dict]:
        if (method, path) == ("GET", "/health"):
            return 200, {"status": "ok"}
        if (method, path) == ("GET", "/v1/models"):
            return 200, SERVICE
        if (method, path) != ("POST", "/v1/completions"):
            return 404, {"error": {"code": 404, "message": "Not found"}}
        (free,), self._held = accept([self.clock()], self.limit, self.window, self._held)
        if not free:
            return 429, {"error": {"code": LIMITED, "message": "Rate limit exceeded"}}
        began = self.clock()
        try:
            found = complete(body or "{}", self.retrieve, self.generate)
            status = 400 if "error" in found else 200
        except Exception:
            found, status = {"error": {"code": INTERNAL, "message": "Internal processing error"}}, 500
        if self.log:
            self.log({"path": path, "status": status, "latency_ms": round(1000 * (self.clock() - began), 3)})
        return status, found


def serve(service: Service, host: str = "127.0.0.1", port: int = 8080) -> HTTPServer:
    """An HTTP server for ``service``, one request at a time; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            status, value = service.answer(self.command, self.path, body)
            data = json.dumps(value, ensure_ascii=False).encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _reply

        def log_message(self, *_args) -> None:
            pass

    return HTTPServer((host, port), Handler)
