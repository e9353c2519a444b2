"""Requests over a socket, one JSON object a line, answered one a line by handle_request(); and the client for it.

The Spark session stays up between requests, which is what a resident process is for. Tables are opened once by path.
"""

from __future__ import annotations

import json
import socket
import socketserver
import threading
from typing import Any

from pyspark.sql import SparkSession

from .service import handle_request
from .sources.table import Table

MOST_AT_ONCE = 50  # requests that run at the same time; others wait
IDLE_SECONDS = 30  # after which a silent connection is closed
MOST_BYTES = 16 << 20  # of one request


class Daemon(socketserver.ThreadingTCPServer):
    allow_reuse_address = daemon_threads = True

    def __init__(self, spark: SparkSession, host: str = "127.0.0.1", port: int = 0, kind: str = "csv"):
        super().__init__((host, port), _Connection)
        self.spark, self.kind = spark, kind
        self.tables: dict[tuple[str, str], Table] = {}
        self.opening, self.room = threading.Lock(), threading.BoundedSemaphore(MOST_AT_ONCE)

    def table(self, path: str, separator: str) -> Table:
        with self.opening:
            if (found := self.tables.get((path, separator))) is None:
                found = self.tables[path, separator] = Table(self.spark, path, self.kind, separator)
            return found

    def answer(self, line: bytes) -> dict[str, Any]:
        try:
            request = json.loads(line)
            if request.get("action") == "ping":
                return {"success": True, "pong": True}
            with self.room:
                return handle_request(self.table(request["csv"], request.get("separator") or ","), request)
        except Exception as e:  # the answer to any failure is a message
            return {"success": False, "error": f"{type(e).__name__}: {e}".splitlines()[0]}

    def start(self) -> tuple[str, int]:
        """Serves in a thread of its own; returns the address."""
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self.server_address


class _Connection(socketserver.StreamRequestHandler):
    timeout = IDLE_SECONDS

    def handle(self) -> None:
        try:
            while line := self.rfile.readline(MOST_BYTES):
                answer = self.server.answer(line) if line.strip() else None
                if answer is not None:
                    self.wfile.write(json.dumps(answer, default=str).encode() + b"\n")
        except (TimeoutError, ConnectionError):
            return


class Client:
    """Asks a daemon; a connection that was lost is made anew once."""

    def __init__(self, host: str, port: int, seconds: float = 600):
        self.address, self.seconds, self.stream = (host, port), seconds, None

    def _open(self) -> None:
        self.close()
        self.socket = socket.create_connection(self.address, self.seconds)
        self.stream = self.socket.makefile("rwb")

    def _ask(self, line: bytes) -> bytes:
        if self.stream is None:
            self._open()
        self.stream.write(line)
        self.stream.flush()
        if not (answer := self.stream.readline()):
            raise ConnectionError("the daemon closed the connection")
        return answer

    def ask(self, **request: Any) -> dict[str, Any]:
        line = json.dumps(request).encode() + b"\n"
        try:
            answer = self._ask(line)
        except (ConnectionError, BrokenPipeError):
            self._open()
            answer = self._ask(line)
        return json.loads(answer)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.socket.close()
            self.stream = None
