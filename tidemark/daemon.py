"""An engine as a service that others watch: ``/healthz`` says that it runs, ``/readyz`` that it is open, ``/metrics`` its counters.

Run ``python -m tidemark.daemon --data-dir DIR [--config FILE] [--set NAME=VALUE ...] [--http-bind HOST:PORT]``. With ``--validate-config``
it only tells whether the settings hold and ends, with 0 if they do and 2 if not. SIGTERM and SIGINT end it after a last
flush, for which it waits ``STOP_SECONDS`` at most; what is not flushed by then is in the log.
"""

from __future__ import annotations

import argparse
import os
import signal
import sys
import tempfile
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from tidemark.config import load
from tidemark.engine import Engine
from tidemark.model import ConfigError


def check_writable(folder: str) -> None:
    """Fail at the start rather than at the first flush."""
    try:
        os.makedirs(folder, exist_ok=True)
        with tempfile.TemporaryFile(dir=folder):
            pass
    except OSError as e:
        raise ConfigError(f"{folder} is not writable: {e}") from None


STOP_SECONDS = 30.0


def nested(assignments: list[str]) -> dict:
    """``a.b=c`` settings as they would stand in a file."""
    out: dict = {}
    for a in assignments:
        name, eq, value = a.partition("=")
        if not eq or not name:
            raise ConfigError(f"not a setting: {a!r}")
        at = out
        *path, last = name.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


class Service:
    """The health endpoints and the engine they tell of."""

    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 8080):
        self.engine, self.ready = engine, False
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                status, body = service.answer(self.path)
                self.send_response(status)
                self.send_header("Content-Type", "text/plain; charset=utf-8")
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *args) -> None:
                pass

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)

    @property
    def port(self) -> int:
        return self.http.server_address[1]

    def answer(self, path: str) -> tuple[int, str]:
        if path == "/healthz":
            return 200, "ok\n"
        if path == "/readyz":
            return (200, "ready\n") if self.ready else (503, "not ready\n")
        if path == "/metrics":
            return 200, self.engine.metrics.render()
        return 404, "not found\n"

    def start(self) -> None:
        self.thread.start()
        self.engine.recover()
        self.engine.start()
        self.ready = True

    def stop(self) -> None:
        self.ready = False
        self.engine.close(STOP_SECONDS)
        self.http.shutdown()
        self.http.server_close()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--data-dir")
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="a setting over those of file and environment, such as segment_store.enable_tag_index=false")
    p.add_argument("--validate-config", action="store_true")
    p.add_argument("--http-bind", default="127.0.0.1:8080")
    a = p.parse_args(argv)
    host, _, port = a.http_bind.rpartition(":")
    try:
        config = load(a.config, **nested(a.set))
        config.segment_store.encoding.options()
        if not port.isdigit():
            raise ConfigError(f"not an address: {a.http_bind!r}")
    except ConfigError as e:
        print(f"settings refused: {e}", file=sys.stderr)
        raise SystemExit(2) from None
    if a.validate_config:
        print("settings hold")
        return
    if a.data_dir is None:
        p.error("--data-dir is needed")
    if "://" not in a.data_dir:
        check_writable(a.data_dir)
    path = a.data_dir if "://" in a.data_dir else "file://" + os.path.abspath(a.data_dir)
    service = Service(Engine(SparkSession.builder.appName("tidemark").getOrCreate(), path, config), host, int(port))
    end = threading.Event()
    for s in (signal.SIGTERM, signal.SIGINT):
        signal.signal(s, lambda *_: end.set())
    service.start()
    end.wait()
    service.stop()


if __name__ == "__main__":
    main()
