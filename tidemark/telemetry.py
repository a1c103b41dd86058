"""Counters and timings of an engine, and their text form for scraping."""

from __future__ import annotations

import threading
from collections import defaultdict

PREFIX = "tidemark"


class Metrics:
    """Counters, gauges (with labels) and timings by name; safe for use from several threads."""

    def __init__(self):
        self._lock = threading.Lock()
        self.counters: dict[str, float] = defaultdict(float)
        self.gauges: dict[tuple[str, tuple], float] = {}
        self.timings: dict[str, list[float]] = defaultdict(lambda: [0, 0.0])

    def count(self, name: str, by: float = 1) -> None:
        with self._lock:
            self.counters[name] += by

    def gauge(self, name: str, value: float, **labels: str) -> None:
        with self._lock:
            self.gauges[name, tuple(sorted(labels.items()))] = value

    def add_gauge(self, name: str, by: float, **labels: str) -> None:
        with self._lock:
            key = (name, tuple(sorted(labels.items())))
            self.gauges[key] = self.gauges.get(key, 0.0) + by

    def time(self, name: str, seconds: float) -> None:
        with self._lock:
            t = self.timings[name]
            t[0] += 1
            t[1] += seconds

    def snapshot(self) -> dict:
        with self._lock:
            gauges = {n + "".join(f"{{{k}={v}}}" for k, v in ls): x for (n, ls), x in self.gauges.items()}
            return {"counters": dict(self.counters), "gauges": gauges, "timings": {k: tuple(v) for k, v in self.timings.items()}}

    def render(self) -> str:
        """Prometheus text."""
        with self._lock:
            lines = [f"{PREFIX}_{n}_total {v:g}" for n, v in sorted(self.counters.items())]
            for (n, labels), v in sorted(self.gauges.items()):
                inner = ",".join(f'{k}="{x}"' for k, x in labels)
                lines.append(f"{PREFIX}_{n}{{{inner}}} {v:g}" if inner else f"{PREFIX}_{n} {v:g}")
            for n, (k, s) in sorted(self.timings.items()):
                lines += [f"{PREFIX}_{n}_count {k}", f"{PREFIX}_{n}_sum {s:g}"]
        return "\n".join(lines) + "\n"
