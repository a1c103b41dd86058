"""Namespaces: one store per tenant below one folder, with nothing shared between them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

from tidemark import storage
from tidemark.engine import Engine
from tidemark.model import ConfigError, EngineConfig


def folder_of(tenant: str) -> str:
    """A folder name for any name of a tenant, from which ``tenant_of`` gets it back; names of folders need not tell capitals apart."""
    if not tenant:
        raise ConfigError("a tenant needs a name")
    return "t-" + "".join(c if c.isascii() and (c.islower() or c.isdigit()) else quote(c, safe="") if quote(c, safe="") != c else f"%{ord(c):02X}" for c in tenant)


def tenant_of(folder: str) -> str:
    return unquote(folder.removeprefix("t-"))


class Tenants:
    """The stores of the tenants in ``path``. A store is opened when it is first asked for; limits and settings hold for each."""

    def __init__(self, spark: SparkSession, path: str, config: EngineConfig | None = None, clock: Callable[[], int] = time.time_ns):
        self.spark, self.path, self.config, self.clock = spark, path.rstrip("/"), config or EngineConfig(), clock
        self._open: dict[str, Engine] = {}
        self._lock = threading.Lock()

    def names(self) -> list[str]:
        """Tenants that have a folder."""
        return sorted(tenant_of(p.rsplit("/", 1)[1]) for p, _, folder in storage.listing(self.spark, self.path) if folder and p.rsplit("/", 1)[1].startswith("t-"))

    def engine(self, tenant: str) -> Engine:
        with self._lock:
            if tenant not in self._open:
                self._open[tenant] = Engine(self.spark, f"{self.path}/{folder_of(tenant)}", self.config, self.clock)
            return self._open[tenant]

    def close(self) -> None:
        with self._lock:
            for e in self._open.values():
                e.close()
            self._open.clear()
