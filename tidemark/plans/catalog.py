"""The manifest: which segments are live, the retention watermark, and what has been committed.

Versions are files of JSON named by number. A commit writes the next version under a temporary name and renames it; the rename
fails if another writer has taken the number, and the commit is then an error. Readers take the highest
version and keep it, so they see one state whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import SparkSession

from tidemark import storage
from tidemark.model import Corruption, EngineError


@dataclass(frozen=True)
class Segment:
    segment_id: int
    level: int
    created_ns: int
    path: str
    rows: int
    bytes: int
    min_ts: int
    max_ts: int
    max_seq: int
    first_series: str
    last_series: str
    indexed: bool  #: whether its index has tag pairs
    promoted: tuple[str, ...]  #: tags with a column of their own

    def may_hold(self, series: str, start: int, end: int | None) -> bool:
        """Whether, by its bounds, it can hold points of a series in [start, end)."""
        return self.first_series <= series <= self.last_series and self.max_ts >= start and (end is None or self.min_ts < end)


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    next_segment_id: int = 1
    next_seq: int = 0
    log_floor: int | None = None  #: logged points below this number are in segments; None before the first flush
    delete_before: int | None = None
    segments: tuple[Segment, ...] = ()
    obsolete: tuple[tuple[str, int], ...] = ()  #: (path, time of removal in ns), still to be deleted
    batches: dict = field(default_factory=dict)  #: last committed batch number of each stream

    @property
    def max_persisted_seq(self) -> int:
        """Greatest number in a live segment, -1 if there is none."""
        return max((s.max_seq for s in self.segments), default=-1)

    @property
    def replay_from(self) -> int:
        """The number from which on points of the log are not yet in a segment."""
        return max(self.max_persisted_seq + 1, self.next_seq) if self.log_floor is None else self.log_floor


class ConcurrentWrite(EngineError):
    """Another writer has committed first; there must be one writer at a time."""


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _, _ in storage.listing(self.spark, self.path)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def load(self) -> Manifest:
        """The latest version; an empty manifest if there is none. A damaged one is an error."""
        versions = self._versions()
        if not versions:
            return Manifest()
        name = f"{self.path}/v{versions[-1]:012d}.json"
        fs, p = storage.hadoop_path(self.spark, name)
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(p)
        try:
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            crc, body = text.split("\n", 1)
            if int(crc) != zlib.crc32(body.encode()):
                raise ValueError("checksum differs")
            d = json.loads(body)
        except ValueError as e:
            raise Corruption(f"manifest {name}: {e}") from None
        d["segments"] = tuple(Segment(**{**s, "promoted": tuple(s["promoted"])}) for s in d["segments"])
        d["obsolete"] = tuple((a, b) for a, b in d["obsolete"])
        return Manifest(**d)

    def commit(self, new: Manifest) -> Manifest:
        """Publish the successor of ``new.version``."""
        new = replace(new, version=new.version + 1)
        body = json.dumps(asdict(new))
        name, temporary = f"{self.path}/v{new.version:012d}.json", f"{self.path}/.v{new.version:012d}.open"
        fs, p = storage.hadoop_path(self.spark, temporary)
        out = fs.create(p, True)
        try:
            out.write(bytearray(f"{zlib.crc32(body.encode())}\n{body}".encode()))
        finally:
            out.close()
        target = storage.hadoop_path(self.spark, name)[1]
        if fs.exists(target) or not fs.rename(p, target):
            raise ConcurrentWrite(f"version {new.version} exists")
        for old in self._versions()[:-8]:
            storage.delete(self.spark, f"{self.path}/v{old:012d}.json")
        return new
