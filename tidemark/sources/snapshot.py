"""Snapshots: all visible points at one time, in one folder named by that time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark import storage
from tidemark.model import POINTS
from tidemark.sources import segments


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def times(self) -> list[int]:
        names = [p.rsplit("/", 1)[1] for p, _, folder in storage.listing(self.spark, self.path) if folder]
        return sorted(int(n[9:]) for n in names if n.startswith("snapshot-"))

    def create(self, points: DataFrame, now_ns: int) -> str:
        """Sorted by series and time; a folder that is not complete is never seen under its name."""
        temporary, path = f"{self.path}/.open-{now_ns}", f"{self.path}/snapshot-{now_ns:019d}"
        points.select(*POINTS.names).repartitionByRange("series", "ts", "seq").sortWithinPartitions("series", "ts", "seq").write.parquet(temporary)
        storage.rename(self.spark, temporary, path)
        return path

    def latest(self) -> DataFrame | None:
        """Points of the newest snapshot, None if there is none."""
        path = self.latest_path()
        return segments.read(self.spark, [path]) if path else None

    def latest_path(self) -> str | None:
        times = self.times()
        return f"{self.path}/snapshot-{times[-1]:019d}" if times else None
