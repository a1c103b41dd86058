"""Data model, settings and errors of the engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

#: The one schema of points; the order of the fields is that of the files.
POINTS = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("ts", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.DoubleType(), False),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType(), False), False),
    ]
)
#: What callers hand in: points without a number of arrival.
NEW_POINTS = T.StructType([f for f in POINTS.fields if f.name != "seq"])
DEFAULT_SCOPE = "default"


class EngineError(Exception):
    """Base of all errors that the engine raises."""


class SeriesNotFound(EngineError):
    def __init__(self, series: str):
        super().__init__(f"no segment has a series {series!r}")
        self.series = series


class InvalidTimeRange(EngineError):
    """A range [start, end) that holds nothing, or a bound out of the domain of ts."""

    def __init__(self, start: int, end: int | None):
        super().__init__(f"the range from {start} up to {end} is empty or out of bounds")
        self.start, self.end = start, end


class ConfigError(EngineError):
    pass


class Corruption(EngineError):
    def __init__(self, details: str, series: str | None = None, timestamp: int | None = None):
        where = "" if series is None else f" (first point there: series {series!r}, ts {timestamp})"
        super().__init__(f"damaged data: {details}{where}")
        self.details, self.series, self.timestamp = details, series, timestamp


class CardinalityLimitExceeded(EngineError):
    def __init__(self, current: int, limit: int, scope: str):
        super().__init__(f"scope {scope!r} has {current} of {limit} series; the batch would add more")
        self.current, self.limit, self.scope = current, limit, scope


@dataclass
class Encoding:
    """How new segments are written.

    ``float_encoding`` is ``raw64`` (Parquet v1 pages) or ``gorillaxor`` (v2 pages with delta-packed times; values round-trip
    alike). ``tag_encoding`` is always ``dictionary``. ``compression`` is ``none``, ``lz4`` or ``zstd`` with ``level``.
    """

    float_encoding: str = "raw64"
    tag_encoding: str = "dictionary"
    compression: str = "none"
    level: int = 3

    def options(self) -> dict[str, str]:
        """Options of the Parquet writer."""
        codecs = {"none": "none", "lz4": "lz4_raw", "zstd": "zstd"}
        if self.compression not in codecs or self.float_encoding not in ("raw64", "gorillaxor") or self.tag_encoding != "dictionary":
            raise ConfigError(f"unknown encoding: {self}")
        out = {"compression": codecs[self.compression], "parquet.enable.dictionary": "true"}
        if self.compression == "zstd":
            out["parquet.compression.codec.zstd.level"] = str(self.level)
        if self.float_encoding == "gorillaxor":
            out["parquet.writer.version"] = "v2"
        return out


# Names and defaults of the settings of these two classes, which are the public interface.


@dataclass
class SegmentConfig:
    compaction_check_interval_s: float = 1.0
    l0_compaction_trigger_segment_count: int = 4
    l0_compaction_trigger_total_bytes: int | None = None
    l0_compaction_trigger_max_age_s: float | None = None
    enable_tag_index: bool = True
    #: tags that new segments give a column of their own, so that conditions on them skip row groups and pages
    promoted_tags: tuple[str, ...] = ()
    encoding: Encoding = field(default_factory=Encoding)
    #: bytes of input that one task of a segment write takes
    target_file_bytes: int = 256 << 20
    #: seconds between the removal of files from the manifest and their deletion; queries built before must have ended
    reap_grace_s: float = 3600.0


@dataclass
class EngineConfig:
    flush_interval_s: float = 1.0
    wal_buffer_size: int = 1000
    enable_wal: bool = True
    enable_snapshots: bool = True
    snapshot_interval_s: float = 900.0
    enable_segments: bool = True
    segment_store: SegmentConfig = field(default_factory=SegmentConfig)
    retention_ttl_s: float | None = None
    retention_check_interval_s: float = 1.0
    max_series_cardinality: int | None = None
    cardinality_scope_tag_key: str | None = None
    event_listener: Callable[[str, dict], None] = lambda name, fields: None
