"""Retrieval of the points of one series in a time range, and reports over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import floor_div
from tidemark.functions.tags import canonical_tags, tag_match
from tidemark.model import InvalidTimeRange

LARGEST = (1 << 63) - 1


def check_range(start: int, end: int | None) -> None:
    """Ranges are [start, end) with start below end; ``end`` None is without bound."""
    if start < 0 or (end is not None and (end <= start or end > LARGEST)) or start > LARGEST:
        raise InvalidTimeRange(start, end)


def condition(series: str | None = None, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None) -> Column:
    """True for points of the series (any if None) in [start, end) whose tags hold all given pairs."""
    out = F.col("ts") >= F.lit(start)
    if series is not None:
        out = (F.col("series") == F.lit(series)) & out
    if end is not None:
        out = out & (F.col("ts") < F.lit(end))
    match = tag_match("tags", tags)
    return out if match is None else out & match


def restricted(points: DataFrame, series: str | None = None, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    check_range(start, end)
    return points.where(condition(series, start, end, tags))


def select_points(points: DataFrame, series: str, start: int = 0, end: int | None = None, tags: dict[str, str] | None = None, delete_before: int | None = None) -> DataFrame:
    """``ts, value`` of one series in [start, end) whose tags hold all given pairs, as a bag without order.

    Conditions on series and ts reach the scan; so does the choice of columns. Points before ``delete_before`` are hidden.
    """
    check_range(start, end)
    return points.where(condition(series, max(start, delete_before or 0), end, tags)).select("ts", "value")


def series_stats(points: DataFrame, *keys: str) -> DataFrame:
    """Per series (and further keys) ``min_ts, max_ts, n_points, max_seq``."""
    return points.groupBy("series", *keys).agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n_points"), F.max("seq").alias("max_seq")
    )


def list_series(points: DataFrame, tags: dict[str, str] | None = None) -> DataFrame:
    """Names of the series that have a point with all given pairs."""
    match = tag_match("tags", tags)
    return (points if match is None else points.where(match)).select("series").distinct()


def downsample(points: DataFrame, step_ns: int) -> DataFrame:
    """Per series and slot of ``step_ns`` the count, least, greatest and sum of values, and the first and last by (ts, seq)."""
    order = F.struct("ts", "seq")
    return points.groupBy("series", (floor_div(F.col("ts"), step_ns) * step_ns).alias("slot_start")).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("value").alias("total"),
        F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"),
    )


def cardinality(points: DataFrame, scope_col) -> DataFrame:
    """``scope, series_keys``: the exact number of distinct series keys per scope."""
    keys = points.select(scope_col.alias("scope"), "series", canonical_tags("tags").alias("key_tags")).distinct()
    return keys.groupBy("scope").agg(F.count(F.lit(1)).alias("series_keys"))


def rolled(points: DataFrame, before: int, step_ns: int) -> DataFrame:
    """Points from ``before`` on as they are, and for those before it one for each series, tags and slot: the mean, at the slot's start."""
    old = points.where(F.col("ts") < before).withColumn("key_tags", canonical_tags("tags"))
    slot = (floor_div(F.col("ts"), step_ns) * step_ns).alias("ts")
    means = old.groupBy("series", slot, "key_tags").agg(F.max("seq").alias("seq"), F.avg("value").alias("value"))
    means = means.select("series", "ts", "seq", "value", F.map_from_entries("key_tags").alias("tags"))
    return points.where(F.col("ts") >= before).select(*means.columns).unionByName(means)
