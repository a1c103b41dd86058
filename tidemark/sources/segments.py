"""Immutable segments: a folder with the points and an index of what they hold.

Points are cut by range of (series, ts, seq) and sorted, so a hot series spreads over many files, every file and row
group holds few series and a short time, and conditions on series and ts skip the rest by Parquet statistics. ``index`` has a
row per series (the zone map, ``k`` null) and, with the tag index on, one per series and tag pair (the postings), each with
bounds of time and sequence. Tags that the settings promote have a column of their own with Parquet's dictionaries and Bloom
filters, so a condition on them skips row groups and pages; a condition on the map alone reads every row of the series.

A write is one pass over the points; what the manifest must know is observed on the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import storage
from tidemark.model import POINTS, Corruption, SegmentConfig
from tidemark.plans.catalog import Segment

EXPANSION = 8  #: at most about what a compressed file grows by in memory
ROW_BYTES = 64  #: about what a point takes in memory, to choose the number of files


def promoted_column(tag: str) -> str:
    """Name of the column of a promoted tag; names of columns do not tell capitals apart, so these are spelled out."""
    return "tag_" + re.sub(r"[^a-z0-9]", lambda m: f"_{ord(m.group(0)):x}_", tag)


def index_of(points: DataFrame, with_pairs: bool) -> DataFrame:
    """``series, k, v, min_ts, max_ts, n_points, max_seq``: per series (``k`` null) and, if wanted, per series and tag pair."""
    whole = F.array(F.struct(F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v")))
    if with_pairs:
        whole = F.concat(whole, F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    rows = points.select("series", "ts", "seq", F.explode(whole).alias("e")).select("series", "ts", "seq", "e.k", "e.v")
    return rows.groupBy("series", "k", "v").agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("n_points"), F.max("seq").alias("max_seq")
    )


def write(
    points: DataFrame, root: str, segment_id: int, level: int, now_ns: int, config: SegmentConfig, delete_before: int | None = None, rows: int | None = None
) -> Segment | None:
    """Write the points that are not before ``delete_before``; None, and no folder, if there are none.

    ``rows`` is their number, or a bound of it, from which the number of files is chosen; without it they are counted, unless the
    optimizer knows that they fit into one file.
    """
    spark = points.sparkSession
    kept = points.select(*POINTS.names)
    if delete_before is not None:
        kept = kept.where(F.col("ts") >= F.lit(delete_before))
    if rows is None:
        most = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        rows = 0 if most * EXPANSION <= config.target_file_bytes else kept.count()
    files = max(1, -(-rows * ROW_BYTES // config.target_file_bytes))
    temporary, path = f"{root}/.open-{segment_id}", f"{root}/seg-{segment_id:010d}-l{level}"
    storage.delete(spark, temporary)
    options = config.encoding.options()
    for tag in config.promoted_tags:
        kept = kept.withColumn(promoted_column(tag), F.try_element_at("tags", F.lit(tag)))
        options[f"parquet.bloom.filter.enabled#{promoted_column(tag)}"] = "true"
        options["parquet.bloom.filter.adaptive.enabled"] = "true"
    ordered = kept.repartitionByRange(files, "series", "ts", "seq") if files > 1 else kept.coalesce(1)
    seen = Observation()
    ordered = ordered.sortWithinPartitions("series", "ts", "seq").observe(
        seen, F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"), F.max("seq").alias("seq"),
        F.min("series").alias("first"), F.max("series").alias("last"),
    )
    ordered.write.options(**options).parquet(f"{temporary}/points")
    s = seen.get
    if not s["n"]:
        storage.delete(spark, temporary)
        return None
    read_back = Observation()
    index = index_of(read(spark, [f"{temporary}/points"]), config.enable_tag_index)
    index = index.observe(read_back, F.sum(F.when(F.col("k").isNull(), F.col("n_points"))).alias("n"))
    index.sortWithinPartitions("series", "k", "v").write.parquet(f"{temporary}/index")
    if read_back.get["n"] != s["n"]:
        raise Corruption(f"segment {segment_id}: wrote {s['n']} points and read {read_back.get['n']}")
    storage.rename(spark, temporary, path)
    return Segment(
        segment_id, level, now_ns, path, s["n"], size(spark, path), s["low"], s["high"], s["seq"], s["first"], s["last"],
        config.enable_tag_index, tuple(config.promoted_tags),
    )


def size(spark: SparkSession, path: str) -> int:
    fs, p = storage.hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def read(spark: SparkSession, paths: list[str], promoted: Iterable[str] = ()) -> DataFrame:
    """Points of files as one bag: equal points of several segments are all kept. Page checksums are verified."""
    schema = T.StructType([*POINTS.fields, *(T.StructField(promoted_column(t), T.StringType()) for t in promoted)])
    return spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths) if paths else spark.createDataFrame([], schema)


def points_of(spark: SparkSession, segments: list[Segment]) -> DataFrame:
    return read(spark, [f"{s.path}/points" for s in segments])


def matching(spark: SparkSession, segments: list[Segment], pairs: dict[str, str] | None) -> DataFrame:
    """Points of segments, without those that a promoted tag shows not to hold a pair; others may still be there.

    Segments are read together by the tags that they have promoted, which differ only after the settings have changed.
    """
    groups: dict[tuple[str, ...], list[Segment]] = {}
    for s in segments:
        groups.setdefault(tuple(t for t in sorted(pairs or {}) if t in s.promoted), []).append(s)
    parts = []
    for tags, members in groups.items():
        condition: Column | None = None
        for t in tags:
            c = F.col(promoted_column(t)) == F.lit(pairs[t])
            condition = c if condition is None else condition & c
        rows = read(spark, [f"{s.path}/points" for s in members], tags)
        parts.append((rows if condition is None else rows.where(condition)).select(*POINTS.names))
    out = parts[0] if parts else read(spark, [])
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(spark: SparkSession, segments: list[Segment]) -> None:
    """Every live segment must be there with its parts; what is missing is an error at once, not at the first query."""

    def whole(s: Segment) -> bool:
        return storage.exists(spark, f"{s.path}/points/_SUCCESS") and storage.exists(spark, f"{s.path}/index/_SUCCESS")

    with ThreadPoolExecutor(16) as pool:
        for s, ok in zip(segments, pool.map(whole, segments)):
            if not ok:
                raise Corruption(f"segment {s.segment_id} at {s.path} is not complete")
