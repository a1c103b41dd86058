"""Irregular readings onto a regular grid of slots.

Readings are first reduced to one row per series and slot. The slots of a series are cut into time shards of a
fixed number of slots, so no task ever holds more than that of one series, however many readings the series has.
Each shard is summed up by its first and its last reading; a prefix scan over these summaries (first within
blocks of shards, then over the blocks) carries the state across the borders; then all shards are filled
independently of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.clean import clean_points, floor_div, is_finite

SHARD_SLOTS = 4096  #: slots of one series in a shard
BLOCK_SHARDS = 4096  #: shards of one series in a block of the scan


def steps(catalog: DataFrame) -> DataFrame:
    """``series, step`` (ns) of a catalog; of a series listed more than once the smallest step holds."""
    return (
        catalog.where(F.col("series").isNotNull() & (F.col("step_ms") > 0))
        .groupBy("series")
        .agg((F.min("step_ms") * F.lit(1_000_000)).alias("step"))
    )


def slot_readings(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per series and slot with a finite reading: ``series, slot, first_ts, last_ts, last_value``.

    All aggregates are unchanged by repeated rows, so none has to be removed, and each is combined before the
    shuffle: what a hot series sends is one row per slot and task.
    """
    readings = clean_points(points).where(is_finite(F.col("value"))).join(steps(catalog), "series")
    order = F.struct("ts", F.coalesce("seq", F.lit(-(2**63))), "value")
    return (
        readings.groupBy("series", floor_div(F.col("ts"), F.col("step")).alias("slot"))
        .agg(F.min("ts").alias("first_ts"), F.max(order).alias("last"))
        .select("series", "slot", "first_ts", F.col("last.ts").alias("last_ts"), F.col("last.value").alias("last_value"))
    )


def _carried(summary: DataFrame) -> DataFrame:
    """Prefix scan over shard summaries in two levels: ``before`` and ``after``, the readings on both sides of a shard."""
    s = summary.withColumn("block", floor_div(F.col("shard"), BLOCK_SHARDS))
    inside = Window.partitionBy("series", "block").orderBy("shard")
    s = s.withColumns({"before": F.lag("tail").over(inside), "after": F.lead("head").over(inside)})
    blocks = summary.withColumn("block", floor_div(F.col("shard"), BLOCK_SHARDS)).groupBy("series", "block").agg(
        F.min_by("head", "shard").alias("block_head"), F.max_by("tail", "shard").alias("block_tail")
    )
    over = Window.partitionBy("series").orderBy("block")
    blocks = blocks.select(
        "series", "block", F.lag("block_tail").over(over).alias("block_before"), F.lead("block_head").over(over).alias("block_after")
    )
    return s.join(blocks, ["series", "block"]).select(
        "series",
        "shard",
        F.coalesce("before", "block_before").alias("before"),
        F.coalesce("after", "block_after").alias("after"),
    )


def regular_grid(points: DataFrame, catalog: DataFrame, max_gap_days: int | None = None) -> DataFrame:
    """A row for every slot of every series from its first to its last finite reading.

    Columns: ``series, slot_start`` (ns), ``state`` (``observed`` or ``missing``), ``value`` (the last finite reading
    of the slot; null where missing), ``carried`` (``value``, or where missing the last reading before), ``prev_ts``
    and ``next_ts`` (the readings on both sides of a missing slot, else the slot's last reading).
    Slot k of a series covers [k * step, (k + 1) * step) with k counted from 1970. With ``max_gap_days``, slots between two
    readings further apart than that are left out.

    Readings of equal time in a slot: the greatest ``seq``, then the greatest value. Null, NaN and infinite
    values are no readings. Rows without series or ts, and series without a positive step in the
    catalog, have no grid and are left out. Empty tables give an empty result. Further columns are ignored.
    """
    # staged, since the rows feed both the summaries and the fill
    rows = storage.staged(slot_readings(points, catalog).withColumn("shard", floor_div(F.col("slot"), SHARD_SLOTS)), "slots")
    reading = F.struct("slot", "first_ts", "last_ts", "last_value")
    summary = rows.groupBy("series", "shard").agg(F.min(reading).alias("head"), F.max(reading).alias("tail"))
    carried = _carried(storage.staged(summary, "shards")).select(
        "series", "shard", F.col("after.slot").alias("after_slot"), F.col("after.first_ts").alias("after_ts")
    )
    inside = Window.partitionBy("series", "shard").orderBy("slot")
    rows = rows.join(carried, ["series", "shard"]).select(
        "series", F.col("slot").alias("from_slot"), "last_ts", "last_value",
        F.coalesce(F.lead("slot").over(inside), F.col("after_slot")).alias("next_slot"),
        F.coalesce(F.lead("first_ts").over(inside), F.col("after_ts")).alias("next_ts"),
    )
    rows = rows.join(steps(catalog), "series")
    near = F.lit(True) if max_gap_days is None else F.col("next_ts") - F.col("last_ts") <= F.lit(max_gap_days * 86400 * 10**9)
    until = F.when(near, F.col("next_slot") - 1).otherwise(F.col("from_slot"))
    rows = rows.withColumn("until", F.coalesce(until, F.col("from_slot")))
    # a reading fills its own slot and the gap after it; gaps are cut at the borders of the shards, so that no array holds
    # more slots than a shard
    first, last = floor_div(F.col("from_slot"), SHARD_SLOTS), floor_div(F.col("until"), SHARD_SLOTS)
    pieces = rows.withColumn("shard", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("from_slot"), F.col("shard") * SHARD_SLOTS)
    hi = F.least(F.col("until"), F.col("shard") * SHARD_SLOTS + (SHARD_SLOTS - 1))
    slots = pieces.withColumn("slot", F.explode(F.sequence(lo, hi)))
    seen = F.col("slot") == F.col("from_slot")
    return slots.select(
        "series",
        (F.col("slot") * F.col("step")).alias("slot_start"),
        F.when(seen, "observed").otherwise("missing").alias("state"),
        F.when(seen, F.col("last_value")).alias("value"),
        F.col("last_value").alias("carried"),
        F.col("last_ts").alias("prev_ts"),
        F.when(seen, F.col("last_ts")).otherwise(F.col("next_ts")).alias("next_ts"),
    )


def missing_slots(grid: DataFrame, max_gap_days: int = 30) -> DataFrame:
    """Missing slots of a grid between two readings at most ``max_gap_days`` apart."""
    return grid.where(
        (F.col("state") == "missing") & (F.col("next_ts") - F.col("prev_ts") <= F.lit(max_gap_days * 86400 * 10**9))
    ).select("series", "slot_start")
