"""Cleaning of raw points: units of time, finite values, repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NS_PER_SECOND = 1_000_000_000
NS_PER_HOUR = 3600 * NS_PER_SECOND
NS_PER_DAY = 24 * NS_PER_HOUR

# Below each bound a time since 1970 can only be in the coarser unit, as nanoseconds it would
# lie before 1973-03 and in the unit itself after the year 5000.
_UNITS = ((10**11, 10**9), (10**14, 10**6), (10**17, 10**3))


def ts_to_ns(ts: Column) -> Column:
    """Bring a time in s, ms, us or ns since 1970 back to ns; the size of the number tells the unit."""
    out = ts
    for bound, factor in reversed(_UNITS):
        out = F.when(F.abs(ts) < F.lit(bound), ts * F.lit(factor)).otherwise(out)
    return out


def is_finite(value: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    v = F.abs(value)
    return F.coalesce(~F.isnan(value) & (v < F.lit(float("inf"))), F.lit(False))


def floor_div(ts: Column, step: Column | int) -> Column:
    """Floor of ts / step over whole numbers; ``div`` alone rounds towards zero."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.call_function("div", ts - F.pmod(ts, step), step)


def day_of(ts: Column) -> Column:
    """UTC date of a time in ns."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(ts, NS_PER_DAY).cast("int"))


def clean_points(points: DataFrame, *columns: str) -> DataFrame:
    """``series, ts, seq, value`` and further ``columns`` of points that have a series and a time, with ts in ns.

    Rows without series or ts belong to no place in time and are left out. Repeated rows stay; see
    ``distinct_points``.
    """
    return points.where(F.col("series").isNotNull() & F.col("ts").isNotNull()).select(
        "series", ts_to_ns(F.col("ts")).alias("ts"), "seq", "value", *columns
    )


def distinct_points(points: DataFrame) -> DataFrame:
    """Count a row repeated as a whole once. ``seq`` identifies a point, so the key of the shuffle is spread evenly."""
    return points.select("series", "ts", "seq", "value").distinct()
