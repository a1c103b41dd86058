"""Totals and averages over trailing periods of days, for days without activity too.

Every daily total is exploded onto each date whose trailing period holds it; grouping by entity and date then
gives the totals of all periods at once, and a join with calendar rows adds the dates that no total reaches.
The window of a date is never gathered: a group holds at most ``max(windows)`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions.clean import clean_points, day_of, distinct_points, is_finite


def daily_totals(points: DataFrame) -> DataFrame:
    """``series, day, day_total, day_points`` of the finite values; rows repeated as a whole count once."""
    finite = distinct_points(clean_points(points).where(is_finite(F.col("value"))))
    return finite.groupBy("series", day_of(F.col("ts")).alias("day")).agg(
        F.sum("value").alias("day_total"), F.count(F.lit(1)).alias("day_points")
    )


def rolling_totals(points: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Per series and UTC day from its first to its last day with a finite point, the trailing totals.

    Columns: ``series, day, day_points, prev_active, next_active`` and per window ``w`` of ``windows``
    ``total_{w}d, avg_{w}d, points_{w}d``. The window of a day ends with that day and holds it.
    ``prev_active`` is the latest day with a point up to this one if it is less than ``max(windows)`` days ago,
    ``next_active`` the earliest such day after ``prev_active``.

    Null, NaN and infinite values take no part; a series with none but such has no rows. Rows without series or
    ts are left out. A period without points has total 0, no average (null) and 0 points. Ties, repeated values and
    points sent twice under different ``seq`` all count; rows repeated as a whole count once. An empty table gives
    an empty result. Further columns of the input, whatever their names, are ignored.
    """
    longest = max(windows)
    of_series = Window.partitionBy("series").orderBy("day")
    # staged, since the few rows of the days feed both the totals and the calendar; the points are read once
    daily = storage.staged(daily_totals(points), "daily").select(
        "*",
        F.lead("day").over(of_series).alias("next_day"),
        F.max("day").over(of_series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last_day"),
    )
    reach = daily.withColumn(
        "date", F.explode(F.expr(f"sequence(day, least(date_add(day, {longest - 1}), last_day), interval 1 day)"))
    )
    age = F.datediff("date", "day")
    sums = [
        e
        for w in windows
        for e in (
            F.sum(F.when(age < w, F.col("day_total"))).alias(f"total_{w}d"),
            F.coalesce(F.sum(F.when(age < w, F.col("day_points"))), F.lit(0)).alias(f"points_{w}d"),
        )
    ]
    rolled = reach.groupBy("series", "date").agg(
        F.coalesce(F.max(F.when(age == 0, F.col("day_points"))), F.lit(0)).alias("day_points"),
        F.max("day").alias("prev_active"),
        F.max_by("next_day", "day").alias("next_active"),
        *sums,
    )
    # the two ends of each gap are known to the day before it, so the calendar needs no further pass over the points
    calendar = daily.select(
        "series",
        F.explode(F.expr("sequence(day, coalesce(date_sub(next_day, 1), day), interval 1 day)")).alias("date"),
    )
    out = calendar.join(rolled, ["series", "date"], "left")
    totals = []
    for w in windows:
        total, n = F.coalesce(f"total_{w}d", F.lit(0.0)), F.coalesce(f"points_{w}d", F.lit(0)).cast("long")
        totals += [
            total.alias(f"total_{w}d"),
            F.when(n > 0, total / n).alias(f"avg_{w}d"),
            n.alias(f"points_{w}d"),
        ]
    return out.select(
        "series",
        F.col("date").alias("day"),
        F.coalesce("day_points", F.lit(0)).cast("long").alias("day_points"),
        "prev_active",
        "next_active",
        *totals,
    )


def inactive_days(rolled: DataFrame, max_gap_days: int = 30) -> DataFrame:
    """Days of ``rolling_totals`` without a point between two active days at most ``max_gap_days`` apart.

    ``max_gap_days`` must not be greater than the longest window, since an older active day is not carried.
    """
    return rolled.where(
        (F.col("day_points") == 0) & (F.datediff("next_active", "prev_active") <= max_gap_days)
    ).select("series", F.date_format("day", "yyyy-MM-dd").alias("calendar_day"))
